"""A replica that lacks a record, has one more, and one that is damaged: moved records are told from damaged ones."""

from lorekeep.llm import warc_fixity


def test_shifted_records(spark):
    rows = [(i, f"u{i}", f"page {i} " * (1 + i % 5)) for i in range(1, 600)]
    there = [r for r in rows if r[0] != 11]  # lost
    there = [(i, u, h + "!!" if i == 300 else h.replace("page 40 ", "qage 40 ", 1) if i == 40 else h) for i, u, h in there] + [(400, "v400", "new")]
    frame = lambda x: spark.createDataFrame(x, "page_id long, url string, html string")
    got = warc_fixity.fixity_report(frame(rows), frame(there)).collect()
    mine = [r for r in got if r["length"] and not (r["page_id"] == 400 and not r["intact"])]
    assert sorted(r["page_id"] for r in mine) == [i for i, *_ in rows]
    assert sorted(r["page_id"] for r in got if not r["intact"] and r["page_id"] != 400) == [11, 40, 300]
    shifted = {r["page_id"] for r in got if r["moved"]}
    assert {12, 255, 301, 511} <= shifted and not shifted & {1, 10, 256, 299, 512, 599}


def test_sides_of_one_file(spark):
    frame = lambda x: spark.createDataFrame(x, "page_id long, url string, html string")
    one = frame([(1, "a", "x"), (2, "b", "y")])
    assert all(r["intact"] and not r["moved"] for r in warc_fixity.fixity_report(one, one).collect())
    assert {(r["page_id"], r["intact"]) for r in warc_fixity.fixity_report(one, one.limit(0)).collect()} == {(1, False), (2, False)}
    assert {(r["page_id"], r["intact"]) for r in warc_fixity.fixity_report(one.limit(0), one).collect()} == {(1, False), (2, False)}
