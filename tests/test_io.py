"""Sources, sinks and streams on small files."""

import pytest
from pyspark.sql import functions as F

from lorekeep.sources import readers, sinks
from lorekeep.streaming import exchange


def test_markdown(spark, tmp_path):
    (tmp_path / "one.md").write_text("---\nname: First\ndescription: what it is\ntype: user\n---\n# Title\nbody [[two]]\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "two.md").write_text("# Second title\nbody")
    (tmp_path / "not.txt").write_text("no")
    got = {r["name"]: r for r in readers.markdown(spark, str(tmp_path)).collect()}
    assert set(got) == {"First", "two"}
    assert (got["First"]["description"], got["First"]["type"]) == ("what it is", "user") and got["First"]["text"].startswith("# Title")
    assert (got["two"]["description"], got["two"]["type"]) == ("Second title", "reference")


def test_transcripts(spark, tmp_path):
    lines = ['{"sessionId": "s", "message": {"role": "user", "content": "hello"}}', "not json", '{"sessionId": "s", "message": {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "tool", "text": "x"}, {"type": "text", "text": "b"}]}}', '{"type": "summary"}']
    (tmp_path / "t.jsonl").write_text("\n".join(lines))
    got = sorted((r["role"], r["text"]) for r in readers.transcripts(spark, str(tmp_path)).collect())
    assert got == [("assistant", "a\nb"), ("user", "hello")]


def test_payloads(spark):
    good = '{"session_id": "s", "assertions": [{"subject": "a", "predicate": "p", "object": "o", "confidence": 9}], "edges": []}'
    bad = '{"assertions": [{"subject": "a", "confidence": 11}], "edges": [{"from_entity": "x"}]}'
    got = [r["errors"] for r in readers.payloads(spark.createDataFrame([(0, good), (1, bad), (2, "junk")], "i int, value string")).orderBy("i").collect()]
    assert got[0] == [] and len(got[1]) == 4 and got[2]


def test_catalogue(spark):
    df = spark.range(1).select("id", F.lit("x").alias("name"))
    assert [tuple(r) for r in readers.columns_of(df).collect()] == [(0, "id", "bigint"), (1, "name", "string")]
    assert readers.missing_columns(df, {"id": "int", "name": "string", "gone": "date"}) == ["id:bigint", "gone"]


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d|e")], "k long, v string")
    with pytest.raises(ValueError):
        sinks.insert(old, new, ["k"])
    assert sinks.insert(old, new.filter("k = 3"), ["k"]).count() == 3
    sinks.export_json(new, str(tmp_path / "j"))
    assert [r["k"] for r in sinks.import_json(spark, str(tmp_path / "j"), old, ["k"]).collect()] == [3]
    assert sorted(r["v"] for r in sinks.import_json(spark, str(tmp_path / "j"), old, ["k"], dry_run=False).collect()) == ["a", "b", "d|e"]
    for _ in range(2):
        sinks.append_csv(old, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 4
    sinks.backup(old, str(tmp_path / "b"))
    with pytest.raises(Exception):
        sinks.backup(old, str(tmp_path / "b"))
    assert sorted(r["line"] for r in sinks.markdown_rows(new, ["k", "v"]).collect()) == ["| 2 | c |", r"| 3 | d\|e |"]
    assert sinks.pairs(spark.createDataFrame([(1, ["x", "y"])], "e long, ids array<string>"), "e", "ids").count() == 2


EVENTS = "event_id long, ts timestamp, user_id long, value double"


def _rows(spark):
    return spark.range(200).select(F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 120).alias("ts"), F.pmod("id", F.lit(5)).alias("user_id"), F.col("id").cast("double").alias("value"))


def _run(df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_tail_and_repeats(spark, tmp_path):
    rows = _rows(spark)
    rows.unionByName(rows.filter("event_id < 20")).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = _run(exchange.once(exchange.tail(spark, str(tmp_path / "in"), EVENTS), "event_id", "ts", "30 days"), "once_rows", tmp_path)
    assert got.count() == 200 == got.select("event_id").distinct().count()


def test_windows_like_batch(spark, tmp_path):
    rows = _rows(spark)
    late = spark.createDataFrame([(999, 99, 0.0)], "event_id long, user_id long, value double").withColumn("ts", F.timestamp_seconds(F.lit(1_800_000_000))).select("event_id", "ts", "user_id", "value")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = exchange.tail(spark, str(tmp_path / "in"), EVENTS, files=1)
    got = _run(exchange.activity(stream, "ts", "user_id"), "activity_rows", tmp_path).filter("user_id != 99")
    want = rows.groupBy(F.window("ts", "1 hour").alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("window_start"), "user_id", "n", "value")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    got = _run(exchange.sessions(stream, "ts", "user_id"), "session_rows", tmp_path).filter("user_id != 99")
    assert sorted((r["user_id"], r["n"]) for r in got.collect()) == [(u, 40) for u in range(5)]


def test_drain(spark, tmp_path):
    items = spark.createDataFrame([(i, "bad" if i % 4 == 0 else "ok") for i in range(20)], "id long, payload string")
    items.coalesce(1).write.parquet(str(tmp_path / "q"))

    def handle(df):
        return df.withColumn("error", F.when(F.col("payload") == "bad", "refused"))

    for _ in range(2):  # the second run finds nothing new
        q = exchange.drain(exchange.tail(spark, str(tmp_path / "q"), "id long, payload string"), handle, str(tmp_path / "done"), str(tmp_path / "err"), str(tmp_path / "c"))
        q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "done")).count() == 15 and spark.read.parquet(str(tmp_path / "err")).count() == 5


def test_payload_limits(spark):
    """Every limit of a payload is told apart, by field and place."""
    import json

    fine = {"session_id": "s", "tldr": "x" * 4000, "assertions": [{"subject": "a", "predicate": "is", "object": "b", "source": "doc_quoted"}], "retrieval_outcome": "success"}
    bad = {
        "session_id": "s", "tldr": "x" * 4001, "open_threads": ["a", "b" * 4001], "resolved_threads": ["c"] * 201, "retrieval_outcome": "fine",
        "entities": [{"name": "n", "entity_type": "t"}, {"name": "n"}, {"name": "n" * 1001, "entity_type": "t"}],
        "assertions": [{"subject": "a", "predicate": "odd", "object": "b", "source": "hearsay"}],
        "edges": [{"from_entity": "a", "to_entity": "b"}], "decisions": [{"topic": "é" * 1001}],
    }
    df = spark.createDataFrame([(0, json.dumps(fine)), (1, json.dumps(bad))], "i int, value string")
    got = {r["i"]: r for r in readers.payloads(df, predicates=["is"]).collect()}
    assert got[0]["errors"] == [] and got[0]["warnings"] == []
    assert set(got[1]["errors"]) == {
        "tldr is too long", "open_threads[1] is too long", "resolved_threads has too many items", "retrieval_outcome is unknown", "entities[1] is incomplete",
        "entities[2].name is too long", "assertions[0].source is unknown", "an edge is incomplete", "decisions[0].topic is too long",
    }
    assert got[1]["warnings"] == ["assertions[0].predicate is not registered: odd"]
    strict = {r["i"]: r for r in readers.payloads(df, predicates=["is"], strict=True).collect()}
    assert "assertions[0].predicate is not registered: odd" in strict[1]["errors"] and strict[1]["warnings"] == []
