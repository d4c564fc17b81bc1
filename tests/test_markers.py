"""The stream of markers' lives against the batch rule, with a restart in between."""

import random

from pyspark.sql import functions as F

from lorekeep.streaming import exchange, markers

ROW = "session string, kind string, us long"
START = 1_700_000_000_000_000
END = START + 40 * 24 * markers.HOUR


def brute(rows, as_of):
    out = []
    for s in {r[0] for r in rows if r[0] and r[2] is not None}:
        mine = sorted((r for r in rows if r[0] == s and r[2] is not None), key=lambda r: (r[2], r[1] == "close"))
        for a, b in zip(mine, [*mine[1:], None]):
            for event, n in markers.LIMITS:
                if a[1] == "open" and a[2] + n <= as_of and (b is None or b[2] > a[2] + n):
                    out.append((s, event, a[2], a[2] + n))
    return sorted(out)


def test_stream_with_a_restart_equals_the_batch_rule(spark, tmp_path):
    rng = random.Random(5)
    hours = sorted(rng.randrange(0, 30 * 24) for _ in range(160))
    rows = [(f"s{rng.randrange(12)}", rng.choice(["open", "open", "close"]), START + h * markers.HOUR + k) for k, h in enumerate(hours)]
    rows += [("s1", "open", START + 5), ("s1", "close", START + 5), (None, "open", START), ("s2", "open", None)]
    rows += [("edge", "open", START), ("edge", "close", START + 24 * markers.HOUR), ("once", "open", START)]
    batch = sorted(map(tuple, markers.life(spark.createDataFrame(rows, ROW), F.lit(END)).collect()))
    assert batch == brute(rows, END) and {e for _, e, _, _ in batch} == {"stale", "prompt"}

    rows.sort(key=lambda r: r[2] or 0)
    parts = [rows[i : i + 30] for i in range(0, len(rows), 30)]
    into, seen = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        q = markers.life_stream(exchange.tail(spark, into, ROW, files=1)).writeStream.format("parquet").option("path", seen).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()

    for k, p in enumerate([*parts, [("z", "close", END + 48 * markers.HOUR)], [("z", "close", END + 49 * markers.HOUR)]]):
        shuffled = rng.sample(p, len(p))
        spark.createDataFrame(shuffled, ROW).coalesce(1).write.mode("append").parquet(into)
        if k in (2, len(parts) + 1):
            run()  # the second run goes on from the checkpoint
    got = sorted(tuple(r) for r in spark.read.parquet(seen).collect())
    assert got == brute(rows, END + 46 * markers.HOUR)
    assert len(got) == len(set(got))


def test_no_rows(spark):
    assert markers.life(spark.createDataFrame([], ROW), F.lit(END)).count() == 0
