"""The apply step of the backfill: caps, deadlines, refused rows, runs that are killed, and providers."""

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import aggregates, backfill

ROW = "id long, body string, embedding array<float>, provider string, term int"


def table(spark, n=40):
    rows = [(k, None if k % 10 == 3 else "  " if k % 10 == 4 else f"text {k}", [9.0, 9.0] if k % 5 == 0 else None, "here" if k % 5 == 0 else None, 1) for k in range(n)]
    return spark.createDataFrame(rows, ROW)


def logged(path, refuse=(), die=()):
    """An embedder that notes each text it makes a vector of, refuses some and dies at others."""

    def run(texts):
        if any(t in refuse for t in texts):
            raise ValueError("refused")
        if any(t in die for t in texts):
            raise SystemExit(3)
        with open(path, "a") as f:
            f.writelines(t + "\n" for t in texts)
        return [[float(len(t)), 1.0, 2.0] for t in texts]

    return run


def go(df, embedder, folder, **more):
    return backfill.backfill(df, "id", "body", embedder, 2, "here", str(folder), **({"seconds": 600.0} | more)).first().asDict()


def test_runs_with_a_cap_go_on_until_done(spark, tmp_path):
    df, log = table(spark), tmp_path / "log"
    plan = aggregates.embedding_plan(df, "embedding", "body").first()
    stops = [go(df, logged(log), tmp_path / "v", most=10, slice_rows=4) for _ in range(4)]
    assert [s["stopped"] for s in stops] == ["cap", "cap", "done", "done"] and sum(s["embedded"] for s in stops) == plan.pending
    assert stops[0] == {"attempted": 10, "embedded": 10, "refused": 0, "left": plan.pending - 10, "stopped": "cap"} and stops[3]["attempted"] == 0
    texts = log.read_text().splitlines()
    assert len(texts) == len(set(texts)) == plan.pending
    x = backfill.filled(df, "id", str(tmp_path / "v"))
    after = aggregates.embedding_plan(x, "embedding", "body").first()
    assert (after.embedded, after.pending, after.exempt) == (plan.embedded + plan.pending, 0, plan.exempt)
    assert x.columns == df.columns and x.filter("id = 6").first().embedding == [6.0, 1.0]


def test_refused_rows_come_last_and_bar_nobody(spark, tmp_path):
    df, log = table(spark), tmp_path / "log"
    bad = logged(log, refuse=("text 1", "text 2"))
    first = go(df, bad, tmp_path / "v", most=3)
    assert (first["attempted"], first["embedded"], first["refused"]) == (3, 1, 2)
    rest = go(df, bad, tmp_path / "v", most=100)
    assert rest["left"] == rest["refused"] == 2 and rest["stopped"] == "cap"
    assert go(df, logged(log), tmp_path / "v", most=100)["stopped"] == "done"
    texts = log.read_text().splitlines()
    assert len(texts) == len(set(texts))


def test_killed_run_keeps_its_slices(spark, tmp_path):
    df, log = table(spark), tmp_path / "log"
    with pytest.raises(Exception):
        go(df, logged(log, die=("text 18",)), tmp_path / "v", most=100, slice_rows=6, size=1)
    kept = backfill.attempts(spark, str(tmp_path / "v"), "id", "long").count()
    assert 0 < kept < 28 and kept % 6 == 0
    end = go(df, logged(log), tmp_path / "v", most=100)
    assert end["stopped"] == "done" and end["embedded"] + kept == aggregates.embedding_plan(df, "embedding", "body").first().pending
    per = backfill.attempts(spark, str(tmp_path / "v"), "id", "long").groupBy("id").count()
    assert per.filter("count > 1").count() == 0


def test_deadline_and_providers(spark, tmp_path):
    df = table(spark)
    late = go(df, logged(tmp_path / "log"), tmp_path / "v", seconds=0.0)
    assert late["stopped"] == "deadline" and late["attempted"] == 0 and not (tmp_path / "log").exists()
    with pytest.raises(ValueError, match="other providers"):
        go(df.withColumn("provider", F.when(F.col("id") == 5, "there").otherwise(F.col("provider"))), logged(tmp_path / "log"), tmp_path / "v")
    go(df, logged(tmp_path / "log"), tmp_path / "v", most=2)
    with pytest.raises(ValueError, match="other providers"):
        backfill.backfill(df.filter("embedding is null"), "id", "body", logged(tmp_path / "log"), 2, "there", str(tmp_path / "v"))


def test_no_cap_and_no_rows(spark, tmp_path):
    df = table(spark)
    assert go(df, logged(tmp_path / "log"), tmp_path / "v", most=None, slice_rows=7)["stopped"] == "done"
    assert go(df.limit(0), logged(tmp_path / "log"), tmp_path / "w")["stopped"] == "done"
