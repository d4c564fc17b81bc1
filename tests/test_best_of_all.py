"""The best facts of many seeds against each seed's own search and against SQL."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lorekeep.operators import names, search
from tests import parity

ODD = [None, "", "  ", "--", "É", "K 1", "a", "b b", "É user_3", "x" * 300, "user_3\tview", "USER_3 view", "user_3 view"]


def made(spark, rng, kind="long"):
    """Facts with many copies of few texts, one text's copies the most, odd and NULL texts, and a NULL id."""
    word = lambda n: "".join(rng.choice("ab1") for _ in range(n))
    texts = [f"user_{rng.randrange(40)} {rng.choice(['click', 'view'])} {rng.randrange(30)}" for _ in range(250)] + [word(rng.randrange(1, 9)) + " " + word(rng.randrange(0, 4)) for _ in range(120)]
    texts += ["user_3 view note"] * 60 + ODD * 2
    rng.shuffle(texts)
    ids = rng.sample(range(-500, 5000), len(texts) - 1) + [None]
    return spark.createDataFrame(list(zip(ids, texts)), "id long, said string").withColumn("id", F.col("id").cast(kind))


@pytest.mark.parametrize("least,k,kind", [(0.05, 4, "long"), (0.3, 12, "string"), (0.5, 3, "long"), (0.6, 1, "long"), (0.7, 5, "int"), (0.95, 2, "long")])
def test_best_of_all_is_fuzzy_of_each(spark, monkeypatch, least, k, kind):
    """Seeds and facts in many parts, and few pairs at once; all thresholds' looks; ties by id, NULL first."""
    monkeypatch.setattr(names, "ENTRIES", 400)
    monkeypatch.setattr(names, "FACTS", 70)
    monkeypatch.setattr(names, "AT_ONCE", 5)
    rng = random.Random(k)
    f = made(spark, rng, kind)
    asked = [*ODD, *(f"user_{n} {what}" for n in (1, 3, 33, 999) for what in ("click", "view", "note")), "ab1 a", " a b ", "nothing like it"]
    s = spark.createDataFrame([(t,) for t in asked + asked[:5]], "seed string")
    got = names.best_of_all(f, s, k, least, F.col("said")).collect()
    want = []
    for t in {t.strip(" ") for t in asked if t is not None}:
        want += [(t, i + 1, r.id, r.sim_score) for i, r in enumerate(search.fuzzy(f, t, k, least, F.col("said")).collect())]
    order = lambda rows: sorted(rows, key=lambda r: (r[0], r[1]))
    assert order(map(tuple, got)) == order(want)


def test_columns_of_facts_and_ids_that_repeat(spark):
    f = spark.createDataFrame([(1, "ann lee", "x"), (1, "ann lee", "y"), (1, "bob", "z"), (2, "ann leee", "u"), (3, "zoe", None)], "id long, said string, more string")
    s = spark.createDataFrame([("ann lee",), ("zoe",), ("none",)], "seed string")
    got = {(r.seed, r.place, r.id, r.said, r.more) for r in names.fuzzy_of_all(f, s, 3, 0.5, F.col("said")).collect()}
    assert {x[:3] for x in got} == {("ann lee", 1, 1), ("ann lee", 2, 1), ("ann lee", 3, 2), ("zoe", 1, 3)}
    assert {x[3:] for x in got} == {("ann lee", "x"), ("ann lee", "y"), ("ann leee", "u"), ("zoe", None)}


def test_long_texts_among_short_seeds(spark, monkeypatch):
    """A text of very many trigrams, like no seed: its pairs of trigrams are never listed."""
    monkeypatch.setattr(names, "AT_ONCE", 1000)
    rng = random.Random(5)
    long = " ".join("".join(rng.choice("abcdefgh123") for _ in range(9)) for _ in range(4000))
    f = spark.createDataFrame([(1, long), (2, "ann lee"), (3, "ann lee " + long[:40])], "id long, said string")
    s = spark.createDataFrame([("ann lee",), (long[:40],)], "seed string")
    got = {(r.seed, r.place, r.id) for r in names.best_of_all(f, s, 3, 0.5, F.col("said")).collect()}
    assert got == {("ann lee", 1, 2), (long[:40].strip(), 1, 3)}


def test_no_facts_and_no_seeds(spark):
    none, one = spark.createDataFrame([], "id long, said string"), spark.createDataFrame([(1, "ann")], "id long, said string")
    s = spark.createDataFrame([("ann",)], "seed string")
    assert names.best_of_all(none, s, 3, 0.5, F.col("said")).count() == 0
    assert names.best_of_all(one, s.limit(0), 3, 0.5, F.col("said")).count() == 0
    assert names.best_of_all(one, s, 3, 0.5, F.col("said")).count() == 1


def shuffled(spark):
    """Rows written to shuffles by this session so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_a_fact_is_shuffled_once_a_look(spark, tmp_path):
    """However many trigrams it has: with rows by pairs of trigrams, 233167 were shuffled here."""
    e = spark.range(20000).select(F.col("id").alias("event_id"), (F.col("id") * 7919 % 300).alias("user_id"), F.lit("click").alias("event_type"), F.format_string('{"k": %d}', F.col("id")).alias("props"), F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), F.lit(1.0).alias("value"))
    e.write.parquet(f"{tmp_path}/events.parquet")
    before = shuffled(spark)
    assert __spark_entry__.queries()["fuzzy_facts_of_pins"](spark, str(tmp_path)).count() == 900
    assert shuffled(spark) - before < 5 * 20000


def test_facts_without_a_user(spark, tmp_path):
    """NULL in a part of a text leaves the fact and the seed out, as in SQL."""
    rows = [(i, None if i % 5 == 0 else i % 9, None if i % 7 == 0 else "view", None if i % 11 == 0 else '{"k": %d}' % (i % 10)) for i in range(400)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string")
    e.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")).withColumn("value", F.lit(1.0)).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    name = "fuzzy_facts_of_pins"
    assert parity.differences(__spark_entry__.queries()[name](spark, str(tmp_path)), c, __spark_entry__.oracle_sql()[name]) == []
