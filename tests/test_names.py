"""Similarity joins of names against the comparison of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from lorekeep.functions.expr import similarity, trigrams
from lorekeep.operators import names, search


def brute(a, b, least, strict=False):
    s = similarity(trigrams(F.col("x")), trigrams(F.col("y")))
    x = a.distinct().crossJoin(b.distinct()).withColumn("s", s).filter((F.col("s") > least) if strict else (F.col("s") >= least))
    return {(r.x, r.y, round(r.s, 9)) for r in x.collect()}


@pytest.mark.parametrize("least,strict,block", [(0.15, False, 2048), (0.4, False, 3), (0.5, True, 5), (0.85, False, 2), (1.0, False, 7)])
def test_pairs(spark, least, strict, block):
    """Random names, a third of them with a common stem; NULL, blank and symbols-only names; repeats; ties on the threshold."""
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcd1") for _ in range(n))
    many = [word(rng.randrange(1, 7)) + rng.choice(["", " ", "-"]) + word(rng.randrange(0, 4)) for _ in range(60)] + [f"customer#{k:06d}" for k in range(30)]
    odd = [None, "", " ", "--", "É", "Customer#000001", "x" * 3000, "abcd"]
    a = spark.createDataFrame([(t,) for t in many[::2] + odd + many[:4]], "x string")
    b = spark.createDataFrame([(t, k) for k, t in enumerate(many[1::2] + odd + many[:20])], "y string, rank int")
    got = names.similar_texts(a, b, least, F.col("x"), F.col("y"), strict, block).collect()
    assert len(got) == len({(r.left_text, r.right_text) for r in got})
    assert {(r.left_text, r.right_text, round(r.similarity, 9)) for r in got} == brute(a, b.select("y"), least, strict)


@pytest.mark.parametrize("least,strict,block", [(0.15, False, 2048), (0.15, True, 3), (0.4, False, 2), (0.5, True, 5), (1.0, False, 7)])
@pytest.mark.parametrize("hot", [0, 1, 4])
def test_pairs_by_two_trigrams(spark, least, strict, block, hot):
    """All trigrams hot, or some: texts of one trigram and of few, which may share one only, and longer ones, each pair once."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("ab1") for _ in range(n))
    many = [" ".join(word(rng.randrange(1, 6)) for _ in range(rng.randrange(1, 4))) for _ in range(50)] + ["a", "b", "a b", "ab", "1"] + [f"customer#{k:04d}" for k in range(25)]
    a = spark.createDataFrame([(t,) for t in many[::2] + ["a", None, "--"]], "x string")
    b = spark.createDataFrame([(t,) for t in many[1::2] + many[:9]], "y string")
    got = names.similar_texts(a, b, least, F.col("x"), F.col("y"), strict, block, hot).collect()
    assert len(got) == len({(r.left_text, r.right_text) for r in got})
    assert {(r.left_text, r.right_text, round(r.similarity, 9)) for r in got} == brute(a, b, least, strict)


def test_few_pairs_meet_by_common_trigrams(spark, monkeypatch):
    """Numbered names at a low threshold: far fewer pairs are compared than share a run of three digits."""
    a = spark.range(3000).select(F.format_string("user_%d", F.col("id") * 7 % 9000).alias("x"))
    b = spark.range(9000).select(F.format_string("customer#%09d", F.col("id") * 11 % 90000).alias("y"))
    sides = []
    real = names._prefixes
    monkeypatch.setattr(names, "_prefixes", lambda *args: sides.append(real(*args)) or sides[-1])
    names.similar_texts(a, b, 0.15, F.col("x"), F.col("y")).count()
    l, r = (x.groupBy("rank", "next").agg(F.count("*").alias(n)) for x, n in zip(sides, "lr"))
    assert l.join(r, ["rank", "next"]).agg(F.sum(F.col("l") * F.col("r"))).first()[0] < 3000 * 9000 / 20


def test_no_names_and_thresholds(spark):
    none = spark.createDataFrame([], "x string")
    assert names.similar_texts(none, none, 0.5, F.col("x"), F.col("x")).count() == 0
    with pytest.raises(ValueError):
        names.similar_texts(none, none, 0.0, F.col("x"), F.col("x"))


def test_near_names_of_all_is_near_names_of_each(spark):
    e = spark.createDataFrame([(1, "Ann Lee"), (2, "ann lee "), (3, "Anne Lee"), (4, "Bob"), (5, "bob"), (6, None), (7, "É"), (8, "Ann Lee")], "id long, name string")
    asked = ["ann lee", "BOB", "bobb", "é", "zz"]
    got = {(r.asked, r.id, r.name, r.exact, r.similarity) for r in names.near_names_of_all(e, spark.createDataFrame([(t,) for t in asked] + [(None,)], "name string")).collect()}
    want = {(t, r.id, r.name, r.exact, r.similarity) for t in asked for r in search.near_names(e, t).collect()}
    assert got == want


def test_fuzzy_of_all_is_fuzzy_of_each(spark):
    rng = random.Random(3)
    rows = [(k, f"user_{rng.randrange(9)}", rng.choice(["click", "view"]), rng.choice(["a b", "note"])) for k in range(200)]
    f = spark.createDataFrame(rows, "id long, subject string, predicate string, object string")
    asked = ["user_3 click", " user_4 view note ", "", "nothing like it"]
    got = {(r.seed, r.place, r.id) for r in names.fuzzy_of_all(f, spark.createDataFrame([(t,) for t in asked], "seed string"), 12).collect()}
    want = {(t.strip(), k + 1, r.id) for t in asked for k, r in enumerate(search.fuzzy(f, t, 12).collect())}
    assert got == want


def test_hot_trigram_is_dealt_out_without_a_cross_join(spark):
    n = spark.range(500).select(F.format_string("customer#%06d", "id").alias("x"))
    x = names.similar_texts(n, n, 0.9, F.col("x"), F.col("x"), block=50)
    plan = x._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert x.filter("left_text = right_text").count() == 500


def test_pairs_do_not_go_through_the_driver(spark):
    """Small as both sides are, neither is broadcast: their rows shuffle to few bytes and unpack to many."""
    n = spark.range(300).select(F.format_string("customer#%06d", "id").alias("x"))
    x = names.similar_texts(n, n, 0.9, F.col("x"), F.col("x"), block=50)
    x.collect()
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [rank" in plan.split("Initial Plan")[0]
