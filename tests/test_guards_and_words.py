"""Registry guards, session overrides, composed forms, load-bearing tokens, decodings and marker counts."""

import json
import re
import unicodedata
from urllib.parse import quote

from pyspark.sql import functions as F

from lorekeep.functions.expr import compare_key, label_key
from lorekeep.operators import registry_guards, search, text
from lorekeep.plans import registry
from lorekeep.sources.domain import as_of, facts
from tests.parity import connect, differences

registry.load()
SF = "/root/testdata/sf0.001"


def test_tokens_against_sql(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        for name in ("load_bearing_tokens", "text_keys"):
            assert not differences(registry.QUERIES[name](spark, sf), connect(sf), registry.ORACLE_SQL[name])


def test_composed_and_decomposed(spark):
    said = ["Café au lait!", "  CAFÉ  au lait", None, "Å", ""]
    df = spark.createDataFrame([(i, t if i % 2 == 0 or t is None else unicodedata.normalize("NFD", t)) for i, t in enumerate(said)], "i long, t string")
    got = {r["i"]: (r["c"], r["l"]) for r in df.select("i", compare_key(F.col("t")).alias("c"), label_key(F.col("t")).alias("l")).collect()}
    assert got[0][0] == got[1][0] == "café au lait" and got[1][1] == "CAFÉ au lait" and got[2] == ("", None) and got[3] == ("å", "Å") and got[4] == ("", "")


def test_load_bearing_tokens(spark):
    said = "See PR #12 and #7, not lib/x.js:30 at https://a.b/c 'an error' on 2026-01-02, sha deadbeef1; don't use v1.2 or é#8 #9x"
    got = spark.createDataFrame([(said,), (None,), ("",)], "t string").select(text.load_bearing(F.col("t")).alias("w")).collect()
    w = got[0]["w"]
    for token in ("PR #12", "#12", "#7", "not", "lib/x.js:30", "https://a.b/c", "'an error'", "2026-01-02", "deadbeef1", "n't", "30", "#8"):
        assert token in w, token
    assert "#9" not in w and w.index("PR #12") < w.index("#7") < w.index("not") and got[1]["w"] == got[2]["w"] == []


def test_truncation(spark):
    cases = {'said "oh': ["dangling_quote"], 'said "oh.': [], "in PR #": ["dangling_pr_ref"], "a/b.js and scripts/lib/reality-check": ["dangling_path"], "projects/resources/views": [], "at https://abc": ["dangling_url"], "commit: 12ab": ["dangling_sha"], "on 2026-01-": ["dangling_date"], "all is well.": []}
    df = spark.createDataFrame([*[(t,) for t in cases], (None,)], "t string")
    got = {r["t"]: r["s"] for r in df.select("t", text.truncation_smells(F.col("t")).alias("s")).collect()}
    assert got == cases | {None: []}


def test_decodings(spark):
    secret, rows = "ann@example.org", []
    coded = secret.replace("@", "%40").replace(".", "%2E")
    for _ in range(6):
        rows.append(coded)
        coded = quote(coded, safe="")
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*rows, "postgres://me:a+b@db", "%zz %40"])], "i long, t string")
    got = {r["i"]: r["k"] for r in df.select("i", text.secret_kinds(F.col("t")).alias("k")).collect()}
    assert [got[i] for i in range(5)] == [["email"]] * 5 and got[5] == [] and got[6] == ["connection"] and got[7] == []


def test_marker_counts(spark):
    said = [[{"ts": "x"}, {"ts": 1}, 5, None, {"ts": "y", "session_id": 3}, {"ts": "z", "session_id": ""}, {"ts": "w", "session_id": None}, {"session_id": "a"}], {"a": 1}]
    df = spark.createDataFrame([("a", json.dumps(said[0])), ("b", json.dumps(said[1])), ("c", "2026-01-01"), ("d", None), ("e", "")], "owner string, raw string")
    assert {r["owner"]: (r["dropped"], r["coerced"]) for r in text.marker_counts(df).collect()} == {"a": (4, 2), "b": (0, 0), "c": (0, 0), "d": (0, 0), "e": (0, 0)}


def test_registry_guards(spark):
    reg = spark.createDataFrame([("a", "m1", 1.0, "n"), ("b", "m2", None, None), ("c", None, 3.0, None)], "label string, model_id string, cost double, notes string")
    rows = [
        (" a ", False, ["cost", "notes"], None, 2.0, None), ("b", False, ["model_id"], "m9", None, None), ("c", None, ["model_id"], "m1", None, None), ("d  e", False, ["model_id", "cost"], "m4", 4.0, "x"),
        ("f", True, ["model_id"], "m2", None, None), ("", False, ["cost"], None, 1.0, None), ("g", False, ["model_id"], "m7", None, None), ("h", False, ["model_id"], "m7", None, None),
    ]
    changes = spark.createDataFrame(rows, "label string, force boolean, touched array<string>, model_id string, cost double, notes string")
    new, refused = registry_guards.registry_set(reg, changes)
    assert {tuple(r) for r in new.collect()} == {("a", "m1", 2.0, None), ("b", "m2", None, None), ("c", None, 3.0, None), ("d e", "m4", 4.0, None), ("f", "m2", None, None)}
    assert {(r["label"], r["reason"]) for r in refused.collect()} == {("b", "label points to another model"), ("c", "model has another label"), ("", "label is empty"), ("g", "model has another label"), ("h", "model has another label")}


def test_overrides(spark):
    kind = "project_id string, session_id string, role string, label string, provider string"
    have = spark.createDataFrame([("p", "s", "dev", "a", "x"), ("p", "s", "qa", "b", None), ("p", "t", "dev", "a", None)], kind)
    reg = spark.createDataFrame([("a",), ("b",)], "label string")
    changes = spark.createDataFrame([("p", "s", " dev", "b ", None), ("p", "u", "ops", "a", "y"), ("p", "s", "qa", "zzz", None), ("p", " ", "qa", "a", None)], kind)
    new, refused = registry_guards.overrides_set(have, changes, reg)
    assert {tuple(r) for r in new.collect()} == {("p", "s", "dev", "b", None), ("p", "s", "qa", "b", None), ("p", "t", "dev", "a", None), ("p", "u", "ops", "a", "y")}
    assert {r["reason"] for r in refused.collect()} == {"label is not registered", "key is empty"}
    assert [r["role"] for r in registry_guards.overrides_of(new, "p", "s").collect()] == ["dev", "qa"]
    assert registry_guards.overrides_of(new, "p", "s", " qa ").count() == 1 and registry_guards.overrides_cleared(new, "p", "s", "qa").count() == 3


def test_session_intent(spark):
    f = facts(spark, SF).withColumn("predicate", F.when(F.col("id") % 3 == 0, "open_thread").when(F.col("id") % 3 == 1, "session_tldr").otherwise(F.col("predicate")))
    got = search.session_intent([search.Query("entity")], f, as_of(), 10).collect()
    assert len(got) == 10 and {r["predicate"] for r in got} <= set(search.SESSION_PREDICATES)
    assert [r["decayed_score"] for r in got] == sorted((r["decayed_score"] for r in got), reverse=True)
    for kind in ("assertion", "recency"):
        assert search.session_intent([search.Query(kind)], f, as_of()).count() == 0


def test_patterns_are_ascii():
    assert all(not re.search(r"\\b|\\w|\\d", p) for p in text.LOAD_BEARING.values())
