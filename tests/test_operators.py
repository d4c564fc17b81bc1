"""Operators on small cases: graphs, communities, texts, contracts, keys."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import expr
from lorekeep.operators import aggregates, graph, search, text, usage
from lorekeep.plans import registry

registry.load()
SF = "/root/testdata/sf0.001"
EDGE = "from_entity string, edge_type string, to_entity string, weight double"


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, "e", b, float(w)) if w is not None else (a, "e", b, None) for a, b, w in pairs], EDGE)


def brute(pairs, seeds, depth, direction):
    """Least depth and greatest last weight over simple paths."""
    best = {}

    def go(node, path, d):
        for a, b, w in pairs:
            near, far = (a, b) if direction == "out" else (b, a)
            if near == node and far not in path and d < depth:
                if far not in seeds:
                    depth0, weight0 = best.get(far, (99, None))
                    weights = [x for x in (weight0, w) if x is not None]
                    best[far] = (min(depth0, d + 1), max(weights) if weights else None)
                go(far, path + [far], d + 1)

    for s in seeds:
        go(s, [s], 0)
    return best


CASES = {
    "chain": [("a", "b", 1), ("b", "c", 2), ("c", "d", 3)],
    "cycle": [("a", "b", 1), ("b", "c", 2), ("c", "a", 3)],
    "loop": [("a", "a", 1), ("a", "b", None)],
    "diamond": [("a", "b", 1), ("a", "c", 5), ("b", "d", 2), ("c", "d", 4)],
    "apart": [("x", "y", 1)],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("direction", ["out", "in"])
def test_traversal(spark, name, direction):
    pairs = CASES[name]
    got = {r["entity_name"]: (r["min_depth"], r["max_weight"]) for r in graph.traverse(edges_of(spark, pairs), ["a"], 3, direction).collect()}
    assert got == brute(pairs, ["a"], 3, direction)


def test_traversal_random(spark):
    rng = random.Random(3)
    pairs = list({(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}", rng.randrange(5)) for _ in range(18)})
    got = {r["entity_name"]: (r["min_depth"], r["max_weight"]) for r in graph.traverse(edges_of(spark, pairs), ["n0", "n1"], 4).collect()}
    assert got == brute(pairs, ["n0", "n1"], 4, "out")


def test_star_is_limited(spark):
    star = spark.range(10_000).select(F.lit("hub").alias("from_entity"), F.lit("e").alias("edge_type"), F.concat(F.lit("leaf"), "id").alias("to_entity"), F.col("id").cast("double").alias("weight"))
    got = graph.traverse(star, ["hub"], 2, limit=25).collect()
    assert [r["entity_name"] for r in got] == [f"leaf{9999 - i}" for i in range(25)]


def test_communities(spark):
    clique = lambda s: [(f"{s}{i}", f"{s}{j}", 1) for i in range(4) for j in range(i)]
    pairs = clique("a") + clique("b") + [("a0", "b0", 0.1), ("a1", "ghost", 9)]
    nodes = spark.createDataFrame([(f"{s}{i}",) for s in "ab" for i in range(4)] + [("alone",)], "name string")
    got = {r["name"]: r["community"] for r in graph.communities(edges_of(spark, pairs), nodes).collect()}
    assert len({got[f"a{i}"] for i in range(4)}) == 1 and len({got[f"b{i}"] for i in range(4)}) == 1
    assert got["a0"] != got["b0"] and got["alone"] == "alone" and len(got) == 9


def test_registered_communities(spark):
    rows = registry.QUERIES["graph_communities"](spark, SF).collect()
    assert len({r["name"] for r in rows}) == len(rows) and len({r["community"] for r in rows}) < len(rows)


def test_threads(spark):
    log = spark.createDataFrame([(1, None)] + [(i, i - 1) for i in range(2, 60)] + [(100, None), (101, 999)], "id long, parent_id long")
    got = {r["id"]: (r["root"], r["depth"]) for r in graph.thread_roots(log).collect()}
    assert got[59] == (1, 58) and got[100] == (100, 0) and got[101] == (999, 1)


def test_chunks():
    assert text.chunk_text("") == [] and text.chunk_text(None) == []
    assert text.chunk_text("intro\n# One\nbody\n## Two\nmore") == ["intro", "# One\nbody", "## Two\nmore"]
    long = "x" * 3000
    parts = text.chunk_text(long)
    assert len(parts[0]) == 1400 and parts[1][:196] == parts[0][-196:] and sum(map(len, parts)) == 3000 + 196 * (len(parts) - 1)
    para = "a" * 900 + "\n\n" + "b" * 900
    assert text.chunk_text(para) == ["a" * 900, "b" * 900]
    said = "One is here. " * 80 + "Two is there. " * 80
    assert all(c.endswith(".") for c in text.chunk_text(said)) and "".join(text.chunk_text(said)).replace(" ", "") == said.replace(" ", "")
    assert not text.chunk_text(said, tool_result=True)[0].endswith(".") or len(text.chunk_text(said, tool_result=True)[0]) == 1400
    fence = "```\n" + "code\n" * 100 + "```\n" + "tail " * 300
    assert text.chunk_text(fence)[0] == fence[: fence.rindex("```") + 3]
    assert text.chunk_text("abc def", ceiling=3)[0] == "abc"


def test_chunks_of_documents(spark):
    rows = registry.QUERIES["document_chunks"](spark, SF).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    per = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["chunk_idx"])):
        per.setdefault(r["doc_id"], []).append(r["content"])
        assert len(r["content"]) <= text.CEILING
    assert set(per) == {d for d, t in docs.items() if t.strip()}
    for d, cs in per.items():
        t, pos = docs[d], 0
        for c in cs:  # in order, without a gap; only hard cuts overlap
            at = t.find(c, max(0, pos - 200))
            assert at >= 0 and not t[pos:at].strip()
            pos = max(pos, at + len(c))
        assert not t[pos:].strip()


def test_contract(spark):
    rows = registry.QUERIES["contract_items"](spark, SF).orderBy("ord", "place").collect()
    budgets = [60, 100, 50, 20, 80]
    for k, b in enumerate(budgets):
        mine = [r for r in rows if r["ord"] == k]
        assert mine and [r["place"] for r in mine] == list(range(1, len(mine) + 1))
        assert mine[-1]["used"] == sum(r["tokens"] for r in mine) <= b
    with pytest.raises(ValueError):
        search.run_query(search.Query("nothing"), {}, F.lit(None))


def test_rerank(spark):
    found = spark.createDataFrame([(str(i), "x" * i, 1.0 / (i + 1)) for i in range(40)], "id string, snippet string, score double")
    got = search.reranked(found, lambda texts: [float(len(t)) for t in texts]).collect()
    assert [r["id"] for r in got] == ["19", "18", "17", "16", "15"]


def test_search_errors(spark):
    d = {"t": search.Searchable("id", "name", F.col("name"), needs=("id", "name"))}
    t = spark.createDataFrame([(1, "a")], "id long, name string")
    assert search.memory_search({"t": t}, d, "a", names=[]).count() == 0
    with pytest.raises(ValueError):
        search.memory_search({"t": t}, d, "a", names=["u"])
    with pytest.raises(ValueError):
        search.memory_search({}, d, "a")
    assert search.availability(None, d["t"]) == "table_missing"
    assert search.availability(t.drop("name"), d["t"]) == "column_missing"
    assert search.availability(t.withColumn("embedding", F.lit("x")), d["t"]) == "type_mismatch"
    assert search.availability(t, d["t"]) == "no_full_text"


def test_fuzzy_and_cosine(spark):
    x = spark.range(1).select(expr.similarity(expr.trigrams(F.lit("word")), expr.trigrams(F.lit("two words"))).alias("s"), expr.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("c"), expr.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("z"), expr.similarity(expr.trigrams(F.lit("")), expr.trigrams(F.lit("!"))).alias("e")).first()
    assert round(x["s"], 6) == round(4 / 11, 6) and math.isclose(x["c"], 2**-0.5) and x["z"] is None and x["e"] == 0


def test_intent_keys(spark):
    long = "wörd " * 400
    said = ["KEY: rest of it", "http://host/x y", "  a \n b ", "", None, ": x", long, long + "z", "k" * 70 + ": no"]
    got = [r[0] for r in spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").orderBy("i").select(expr.intent_key(F.col("s"))).collect()]
    assert got[:6] == ["KEY", "http://host/x y", "a b", "", "", ": x"]
    assert got[8] == "k" * 70 + ": no" and got[6] != got[7]
    assert all(len(k.encode()) <= 1000 and " …#" in k and not k.split(" …#")[0].endswith(" ") for k in got[6:8])


def test_markers(spark):
    raw = [("list", '[{"session_id": "s1", "ts": "2024-01-01", "host": "h"}, {"ts": "2024-02-01"}, {"session_id": "x"}]'), ("legacy", "sometime"), ("none", ""), ("null", None), ("object", '{"ts": "1"}')]
    got = sorted((r["owner"], r["ord"], r["session_id"], r["host"], r["ts"]) for r in text.markers(spark.createDataFrame(raw, "owner string, raw string")).collect())
    assert got == [("legacy", 0, None, None, "sometime"), ("list", 0, "s1", "h", "2024-01-01"), ("list", 1, None, None, "2024-02-01")]


def test_secrets(spark):
    import base64

    inner = base64.b64encode(b"mail to some.one@example.com now").decode()
    said = ["nothing", "a@b.co", "a%40b.co", f"blob {inner}", "postgres://u:pw@host/db /home/me/x", None, "100% sure"]
    got = [r[0] for r in spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").orderBy("i").select(text.secret_kinds(F.col("s"))).collect()]
    assert got == [[], ["email"], ["email"], ["email"], ["connection", "home_path"], [], []]


def test_cells_and_replies(spark):
    x = spark.createDataFrame([(r"| a | b \| c |  |", "said:\n```json\n{\"entities\": [{\"name\": \"n\"}], \"edges\": []}\n```\nend"), ("plain", "no json")], "line string, reply string")
    got = x.select(text.table_cells(F.col("line")).alias("c"), text.cell_escaped(F.lit("p|q\nr")).alias("e")).collect()
    assert got[0]["c"] == ["a", "b | c", ""] and got[1]["c"] == ["plain"] and got[0]["e"] == r"p\|q r"
    e = [r["extraction"] for r in text.extracted(x).collect()]
    assert e[0]["entities"][0]["name"] == "n" and (e[1] is None or e[1]["entities"] is None)


def test_fingerprint(spark):
    x = spark.range(500).select("id", (F.col("id") * 7 % 13).alias("v"))
    f = lambda d: tuple(aggregates.fingerprint(d, "id", ["id", "v"]).first())
    assert f(x) == f(x.repartition(7)) != f(x.withColumn("v", F.when(F.col("id") == 3, 99).otherwise(F.col("v"))))
    assert f(x.limit(0))[0] == 0


def test_hash_multiset(spark):
    x = spark.createDataFrame([("a", None), ("a", "NULL"), ("a", None)], "k string, v string")
    assert sorted(r["n"] for r in aggregates.hash_multiset(x, ["k", "v"], "k").collect()) == [1, 2]


def test_usage_scopes():
    for bad in ({"granularity": "x"}, {"by": "pr"}, {"by": "role"}, {"granularity": "feature", "session": "s"}, {"granularity": "feature", "by": "role"}):
        with pytest.raises(ValueError):
            usage.usage(None, None, None, "p", **bad)


def test_embedding(spark):
    from lorekeep.operators import enrich

    rows = [(1, "one", None), (2, "  ", None), (3, "bad", None), (4, "kept", [9.0, 9.0]), (5, "zero", None), (6, None, None)]
    df = spark.createDataFrame(rows, "id int, text string, embedding array<float>").coalesce(1)

    def embedder(texts):
        if "bad" in texts:
            raise RuntimeError("down")
        return [[0.0, 0.0, 0.0] if t == "zero" else [float(len(t)), 1.0, 2.0] for t in texts]

    got = {r["id"]: r["embedding"] for r in enrich.embedded(df, "text", embedder, 2).collect()}
    assert got == {1: [3.0, 1.0], 2: None, 3: None, 4: [9.0, 9.0], 5: None, 6: None}

    def write(t):
        return {"one": " a line ", "bad": 1 / 0 if t == "bad" else "", "kept": ""}.get(t)

    lines = {r["id"]: r["blurb"] for r in enrich.generated(df, "text", write).collect()}
    assert lines == {1: "a line", 2: None, 3: None, 4: None, 5: None, 6: None}
    x = spark.createDataFrame([("a", [1.0, 3.0]), ("a", [3.0, 5.0]), ("b", [0.0, 2.0])], "k string, embedding array<double>")
    assert {r["k"]: r["embedding"] for r in enrich.mean_pooled(x, "k").collect()} == {"a": [2.0, 4.0], "b": [0.0, 2.0]}
    assert [r[0] for r in x.filter("k = 'b'").select(enrich.normalised(F.col("embedding"), 1)).collect()] == [[0.0]]
    with pytest.raises(ValueError):
        enrich.one_provider(x.withColumnRenamed("k", "provider"))


def test_rollback(spark):
    from lorekeep.operators import state

    h = spark.createDataFrame([("c", 1, "x"), ("c", 2, "y")], "name string, version int, body string")
    got = sorted(tuple(r) for r in state.rolled_back(h, spark.createDataFrame([("c", 1), ("d", 1)], "name string, to_version int")).collect())
    assert got == [("c", 1, "x"), ("c", 2, "y"), ("c", 3, "x")]


def test_sampled(spark):
    from lorekeep.operators import filters

    x = spark.range(1000)
    pick = lambda d: {r["id"] for r in filters.sampled(d, 3, 7).collect()}
    assert pick(x) == pick(x.repartition(5)) and len(pick(x)) == 3
    assert filters.without_vectors(x.withColumn("v", F.array(F.lit(1.0)))).columns == ["id"]
