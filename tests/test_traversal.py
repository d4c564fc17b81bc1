"""Traversal against the listing of all simple paths, on graphs where cycles matter, stars and cliques."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import graph
from lorekeep.plans import registry
from tests.parity import connect, differences

registry.load()
EDGE = "project_id string, from_entity string, edge_type string, to_entity string, weight double"


def by_paths(df, seeds, depth, direction):
    """What ``traverse`` must give, from every simple path."""
    ways = ["out", "in"] if direction == "both" else [direction]
    out = {}
    for w in ways:
        for r in graph.walks(df, seeds, depth, w).collect():
            if r["entity_name"] not in seeds:
                out.setdefault(r["entity_name"], []).append(r)
    found = {}
    for n, rs in out.items():
        rep = min(rs, key=lambda r: (r["depth"], float("-inf") if r["weight"] is None else -r["weight"], r["edge_from"], r["edge_type"], r["edge_to"]))
        known = [r["weight"] for r in rs if r["weight"] is not None]
        found[n] = (rep["depth"], max(known, default=None), rep["edge_from"], rep["edge_type"], rep["edge_to"])
    return found


@pytest.mark.parametrize("seed,depth,direction", [(1, 5, "out"), (2, 4, "in"), (3, 5, "both"), (4, 5, "out")])
def test_random_graphs(spark, seed, depth, direction):
    """Sparse graphs with heavy edges back, so that some last edges are reached only around their node."""
    rng = random.Random(seed)
    links = [("p", f"n{rng.randrange(14)}", rng.choice("ab"), f"n{rng.randrange(14)}", rng.choice([None, 1.0, 2.0, 5.0, 9.0])) for _ in range(24)]
    links += [("p", f"n{k + 1}", "back", f"n{k}", 20.0 + k) for k in range(0, 12, 2)] + [("p", f"n{k}", "on", f"n{k + 1}", 0.5) for k in range(12)]
    df = spark.createDataFrame(links, EDGE)
    for seeds in (["n0"], ["n3", "n7", "nowhere"]):
        got = {r["entity_name"]: tuple(r)[1:] for r in graph.traverse(df, seeds, depth, direction).collect()}
        assert got == by_paths(df, seeds, depth, direction)


def test_edges_back_around_their_node(spark):
    """An edge back to n counts only if its start is reached without n: here by a longer way, or not at all."""
    links = [("p", "s", "e", "n", 1.0), ("p", "n", "e", "x", 1.0), ("p", "x", "e", "n", 50.0)]
    df = spark.createDataFrame(links, EDGE)
    assert {r["entity_name"]: r["max_weight"] for r in graph.traverse(df, ["s"], 5).collect()} == {"n": 1.0, "x": 1.0}
    way = [("p", "s", "e", "a", 1.0), ("p", "a", "e", "b", 1.0), ("p", "b", "e", "x", 1.0)]
    df = spark.createDataFrame(links + way, EDGE)
    assert {r["entity_name"]: r["max_weight"] for r in graph.traverse(df, ["s"], 5).collect()}["n"] == 50.0
    assert {r["entity_name"]: r["max_weight"] for r in graph.traverse(df, ["s"], 3).collect()}["n"] == 1.0


def test_star_and_clique(spark):
    """10000 leaves, and a clique of 200 at the greatest depth, within seconds: simple paths of the clique number some 10**11."""
    star = spark.range(10_000).select(F.lit("p").alias("project_id"), F.lit("hub").alias("from_entity"), F.lit("e").alias("edge_type"), F.concat(F.lit("leaf"), "id").alias("to_entity"), F.lit(1.0).alias("weight"))
    began = time.time()
    assert graph.traverse(star, ["hub"], 5, "both").count() == 10_000
    n = spark.range(200).select(F.col("id").cast("string").alias("a"))
    clique = n.join(n.withColumnRenamed("a", "b"), F.col("a") != F.col("b")).select(F.lit("p").alias("project_id"), F.col("a").alias("from_entity"), F.lit("e").alias("edge_type"), F.col("b").alias("to_entity"), (F.col("a").cast("double") + F.col("b").cast("double")).alias("weight"))
    rows = {r["entity_name"]: (r["min_depth"], r["max_weight"]) for r in graph.traverse(clique, ["0"], 5).collect()}
    assert len(rows) == 199 and rows["7"] == (1, 206.0) and rows["199"] == (1, 397.0)
    assert time.time() - began < 60


def test_one_project(spark):
    links = [("p", "s", "e", "a", 1.0), ("q", "s", "e", "b", 1.0), ("q", "a", "e", "c", 1.0), ("p", "a", "e", "d", None)]
    df = spark.createDataFrame(links, EDGE)
    for project, names in (("p", {"a", "d"}), ("q", {"b"}), (None, {"a", "b", "c", "d"})):
        assert {r["entity_name"] for r in graph.traverse(df, ["s"], 3, project=project).collect()} == names


@pytest.mark.parametrize("name", ["graph_out", "graph_out_limited", "graph_in", "graph_both"])
def test_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert not differences(registry.QUERIES[name](spark, sf), connect(sf), registry.ORACLE_SQL[name])
