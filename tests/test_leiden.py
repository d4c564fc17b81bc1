"""Communities by modularity: against its definition, exhaustive search on small graphs, and label propagation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.operators import graph, leiden
from lorekeep.plans import registry
from lorekeep.sources.domain import edges, entities

registry.load()
SF = "/root/testdata/sf0.001"
EDGE = "from_entity string, to_entity string, weight double"


def quality(links, label):
    """Modularity by definition; links (u, v, w)."""
    a = {}
    for u, v, w in links:
        if u in label and v in label:
            w = w or 1.0
            a[u, v] = a.get((u, v), 0) + w
            a[v, u] = a.get((v, u), 0) + w
    k = {u: sum(w for (x, _), w in a.items() if x == u) for u in label}
    m2 = sum(k.values())
    return sum((a.get((u, v), 0) - k[u] * k[v] / m2) for u in label for v in label if label[u] == label[v]) / m2 if m2 else 0.0


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        for k in range(len(rest)):
            yield rest[:k] + [[items[0], *rest[k]]] + rest[k + 1 :]
        yield [[items[0]], *rest]


def is_connected(links, label):
    for c in set(label.values()):
        mine = {u for u in label if label[u] == c}
        seen, todo = set(), [min(mine)]
        while todo:
            u = todo.pop()
            if u not in seen:
                seen.add(u)
                todo += [y for x, y, _ in links if x == u and y in mine] + [x for x, y, _ in links if y == u and x in mine]
        if seen != mine:
            return False
    return True


def found(spark, links, names):
    df = leiden.leiden(spark.createDataFrame(links, EDGE), spark.createDataFrame([(n,) for n in names], "name string"))
    rows = df.collect()
    return {r["name"]: r["community"] for r in rows}, {r["modularity"] for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_small_graphs(spark, seed):
    rng = np.random.default_rng(seed)
    n = 8
    names = [f"n{k}" for k in range(n)]
    links = [(names[int(a)], names[int(b)], [None, 0.0, 1.0, 2.5][int(rng.integers(0, 4))]) for a, b in rng.integers(0, n, (14, 2))] + [("n0", "stranger", 5.0)]
    label, (q,) = found(spark, links, names)
    assert sorted(label) == names and is_connected(links, label)
    assert abs(q - quality(links, label)) < 1e-9
    best = max(quality(links, {u: i for i, p in enumerate(ps) for u in p}) for ps in partitions(names))
    assert q >= 0.9 * best
    assert all(c == min(u for u in label if label[u] == c) for c in label.values())


def test_cliques_and_hub(spark):
    """Two cliques with a bridge, a star, and nodes without edges."""
    links = [(f"{g}{i}", f"{g}{j}", None) for g in "ab" for i in range(6) for j in range(i)] + [("a0", "b0", 0.0)]
    links += [("hub", f"leaf{k}", 1.0) for k in range(200)]
    names = [f"{g}{i}" for g in "ab" for i in range(6)] + ["hub", "alone"] + [f"leaf{k}" for k in range(200)]
    label, (q,) = found(spark, links, names)
    assert {label[f"a{i}"] for i in range(6)} == {"a0"} and {label[f"b{i}"] for i in range(6)} == {"b0"}
    assert label["alone"] == "alone" and len({label[f"leaf{k}"] for k in range(200)} | {label["hub"]}) == 1
    assert abs(q - quality(links, label)) < 1e-9


def test_no_edges(spark):
    assert found(spark, [("x", "y", 1.0)], ["a", "b"]) == ({"a": "a", "b": "b"}, {0.0})
    assert leiden.leiden(spark.createDataFrame([], EDGE), spark.createDataFrame([], "name string")).count() == 0


def test_all_entities(spark):
    """Never less modular than label propagation, and every community connected."""
    e, n = edges(spark, SF), entities(spark, SF)
    rows = registry.QUERIES["graph_modular_communities"](spark, SF).collect()
    label, links = {r["name"]: r["community"] for r in rows}, [tuple(r) for r in e.select("from_entity", "to_entity", "weight").collect()]
    assert len(label) == n.select("name").distinct().count() and is_connected(links, label)
    q = leiden.modularity(e, spark.createDataFrame(list(label.items()), "name string, community string"))
    assert abs(q - rows[0]["modularity"]) < 1e-8 and q >= leiden.modularity(e, graph.communities(e, n)) - 1e-12


def test_no_rows_of_the_graph_go_through_the_driver(spark, monkeypatch):
    """Small as the tables of a round are, none is broadcast."""
    plans = []
    for name in ("written", "checkpoint"):
        real = getattr(leiden, name)
        monkeypatch.setattr(leiden, name, lambda df, real=real: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df))[1])
    e = spark.createDataFrame([(f"n{k}", f"n{k // 4 * 4}", 1.0) for k in range(40)] + [("n0", "n4", 0.5)], "from_entity string, to_entity string, weight double")
    got = leiden.leiden(e, e.select(F.col("from_entity").alias("name")))
    assert got.select("community").distinct().count() > 1
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) > 5 and not any("Broadcast" in p for p in plans)
