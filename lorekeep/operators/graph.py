"""Bounded traversal, communities, siblings and reply threads over edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.recovery import checkpoint

MAX_DEPTH = 5


def walks(edges: DataFrame, seeds: list[str], depth: int, direction: str = "out", project: str | None = None) -> DataFrame:
    """entity_name, depth, weight, edge_from, edge_type, edge_to of every simple path of 1 to depth edges from a seed.

    Unrolled joins, one a level.  A path is a row, as the answer needs the last edge of each.  With a project, only
    its edges are walked.
    """
    if project is not None:
        edges = edges.filter(F.col("project_id") == project)
    depth = max(1, min(MAX_DEPTH, depth))
    a, b = ("from_entity", "to_entity") if direction == "out" else ("to_entity", "from_entity")
    e = edges.select(F.col(a).alias("near"), F.col(b).alias("far"), F.col("weight").alias("w"), F.col("from_entity").alias("edge_from"), "edge_type", F.col("to_entity").alias("edge_to"))
    at = e.filter(F.col("near").isin(*seeds) & (F.col("far") != F.col("near"))).select(F.col("far").alias("entity_name"), F.lit(1).alias("depth"), F.col("w").alias("weight"), "edge_from", "edge_type", "edge_to", F.array("near", "far").alias("path"))
    levels = [at]
    for k in range(2, depth + 1):
        here = levels[-1].select("entity_name", "path")
        at = here.join(e, F.col("entity_name") == F.col("near")).filter(~F.array_contains("path", F.col("far"))).select(F.col("far").alias("entity_name"), F.lit(k).alias("depth"), F.col("w").alias("weight"), "edge_from", "edge_type", "edge_to", F.array_append("path", F.col("far")).alias("path"))
        levels.append(at)
    return reduce(DataFrame.unionByName, levels).drop("path")


def _steps(edges: DataFrame, direction: str, project: str | None) -> DataFrame:
    """near, far, w and the edge's own ends and type, in the direction of a walk; loops lie on no simple path."""
    if project is not None:
        edges = edges.filter(F.col("project_id") == project)
    a, b = ("from_entity", "to_entity") if direction == "out" else ("to_entity", "from_entity")
    return edges.filter(F.col(a) != F.col(b)).select(F.col(a).alias("near"), F.col(b).alias("far"), F.col("weight").alias("w"), F.col("from_entity").alias("edge_from"), "edge_type", F.col("to_entity").alias("edge_to"))


def _layers(e: DataFrame, seeds: list[str], depth: int) -> DataFrame:
    """node, depth, lo, hi of every node within depth: lo[k] and hi[k] are the least and greatest node at depth k on its shortest paths."""
    layers = [e.sparkSession.createDataFrame([(s,) for s in sorted(set(seeds))], "node string").select("node", F.lit(0).alias("depth"), F.array().cast("array<string>").alias("lo"), F.array().cast("array<string>").alias("hi"))]
    for k in range(1, depth + 1):
        x = layers[-1].join(e.select("near", "far").distinct(), F.col("node") == F.col("near"))
        ends = [F.struct(*[agg(F.when(F.lit(j == k - 1), F.col("near")).otherwise(F.get(c, F.lit(j)))).alias(f"k{j}") for j in range(k)]).alias(c) for c, agg in (("lo", F.min), ("hi", F.max))]
        x = x.groupBy("far").agg(*ends).select(F.col("far").alias("node"), F.lit(k).alias("depth"), *[F.array(*[F.col(c)[f"k{j}"] for j in range(k)]).alias(c) for c in ("lo", "hi")])
        for before in layers:
            x = x.join(before.select(F.col("node").alias("known")), F.col("node") == F.col("known"), "left_anti")
        layers.append(checkpoint(x) if k < depth else x)
    return reduce(DataFrame.unionByName, layers)


def _avoiding(e: DataFrame, pairs: DataFrame, seeds: list[str], most: int) -> DataFrame:
    """The pairs (n, x) for which a path of at most ``most`` edges leads from a seed to x without n: a frontier of (n, node), each once."""
    seen = pairs.select("n").distinct().select("n", F.explode(F.array(*[F.lit(s) for s in sorted(set(seeds))])).alias("node"))
    at, steps = seen, e.select("near", "far").distinct()
    for _ in range(most):
        new = at.join(steps, F.col("node") == F.col("near")).filter("far != n").select("n", F.col("far").alias("node")).distinct()
        at = checkpoint(new.join(seen, ["n", "node"], "left_anti"))
        seen = seen.unionByName(at)
    return pairs.join(seen.withColumnRenamed("node", "x"), ["n", "x"], "left_semi")


def _reached(edges: DataFrame, seeds: list[str], depth: int, direction: str, project: str | None) -> DataFrame:
    """entity_name, max_weight and rep (see ``traverse``) of one direction.

    A node's least depth and representative edge come from its shortest paths.  Its greatest last weight is that of an edge x to n such that some
    path of depth - 1 edges at most reaches x without n.  Shortest paths to x pass n at n's own depth or not at all, so the
    least and greatest node that they have there tell; only where all of them pass n, and a longer path has room, and the edge weighs more than
    those that are sure, are such paths looked for.
    """
    e = _steps(edges, direction, project)
    layers = checkpoint(_layers(e, seeds, depth))
    last = layers.filter(F.col("depth") < depth).select(F.col("node").alias("x"), F.col("depth").alias("x_depth"), "lo", "hi")
    to = layers.filter("depth > 0").select(F.col("node").alias("n"), F.col("depth").alias("n_depth"))
    x = e.join(last, F.col("near") == F.col("x")).join(to, F.col("far") == F.col("n"))
    around = (F.get("lo", F.col("n_depth")) != F.col("n")) | (F.get("hi", F.col("n_depth")) != F.col("n"))
    sure = (F.col("x_depth") <= F.col("n_depth")) | around
    # min of a struct: depth, then weight downwards with NULL first, then names, so that ties are settled
    order = F.struct(F.col("n_depth").alias("depth"), F.when(F.col("w").isNull(), F.lit(float("-inf"))).otherwise(-F.col("w")).alias("w"), "edge_from", "edge_type", "edge_to")
    best = x.groupBy("n").agg(F.max(F.when(sure, F.col("w"))).alias("max_weight"), F.min(F.when(F.col("x_depth") == F.col("n_depth") - 1, order)).alias("rep"))
    if depth > 3:  # else no longer path has room
        best = checkpoint(best)
        doubtful = x.filter(~sure & (F.col("x_depth") < depth - 1) & F.col("w").isNotNull()).groupBy("n", "x").agg(F.max("w").alias("w"))
        doubtful = checkpoint(doubtful.join(best.select(F.col("n").alias("of_n"), "max_weight"), (F.col("n") == F.col("of_n")) & (F.col("max_weight").isNull() | (F.col("w") > F.col("max_weight")))).select("n", "x", "w"))
        if not doubtful.isEmpty():
            more = _avoiding(e, doubtful, seeds, depth - 1).groupBy(F.col("n").alias("of_n")).agg(F.max("w").alias("more"))
            best = best.join(more, F.col("n") == F.col("of_n"), "left").select("n", F.greatest("max_weight", "more").alias("max_weight"), "rep")
    return best.withColumnRenamed("n", "entity_name")


def traverse(edges: DataFrame, seeds: list[str], depth: int = 2, direction: str = "out", limit: int | None = None, project: str | None = None) -> DataFrame:
    """Nodes within depth of the seeds: least depth, greatest known last weight of a simple path, and a representative edge.

    ``both`` unites the walks along and against the edges; no path mixes them.  Suppressed edges count.  Paths aren't listed: see ``_reached``;
    a node is a row a layer, so that hubs and cliques cost what their edges do.
    """
    depth = max(1, min(MAX_DEPTH, depth))
    ways = ["out", "in"] if direction == "both" else [direction]
    found = reduce(DataFrame.unionByName, [_reached(edges, seeds, depth, w, project) for w in ways])
    if len(ways) > 1:
        found = found.groupBy("entity_name").agg(F.max("max_weight").alias("max_weight"), F.min("rep").alias("rep"))
    x = found.select("entity_name", F.col("rep.depth").alias("min_depth"), "max_weight", F.col("rep.edge_from").alias("rep_from"), F.col("rep.edge_type").alias("rep_edge_type"), F.col("rep.edge_to").alias("rep_to"))
    return x if limit is None else x.orderBy("min_depth", F.desc_nulls_first("max_weight"), "entity_name").limit(limit)


def communities(edges: DataFrame, nodes: DataFrame, rounds: int = 10) -> DataFrame:
    """name, community, settled of each node, by weighted label propagation over undirected edges, to a fixed point or for so many rounds.

    ``settled`` says of all nodes whether the fixed point was reached, that is whether a further round would change no label.
    NULL or zero weights count as 1, edges to unknown nodes don't count.  In every round a node takes the
    label of the greatest summed weight among its neighbours and itself (its own label weighs as much as its heaviest edge,
    which keeps two-sided graphs from swapping labels for ever), the smallest of those that tie.  Nodes without edges stay alone.
    Sums are partial before the shuffle, so that a hub of any degree is no single group; lineage is cut every round.
    """
    names = nodes.select("name").distinct()
    w = F.when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight"))
    e = edges.filter("from_entity != to_entity").select(F.col("from_entity").alias("u"), F.col("to_entity").alias("v"), w.alias("w"))
    e = e.join(names.withColumnRenamed("name", "n1"), F.col("u") == F.col("n1"), "left_semi").join(names.withColumnRenamed("name", "n2"), F.col("v") == F.col("n2"), "left_semi")
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")).groupBy("u", "v").agg(F.sum("w").alias("w"))
    own = both.groupBy("u").agg(F.max("w").alias("w")).select("u", F.col("u").alias("v"), "w")
    links = checkpoint(both.unionByName(own))
    label, settled = names.select(F.col("name").alias("node"), F.col("name").alias("community")), False
    for _ in range(rounds):
        votes = links.join(label, F.col("v") == F.col("node")).groupBy("u", "community").agg(F.round(F.sum("w"), 9).alias("w"))
        won = votes.groupBy(F.col("u").alias("won")).agg(F.min(F.struct((-F.col("w")).alias("w"), "community")).alias("best"))
        now = F.coalesce("best.community", "community")
        new = checkpoint(label.join(won, F.col("node") == F.col("won"), "left").select("node", now.alias("community"), (now != F.col("community")).alias("moved")))
        label, settled = new.drop("moved"), new.filter("moved").isEmpty()
        if settled:
            break
    return label.withColumnRenamed("node", "name").withColumn("settled", F.lit(settled))


def siblings(members: DataFrame, hits: list[str], limit: int) -> DataFrame:
    """Other members (entity_name) of the hits' communities, by name, at most limit: a report."""
    of = members.filter(F.col("entity_name").isin(*hits)).select(F.col("community_id").alias("cid")).distinct()
    x = members.join(of, F.col("community_id") == F.col("cid"), "left_semi").filter(~F.col("entity_name").isin(*hits))
    return x.select("entity_name").distinct().orderBy("entity_name").limit(limit)


def thread_roots(log: DataFrame) -> DataFrame:
    """id, root, depth of every message, by pointer doubling: a thread of n messages takes log n joins.

    Messages that answer each other in a circle, and those below them, have no root: their root and depth are NULL.
    """
    x = log.select("id", F.coalesce("parent_id", "id").alias("root"), F.when(F.col("parent_id").isNull() | (F.col("parent_id") == F.col("id")), 0).otherwise(1).cast("long").alias("depth"))
    x = checkpoint(x)
    for _ in range(x.count().bit_length() + 1):  # as many doublings as the longest possible thread needs
        up = x.select(F.col("id").alias("up_id"), F.col("root").alias("up_root"), F.col("depth").alias("up_depth"))
        root = F.coalesce("up_root", "root")
        new = checkpoint(x.join(up, F.col("root") == F.col("up_id"), "left").select("id", root.alias("root"), (F.col("depth") + F.coalesce("up_depth", F.lit(0))).alias("depth"), (root != F.col("root")).alias("moved")))
        x = new.drop("moved")
        if new.filter("moved").isEmpty():
            break
    # what circles may come to rest on a message that isn't a thread's first
    first = log.filter("parent_id is null or parent_id = id").select(F.col("id").alias("first_id"))
    missing = log.select(F.col("id").alias("known_id"))
    y = x.join(first, F.col("root") == F.col("first_id"), "left").join(missing, F.col("root") == F.col("known_id"), "left")
    whole = F.col("first_id").isNotNull() | F.col("known_id").isNull()
    return y.select("id", F.when(whole, F.col("root")).alias("root"), F.when(whole, F.col("depth")).alias("depth"))
