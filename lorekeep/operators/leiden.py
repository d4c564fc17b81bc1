"""Communities of greatest modularity, by moves, refinement and contraction over edge tables.

A level is a table of links (u, v, w: both directions, loops too) and one of nodes with their weighted degrees.  Nodes move
in rounds to the neighbouring community that gains most; a round lets a hashed share of the nodes move, and is taken
back, the share then halved, if all moves together lose modularity.  Communities are then refined: each starts again from
single nodes, which only join a connected part that stays put in that round, so that every refined part is connected.
The parts are the nodes of the next level.  What is left in the end is split into connected components.

Joins that carry labels along links are dealt out over SALTS copies of a label, of which only those that some link asks for
are made: a hub is no single key.  All joins are of sorted shuffles: what grows with the graph mustn't be broadcast while it is still
small, as that goes through the driver in every round.  Lineage is cut every round, and only sums reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.recovery import checkpoint, written

SALTS = 32
ROUNDS = 16
LEVELS = 10
LEAST_SHARE = 16  # a share of one in so many nodes is the last that is tried
GAIN = 1e-9


class _Level:
    """links (u, v, w, salt) of one level, the copies of labels that they ask for, and each node's degree."""

    def __init__(self, links: DataFrame):
        self.links = checkpoint(links.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int")))
        self.asked = checkpoint(self.links.select(F.col("v").alias("asked_v"), F.col("salt").alias("asked_salt")).distinct())
        self.nodes = checkpoint(self.links.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k")))
        self.total = self.nodes.agg(F.sum("k")).first()[0] or 0.0

    def carried(self, label: DataFrame, of: str, name: str, links: DataFrame | None = None) -> DataFrame:
        """links with the label ``of`` of v as ``name``."""
        copies = label.select("node", F.col(of).alias(name)).hint("merge").join(self.asked, F.col("node") == F.col("asked_v")).select("asked_v", "asked_salt", name)
        x = self.links if links is None else links
        return x.hint("merge").join(copies, (F.col("v") == F.col("asked_v")) & (F.col("salt") == F.col("asked_salt"))).drop("asked_v", "asked_salt")


def undirected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (u, v, w) of both directions between known nodes, one a pair: NULL or zero weights count as 1, a loop counts twice."""
    names = nodes.select("name").distinct()
    w = F.when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight"))
    e = edges.select(F.col("from_entity").alias("u"), F.col("to_entity").alias("v"), w.alias("w"))
    for side in ("u", "v"):
        e = e.hint("merge").join(names.withColumnRenamed("name", "known"), F.col(side) == F.col("known"), "left_semi")
    return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")).groupBy("u", "v").agg(F.sum("w").alias("w"))


def _weighed(level: _Level, label: DataFrame, may: Column, moves: Column, links: DataFrame | None = None) -> DataFrame:
    """node, own, target, next, inside, chance of every node, written out.

    target is the community for which ``may`` holds (of columns u, own, community, members, w) that gains most by the node's
    moving there, the least name of those that tie, or NULL if none gains; next is target where ``moves`` holds (of node and members, how many its own
    community has), else own.  The sums of inside and chance give the modularity.
    """
    x = level.carried(label, "community", "community", links)
    loop = F.col("u") == F.col("v")
    near = x.groupBy("u", "community").agg(F.sum(F.when(loop, 0.0).otherwise(F.col("w"))).alias("w"), F.sum(F.when(loop, F.col("w")).otherwise(0.0)).alias("loop"))
    mine = label.hint("merge").join(level.nodes, "node").select(F.col("node").alias("u"), "k", F.col("community").alias("own"))
    near = near.unionByName(mine.select("u", F.col("own").alias("community"), F.lit(0.0).alias("w"), F.lit(0.0).alias("loop"))).groupBy("u", "community").agg(F.sum("w").alias("w"), F.sum("loop").alias("loop"))
    totals = mine.groupBy(F.col("own").alias("community")).agg(F.sum("k").alias("total"), F.count("*").alias("members"))
    own = F.col("community") == F.col("own")
    gain = F.round(F.col("w") - F.col("k") * (F.col("total") - F.when(own, F.col("k")).otherwise(0.0)) / level.total, 12)
    x = near.hint("merge").join(mine, "u").hint("merge").join(totals, "community").withColumn("gain", gain)
    x = x.groupBy(F.col("u").alias("node")).agg(
        F.first("own").alias("own"),
        F.min(F.when(~own & may, F.struct((-F.col("gain")).alias("g"), "community"))).alias("best"),
        F.max(F.when(own, F.col("gain"))).alias("stay"),
        F.max(F.when(own, F.col("members"))).alias("members"),
        F.sum(F.when(own, F.col("w") + F.col("loop"))).alias("inside"),
        F.sum(F.when(own, F.col("k") * F.col("total"))).alias("chance"),  # of a community, the sum of k * total is total squared
    )
    target = F.when(-F.col("best.g") > F.col("stay") + GAIN, F.col("best.community"))
    return written(x.select("node", "own", target.alias("target"), F.when(moves, F.coalesce(target, "own")).otherwise(F.col("own")).alias("next"), "inside", "chance"))


def _sums(x: DataFrame, total: float) -> tuple[float, int]:
    """(modularity, nodes that gain by moving)."""
    r = x.agg(F.sum("inside").alias("i"), F.sum("chance").alias("c"), F.count("target").alias("n")).first()
    return (r["i"] or 0.0) / total - (r["c"] or 0.0) / total**2, r["n"]


def _share(node: str, k: int, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(k), F.col(node)), F.lit(parts)) == 0


def _moved(level: _Level, label: DataFrame) -> DataFrame:
    """Labels (node, community) after moves that gain modularity."""
    best, parts, kept = float("-inf"), 2, None
    for k in range(ROUNDS):
        now = _weighed(level, label, F.lit(True), _share("node", k, parts))
        q, wish = _sums(now, level.total)
        if q >= best - 1e-12:
            kept, best = now, q
            if not wish:
                break
            label = kept.select("node", F.col("next").alias("community"))
        else:
            parts *= 2
            if parts > LEAST_SHARE:
                break
            label = kept.select("node", F.when(_share("node", k, parts), F.coalesce("target", "own")).otherwise(F.col("own")).alias("community"))
    return kept.select("node", F.col("own").alias("community"))


def _refined(level: _Level, label: DataFrame) -> DataFrame:
    """node, part: connected parts of each community, grown from single nodes."""
    inside = level.carried(label, "community", "far").hint("merge").join(label.select(F.col("node").alias("u"), F.col("community").alias("near")), "u")
    inside = checkpoint(inside.filter((F.col("near") == F.col("far")) & (F.col("u") != F.col("v"))).select("u", "v", "w", "salt"))
    part, idle = label.select("node", F.col("node").alias("community")), 0
    for k in range(ROUNDS):
        # a part stays put in this round unless it is a single node of the round's share, which may join
        still = (F.col("members") > 1) | ~_share("community", k, 2)
        x = _weighed(level, part, (F.col("w") > 0) & still, _share("node", k, 2) & (F.col("members") == 1), inside)
        part = x.select("node", F.col("next").alias("community"))
        idle = idle + 1 if x.filter("own != next").isEmpty() else 0
        if idle == 2:
            break
    return checkpoint(part.withColumnRenamed("community", "part"))


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, root: the least node that each of nodes (node) is linked with, by links (u, v) of both directions; pointers double every round."""
    level = _Level(links.withColumn("w", F.lit(1.0)))
    root = checkpoint(nodes.select("node", F.col("node").alias("root")))
    while True:
        near = level.carried(root, "root", "far").groupBy(F.col("u").alias("u_")).agg(F.min("far").alias("far"))
        x = root.hint("merge").join(near, F.col("node") == F.col("u_"), "left").select("node", "root", F.least("root", F.coalesce("far", "root")).alias("least"))
        up = x.select(F.col("node").alias("up_node"), F.col("least").alias("up"))
        x = written(x.hint("merge").join(up, F.col("least") == F.col("up_node")).select("node", F.least("least", "up").alias("root"), (F.least("least", "up") != F.col("root")).alias("moved")))
        root = x.drop("moved")
        if x.filter("moved").isEmpty():
            return root


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Modularity of labels (name, community) over edges (from_entity, to_entity, weight) between labelled nodes; 0 without edges."""
    level = _Level(undirected(edges, labels))
    if not level.total:
        return 0.0
    label = labels.select(F.col("name").alias("node"), "community").hint("merge").join(level.nodes.select("node"), "node", "left_semi")
    return _sums(_weighed(level, label, F.lit(True), F.lit(False)), level.total)[0]


def leiden(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """name, community, modularity of every node (name): communities are connected, and named by their least node.

    Edges (from_entity, to_entity, weight) have no direction; those to unknown nodes don't count, NULL or zero weights count as 1, and
    edges that repeat add up.  Nodes without edges are alone; without edges at all every node is, and the modularity is 0.
    """
    names = checkpoint(nodes.select(F.col("name").alias("node")).distinct())
    links = checkpoint(undirected(edges, nodes))
    level = first = _Level(links)
    if not level.total:
        return names.select(F.col("node").alias("name"), F.col("node").alias("community"), F.lit(0.0).alias("modularity"))
    where = level.nodes.select(F.col("node").alias("name"), "node")  # the node of the level that each first node is in
    label = level.nodes.select("node", F.col("node").alias("community"))
    for _ in range(LEVELS):
        label = _moved(level, label)
        part = _refined(level, label)
        final = checkpoint(where.hint("merge").join(label, "node").select("name", "community"))
        n, parts = level.nodes.count(), part.select("part").distinct().count()
        if parts == n:
            break
        where = checkpoint(where.hint("merge").join(part, "node").select("name", F.col("part").alias("node")))
        label = checkpoint(label.hint("merge").join(part, "node").select(F.col("part").alias("node"), "community").distinct())
        far = level.carried(part, "part", "far").drop("salt")
        near = part.select(F.col("node").alias("u"), F.col("part").alias("near"))
        level = _Level(far.hint("merge").join(near, "u").groupBy(F.col("near").alias("u"), F.col("far").alias("v")).agg(F.sum("w").alias("w")))
    # parts of a community that aren't connected are communities of their own: that always gains
    of = final.select(F.col("name").alias("node"), "community")
    far = first.carried(of, "community", "far_community")
    inside = far.hint("merge").join(of.select(F.col("node").alias("u"), F.col("community").alias("near_community")), "u").filter("near_community = far_community and u != v").select("u", "v")
    found = components(inside, names).select(F.col("node").alias("name"), F.col("root").alias("community"))
    found = checkpoint(found)
    label = found.withColumnRenamed("name", "node").hint("merge").join(first.nodes.select("node"), "node", "left_semi")
    q = _sums(_weighed(first, label, F.lit(True), F.lit(False)), first.total)[0]
    return found.withColumn("modularity", F.lit(q))
