"""Queries over the entity graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.operators import graph, leiden
from lorekeep.plans.registry import query
from lorekeep.sources.domain import edges, entities, with_tables
from lorekeep.sources.tables import table


def _paths_sql(direction: str, seeds: str, depth: int) -> str:
    """Simple paths by their first edge and what follows: the node reached, the nodes seen, the number of edges, the last edge."""
    near, far = ("from_entity", "to_entity") if direction == "out" else ("to_entity", "from_entity")
    last = "struct_pack(w := e.weight, a := e.from_entity, kind := e.edge_type, b := e.to_entity)"
    return f"""paths_{direction}(tip, seen, hops, edge) AS (
  SELECT {far}, [{near}, {far}], 1, {last} FROM edges e WHERE {near} IN ({seeds}) AND {near} <> {far}
  UNION ALL SELECT e.{far}, p.seen || [e.{far}], p.hops + 1, {last} FROM edges e, paths_{direction} p WHERE p.tip = e.{near} AND p.hops < {depth} AND list_position(p.seen, e.{far}) IS NULL)"""


def _traverse_sql(directions: list[str], seeds: list[str], depth: int, limit: str = "") -> str:
    s = ", ".join(f"'{x}'" for x in seeds)
    every = " UNION ALL ".join(f"SELECT tip, hops, edge FROM paths_{d}" for d in directions)
    body = f"""SELECT tip AS entity_name, CAST(min(hops) AS INTEGER) AS min_depth, max(edge.w) AS max_weight, min(r).edge.a AS rep_from, min(r).edge.kind AS rep_edge_type, min(r).edge.b AS rep_to
FROM (SELECT tip, hops, edge, struct_pack(h := hops, v := coalesce(-edge.w, CAST('-infinity' AS DOUBLE)), edge := struct_pack(a := edge.a, kind := edge.kind, b := edge.b)) AS r FROM ({every}) WHERE tip NOT IN ({s})) GROUP BY tip{limit}"""
    return with_tables("edges", body, *[_paths_sql(d, s, depth) for d in directions], recursive=True)


LIMIT = "\nORDER BY min_depth, max_weight DESC NULLS FIRST, entity_name LIMIT 25"


@query(_traverse_sql(["out"], ["ASIA", "NATION_3"], 2))
def graph_out(spark, sf_dir):
    """Two steps along the edges."""
    return graph.traverse(edges(spark, sf_dir), ["ASIA", "NATION_3"], 2)


@query(_traverse_sql(["out"], ["NATION_7"], 3, LIMIT))
def graph_out_limited(spark, sf_dir):
    return graph.traverse(edges(spark, sf_dir), ["NATION_7"], 3, limit=25)


@query(_traverse_sql(["in"], ["Customer#000000010"], 4))
def graph_in(spark, sf_dir):
    """Four steps against the edges, through the cycles of nations."""
    return graph.traverse(edges(spark, sf_dir), ["Customer#000000010"], 4, "in")


@query(_traverse_sql(["out", "in"], ["NATION_11"], 2))
def graph_both(spark, sf_dir):
    """Walks along and against the edges, which don't mix."""
    return graph.traverse(edges(spark, sf_dir), ["NATION_11"], 2, "both")


@query(with_tables("entities", """SELECT DISTINCT entity_name FROM m WHERE cid IN (SELECT cid FROM m WHERE entity_name IN ('NATION_3', 'NATION_4')) AND entity_name NOT IN ('NATION_3', 'NATION_4') ORDER BY entity_name LIMIT 40""",
    "m AS (SELECT name AS entity_name, id % 13 AS cid FROM entities)"))
def community_siblings(spark, sf_dir):
    """Other members of the hits' communities."""
    m = entities(spark, sf_dir).select(F.col("name").alias("entity_name"), F.pmod("id", F.lit(13)).alias("community_id"))
    return graph.siblings(m, ["NATION_3", "NATION_4"], 40)


@query()
def graph_communities(spark, sf_dir):
    """Communities of all entities over all edges by label propagation (iterative: no SQL form)."""
    return graph.communities(edges(spark, sf_dir), entities(spark, sf_dir))


@query()
def graph_modular_communities(spark, sf_dir):
    """Connected communities of great modularity of all entities over all edges (iterative: no SQL form)."""
    return leiden.leiden(edges(spark, sf_dir), entities(spark, sf_dir)).withColumn("modularity", F.round("modularity", 9))


@query("""SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY l_suppkey""")
def supplier_degrees(spark, sf_dir):
    """Degrees of a bipartite graph."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_orderkey").alias("n_orders"))
