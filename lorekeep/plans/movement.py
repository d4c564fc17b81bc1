"""Queries of moving rows between stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.operators import movement
from lorekeep.plans.registry import query
from lorekeep.sources.tables import table

TOPIC = "lower(replace(p_type, ' ', '-')) || '-' || replace(p_name, ' ', '-') || '-' || p_size"


def _topics(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = F.concat_ws("-", F.lower(F.replace("p_type", F.lit(" "), F.lit("-"))), F.replace("p_name", F.lit(" "), F.lit("-")), F.col("p_size").cast("string"))
    return p.select("p_partkey", name.alias("topic"))


@query(f"""SELECT p_partkey, topic, CASE WHEN array_to_string(string_split(topic, '-')[1:2], '-') = 'economy-red' THEN 'red-store' WHEN string_split(topic, '-')[1] = 'economy' THEN 'cheap' WHEN string_split(topic, '-')[1] = 'standard' THEN 'usual'
  ELSE 'unmatched-' || string_split(topic, '-')[1] END AS tenant FROM (SELECT p_partkey, {TOPIC} AS topic FROM part)""")
def routed_by_rules(spark, sf_dir):
    """The first rule that matches: two tokens literally, or the first token."""
    return movement.routed_by_rules(_topics(spark, sf_dir), "topic", [("literal", "economy-red", "red-store"), ("wildcard", "economy", "cheap"), ("wildcard", "standard", "usual")])


@query(f"""SELECT p_partkey, tenant, CASE WHEN tenant IS NULL THEN 'unmapped-branch-' || topic END AS verdict FROM (SELECT p_partkey, topic, CASE WHEN starts_with(topic, 'economy-b') THEN 'eb' WHEN starts_with(topic, 'economy') THEN 'e' WHEN starts_with(topic, 's') THEN 's' END AS tenant
  FROM (SELECT p_partkey, {TOPIC} AS topic FROM part))""")
def routed_by_prefix(spark, sf_dir):
    """The longest prefix wins."""
    return movement.routed_by_prefix(_topics(spark, sf_dir), "topic", {"s": "s", "economy": "e", "economy-b": "eb"}).select("p_partkey", "tenant", "verdict")


@query("""SELECT doc_id, coalesce(source, tenant, 'orphan') AS source FROM (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN source END AS source, lang FROM documents) LEFT JOIN (VALUES ('en', 'english'), ('fr', 'french')) m(l, tenant) ON lang = l""")
def filled_tenants(spark, sf_dir):
    """NULL tenants by a lookup, then a constant."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.pmod("doc_id", F.lit(3)) > 0, F.col("source")).alias("source"), "lang")
    m = spark.createDataFrame([("en", "english"), ("fr", "french")], "l string, tenant string")
    return movement.filled(d, "source", m, on="l", value="tenant", key="lang", otherwise="orphan").select("doc_id", "source")


@query("""SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_suppkey % 4 > 0 THEN 'line' END, o_orderpriority) AS tenant FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def filled_from_parent(spark, sf_dir):
    """A child's missing tenant is its parent's."""
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.pmod("l_suppkey", F.lit(4)) > 0, "line").alias("tenant"))
    parents = table(spark, sf_dir, "orders")
    known = x.join(parents.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return movement.filled(known, "tenant", parents, on="o_orderkey", value="o_orderpriority", key="l_orderkey").select("l_orderkey", "l_linenumber", "tenant")


@query("""SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_suppkey % 4 > 0 THEN 'line' END, o_orderpriority) AS tenant FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def lines_filled_from_parent(spark, sf_dir):
    """Every child's missing tenant is its parent's."""
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.pmod("l_suppkey", F.lit(4)) > 0, "line").alias("tenant"))
    parents = table(spark, sf_dir, "orders")
    known = x.join(parents.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return movement.filled(known, "tenant", parents, on="o_orderkey", value="o_orderpriority", key="l_orderkey").select("l_orderkey", "l_linenumber", "tenant")


@query("SELECT count(*) AS n_before, count(*) AS n_after, count(*) FILTER (doc_id % 3 = 0) AS n_null, count(*) FILTER (doc_id % 3 = 0) = 0 AS passed FROM documents")
def not_null_gate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return movement.not_null_gate(d, d.withColumn("source", F.when(F.pmod("doc_id", F.lit(3)) > 0, F.col("source"))), "source")


@query("SELECT s_suppkey AS id, s_name AS title, 'suppliers' AS origin FROM supplier")
def projected_rows(spark, sf_dir):
    return movement.projected(table(spark, sf_dir, "supplier"), {"s_suppkey": "id", "s_name": "title"}, {"origin": "suppliers"})


@query("""SELECT o_orderkey, k + 100000 AS new_key, CASE WHEN o.k0 IS NULL THEN 'null' WHEN k IS NOT NULL THEN 'remapped' ELSE 'dangling' END AS key_state FROM (SELECT o_orderkey, CASE WHEN o_custkey % 8 > 0 THEN o_custkey END AS k0 FROM orders) o
LEFT JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey % 5 > 0) c ON o.k0 = c.k""")
def remapped_keys(spark, sf_dir):
    """Foreign keys by lineage: NULL, remapped or dangling."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.pmod("o_custkey", F.lit(8)) > 0, F.col("o_custkey")).alias("k"))
    l = table(spark, sf_dir, "customer").filter(F.pmod("c_custkey", F.lit(5)) > 0).select(F.col("c_custkey").alias("old_id"), (F.col("c_custkey") + 100_000).alias("new_id"))  # noqa: E741
    return movement.remapped(o, "k", l).select("o_orderkey", "new_key", "key_state")


@query("""SELECT l_partkey AS left_id, l_suppkey AS right_id, l_partkey * 10 AS new_left, l_suppkey * 100 AS new_right, count(*) AS n FROM lineitem WHERE l_partkey % 3 = 0 AND l_suppkey % 4 = 1 GROUP BY ALL""")
def bridged_rows(spark, sf_dir):
    """Bridge rows both of whose parents moved."""
    b = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("left_id"), F.col("l_suppkey").alias("right_id"))
    a = table(spark, sf_dir, "part").filter(F.pmod("p_partkey", F.lit(3)) == 0).select(F.col("p_partkey").alias("old_id"), (F.col("p_partkey") * 10).alias("new_id"))
    c = table(spark, sf_dir, "supplier").filter(F.pmod("s_suppkey", F.lit(4)) == 1).select(F.col("s_suppkey").alias("old_id"), (F.col("s_suppkey") * 100).alias("new_id"))
    return movement.bridged(b, a, c).groupBy("left_id", "right_id", "new_left", "new_right").agg(F.count("*").alias("n"))


@query("""SELECT k, a.n AS n_a, b.n AS n_b FROM (SELECT o_custkey % 5000 AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a JOIN (SELECT o_custkey % 5000 AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) b USING (k)""")
def shared_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("k", F.pmod("o_custkey", F.lit(5000)))
    return movement.shared_keys(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'P'"), "k")


@query("""WITH m AS (SELECT l_orderkey AS owner, CASE WHEN l_orderkey % 3 > 0 AND l_linenumber > 2 THEN 'host' || (l_linenumber % 2) END AS host, l_linenumber AS ord FROM lineitem)
SELECT owner, ord FROM m WHERE host = 'host1' OR owner NOT IN (SELECT owner FROM m WHERE host IS NOT NULL)""")
def host_markers(spark, sf_dir):
    """This host's markers, or all of an owner's if none names a host."""
    k = F.col("l_orderkey")
    m = table(spark, sf_dir, "lineitem").select(k.alias("owner"), F.when((F.pmod(k, F.lit(3)) > 0) & (F.col("l_linenumber") > 2), F.concat(F.lit("host"), F.pmod("l_linenumber", F.lit(2)))).alias("host"), F.col("l_linenumber").alias("ord"))
    return movement.host_markers(m, "host1").select("owner", "ord")


@query("""WITH m AS (SELECT l_orderkey AS owner, l_linenumber AS ord, CASE WHEN l_orderkey % 4 = 0 THEN 'old-' || l_linenumber WHEN l_linenumber % 3 = 0 THEN 'n/a' ELSE strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') END AS ts, l_partkey, l_suppkey FROM lineitem)
SELECT owner, first(ts ORDER BY try_cast(ts AS TIMESTAMP) IS NULL, try_cast(ts AS TIMESTAMP) DESC, CASE WHEN try_cast(ts AS TIMESTAMP) IS NULL THEN -ord ELSE ord END, ts) AS ts FROM m GROUP BY owner""")
def latest_markers(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    ts = F.when(F.pmod("l_orderkey", F.lit(4)) == 0, F.concat(F.lit("old-"), "l_linenumber")).when(F.pmod("l_linenumber", F.lit(3)) == 0, "n/a").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))
    return movement.latest_marker(x.select(F.col("l_orderkey").alias("owner"), F.col("l_linenumber").alias("ord"), ts.alias("ts")))


@query("""WITH own AS (SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'stale' ELSE 't' || (p_size % 4) END AS tenant FROM part) SELECT p_partkey, tenant FROM own WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = own.p_partkey AND 't' || (p.p_size % 4) = own.tenant)""")
def reclassified_rows(spark, sf_dir):
    """Rows of an earlier run whose tenant has changed."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("t"), F.pmod("p_size", F.lit(4))).alias("tenant"))
    own = p.withColumn("tenant", F.when(F.pmod("p_partkey", F.lit(6)) == 0, "stale").otherwise(F.col("tenant")))
    return movement.reclassified(own, p, "p_partkey")


@query("""SELECT tenant, path, array_to_string(list_sort(list_distinct(list(id))), ',') AS ids FROM (SELECT doc_id AS id, source AS tenant, 'notes/' || lang || '/' || (doc_id % 9) AS path FROM documents) GROUP BY tenant, path HAVING count(DISTINCT id) > 1""")
def path_divergence(spark, sf_dir):
    """Paths that several entries of a tenant claim, slashes and case aside."""
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("Notes"), F.when(F.pmod(k, F.lit(2)) == 0, "\\").otherwise("//"), "lang", F.lit("/"), F.pmod(k, F.lit(9)))
    x = movement.divergence(d.select(k.alias("id"), F.col("source").alias("project_id")), d.select(k.alias("entry_id"), path.alias("path")))
    return x.select("tenant", "path", F.array_join("ids", ",").alias("ids"))
