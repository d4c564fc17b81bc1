"""Queries of joins: hits, orphans, containment, contradictions, mentions, routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.functions.expr import compare_key, entity_shaped, live
from lorekeep.operators import joins
from lorekeep.plans.registry import query
from lorekeep.sources.domain import chunks, edges, entities, entries, facts, with_tables
from lorekeep.sources.tables import table


@query(with_tables("chunks entries", """SELECT entry_id, chunk_idx, count(*) OVER (PARTITION BY entry_id) AS total_chunks, name AS label, substring(content, 1, 300) AS snippet
FROM chunks JOIN entries ON entry_id = id"""))
def chunk_hits(spark, sf_dir):
    return joins.chunk_hits(chunks(spark, sf_dir), entries(spark, sf_dir)).drop("content")


@query(with_tables("chunks entries", """SELECT e.id, e.name, count(c.entry_id) AS n_chunks FROM entries e LEFT JOIN (SELECT * FROM chunks WHERE length(content) > 200) c ON c.entry_id = e.id GROUP BY e.id, e.name"""))
def entries_with_chunk_counts(spark, sf_dir):
    """Left outer: entries without long chunks count 0."""
    return joins.with_chunk_counts(entries(spark, sf_dir).select("id", "name"), chunks(spark, sf_dir).filter(F.length("content") > 200))


@query("""WITH w AS (SELECT TIMESTAMP '1996-03-01' + to_days(CAST(n_nationkey * 40 AS INTEGER)) AS a, CASE WHEN n_nationkey % 5 > 0 THEN TIMESTAMP '1996-03-01' + to_days(CAST(n_nationkey * 40 + 9 AS INTEGER)) END AS b FROM nation WHERE n_nationkey < 12)
SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM w WHERE o_orderdate BETWEEN a AND coalesce(b, a + INTERVAL 3 DAY))""")
def written_in_windows(spark, sf_dir):
    """Semi join with a range: rows written in any of a few windows, open ones ending after three days."""
    n = table(spark, sf_dir, "nation").filter("n_nationkey < 12")
    start = F.timestamp_add("DAY", (F.col("n_nationkey") * 40).cast("int"), F.lit("1996-03-01").cast("timestamp_ntz"))
    w = n.select(start.alias("enabled_at"), F.when(F.pmod("n_nationkey", F.lit(5)) > 0, F.timestamp_add("DAY", F.lit(9), start)).alias("disabled_at"))
    return joins.written_in_window(table(spark, sf_dir, "orders"), w, "o_orderdate", F.timestamp_add("DAY", F.lit(3), F.col("enabled_at"))).select("o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def customers_without_orders(spark, sf_dir):
    return joins.missing(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query(with_tables("edges entities", """SELECT from_entity, to_entity, f.name IS NULL AS missing_from, t.name IS NULL AS missing_to FROM edges g
LEFT JOIN (SELECT * FROM entities WHERE NOT suppressed) f ON f.project_id = g.project_id AND f.name = from_entity
LEFT JOIN (SELECT * FROM entities WHERE NOT suppressed) t ON t.project_id = g.project_id AND t.name = to_entity WHERE f.name IS NULL OR t.name IS NULL"""))
def orphan_edges(spark, sf_dir):
    """Edges one of whose ends is no unsuppressed entity."""
    return joins.orphan_edges(edges(spark, sf_dir), entities(spark, sf_dir).filter("not suppressed")).select("from_entity", "to_entity", "missing_from", "missing_to")


@query(with_tables("edges entities", """SELECT id, name, entity_type FROM entities e WHERE NOT EXISTS (SELECT 1 FROM edges g WHERE g.from_entity = e.name) AND NOT EXISTS (SELECT 1 FROM edges g WHERE g.to_entity = e.name)"""))
def orphan_entities(spark, sf_dir):
    return joins.orphan_entities(entities(spark, sf_dir), edges(spark, sf_dir)).select("id", "name", "entity_type")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def parts_never_in_bulk(spark, sf_dir):
    return joins.missing(table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem").filter("l_quantity > 45"), "p_partkey", "l_partkey").select("p_partkey")


@query(with_tables("facts", """SELECT DISTINCT x.project_id, x.who AS subject, x.predicate, least(x.id, f.first) AS a, greatest(x.id, f.first) AS b FROM x JOIN f ON x.project_id = f.project_id AND x.who = f.who AND x.predicate = f.predicate AND x.said <> f.said""",
    "x AS (SELECT *, lower(trim(subject)) AS who, lower(object) AS said FROM facts WHERE NOT suppressed AND invalid_at IS NULL AND predicate IN ('signup', 'purchase'))",
    "f AS (SELECT project_id, who, predicate, said, min(id) AS first FROM x GROUP BY ALL)"))
def contradicting_facts(spark, sf_dir):
    """Live facts of one subject and 1:1 predicate that say different things."""
    return joins.contradictions(facts(spark, sf_dir).filter(live()), ["signup", "purchase"], F.lower("object"))


@query(with_tables("entities edges", """SELECT DISTINCT f.id, f.project_id, f.subject AS entity, m.name AS mentioned FROM f JOIN entities m ON m.name <> f.subject AND length(m.name) >= 4 AND regexp_matches(f.object, '(?i)\\b' || m.name || '\\b')
WHERE NOT EXISTS (SELECT 1 FROM edges g WHERE (g.from_entity = f.subject AND g.to_entity = m.name) OR (g.to_entity = f.subject AND g.from_entity = m.name))""",
    """f AS (SELECT s_suppkey AS id, 'geo' AS project_id, s_name AS subject, 'ships from ' || lower(n_name) || ' to ' || CASE WHEN s_suppkey % 2 = 0 THEN 'ASIA' ELSE 'nowhere' END AS object
  FROM supplier JOIN nation ON (s_nationkey + s_suppkey % 3) % 25 = n_nationkey)"""))
def unlinked_mentions(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    x = s.join(n, F.pmod(F.col("s_nationkey") + F.pmod("s_suppkey", F.lit(3)), F.lit(25)) == F.col("n_nationkey"))
    said = F.concat(F.lit("ships from "), F.lower("n_name"), F.lit(" to "), F.when(F.pmod("s_suppkey", F.lit(2)) == 0, "ASIA").otherwise("nowhere"))
    f = x.select(F.col("s_suppkey").alias("id"), F.lit("geo").alias("project_id"), F.col("s_name").alias("subject"), said.alias("object"))
    return joins.mentions(f, entities(spark, sf_dir), edges(spark, sf_dir))


DANGLING = """f AS (SELECT s_suppkey AS id, 'geo' AS project_id, CASE s_suppkey % 4 WHEN 0 THEN upper(s_name) WHEN 1 THEN s_name WHEN 2 THEN 'User_' || s_suppkey ELSE ' ' END AS subject,
    CASE s_suppkey % 5 WHEN 0 THEN 'a long text, which ends.' WHEN 1 THEN '12.5' WHEN 2 THEN 'Some thing' WHEN 3 THEN 'user_' || s_suppkey ELSE 'NATION_3' END AS object FROM supplier),
o AS (SELECT 'people' AS project_id, 'user_' || s_suppkey AS name FROM supplier UNION ALL SELECT project_id, name FROM entities),
c AS (SELECT id, project_id, field, trim(raw) AS candidate FROM (SELECT id, project_id, 'subject' AS field, subject AS raw FROM f UNION ALL SELECT id, project_id, 'object', object FROM f))"""


@query(with_tables("entities", """SELECT id, field, candidate, CASE WHEN candidate = '' THEN 'blank' WHEN EXISTS (SELECT 1 FROM o WHERE o.project_id = c.project_id AND o.name = candidate) THEN 'linked'
  WHEN EXISTS (SELECT 1 FROM o WHERE o.project_id = c.project_id AND lower(o.name) = lower(candidate)) THEN 'case_mismatch'
  WHEN EXISTS (SELECT 1 FROM o WHERE o.project_id <> c.project_id AND lower(o.name) = lower(candidate)) THEN 'cross_project'
  WHEN len(string_split(candidate, ' ')) <= 4 AND NOT regexp_matches(candidate, '[.?!]$') AND NOT regexp_matches(candidate, '^-?[0-9]+(\\.[0-9]+)?$') THEN 'no_match' ELSE 'not_entity' END AS reason FROM c""", DANGLING))
def dangling_references(spark, sf_dir):
    """How subjects and objects refer to entities, of the project or of others."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    m = lambda n, v: F.pmod(k, F.lit(n)) == v
    subject = F.when(m(4, 0), F.upper("s_name")).when(m(4, 1), F.col("s_name")).when(m(4, 2), F.concat(F.lit("User_"), k)).otherwise(" ")
    obj = F.when(m(5, 0), "a long text, which ends.").when(m(5, 1), "12.5").when(m(5, 2), "Some thing").when(m(5, 3), F.concat(F.lit("user_"), k)).otherwise("NATION_3")
    f = s.select(k.alias("id"), F.lit("geo").alias("project_id"), subject.alias("subject"), obj.alias("object"))
    people = s.select(F.lit("people").alias("project_id"), F.concat(F.lit("user_"), k).alias("name"))
    return joins.dangling_references(f, entities(spark, sf_dir).select("project_id", "name").unionByName(people), entity_shaped)


ROUTES = """req AS (SELECT o_orderkey AS id, 'p' || (o_custkey % 6) AS project_id, 's' || (o_orderkey % 50) AS session_id, CASE o_orderkey % 3 WHEN 0 THEN 'coder' WHEN 1 THEN 'critic' ELSE 'scribe' END AS role FROM orders),
ov AS (SELECT 'p' || (n_nationkey % 6) AS project_id, 's' || (n_nationkey * 2) AS session_id, 'coder' AS role, 'm' || n_nationkey AS model FROM nation),
pins AS (SELECT CASE WHEN n_nationkey % 4 = 0 THEN '*' ELSE 'p' || (n_nationkey % 4) END AS project_id, CASE WHEN n_nationkey % 2 = 0 THEN 'coder' ELSE 'critic' END AS role, CAST(n_nationkey AS INTEGER) AS version, 'pin' || n_nationkey AS model, n_nationkey % 5 <> 0 AS active FROM nation),
act AS (SELECT project_id, role, max(version) AS version, max_by(model, version) AS model FROM pins WHERE active GROUP BY ALL)"""


@query(f"""WITH {ROUTES}
SELECT r.*, coalesce(ov.model, a.model, g.model, 'm0') AS model,
  CASE WHEN ov.model IS NOT NULL THEN 'session override' WHEN a.model IS NOT NULL THEN 'project pin v' || a.version WHEN g.model IS NOT NULL THEN 'global default pin' ELSE 'recommended' END AS rationale
FROM req r LEFT JOIN ov ON ov.project_id = r.project_id AND ov.session_id = r.session_id AND ov.role = r.role
LEFT JOIN act a ON a.project_id = r.project_id AND a.role = r.role LEFT JOIN act g ON g.project_id = '*' AND g.role = r.role""")
def resolved_routes(spark, sf_dir):
    """Override, project pin, global pin, recommendation: the first that there is."""
    o, n, k = table(spark, sf_dir, "orders"), table(spark, sf_dir, "nation"), F.col("n_nationkey")
    m = lambda c, d: F.pmod(F.col(c), F.lit(d))
    role = F.when(m("o_orderkey", 3) == 0, "coder").when(m("o_orderkey", 3) == 1, "critic").otherwise("scribe")
    req = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("p"), m("o_custkey", 6)).alias("project_id"), F.concat(F.lit("s"), m("o_orderkey", 50)).alias("session_id"), role.alias("role"))
    ov = n.select(F.concat(F.lit("p"), m("n_nationkey", 6)).alias("project_id"), F.concat(F.lit("s"), k * 2).alias("session_id"), F.lit("coder").alias("role"), F.concat(F.lit("m"), k).alias("model"))
    pins = n.select(F.when(m("n_nationkey", 4) == 0, "*").otherwise(F.concat(F.lit("p"), m("n_nationkey", 4))).alias("project_id"), F.when(m("n_nationkey", 2) == 0, "coder").otherwise("critic").alias("role"), k.cast("int").alias("version"), F.concat(F.lit("pin"), k).alias("model"), (m("n_nationkey", 5) != 0).alias("active"))
    return joins.resolved_routes(req, ov, pins, "m0")


@query(with_tables("facts", "SELECT k, count(*) AS n FROM (SELECT DISTINCT trim(lower(replace(subject, '_', ' '))) AS k, subject FROM facts) GROUP BY k"))
def subjects_by_compare_key(spark, sf_dir):
    x = facts(spark, sf_dir).select(compare_key(F.replace("subject", F.lit("_"), F.lit(" "))).alias("k"), "subject").distinct()
    return x.groupBy("k").agg(F.count("*").alias("n"))
