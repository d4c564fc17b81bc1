"""The memory store's tables, derived from the driver's tables, as DataFrames and as SQL.

Each function takes (spark, sf_dir); ``SQL`` holds the same table as a common table expression for
the oracles, which ``with_tables`` puts in front of a query.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.sources.tables import table

AS_OF = "2024-06-01 00:00:00"
AS_OF_TS = f"TIMESTAMP '{AS_OF}'"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def _mod(col: str, n: int) -> Column:
    return F.pmod(F.col(col), F.lit(n))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as facts: subject, predicate, object, confidence, validity, state flags."""
    k = "event_id"
    gone = _mod(k, 11) == 0
    return table(spark, sf_dir, "events").select(
        F.col(k).alias("id"),
        F.concat(F.lit("p"), _mod("user_id", 7)).alias("project_id"),
        F.concat(F.lit("user_"), F.col("user_id")).alias("subject"),
        F.col("event_type").alias("predicate"),
        F.col("props").alias("object"),
        (_mod(k, 10) + 1).cast("double").alias("confidence"),
        F.lit(0.05).alias("decay_rate"),
        F.col("ts").alias("created_at"),
        F.timestamp_add("HOUR", _mod(k, 60), F.col("ts")).alias("last_reinforced"),
        F.date_format("ts", "yyyy-MM-dd").alias("session_id"),
        gone.alias("suppressed"),
        F.when(_mod(k, 13) == 0, F.col("ts")).alias("invalid_at"),
        F.when(gone, F.when(_mod(k, 2) == 0, F.lit("downvoted_probation")).otherwise(F.lit("superseded"))).alias("suppression_kind"),
        (_mod(k, 17) == 0).alias("pinned"),
        F.when(_mod(k, 3) == 0, F.lit("probationary")).when(_mod(k, 3) == 1, F.lit("consolidated")).alias("tier"),
        F.when(_mod(k, 4) == 0, F.lit("verified")).when(_mod(k, 4) == 1, F.lit("mismatch")).alias("reality_check"),
        (F.floor(_mod(k, 25) / 4) * 0.25 - 0.75).alias("outcome_bias"),
        F.col("value"),
    )


def turn_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as turns of sessions (orders) with token counts and a cost of fixed scale; some keys and numbers are NULL."""
    parts = F.round(F.col("l_extendedprice") * 100).cast("long") * (100 - F.round(F.col("l_discount") * 100).cast("long"))
    cost = (parts.cast("decimal(18,0)") * F.lit(Decimal("0.000001"))).cast("decimal(18,6)")  # exact: cents times per cent
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("p"), _mod("l_orderkey", 5)).alias("project_id"),
        F.concat(F.lit("s"), _mod("l_orderkey", 400)).alias("session_id"),
        F.col("l_orderkey").alias("turn"),
        F.col("l_linenumber").alias("line"),
        F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("agent_role"),
        F.col("l_linestatus").alias("provider"),
        F.when(_mod("l_suppkey", 12) < 11, F.concat(F.lit("m"), _mod("l_suppkey", 12))).alias("model_id"),
        F.when(_mod("l_partkey", 9) > 0, (F.col("l_quantity") * 100).cast("long")).alias("tokens_in"),
        F.when(_mod("l_partkey", 8) > 0, (F.col("l_quantity") * 10).cast("long")).alias("tokens_out"),
        F.when(_mod("l_suppkey", 12) != 7, cost).alias("cost_usd"),
        F.col("l_shipdate").alias("ts"),
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, suppliers and customers as named nodes."""
    t = lambda n: table(spark, sf_dir, n)
    base = lambda off, key, name, kind: (F.col(key).cast("long") + off, F.lit("geo"), F.col(name), F.lit(kind), F.pmod(F.col(key), F.lit(19)) == 7)
    cols = ["id", "project_id", "name", "entity_type", "suppressed"]
    parts = [t("region").select(*base(0, "r_regionkey", "r_name", "region")), t("nation").select(*base(100, "n_nationkey", "n_name", "nation")), t("supplier").select(*base(1000, "s_suppkey", "s_name", "supplier")), t("customer").select(*base(10_000_000, "c_custkey", "c_name", "customer"))]
    out = parts[0].toDF(*cols)
    for p in parts[1:]:
        out = out.unionByName(p.toDF(*cols))
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed, weighted, directed edges, cycles of trading nations among them; some weights are NULL, some customers unlinked."""
    t = lambda n: table(spark, sf_dir, n)
    nation, region = t("nation"), t("region")
    partner = nation.select(F.col("n_nationkey").alias("k2"), F.col("n_name").alias("n2"))
    cust = t("customer").filter(F.pmod("c_custkey", F.lit(9)) != 4)
    parts = [
        region.join(nation, F.col("r_regionkey") == F.col("n_regionkey")).select("r_name", F.lit("contains"), "n_name", F.lit(1.0), F.lit(False)),
        nation.join(partner, F.pmod(F.col("n_nationkey") * 7 + 3, F.lit(25)) == F.col("k2")).select("n_name", F.lit("trades_with"), "n2", F.pmod("n_nationkey", F.lit(5)).cast("double"), F.pmod("n_nationkey", F.lit(6)) == 0),
        nation.join(t("supplier"), F.col("n_nationkey") == F.col("s_nationkey")).select("n_name", F.lit("has_supplier"), "s_name", F.round(F.col("s_acctbal") / 1000, 3), F.lit(False)),
        nation.join(cust, F.col("n_nationkey") == F.col("c_nationkey")).select("n_name", F.lit("has_customer"), "c_name", F.when(F.pmod("c_custkey", F.lit(10)) != 0, F.round(F.col("c_acctbal") / 1000, 3)), F.lit(False)),
    ]
    cols = ["from_entity", "edge_type", "to_entity", "weight", "suppressed"]
    out = parts[0].toDF(*cols)
    for p in parts[1:]:
        out = out.unionByName(p.toDF(*cols))
    return out.withColumn("project_id", F.lit("geo"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as named entries; the tenant is the source."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("doc_"), F.col("doc_id")).alias("name"), F.col("source").alias("project_id"), F.col("lang").alias("type"), F.col("text").alias("description"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as chunks of entries."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("entry_id"), F.posexplode(F.split("text", "\n")).alias("chunk_idx", "content"))


def exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as an append-only log with a reply tree; times have microseconds."""
    c = F.col
    micros = c("conv_id") * 60_000_000 + c("turn") * 1_000_400 + F.pmod("conv_id", F.lit(7))
    return table(spark, sf_dir, "conversations").select(
        (c("conv_id") * 1000 + c("turn")).alias("id"),
        F.concat(F.lit("p"), F.pmod("conv_id", F.lit(3))).alias("project_id"),
        c("role").alias("agent_id"),
        c("text").alias("body"),
        F.when(c("turn") > 0, c("conv_id") * 1000 + c("turn") - F.when(F.pmod("turn", F.lit(3)) == 2, 2).otherwise(1)).alias("parent_id"),
        (F.lit(1_700_000_000_000_000) + micros).alias("created_us"),
    )


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation as a model registry: label, provider, tier, availability and rates per million tokens (some NULL)."""
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("m"), k).alias("label"),
        F.concat(F.lit("prov"), F.col("n_regionkey")).alias("provider"),
        F.element_at(F.array(F.lit("low"), F.lit("mid"), F.lit("high")), (F.pmod(k, F.lit(3)) + 1).cast("int")).alias("capability_tier"),
        (F.pmod(k, F.lit(5)) != 4).alias("available"),
        F.when(F.pmod(k, F.lit(7)) != 6, F.pmod(k * 13, F.lit(17)) * 0.25).alias("cost_in"),
        F.when(F.pmod(k, F.lit(7)) != 6, F.pmod(k * 5, F.lit(11)) * 1.5).alias("cost_out"),
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as outcomes of retrieval events, and the encoded kinds that each used."""
    d = F.col("doc_id")
    kind = F.when(F.col("toxic") == 1, "irrelevant").when(F.col("quality") == 1, "success").when(F.pmod(d, F.lit(5)) == 0, "pending").otherwise("failure")
    used = F.concat(F.lit("contract=default kinds="), F.when(F.pmod(d, F.lit(2)) == 0, "assertion").otherwise("entity"), F.when(F.pmod(d, F.lit(3)) == 0, ",graph").otherwise(F.lit("")), F.lit(" v=1"))
    return table(spark, sf_dir, "labels").select(d.alias("event_id"), kind.alias("outcome"), used.alias("query_text"), F.pmod(d, F.lit(40)).cast("int").alias("age_days"))


SQL = {
    "facts": """facts AS (
  SELECT event_id AS id, 'p' || (user_id % 7) AS project_id, 'user_' || user_id AS subject,
    event_type AS predicate, props AS object, CAST(event_id % 10 + 1 AS DOUBLE) AS confidence,
    CAST(0.05 AS DOUBLE) AS decay_rate, ts AS created_at, ts + to_hours(CAST(event_id % 60 AS INTEGER)) AS last_reinforced,
    strftime(ts, '%Y-%m-%d') AS session_id, event_id % 11 = 0 AS suppressed,
    CASE WHEN event_id % 13 = 0 THEN ts END AS invalid_at,
    CASE WHEN event_id % 11 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'downvoted_probation' ELSE 'superseded' END END AS suppression_kind,
    event_id % 17 = 0 AS pinned,
    CASE event_id % 3 WHEN 0 THEN 'probationary' WHEN 1 THEN 'consolidated' END AS tier,
    CASE event_id % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'mismatch' END AS reality_check,
    CAST(floor((event_id % 25) / 4.0) * 0.25 - 0.75 AS DOUBLE) AS outcome_bias, value
  FROM events)""",
    "turn_usage": """turn_usage AS (
  SELECT 'p' || (l_orderkey % 5) AS project_id, 's' || (l_orderkey % 400) AS session_id, l_orderkey AS turn, l_linenumber AS line,
    CASE WHEN l_returnflag <> 'R' THEN l_returnflag END AS agent_role, l_linestatus AS provider,
    CASE WHEN l_suppkey % 12 < 11 THEN 'm' || (l_suppkey % 12) END AS model_id,
    CASE WHEN l_partkey % 9 > 0 THEN CAST(l_quantity * 100 AS BIGINT) END AS tokens_in,
    CASE WHEN l_partkey % 8 > 0 THEN CAST(l_quantity * 10 AS BIGINT) END AS tokens_out,
    CASE WHEN l_suppkey % 12 <> 7 THEN CAST(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) AS DECIMAL(18,0)) * CAST(0.000001 AS DECIMAL(7,6)) AS DECIMAL(18,6)) END AS cost_usd, l_shipdate AS ts
  FROM lineitem)""",
    "entities": """entities AS (
  SELECT CAST(r_regionkey AS BIGINT) AS id, 'geo' AS project_id, r_name AS name, 'region' AS entity_type, r_regionkey % 19 = 7 AS suppressed FROM region
  UNION ALL SELECT n_nationkey + 100, 'geo', n_name, 'nation', n_nationkey % 19 = 7 FROM nation
  UNION ALL SELECT s_suppkey + 1000, 'geo', s_name, 'supplier', s_suppkey % 19 = 7 FROM supplier
  UNION ALL SELECT c_custkey + 10000000, 'geo', c_name, 'customer', c_custkey % 19 = 7 FROM customer)""",
    "edges": """edges AS (
  SELECT r_name AS from_entity, 'contains' AS edge_type, n_name AS to_entity, CAST(1 AS DOUBLE) AS weight, false AS suppressed, 'geo' AS project_id FROM region JOIN nation ON r_regionkey = n_regionkey
  UNION ALL SELECT a.n_name, 'trades_with', b.n_name, CAST(a.n_nationkey % 5 AS DOUBLE), a.n_nationkey % 6 = 0, 'geo' FROM nation a JOIN nation b ON (a.n_nationkey * 7 + 3) % 25 = b.n_nationkey
  UNION ALL SELECT n_name, 'has_supplier', s_name, round(s_acctbal / 1000, 3), false, 'geo' FROM nation JOIN supplier ON n_nationkey = s_nationkey
  UNION ALL SELECT n_name, 'has_customer', c_name, CASE WHEN c_custkey % 10 <> 0 THEN round(c_acctbal / 1000, 3) END, false, 'geo' FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE c_custkey % 9 <> 4)""",
    "entries": """entries AS (SELECT doc_id AS id, 'doc_' || doc_id AS name, source AS project_id, lang AS type, text AS description FROM documents)""",
    "chunks": """chunks AS (
  SELECT entry_id, CAST(i - 1 AS INTEGER) AS chunk_idx, parts[i] AS content
  FROM (SELECT entry_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id AS entry_id, string_split(text, chr(10)) AS parts FROM documents)))""",
    "exchange": """exchange AS (
  SELECT conv_id * 1000 + turn AS id, 'p' || (conv_id % 3) AS project_id, role AS agent_id, text AS body,
    CASE WHEN turn > 0 THEN conv_id * 1000 + turn - CASE WHEN turn % 3 = 2 THEN 2 ELSE 1 END END AS parent_id,
    1700000000000000 + conv_id * 60000000 + turn * 1000400 + conv_id % 7 AS created_us
  FROM conversations)""",
    "models": """models AS (
  SELECT 'm' || n_nationkey AS label, 'prov' || n_regionkey AS provider, CASE n_nationkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'mid' ELSE 'high' END AS capability_tier,
    n_nationkey % 5 <> 4 AS available, CASE WHEN n_nationkey % 7 <> 6 THEN CAST((n_nationkey * 13) % 17 * 0.25 AS DOUBLE) END AS cost_in,
    CASE WHEN n_nationkey % 7 <> 6 THEN CAST((n_nationkey * 5) % 11 * 1.5 AS DOUBLE) END AS cost_out
  FROM nation)""",
    "outcomes": """outcomes AS (
  SELECT doc_id AS event_id, CASE WHEN toxic = 1 THEN 'irrelevant' WHEN quality = 1 THEN 'success' WHEN doc_id % 5 = 0 THEN 'pending' ELSE 'failure' END AS outcome,
    'contract=default kinds=' || CASE WHEN doc_id % 2 = 0 THEN 'assertion' ELSE 'entity' END || CASE WHEN doc_id % 3 = 0 THEN ',graph' ELSE '' END || ' v=1' AS query_text,
    CAST(doc_id % 40 AS INTEGER) AS age_days
  FROM labels)""",
}


def with_tables(tables: str, body: str, *more: str, recursive: bool = False) -> str:
    """SQL with the named tables (separated by spaces), then further common table expressions, in front of body."""
    parts = [SQL[t] for t in tables.split()] + list(more)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + body
