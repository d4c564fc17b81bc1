"""Queries of data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.operators import alignment, verify
from lorekeep.plans.registry import query
from lorekeep.sources.domain import facts, with_tables
from lorekeep.sources.tables import table


def _moved(spark, sf_dir):
    """orders after a faulty move: some lost, some doubled, some changed."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    k = F.col("o_orderkey")
    x = o.filter(F.pmod(k, F.lit(500)) != 7).withColumn("o_orderstatus", F.when(F.pmod(k, F.lit(700)) == 3, "X").otherwise(F.col("o_orderstatus")))
    return x.unionByName(x.filter(F.pmod(k, F.lit(900)) == 11))


MOVED = """moved AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 700 = 3 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 500 <> 7
  UNION ALL SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 700 = 3 THEN 'X' ELSE o_orderstatus END FROM orders WHERE o_orderkey % 500 <> 7 AND o_orderkey % 900 = 11)"""


@query(f"""WITH {MOVED}, a AS (SELECT o_orderkey, o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL), b AS (SELECT o_orderkey, o_custkey, o_orderstatus, count(*) AS n FROM moved GROUP BY ALL)
SELECT coalesce(a.n, 0) AS n_old, coalesce(b.n, 0) AS n_new, coalesce(a.n, 0) - coalesce(b.n, 0) AS lost, count(*) AS hashes
FROM a FULL JOIN b USING (o_orderkey, o_custkey, o_orderstatus) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0) GROUP BY ALL""")
def multiset_differences(spark, sf_dir):
    """Row hashes of other counts, by how they differ."""
    x = verify.multiset_difference(table(spark, sf_dir, "orders"), _moved(spark, sf_dir), ["o_orderkey", "o_custkey", "o_orderstatus"])
    return x.groupBy("n_old", "n_new", "lost").agg(F.count("*").alias("hashes"))


@query(f"""WITH {MOVED} SELECT part, grp, count(*) AS n FROM (SELECT 'orders' AS part, o_orderstatus AS grp, o_orderkey AS k FROM orders UNION ALL SELECT 'doubled', o_orderstatus, o_orderkey * 2 FROM orders) WHERE k NOT IN (SELECT o_orderkey FROM moved) GROUP BY ALL""")
def reverse_containment(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return verify.uncontained({"orders": o, "doubled": o.withColumn("o_orderkey", F.col("o_orderkey") * 2)}, _moved(spark, sf_dir), "o_orderkey", "o_orderstatus")


@query(f"WITH {MOVED} SELECT o_orderkey, o_custkey, o_orderstatus FROM orders EXCEPT ALL SELECT o_orderkey, o_custkey, o_orderstatus FROM moved")
def tuple_difference(spark, sf_dir):
    return verify.tuple_difference(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), _moved(spark, sf_dir))


@query(f"""WITH {MOVED}, m AS (SELECT DISTINCT * FROM moved UNION ALL SELECT c_custkey + 9000000000, c_custkey, 'N' FROM customer WHERE c_custkey < 5)
SELECT coalesce(o.o_orderkey, m.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'new' WHEN m.o_orderkey IS NULL THEN 'missing' ELSE 'changed' END AS change
FROM orders o FULL JOIN m ON o.o_orderkey = m.o_orderkey WHERE o.o_orderkey IS NULL OR m.o_orderkey IS NULL OR o.o_orderstatus <> m.o_orderstatus""")
def snapshot_differences(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_custkey < 5").select((F.col("c_custkey") + 9_000_000_000).alias("o_orderkey"), F.col("c_custkey").alias("o_custkey"), F.lit("N").alias("o_orderstatus"))
    return verify.snapshot_diff(table(spark, sf_dir, "orders"), _moved(spark, sf_dir).distinct().unionByName(c), "o_orderkey", ["o_custkey", "o_orderstatus"])


@query(f"""WITH {MOVED}, a AS (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_orderstatus AS s, count(*) AS n FROM moved GROUP BY 1)
SELECT coalesce(a.s, b.s) AS slice, coalesce(a.n, 0) AS n_old, coalesce(b.n, 0) AS n_new, coalesce(a.n, 0) = coalesce(b.n, 0) AS equal FROM a FULL JOIN b ON a.s = b.s""")
def count_reconciliation(spark, sf_dir):
    return verify.count_reconciliation(table(spark, sf_dir, "orders"), _moved(spark, sf_dir), "o_orderstatus")


@query(with_tables("facts", "SELECT count(*) AS n FROM facts WHERE project_id IN (SELECT DISTINCT 'p' || (n_nationkey % 20) FROM nation WHERE n_nationkey % 2 = 0)"))
def excluded_slices_present(spark, sf_dir):
    e = table(spark, sf_dir, "nation").filter(F.pmod("n_nationkey", F.lit(2)) == 0).select(F.concat(F.lit("p"), F.pmod("n_nationkey", F.lit(20))).alias("project_id"))
    return verify.present(facts(spark, sf_dir), e, "project_id")


@query("""SELECT o_custkey, day, count(*) AS n, CAST(sum(is_new) AS BIGINT) AS n_new, min(is_new) = 0 AS has_existing FROM (SELECT CASE WHEN o_custkey % 10 > 0 THEN o_custkey END AS o_custkey, strftime(o_orderdate, '%Y-%m') AS day, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS is_new FROM orders)
WHERE o_custkey IS NOT NULL GROUP BY ALL HAVING count(*) > 1 AND sum(is_new) > 0""")
def constraint_preflight(spark, sf_dir):
    """Keys that would collide under a unique index; rows with NULL keys never do."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.pmod("o_custkey", F.lit(10)) > 0, F.col("o_custkey")).alias("o_custkey"), F.date_format("o_orderdate", "yyyy-MM").alias("day"))
    new = F.pmod("o_orderkey", F.lit(3)) == 0
    return verify.constraint_preflight(o.filter(~new), o.filter(new), ["o_custkey", "day"])


@query("""SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens_verbose, CAST(ceil(length(c) / 4.0) AS BIGINT) AS tokens_compact, CASE WHEN length(text) > 0 THEN round(1 - CAST(ceil(length(c) / 4.0) AS DOUBLE) / ceil(length(text) / 4.0), 6) END AS saved
FROM (SELECT doc_id, text, regexp_replace(text, ' (the|and|of|to|in) ', ' ', 'g') AS c FROM documents)""")
def text_economy(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return verify.text_economy(d, d.withColumn("text", F.regexp_replace("text", " (the|and|of|to|in) ", " ")), "doc_id")


@query("""SELECT c_custkey, concat_ws(',', CASE WHEN c_name <> n2 THEN 'c_name' END, CASE WHEN c_nationkey IS DISTINCT FROM k2 THEN 'c_nationkey' END) AS differs FROM (
  SELECT *, CASE WHEN c_custkey % 50 = 1 THEN lower(c_name) ELSE c_name END AS n2, CASE WHEN c_custkey % 75 > 1 THEN c_nationkey END AS k2 FROM customer) WHERE c_name <> n2 OR c_nationkey IS DISTINCT FROM k2""")
def column_differences(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    k = F.col("c_custkey")
    n = c.withColumn("c_name", F.when(F.pmod(k, F.lit(50)) == 1, F.lower("c_name")).otherwise(F.col("c_name"))).withColumn("c_nationkey", F.when(F.pmod(k, F.lit(75)) > 1, F.col("c_nationkey")))
    return verify.column_differences(c, n, "c_custkey", ["c_name", "c_nationkey"])


@query("""WITH o AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT doc_id, unnest(string_split(CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || 'tail' ELSE replace(text, 'tion', 'sion') END, chr(10))) AS line FROM documents)
SELECT change, count(*) AS lines, CAST(sum(abs(d)) AS BIGINT) AS n FROM (SELECT doc_id, line, sum(d) AS d, CASE WHEN sum(d) > 0 THEN 'added' ELSE 'removed' END AS change FROM (SELECT *, 1 AS d FROM n UNION ALL SELECT *, -1 FROM o) GROUP BY doc_id, line HAVING sum(d) <> 0) GROUP BY change""")
def line_changes(spark, sf_dir):
    """Lines that a version adds or removes, counted."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    new = d.withColumn("body", F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat("body", F.lit("\ntail"))).otherwise(F.replace("body", F.lit("tion"), F.lit("sion"))))
    return verify.line_changes(d, new, "doc_id").groupBy("change").agg(F.count("*").alias("lines"), F.sum("n").alias("n"))


@query("SELECT o_orderstatus AS slice, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1 UNION ALL SELECT 'P', count(*) FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 2 = 0")
def rewritten_manifest(spark, sf_dir):
    """One slice of a manifest is replaced; fingerprints are left out here, as their row hash has no SQL twin."""
    o = table(spark, sf_dir, "orders")
    cols = ["o_orderkey", "o_custkey"]
    old = verify.manifest(o, "o_orderstatus", "o_orderkey", cols)
    new = verify.manifest(o.filter((F.col("o_orderstatus") == "P") & (F.pmod("o_orderkey", F.lit(2)) == 0)), "o_orderstatus", "o_orderkey", cols)
    return verify.manifest_rewritten(old, new).select("slice", "n")


@query("""SELECT doc_id, md5(text) AS digest, length(text) - length(replace(text, chr(10), '')) + 1 AS lines FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || 'tail' WHEN doc_id % 3 = 1 THEN 'head' || chr(10) || text ELSE replace(text, 'tion', 'sion') END AS text FROM documents)""")
def patched_documents(spark, sf_dir):
    """All documents aligned with a later version line by line, and the later version made of the kept and added lines."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    k, b = F.pmod("doc_id", F.lit(3)), F.col("body")
    new = d.withColumn("body", F.when(k == 0, F.concat(b, F.lit("\ntail"))).when(k == 1, F.concat(F.lit("head\n"), b)).otherwise(F.replace(b, F.lit("tion"), F.lit("sion"))))
    x = alignment.patched(alignment.aligned_lines(d, new, "doc_id"), "doc_id")
    return x.select("doc_id", F.md5(F.col("body").cast("binary")).alias("digest"), F.size(F.split("body", "\n")).cast("long").alias("lines"))
