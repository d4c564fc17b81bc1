"""Queries over the star schema: what the store's analytics ask of joins, windows, sets and rankings at scale."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorekeep.functions.expr import severity_rank
from lorekeep.plans.registry import query
from lorekeep.sources.tables import table


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
  round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(disc), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""")
def regional_revenue(spark, sf_dir):
    """A star join; the small sides are broadcast if their size allows, by the optimiser's own check."""
    t = lambda n: table(spark, sf_dir, n)
    n = t("nation").join(t("region").filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    c = t("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    o = t("orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"))
    x = t("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return x.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 4 ELSE 5 END, o_orderdate DESC, o_orderkey LIMIT 40""")
def severity_sorted(spark, sf_dir):
    """Sorted by an enumerated severity, then the newest."""
    word = F.regexp_replace(F.regexp_extract("o_orderpriority", r"^\d-(.*)$", 1), "URGENT", "CRITICAL")
    return table(spark, sf_dir, "orders").orderBy(severity_rank(word), F.desc("o_orderdate"), "o_orderkey").limit(40).select("o_orderkey", "o_orderpriority")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY CASE WHEN c_custkey % 10 > 0 THEN c_acctbal END DESC NULLS LAST, c_custkey LIMIT 20")
def nulls_last_top(spark, sf_dir):
    x = table(spark, sf_dir, "customer").withColumn("b", F.when(F.pmod("c_custkey", F.lit(10)) > 0, F.col("c_acctbal")))
    return x.orderBy(F.desc_nulls_last("b"), "c_custkey").limit(20).select("c_custkey", "c_acctbal")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
def intersected_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select("c_custkey").intersect(table(spark, sf_dir, "orders").filter("o_totalprice > 200000").select("o_custkey"))


@query("SELECT n_name AS name FROM nation UNION SELECT r_name FROM region UNION SELECT c_mktsegment FROM customer")
def united_names(spark, sf_dir):
    t = lambda n, c: table(spark, sf_dir, n).select(F.col(c).alias("name"))
    return t("nation", "n_name").union(t("region", "r_name")).union(t("customer", "c_mktsegment")).distinct()


@query("""SELECT o_custkey, o_orderkey, CAST(rank() OVER w AS INTEGER) AS place, round(sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS running, lag(o_orderkey) OVER w AS before
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def customer_order_windows(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    x = table(spark, sf_dir, "orders")
    return x.select("o_custkey", "o_orderkey", F.rank().over(w).alias("place"), F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"), F.lag("o_orderkey").over(w).alias("before"))


@query("""SELECT e.event_id, e.user_id, p.event_id AS purchase_id FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts > p.ts WHERE e.event_type = 'error'""")
def last_purchase_before_error(spark, sf_dir):
    """As-of join as one window over the union: the latest purchase of the user before each error."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "purchase"))
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type").desc()).rowsBetween(Window.unboundedPreceding, -1)
    x = e.withColumn("purchase_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w))
    return x.filter("event_type = 'error'").select("event_id", "user_id", "purchase_id")


@query("""SELECT c_mktsegment, n_regionkey, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (c_mktsegment, n_regionkey)""")
def segment_cube(spark, sf_dir):
    x = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return x.cube("c_mktsegment", "n_regionkey").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))
