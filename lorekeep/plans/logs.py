"""Queries over the message log: cursor reads, threads, streams' batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.operators import filters
from lorekeep.operators.graph import thread_roots
from lorekeep.plans.registry import query
from lorekeep.sources.domain import exchange, with_tables
from lorekeep.sources.tables import table


@query(with_tables("exchange", """SELECT id, agent_id, created_us // 1000 AS created_ms FROM exchange
WHERE created_us // 1000 > 1700000600000 OR (created_us // 1000 = 1700000600000 AND id > 10000)
ORDER BY created_us // 1000, id LIMIT 50"""))
def exchange_after_cursor(spark, sf_dir):
    """The next 50 messages after a (milliseconds, id) cursor."""
    return filters.keyset_page(exchange(spark, sf_dir), (1_700_000_600_000, 10_000)).select("id", "agent_id", "created_ms")


@query(with_tables("exchange", """SELECT id, arg_max(node, depth) AS root, CAST(max(depth) AS BIGINT) AS depth FROM up GROUP BY id""", """up(id, node, depth) AS (
  SELECT id, coalesce(parent_id, id), CASE WHEN parent_id IS NULL THEN 0 ELSE 1 END FROM exchange
  UNION ALL SELECT up.id, e.parent_id, depth + 1 FROM up JOIN exchange e ON up.node = e.id WHERE e.parent_id IS NOT NULL)""", recursive=True))
def exchange_threads(spark, sf_dir):
    """Root and depth of every message."""
    return thread_roots(exchange(spark, sf_dir))


@query("""SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS value
FROM events GROUP BY 1, 2""")
def hourly_activity(spark, sf_dir):
    """Tumbling windows; the batch twin of the stream."""
    x = table(spark, sf_dir, "events").groupBy(F.date_format(F.date_trunc("HOUR", "ts"), "yyyy-MM-dd HH:mm").alias("hour"), "event_type")
    return x.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query("""SELECT user_id, count(*) AS n, min(us) AS start_us, max(us) AS end_us FROM (
  SELECT user_id, us, sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id) AS s FROM (
    SELECT user_id, event_id, us, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) < 21600000000 THEN 0 ELSE 1 END AS fresh
    FROM (SELECT user_id, event_id, epoch_us(ts) AS us FROM events)))
GROUP BY user_id, s""")
def activity_sessions(spark, sf_dir):
    """Sessions of a user: no gap of six hours.  Spark's session windows merge partial sessions before the shuffle."""
    x = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    x = x.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.min(F.unix_micros("ts")).alias("start_us"), F.max(F.unix_micros("ts")).alias("end_us"))
    return x.drop("w")


@query(with_tables("exchange", """SELECT agent_id, count(*) AS n, count(DISTINCT project_id) AS projects, CAST(sum(length(body)) AS BIGINT) AS chars FROM exchange GROUP BY agent_id"""))
def exchange_by_agent(spark, sf_dir):
    return exchange(spark, sf_dir).groupBy("agent_id").agg(F.count("*").alias("n"), F.countDistinct("project_id").alias("projects"), F.sum(F.length("body").cast("long")).alias("chars"))
