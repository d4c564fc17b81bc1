"""Queries of usage and cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.operators import usage
from lorekeep.plans.registry import query
from lorekeep.sources.domain import models, turn_usage, with_tables

SUMS = "CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, CAST(sum(cost_usd) AS DECIMAL(24,6)) AS cost_usd, count(*) AS turns"


def _named(name: str, by: str, key: str) -> None:
    def run(spark, sf_dir):
        return usage.usage_by(turn_usage(spark, sf_dir), by)

    run.__name__, run.__doc__ = name, f"Tokens, cost and turns by {by}, unknown ones as (none)."
    query(with_tables("turn_usage", f"SELECT {key} AS key, {SUMS} FROM turn_usage GROUP BY 1"))(run)


_named("usage_by_model", "model", "coalesce(model_id, '(none)')")
_named("usage_by_role", "role", "coalesce(agent_role, '(none)')")
_named("usage_by_provider", "provider", "coalesce(provider, '(none)')")
_named("usage_by_day", "day", "strftime(ts, '%Y-%m-%d')")


@query(with_tables("turn_usage", """SELECT project_id, session_id, CAST(sum(tokens_in) AS BIGINT) AS total_tokens_in, CAST(sum(tokens_out) AS BIGINT) AS total_tokens_out,
  CAST(sum(cost_usd) AS DECIMAL(24,6)) AS total_cost_usd, CAST(sum(turns) AS BIGINT) AS turn_count, string_agg(model_key || '=' || turns, ',' ORDER BY model_key) AS breakdown
FROM (SELECT project_id, session_id, coalesce(model_id, '(none)') AS model_key, sum(tokens_in) AS tokens_in, sum(tokens_out) AS tokens_out, sum(cost_usd) AS cost_usd, count(*) AS turns FROM turn_usage GROUP BY 1, 2, 3)
GROUP BY project_id, session_id"""))
def session_rollups(spark, sf_dir):
    """Totals of each session and its map by model, here as text."""
    x = usage.session_rollup(turn_usage(spark, sf_dir))
    said = F.array_join(F.transform(F.map_entries("model_breakdown"), lambda e: F.concat_ws("=", e["key"], e["value"]["turns"])), ",")
    return x.select("project_id", "session_id", "total_tokens_in", "total_tokens_out", "total_cost_usd", "turn_count", said.alias("breakdown"))


@query(with_tables("turn_usage", f"""SELECT project_id, coalesce(model_id, '(none)') AS key, {SUMS} FROM turn_usage GROUP BY 1, 2"""))
def project_usage(spark, sf_dir):
    """Sums over the sessions' saved maps."""
    return usage.project_usage(usage.session_rollup(turn_usage(spark, sf_dir)))


@query(with_tables("turn_usage", f"""SELECT coalesce(model_id, '(none)') AS key, {SUMS} FROM turn_usage WHERE project_id = 'p1' AND session_id = 's1' GROUP BY 1"""))
def one_session_usage(spark, sf_dir):
    t = turn_usage(spark, sf_dir)
    return usage.usage(t, t, t, "p1", "s1")


@query(with_tables("turn_usage models", """SELECT model_id, count(*) AS turns, count(c) AS priced, round(sum(c), 4) AS computed_cost, count(*) FILTER (abs(c) <= 999999.999999) AS in_range FROM (
  SELECT model_id, round((coalesce(tokens_in, 0) * cost_in + coalesce(tokens_out, 0) * cost_out) / 1e6, 6) AS c FROM turn_usage LEFT JOIN models ON model_id = label) GROUP BY model_id"""))
def priced_usage(spark, sf_dir):
    """Cost by the registry's rates; unknown rates cost NULL."""
    x = usage.priced(turn_usage(spark, sf_dir), models(spark, sf_dir))
    return x.groupBy("model_id").agg(F.count("*").alias("turns"), F.count("computed_cost").alias("priced"), F.round(F.sum("computed_cost"), 4).alias("computed_cost"), F.count_if("in_range").alias("in_range"))


def _features(spark, sf_dir):
    t = turn_usage(spark, sf_dir)
    return t.withColumn("branch", F.concat(F.lit("feat/"), F.pmod("turn", F.lit(30)))).withColumn("pr_number", F.when(F.pmod("turn", F.lit(4)) > 0, F.pmod("turn", F.lit(30)))).withColumn("started_at", F.col("ts"))


FEATURES = """features AS (SELECT *, 'feat/' || (turn % 30) AS branch, CASE WHEN turn % 4 > 0 THEN turn % 30 END AS pr_number FROM turn_usage)"""


@query(with_tables("turn_usage", f"SELECT coalesce(CAST(pr_number AS VARCHAR), '(none)') AS key, {SUMS} FROM features WHERE project_id = 'p2' GROUP BY 1", FEATURES))
def feature_usage_by_pr(spark, sf_dir):
    f = _features(spark, sf_dir)
    return usage.usage(f, f, f, "p2", granularity="feature", by="pr")


@query(with_tables("turn_usage", f"SELECT branch AS key, {SUMS} FROM features WHERE project_id = 'p2' GROUP BY 1", FEATURES))
def feature_usage_by_branch(spark, sf_dir):
    f = _features(spark, sf_dir)
    return usage.usage(f, f, f, "p2", granularity="feature", by="branch")


@query(with_tables("turn_usage", """SELECT agent_role, session_id, round(avg(tokens_in), 6) AS mean_in, CAST(max(tokens_out) AS BIGINT) AS most_out FROM turn_usage
GROUP BY GROUPING SETS ((agent_role), (session_id), ())"""))
def usage_grouping_sets(spark, sf_dir):
    t = turn_usage(spark, sf_dir)
    return t.groupingSets([[F.col("agent_role")], [F.col("session_id")], []], F.col("agent_role"), F.col("session_id")).agg(F.round(F.avg("tokens_in"), 6).alias("mean_in"), F.max("tokens_out").alias("most_out"))
