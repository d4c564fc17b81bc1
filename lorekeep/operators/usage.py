"""Usage and cost roll-ups over turns, sessions and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.expr import cost_of, day_bucket

NONE = "(none)"
TURN_KEYS = ("model", "role", "provider", "day")
FEATURE_KEYS = ("branch", "pr", "model", "day")
MOST_COST = 999999.999999


def group_key(by: str, time: str = "ts") -> Column:
    """The column that usage is grouped by, NULLs as NONE."""
    columns = {"model": "model_id", "role": "agent_role", "provider": "provider", "branch": "branch", "pr": "pr_number"}
    return day_bucket(F.col(time)) if by == "day" else F.coalesce(F.col(columns[by]).cast("string"), F.lit(NONE))


def sums() -> list[Column]:
    """SUMs ignore NULLs and are NULL of NULLs alone."""
    return [F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost_usd").cast("decimal(24,6)").alias("cost_usd"), F.count("*").alias("turns")]


def usage_by(turns: DataFrame, by: str, time: str = "ts") -> DataFrame:
    """key, tokens, cost and turns of each group, the most costly first, unknown costs last."""
    return turns.groupBy(group_key(by, time).alias("key")).agg(*sums()).orderBy(F.desc_nulls_last("cost_usd"), "key")


def reserved_rows(turns: DataFrame) -> DataFrame:
    """Rows that carry the reserved model name; roll-ups are refused while there are any."""
    return turns.filter(F.col("model_id") == NONE)


def session_rollup(turns: DataFrame) -> DataFrame:
    """One row a session: totals, and a map of the same by model.  Two levels of partial sums, one shuffle each."""
    per = turns.groupBy("project_id", "session_id", group_key("model").alias("model_key")).agg(*sums())
    entry = F.struct("model_key", F.struct("tokens_in", "tokens_out", "cost_usd", "turns").alias("usage"))
    totals = [F.sum("tokens_in").alias("total_tokens_in"), F.sum("tokens_out").alias("total_tokens_out"), F.sum("cost_usd").cast("decimal(24,6)").alias("total_cost_usd"), F.sum("turns").alias("turn_count")]
    return per.groupBy("project_id", "session_id").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("model_breakdown"), *totals)


def project_usage(rollups: DataFrame) -> DataFrame:
    """Sums over the sessions' saved maps: what isn't rolled up yet doesn't count."""
    x = rollups.select("project_id", F.explode("model_breakdown").alias("key", "u")).select("project_id", "key", "u.*")
    return x.groupBy("project_id", "key").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost_usd").cast("decimal(24,6)").alias("cost_usd"), F.sum("turns").alias("turns"))


def usage(turns: DataFrame, rollups: DataFrame, features: DataFrame, project: str, session: str | None = None, granularity: str = "turn", by: str = "model") -> DataFrame:
    """Dispatch on scope: features, one session's turns, or the project's roll-ups (by model only)."""
    if granularity not in ("turn", "feature"):
        raise ValueError(f"granularity is turn or feature, not {granularity!r}")
    allowed = FEATURE_KEYS if granularity == "feature" else TURN_KEYS
    if by not in allowed:
        raise ValueError(f"by is one of {allowed}, not {by!r}")
    if granularity == "feature":
        if session is not None:
            raise ValueError("features have no sessions")
        return usage_by(features.filter(F.col("project_id") == project), by, "started_at")
    if session is not None:
        return usage_by(turns.filter((F.col("project_id") == project) & (F.col("session_id") == session)), by)
    if by != "model":
        raise ValueError("a project's roll-ups are by model only")
    return project_usage(rollups.filter(F.col("project_id") == project)).drop("project_id").orderBy(F.desc_nulls_last("cost_usd"), "key")


def priced(turns: DataFrame, models: DataFrame) -> DataFrame:
    """Turns with the cost that the registry's rates give; NULL where model or rate is unknown, flagged where out of range."""
    rates = models.select(F.col("label").alias("rate_label"), "cost_in", "cost_out")
    x = turns.join(rates, F.col("model_id") == F.col("rate_label"), "left")
    cost = cost_of(F.col("tokens_in"), F.col("tokens_out"), F.col("cost_in"), F.col("cost_out"))
    return x.withColumn("computed_cost", cost).withColumn("in_range", F.abs("computed_cost") <= MOST_COST).drop("rate_label", "cost_in", "cost_out")
