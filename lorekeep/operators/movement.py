"""Moving rows between stores: routing, key remapping, lineage, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def routed_by_rules(df: DataFrame, topic: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """df with tenant: the first rule (literal or wildcard, prefix, target) that the topic's first two tokens, or its first, meet.

    Rules are a short list in order, so they make one CASE expression; without a match, unmatched-<first token>.
    """
    tokens = F.split(F.col(topic), "-")
    first, two = F.get(tokens, 0), F.array_join(F.slice(tokens, 1, 2), "-")
    target: Column | None = None
    for kind, prefix, name in rules:
        hit = (two == prefix) if kind == "literal" else (first == prefix)
        target = F.when(hit, name) if target is None else target.when(hit, name)
    rest = F.concat(F.lit("unmatched-"), first)
    return df.withColumn("tenant", rest if target is None else target.otherwise(rest))


def routed_by_prefix(df: DataFrame, column: str, prefixes: dict[str, str], default: str | None = None) -> DataFrame:
    """df with tenant of the longest prefix that matches, else the default, and verdict where there is neither."""
    target: Column | None = None
    for p in sorted(prefixes, key=lambda p: (-len(p), p)):
        hit = F.startswith(F.col(column), F.lit(p))
        target = F.when(hit, prefixes[p]) if target is None else target.when(hit, prefixes[p])
    other = F.lit(default).cast("string")
    tenant = other if target is None else target.otherwise(other)
    return df.withColumn("tenant", tenant).withColumn("verdict", F.when(F.col("tenant").isNull(), F.concat(F.lit("unmapped-branch-"), F.col(column))))


def reclassified(own: DataFrame, routed: DataFrame, key: str) -> DataFrame:
    """Rows written by an earlier run whose tenant has changed since: they go before the new rows come."""
    r = routed.select(F.col(key).alias("r_key"), F.col("tenant").alias("r_tenant"))
    return own.join(r, (F.col(key) == F.col("r_key")) & (F.col("tenant") == F.col("r_tenant")), "left_anti")


def filled(df: DataFrame, column: str, lookup: DataFrame, on: str, value: str, key: str, otherwise: str | None = None) -> DataFrame:
    """df whose NULLs in column are filled by the value of a lookup, whose column ``on`` meets df's ``key``, then by a constant.

    Of lookup rows with one key, the smallest value counts.
    """
    m = lookup.groupBy(F.col(on).alias("m_key")).agg(F.min(value).alias("m_value"))
    x = df.join(m, F.col(key) == F.col("m_key"), "left")
    return x.withColumn(column, F.coalesce(column, "m_value", F.lit(otherwise).cast("string"))).drop("m_key", "m_value")


def not_null_gate(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """One row: is the number of rows unchanged, and is no value NULL?"""
    b = before.agg(F.count("*").alias("n_before"))
    return after.agg(F.count("*").alias("n_after"), F.count_if(F.col(column).isNull()).alias("n_null")).crossJoin(b).select("n_before", "n_after", "n_null", ((F.col("n_before") == F.col("n_after")) & (F.col("n_null") == 0)).alias("passed"))


def projected(df: DataFrame, columns: dict[str, str], constants: dict[str, str]) -> DataFrame:
    """Renamed columns and constant tags."""
    return df.select(*[F.col(a).alias(b) for a, b in columns.items()], *[F.lit(v).alias(c) for c, v in constants.items()])


def remapped(df: DataFrame, key: str, lineage: DataFrame) -> DataFrame:
    """df with new_key and key_state: null, remapped, or dangling (a key that lineage (old_id, new_id) doesn't know)."""
    m = lineage.select(F.col("old_id").alias("l_old"), F.col("new_id").alias("l_new"))
    x = df.join(m, F.col(key) == F.col("l_old"), "left")
    state = F.when(F.col(key).isNull(), "null").when(F.col("l_old").isNotNull(), "remapped").otherwise("dangling")
    return x.withColumn("new_key", F.col("l_new")).withColumn("key_state", state).drop("l_old", "l_new")


def bridged(bridge: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Bridge rows (left_id, right_id) with both ends remapped by their lineages; a row without one of them is skipped."""
    a = left.select(F.col("old_id").alias("a_old"), F.col("new_id").alias("new_left"))
    b = right.select(F.col("old_id").alias("b_old"), F.col("new_id").alias("new_right"))
    return bridge.join(a, F.col("left_id") == F.col("a_old")).join(b, F.col("right_id") == F.col("b_old")).drop("a_old", "b_old")


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys in both, with how often each has them."""
    x = a.groupBy(key).agg(F.count("*").alias("n_a"))
    y = b.groupBy(F.col(key).alias("k2")).agg(F.count("*").alias("n_b"))
    return x.join(y, F.col(key) == F.col("k2")).drop("k2")


def embedding_gate(df: DataFrame, vector: str, text: str, suppressed: str) -> DataFrame:
    """Counts of rows that have a vector, still need one, or need none as their text is empty (suppressed or not)."""
    empty = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    none = F.col(vector).isNull()
    return df.agg(F.count_if(~none).alias("embedded"), F.count_if(none & ~empty).alias("pending"), F.count_if(none & empty & ~F.col(suppressed)).alias("exempt_empty"), F.count_if(none & empty & F.col(suppressed)).alias("exempt_suppressed"))


def host_markers(markers: DataFrame, host: str | None) -> DataFrame:
    """Markers (owner, host, ts) of this host; all of an owner's if none of them names a host."""
    if not host:
        return markers
    tagged = markers.filter(F.coalesce(F.col("host"), F.lit("")) != "").select(F.col("owner").alias("t_owner")).distinct()
    x = markers.join(tagged, F.col("owner") == F.col("t_owner"), "left")
    return x.filter(F.col("t_owner").isNull() | (F.col("host") == host)).drop("t_owner")


def latest_marker(markers: DataFrame) -> DataFrame:
    """owner, ts of the latest marker: parsable times win over others and the earliest element wins a tie; of unparsable ones the last counts."""
    at = F.try_to_timestamp("ts")
    order = F.struct(at.isNotNull().alias("parsed"), F.unix_micros(at).alias("us"), F.when(at.isNull(), F.col("ord")).otherwise(-F.col("ord")).alias("o"))
    return markers.groupBy("owner").agg(F.max_by("ts", order).alias("ts"))


def divergence(entries: DataFrame, lineage: DataFrame) -> DataFrame:
    """tenant, path, ids of entries that a moved path has more than one of: lineage (entry_id, path) meets entries (id, project_id)."""
    x = entries.join(lineage.select("entry_id", F.lower(F.regexp_replace("path", r"[\\/]+", "/")).alias("path")), F.col("id") == F.col("entry_id"))
    return x.groupBy(F.col("project_id").alias("tenant"), "path").agg(F.sort_array(F.collect_set("id")).alias("ids")).filter(F.size("ids") > 1)
