"""Guarded writes: a model registry whose labels can't silently change, and session overrides for registered labels only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.expr import label_key
from lorekeep.operators.state import upserted

OVERRIDE_KEY = ["project_id", "session_id", "role"]


def registry_set(registry: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registry, refused): the registry after changes, and the changes that were refused, with ``reason``.

    changes has label, force, touched (names of the columns that it sets) and these columns; the last of several changes of a label isn't
    known, so labels are unique in it.  Only touched columns change, to NULL too; labels are normalised.  Without force, a label that points to a model
    can't be pointed to another, and a model of another label, in the registry or among the changes, can't be taken.
    """
    cols = [c for c in registry.columns if c not in ("label", "model_id")]
    c = changes.withColumn("label", label_key(F.col("label"))).withColumn("sets_model", F.array_contains("touched", "model_id") & F.col("model_id").isNotNull())
    own = registry.select(F.col("label").alias("own_label"), F.col("model_id").alias("own_model"))
    held = registry.select("model_id", "label").unionByName(c.filter("sets_model").select("model_id", "label")).filter("model_id is not null").distinct()
    held = held.groupBy(F.col("model_id").alias("held_model")).agg(F.min("label").alias("first_label"), F.max("label").alias("last_label"))
    x = c.join(own, F.col("label") == F.col("own_label"), "left").join(held, F.col("model_id") == F.col("held_model"), "left")
    free = F.coalesce(F.col("force"), F.lit(False))
    moved = F.col("sets_model") & F.col("own_model").isNotNull() & (F.col("own_model") != F.col("model_id"))
    shared = F.col("sets_model") & ((F.col("first_label") != F.col("label")) | (F.col("last_label") != F.col("label")))
    reason = F.when(F.coalesce(F.col("label"), F.lit("")) == "", "label is empty").when(moved & ~free, "label points to another model").when(shared & ~free, "model has another label")
    x = x.withColumn("reason", reason).drop("own_label", "own_model", "held_model", "first_label", "last_label", "sets_model")
    ok = x.filter("reason is null").select(F.col("label").alias("to_label"), F.col("touched"), *[F.col(n).alias(f"to_{n}") for n in ("model_id", *cols)])
    j = registry.join(ok, F.col("label") == F.col("to_label"), "full_outer")
    out = [F.when(F.array_contains("touched", n), F.col(f"to_{n}")).otherwise(F.col(n)).alias(n) for n in registry.columns if n != "label"]
    return j.select(F.coalesce("label", "to_label").alias("label"), *out).select(*registry.columns), x.filter("reason is not null")


def overrides_set(overrides: DataFrame, changes: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(overrides, refused): one override a project, session and role; changes to labels that aren't registered, or without these keys, are refused.

    Roles and labels are normalised; changes are unique by their key.
    """
    c = changes.withColumn("role", label_key(F.col("role"))).withColumn("label", label_key(F.col("label")))
    known = registry.select(F.col("label").alias("known")).distinct()
    missing = F.lit(False)
    for k in OVERRIDE_KEY:
        missing = missing | (F.trim(F.coalesce(F.col(k), F.lit(""))) == "")
    x = c.join(known, F.col("label") == F.col("known"), "left").withColumn("reason", F.when(missing, "key is empty").when(F.col("known").isNull(), "label is not registered")).drop("known")
    ok = x.filter("reason is null").drop("reason")
    return upserted(overrides, ok, OVERRIDE_KEY, replace=[n for n in overrides.columns if n not in OVERRIDE_KEY]).drop("inserted"), x.filter("reason is not null")


def overrides_of(overrides: DataFrame, project: str, session: str, role: str | None = None) -> DataFrame:
    """A session's overrides, all or of one role, by role."""
    x = overrides.filter((F.col("project_id") == project) & (F.col("session_id") == session))
    return (x if role is None else x.filter(F.col("role") == label_key(F.lit(role)))).orderBy("role")


def overrides_cleared(overrides: DataFrame, project: str, session: str, role: str) -> DataFrame:
    """overrides without a session's override of a role."""
    hit: Column = (F.col("project_id") == project) & (F.col("session_id") == session) & (F.col("role") == label_key(F.lit(role)))
    return overrides.filter(~F.coalesce(hit, F.lit(False)))
