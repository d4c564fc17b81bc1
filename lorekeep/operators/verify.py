"""Data-quality checks between two stores: containment, multisets, snapshots, integrity, constraints, economy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.expr import row_hash, token_estimate
from lorekeep.operators.aggregates import digest_tree


def multiset_difference(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Row hashes with other counts on either side, and by how much."""
    side = lambda df, name: df.groupBy(row_hash(*columns).alias(name)).agg(F.count("*").alias(f"n_{name}"))
    x = side(old, "old").join(side(new, "new"), F.col("old") == F.col("new"), "full_outer")
    a, b = F.coalesce("n_old", F.lit(0)), F.coalesce("n_new", F.lit(0))
    return x.select(F.coalesce("old", "new").alias("row_hash"), a.alias("n_old"), b.alias("n_new"), (a - b).alias("lost")).filter("lost != 0")


def uncontained(parts: dict[str, DataFrame], store: DataFrame, key: str, by: str) -> DataFrame:
    """part, group and number of rows of any part whose key the store lacks."""
    rows = reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("part"), F.col(by).alias("grp"), F.col(key).alias("k")) for n, df in sorted(parts.items())])
    have = store.select(F.col(key).alias("have")).distinct()
    return rows.join(have, F.col("k") == F.col("have"), "left_anti").groupBy("part", "grp").agg(F.count("*").alias("n"))


def tuple_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of old that new lacks, repeats counted."""
    return old.exceptAll(new.select(old.columns))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and change (new, missing or changed) of what two snapshots differ in."""
    side = lambda df, name: df.select(F.col(key).alias(name), row_hash(*columns).alias(f"h_{name}"))
    x = side(before, "a").join(side(after, "b"), F.col("a") == F.col("b"), "full_outer")
    what = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "missing").when(F.col("h_a") != F.col("h_b"), "changed")
    return x.select(F.coalesce("a", "b").alias(key), what.alias("change")).filter("change is not null")


def count_reconciliation(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """Rows by slice on both sides, and whether they agree."""
    side = lambda df, name: df.groupBy(F.col(by).alias(name)).agg(F.count("*").alias(f"n_{name}"))
    x = side(old, "a").join(side(new, "b"), F.col("a").eqNullSafe(F.col("b")), "full_outer")
    return x.select(F.coalesce("a", "b").alias("slice"), F.coalesce("n_a", F.lit(0)).alias("n_old"), F.coalesce("n_b", F.lit(0)).alias("n_new"), (F.coalesce("n_a", F.lit(0)) == F.coalesce("n_b", F.lit(0))).alias("equal"))


def present(df: DataFrame, excluded: DataFrame, column: str) -> DataFrame:
    """How many rows are of slices that must not be there."""
    e = excluded.select(F.col(column).alias("ex")).distinct()
    return df.join(e, F.col(column) == F.col("ex"), "left_semi").agg(F.count("*").alias("n"))


def constraint_preflight(existing: DataFrame, batch: DataFrame, key: list[str], where: Column | None = None) -> DataFrame:
    """Keys that a batch would make collide under a unique index: rows, of which new, whether old ones are in it."""
    both = existing.select(*key, F.lit(0).alias("is_new")).unionByName(batch.select(*key, F.lit(1).alias("is_new")))
    both = both if where is None else both.filter(where)
    full = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    return both.filter(full).groupBy(*key).agg(F.count("*").alias("n"), F.sum("is_new").alias("n_new"), (F.min("is_new") == 0).alias("has_existing")).filter("n > 1 and n_new > 0")


def null_keys(batch: DataFrame, key: list[str]) -> DataFrame:
    """Batch rows that a unique index can't see, as part of their key is NULL."""
    return batch.filter(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key]))


def text_economy(verbose: DataFrame, compact: DataFrame, on: str, text: str = "text") -> DataFrame:
    """Token estimates of both forms of a text, and the share saved."""
    a = verbose.select(F.col(on), token_estimate(F.col(text)).alias("tokens_verbose"))
    b = compact.select(F.col(on).alias("on2"), token_estimate(F.col(text)).alias("tokens_compact"))
    return a.join(b, F.col(on) == F.col("on2")).select(on, "tokens_verbose", "tokens_compact", F.when(F.col("tokens_verbose") > 0, F.round(1 - F.col("tokens_compact") / F.col("tokens_verbose"), 6)).alias("saved"))


def column_differences(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and the names of the columns that differ, NULLs compared safely, of rows on both sides."""
    n = new.select(F.col(key).alias("n_key"), *[F.col(c).alias(f"n_{c}") for c in columns])
    names = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"n_{c}")), F.lit(c)) for c in columns]))
    return old.join(n, F.col(key) == F.col("n_key")).select(key, F.array_join(names, ",").alias("differs")).filter("differs != ''")


def line_changes(old: DataFrame, new: DataFrame, key: str, text: str = "body") -> DataFrame:
    """key, change (added or removed), line, n: lines that one version has more often than the other."""
    side = lambda df, s: df.select(F.col(key), F.explode(F.split(text, "\n")).alias("line")).groupBy(key, "line").agg(F.sum(F.lit(s)).alias("d"))
    x = side(new, 1).unionByName(side(old, -1)).groupBy(key, "line").agg(F.sum("d").alias("d")).filter("d != 0")
    return x.select(key, F.when(F.col("d") > 0, "added").otherwise("removed").alias("change"), "line", F.abs("d").alias("n"))


def manifest(df: DataFrame, by: str, key: str, columns: list[str]) -> DataFrame:
    """slice, n and digest of every slice of a table, each by a digest tree of its own (see ``digest_tree``); NULL is a slice."""
    return digest_tree(df, key, row_hash(*columns), F.col(by))


def manifest_rewritten(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with the slices of new in place of its own of the same name, NULL slices too."""
    return old.join(new.select(F.col("slice").alias("n_slice")), F.col("slice").eqNullSafe(F.col("n_slice")), "left_anti").unionByName(new)


def stale_unreconciled(facts: DataFrame, annotate_only: list[str]) -> DataFrame:
    """Live facts that reality contradicts: their columns and ``excluded``, true of predicates that only annotate, which are counted but not reported as stale."""
    stale = F.coalesce(~F.col("suppressed"), F.lit(False)) & F.col("invalid_at").isNull() & (F.col("reality_check") == "mismatch")
    return facts.filter(stale).withColumn("excluded", F.coalesce(F.col("predicate").isin(*annotate_only), F.lit(False)))
