"""Sinks: insert-only writes, JSON export and import, CSV logs, Markdown, backups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators.state import collisions, inserted_only
from lorekeep.operators.text import cell_escaped


def insert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old and new; a key that exists, or comes twice, is an error."""
    if not collisions(old, new, key).isEmpty() or not new.groupBy(*key).count().filter("count > 1").isEmpty():
        raise ValueError(f"rows with the same {', '.join(key)} exist")
    return old.unionByName(new)


def pairs(left: DataFrame, column: str, values: str) -> DataFrame:
    """(column, value) rows, one for each element of an array."""
    return left.select(column, F.explode(values).alias("value"))


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def import_json(spark: SparkSession, path: str, old: DataFrame, key: list[str], dry_run: bool = True) -> DataFrame:
    """What an import would add (dry run), or the table after it; keys that exist are skipped."""
    new = spark.read.schema(old.schema).json(path)
    return new.join(old.select(*key).distinct(), key, "left_anti") if dry_run else inserted_only(old, new, key)


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def backup(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def markdown_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """line: each row as one of a Markdown table, pipes escaped."""
    cells = [cell_escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
