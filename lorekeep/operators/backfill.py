"""The apply step of an embedding backfill: capped, with a deadline, and resumed where an earlier run ended."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions.recovery import new_path
from lorekeep.operators.enrich import BATCH, embedded

REPORT = "attempted long, embedded long, refused long, left long, stopped string"


def attempts(spark: SparkSession, folder: str, key: str, key_type: str) -> DataFrame:
    """What all runs wrote: key, embedding (NULL where the embedder refused) and provider."""
    schema = f"`{key}` {key_type}, embedding array<float>, provider string"
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _actionable(df: DataFrame, text: str, vector: str) -> DataFrame:
    return df.filter(F.col(vector).isNull() & (F.trim(F.coalesce(F.col(text), F.lit(""))) != ""))


def backfill(df: DataFrame, key: str, text: str, embedder: Callable[[list[str]], list[list[float]]], dims: int, provider: str, folder: str, most: int | None = 250, seconds: float = 2.0, slice_rows: int = 250, vector: str = "embedding", providers: str = "provider", size: int = BATCH) -> DataFrame:
    """Embed up to ``most`` rows that have text and no vector, until the deadline; one row of counts, and why it stopped: done, cap or deadline.

    Vectors go to ``folder``, a slice of rows at a time: a run that is killed loses at most its slice, and the next one goes on with rows that no
    slice holds.  Rows that the embedder refused come after those not tried yet, by how often they were tried, then by key.  The cap and the
    deadline are the feature; work that comes after the deadline (by the executors' clocks) isn't begun.  Vectors of another provider than the
    one given, in df or in the folder, are refused before any work.  Keys must be unique and not NULL.  Without a cap (None) slices are by a hash of the
    key, about as large, and no task holds more than its share.
    """
    spark, key_type, until = df.sparkSession, dict(df.dtypes)[key], time.time() + seconds
    tried = attempts(spark, folder, key, key_type)
    had = df.filter(F.col(vector).isNotNull()).select(F.col(providers).alias("p")).unionByName(tried.filter("embedding is not null").select(F.col("provider").alias("p")))
    others = [r.p for r in had.filter(~F.col("p").eqNullSafe(F.lit(provider))).distinct().limit(3).collect()]
    if others:
        raise ValueError(f"vectors of other providers than {provider}: {sorted(map(str, others))}")
    seen = tried.groupBy(F.col(key).alias("t_key")).agg(F.count("*").alias("t_times"), F.count("embedding").alias("t_done"))
    x = _actionable(df, text, vector).select(key, text).join(seen, F.col(key) == F.col("t_key"), "left").filter("t_done is null or t_done = 0")
    x = x.withColumn("t_times", F.coalesce("t_times", F.lit(0)))
    if most is None:
        slices_of = F.pmod(F.xxhash64(key), F.lit(max(1, -(-x.count() // slice_rows)))).cast("int")
    else:
        x = x.orderBy("t_times", key).limit(most)
        slices_of = F.floor((F.row_number().over(Window.orderBy("t_times", key)) - 1) / slice_rows).cast("int")  # at most ``most`` rows
    path = new_path(df)
    x.withColumn("slice", slices_of).select(key, text, "slice").write.partitionBy("slice").parquet(path)
    work = spark.read.schema(f"`{key}` {key_type}, `{text}` string, slice int").parquet(path)
    slices = [r.slice for r in work.select("slice").distinct().orderBy("slice").collect()]

    def before_deadline(batches):
        for pdf in batches:
            for at in range(0, len(pdf), size):
                if time.time() >= until:
                    return
                yield pdf.iloc[at : at + size]

    run, attempted, done = uuid.uuid4().hex, 0, 0
    for k in slices:
        if time.time() >= until:
            break
        part = work.filter(F.col("slice") == k).select(key, text).repartition(spark.sparkContext.defaultParallelism, key)
        part = part.mapInPandas(before_deadline, part.schema).withColumn("embedding", F.lit(None).cast("array<float>"))
        out = f"{folder}/run={run}/slice={k}"
        embedded(part, text, embedder, dims, "embedding", size).select(key, "embedding", F.lit(provider).alias("provider")).write.parquet(out)
        n = attempts(spark, out, key, key_type).agg(F.count("*").alias("n"), F.count("embedding").alias("done")).first()
        attempted, done = attempted + n.n, done + n.done
    left = _actionable(filled(df, key, folder, vector), text, vector).count()
    why = "done" if left == 0 else "deadline" if attempted < work.count() else "cap"
    return spark.createDataFrame([(attempted, done, attempted - done, left, why)], REPORT)


def filled(df: DataFrame, key: str, folder: str, vector: str = "embedding") -> DataFrame:
    """df with the vectors that backfills wrote to ``folder`` where it has none."""
    v = attempts(df.sparkSession, folder, key, dict(df.dtypes)[key]).filter("embedding is not null").groupBy(F.col(key).alias("v_key")).agg(F.first("embedding").alias("v_new"))
    x = df.join(v, F.col(key) == F.col("v_key"), "left")
    return x.withColumn(vector, F.coalesce(F.col(vector), F.col("v_new"))).drop("v_key", "v_new")
