"""The message log and the work queue as streams: appended files are read once, late rows and repeats are settled by state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def tail(spark: SparkSession, path: str, schema: StructType | str, files: int = 100) -> DataFrame:
    """New rows of a folder of Parquet files, at most so many files a batch; the checkpoint is the cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def once(rows: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Rows whose key hasn't come within the delay: state is bounded by the watermark."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def activity(rows: DataFrame, time: str, by: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Rows and sum of value by window and key; a window is final when the watermark has passed it."""
    return rows.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("window_start"), by, "n", "value")


def sessions(rows: DataFrame, time: str, by: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of a key: activity without a gap as long as the one given."""
    return rows.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def drain(queue: DataFrame, handle, done: str, errors: str, checkpoint: str) -> StreamingQuery:
    """Drain pending items (id, payload): handle(batch) returns (id, error); those without an error go to done, others to errors.

    A batch that is run again leaves no repeats: its files carry the batch's number and replace themselves.
    """

    def batch(df: DataFrame, number: int) -> None:
        out = handle(df).persist()
        out.filter("error is null").write.mode("overwrite").parquet(f"{done}/batch={number}")
        out.filter("error is not null").write.mode("overwrite").parquet(f"{errors}/batch={number}")
        out.unpersist()

    return queue.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
