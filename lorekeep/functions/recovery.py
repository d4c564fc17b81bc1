"""Lineage cuts in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def _folder(df: DataFrame) -> str:
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lorekeep-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """df written to the folder in spark.checkpoint.dir (a temporary one only where it is unset and Spark is local, as in tests)."""
    _folder(df)
    return df.checkpoint(eager=True)


def new_path(df: DataFrame) -> str:
    """A new folder's path in the same shared folder."""
    return f"{_folder(df)}/table-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written to the same folder as a table, and read again.

    For loops of many rounds: a checkpointed frame still carries what the optimiser inferred of its columns, which can double every round.
    """
    path = new_path(df)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
