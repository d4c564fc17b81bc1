"""Stemmed full text: a scan, and an index of postings by stem of which a query reads a few folders."""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from lorekeep.functions.expr import STOP_WORDS, query_terms
from lorekeep.functions.recovery import written
from lorekeep.functions.stem import stem

BUCKETS = 64
WORDS = 1 << 20  # words whose stems a task counts at once, about: whole texts
SCORE_PLACES = 12  # sums in any order agree to so many places, so that ties are ties


@lru_cache(1 << 17)
def _stem(word: str) -> str:
    return stem(word)


def stems_of(query: str) -> list[str]:
    """Distinct stems of a query's words that aren't stop words, in order."""
    return list(dict.fromkeys(stem(w) for w in query_terms(query)))


def _counted(df: DataFrame, key: str, text: str) -> DataFrame:
    """id, term, n: how often each stem occurs, summed over some texts at a time; each distinct word of these is stemmed once.  The words are those of ``lexemes``."""
    kind = StructType().add("id", df.select(key).schema[0].dataType).add("term", StringType()).add("n", LongType())

    def run(batches):
        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy())
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + WORDS, side="right")))
                lists = b.column(1).slice(lo, hi - lo)
                words = lists.flatten().dictionary_encode()
                terms = pa.array([_stem(w) if w and w not in STOP_WORDS else None for w in words.dictionary.to_pylist()], pa.string()).dictionary_encode()
                term = pc.fill_null(terms.indices, -1).to_numpy()[words.indices.to_numpy()].astype(np.int64)
                kept = term >= 0
                pair, n = np.unique(pc.list_parent_indices(lists).to_numpy()[kept] * max(1, len(terms.dictionary)) + term[kept], return_counts=True)
                row, term = np.divmod(pair, max(1, len(terms.dictionary)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row + lo)), terms.dictionary.take(pa.array(term)), pa.array(n.astype(np.int64))], names=["id", "term", "n"])
                lo = hi

    return df.select(F.col(key).alias("id"), F.split(F.lower(F.col(text)), "[^a-z0-9]+").alias("words")).mapInArrow(run, kind)


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """id, term, tf: how often each stem occurs in each row's text.  Rows of one key count as one text; NULL texts have no words."""
    return _counted(df, key, text).groupBy("id", "term").agg(F.sum("n").alias("tf"))


def write_index(df: DataFrame, key: str, text: str, path: str, buckets: int = BUCKETS) -> None:
    """Postings in folders by a hash of the term, each sorted by term and id.

    Ranges of (bucket, term, id) are dealt to tasks, so a term of any number of rows is spread over tasks, and each task writes few files; the
    sums by term reuse that partitioning.  Stems are written out before, as ranges are found by reading them once more.
    """
    x = written(_counted(df, key, text)).withColumn("bucket", F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(buckets)).cast("int"))
    x = x.repartitionByRange("bucket", "term", "id").groupBy("bucket", "term", "id").agg(F.sum("n").alias("tf"))
    x.select("term", "id", "tf", "bucket").sortWithinPartitions("bucket", "term", "id").write.mode("errorifexists").partitionBy("bucket").option("parquet.block.size", 8 << 20).parquet(path)


def read_index(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    return spark.read.schema(f"term string, id {id_type}, tf long, bucket int").parquet(path)


def ranked(found: DataFrame, query: str) -> DataFrame:
    """id, score of the rows that have all of a query's stems: the mean of tf / (tf + 1).  A query without words finds nothing."""
    terms = stems_of(query)
    x = found.filter(F.col("term").isin(terms)).groupBy("id").agg(F.count("*").alias("terms"), F.round(F.sum(F.col("tf") / (F.col("tf") + 1)) / max(1, len(terms)), SCORE_PLACES).alias("score"))
    return x.filter(F.col("terms") == len(terms)).select("id", "score")


def stemmed_full_text(df: DataFrame, query: str, k: int, text: str = "text", key: str = "id") -> DataFrame:
    """The k best rows by a scan of all texts."""
    return ranked(postings(df, key, text), query).orderBy(F.desc("score"), "id").limit(k)


def indexed_full_text(index: DataFrame, query: str, k: int, buckets: int = BUCKETS) -> DataFrame:
    """The k best rows by the index: only the folders of the query's stems are read, and in them only row groups that may hold these."""
    folders = sorted({zlib.crc32(t.encode()) % buckets for t in stems_of(query)})
    return ranked(index.filter(F.col("bucket").isin(folders)), query).orderBy(F.desc("score"), "id").limit(k)
