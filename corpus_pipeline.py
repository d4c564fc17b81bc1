"""A training-corpus pipeline of five of the dealt operators.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame,
which may be written and read again as the next one's docs.  All but the last return the columns
of documents, fewer rows or, where the mix repeats a source, more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import exact_dedup, lang_crf, mixing, ngram_join, piece_bpe

NEAR_WORDS, NEAR_PERCENT = 5, 80  # near-duplicates: five words, a similarity of 0.8 or more


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told: without letters, or below the score asked for."""
    return lang_crf.accepted(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one of the documents that are equal but for white space."""
    return exact_dedup.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of linked documents."""
    return ngram_join.without_near_duplicates(docs, NEAR_WORDS, NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take sources to their target weights, repeating documents of those with too little."""
    return mixing.mixed(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode: token counts and digests of the ids and of the text that they give back."""
    return piece_bpe.round_trip_digests(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs


ORACLE_SQL = None  # language identification and subword encoding have no SQL form
