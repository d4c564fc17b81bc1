"""The queries of the corpus-pipeline operators, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import audio_features, block_max, chat_windows, collocations, exact_dedup, fm_index, lang_crf, maxent_lm, mixing, ngram_join, piece_bpe, pii, warc_fixity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.round_trip_digests(_table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return warc_fixity.fixity_report(pages, warc_fixity.damaged(pages))


def op5_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.lm_scores(_table(spark, sf_dir, "documents"))


def op6_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_windows.read_back(chat_windows.format_windows(rows, repeat_system=False), stored=True)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_decisions(_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(_table(spark, sf_dir, "documents"))


def op9_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start_ms"], x["end_ms"])), ",")
    return audio_features.audio_columns(_table(spark, sf_dir, "documents")).withColumn("spans", spans)


def op10_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_crf.identify(_table(spark, sf_dir, "documents"))


def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_index.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("spans")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_max.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_sentencepiece, op3_ngram_join, op4_warc_fixity, op5_maxent_lm, op6_chat_windows, op7_exact_dedup, op8_pii, op9_audio_features, op10_language_crf, op11_benchmark_decontamination, op12_lexical_search, op13_collocations)}
ORACLE_SQL = {
    "op3_ngram_join": ngram_join.ORACLE_SQL,
    "op4_warc_fixity": warc_fixity.ORACLE_SQL,
    "op7_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_benchmark_decontamination": fm_index.ORACLE_SQL,
    "op12_lexical_search": block_max.ORACLE_SQL,
    "op13_collocations": collocations.ORACLE_SQL,
}
