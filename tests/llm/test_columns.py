"""Extra columns of any name, texts of megabytes, and rows that repeat very often, through the stages and operators."""

import inspect
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lorekeep.llm import _spark, audio_features, components, exact_dedup, lang_crf, maxent_lm, mixing, ngram_join, piece_bpe, pii

OWN = ["doc_id", "text", "lang", "source", "n_chars"]
SOURCES = "".join(inspect.getsource(m) for m in (_spark, components, exact_dedup, lang_crf, maxent_lm, mixing, ngram_join, piece_bpe, pii, audio_features))
#: every string in the operators' code that can name a column
NAMES = sorted({x.lower() for x in re.findall(r"[\"' ,(]([A-Za-z_]\w*)[\"' ,)]", SOURCES)} & {x.lower() for x in re.findall(r"\"[^\"\n]*\"", SOURCES) for x in re.findall(r"[A-Za-z_]\w*", x)} - set(OWN))
STAGES = dict(corpus_pipeline.STAGES[:-1])


@pytest.fixture(scope="module")
def crowded(spark, odd):
    """odd with a column for every name."""
    docs = odd.drop("NODE")
    return docs.select(*OWN, *[F.concat(F.lit(f"{n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in NAMES])


def test_names_are_found():
    assert len(NAMES) > 100 and {"mix_copy", "row_hash", "node", "ids", "decoded", "stays", "score", "certainty", "digest", "n"} <= set(NAMES)


def rows(df):
    return Counter(map(repr, df.select(*OWN).collect()))


@pytest.mark.parametrize("stage", STAGES)
def test_stage_keeps_columns(spark, odd, crowded, stage):
    got = STAGES[stage](spark, crowded, "")
    assert got.columns == crowded.columns
    assert rows(got) == rows(STAGES[stage](spark, odd.drop("NODE"), ""))
    for r in got.collect():
        assert all(r[n] == f"{n} {r['doc_id'] if r['doc_id'] is not None else '-'}" for n in NAMES)


def test_operators_pass_names_by(spark, odd, crowded):
    coded = piece_bpe.encode(crowded)
    ids = coded.columns[-1]
    back = piece_bpe.decode(coded, ids=ids)
    assert back.columns[:-2] == crowded.columns
    assert all(r[back.columns[-1]] == (r["text"] or "").replace("▁", " ") for r in back.collect())
    plain = odd.drop("NODE")
    for f in (exact_dedup.dedup_decisions, ngram_join.near_duplicates, mixing.mix_sources, pii.pii_report, piece_bpe.round_trip_digests, lang_crf.identify):
        assert sorted(map(repr, f(crowded).collect())) == sorted(map(repr, f(plain).collect())), f


@pytest.fixture(scope="module")
def heavy(spark):
    """A text of 5 MB, one of 3 MB in one word, and 20000 repeats of a row."""
    words = " ".join(f"w{k % 9973}" for k in range(900_000))
    texts = [(1, words, "en", "a"), (2, "x" * 3_000_000, "en", "a"), (3, words + " more", "en", "b"), (4, "short text here", "fr", "b")]
    some = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string")
    same = spark.range(20_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("one row that repeats").alias("text"), F.lit("fr").alias("lang"), F.lit("b").alias("source"))
    return some.union(same)


def test_heavy_rows(spark, heavy):
    n = 20_004
    one = {r["doc_id"]: r for r in exact_dedup.dedup_decisions(heavy).filter("kept").collect()}
    assert sorted(one) == [1, 2, 3, 4, 5] and one[5]["group_size"] == 20_000
    assert sorted(r["doc_id"] for r in exact_dedup.deduplicated(heavy).select("doc_id").collect()) == [1, 2, 3, 4, 5]
    near = {(r["doc_id"], r["component_id"]) for r in ngram_join.near_duplicates(heavy).collect()}
    assert near == {(1, 1), (2, 2), (3, 1), (4, 4), (5, 5)}
    assert sorted(r["doc_id"] for r in ngram_join.without_near_duplicates(heavy).select("doc_id").collect()) == [1, 2, 4, 5]
    mix = mixing.mix_sources(heavy)
    taken = {r["target"]: r["t"] for r in mix.groupBy("target").agg(F.sum("taken").alias("t")).collect()}
    assert all(t == int(k + 0.5) for k, t in taken.items()) and mix.count() == n
    want = mix.filter("size > 0").agg(F.sum(F.ceil(F.col("taken") / F.col("size")))).first()[0]
    assert mixing.mixed(heavy).count() == want
    assert lang_crf.identify(heavy).count() == n
    assert audio_features.audio_columns(heavy).agg(F.sum("n_bytes")).first()[0] == heavy.agg(F.sum(F.octet_length("text"))).first()[0]
    assert piece_bpe.round_trip_digests(heavy).count() == n
    scores = maxent_lm.lm_scores(heavy, rounds=2)
    assert scores.agg(F.sum("n_tokens")).first()[0] == heavy.agg(F.sum(F.size(F.split("text", " ")) + 1)).first()[0]
