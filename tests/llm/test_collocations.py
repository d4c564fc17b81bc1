"""Collocation mining against SQL and brute force; the perfect hash by its definition."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import collocations, queries
from tests.parity import connect, differences

WORD, PIECE = re.compile(r"[^\x20\x09]+"), re.compile(r"[.,;:!?\x0A-\x0D]")


def brute(docs, top=2000):
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in PIECE.split(text):
            w = WORD.findall(piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    have = {key: a for key, a in f.items() if a >= 100 and len(key[1]) > 1}
    inside = set()
    for (lang, p), a in have.items():
        inside |= {(lang, p[i : i + k]) for k in range(2, len(p)) for i in range(len(p) - k + 1) if a >= f[lang, p[i : i + k]]}
    out = {}
    for (lang, p), a in have.items():
        if (lang, p) not in inside:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, r + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, xs in out.items() for r, x in enumerate(sorted(xs)[:top]))


def rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_against_sql(spark, sf):
    x = queries.op13_collocations(spark, sf)
    assert not differences(x, connect(sf), collocations.ORACLE_SQL)


class Segments:
    """Few keys a segment and few occurrences a bincount, in tasks too."""

    def __init__(self, flush):
        self.flush = flush

    def __call__(self, batches, real=collocations._phrases):
        collocations.FLUSH = self.flush
        yield from real(batches)


@pytest.mark.parametrize("segment,slots,flush", [(1 << 16, 1 << 22, 1 << 22), (50, 200, 3000)])
def test_random_texts(spark, monkeypatch, segment, slots, flush):
    rng = np.random.default_rng(4)
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ; "]
    docs = []
    for i in range(1500):
        w = rng.zipf(1.6, int(rng.integers(0, 120))) % 40
        docs.append((["en", "fr", None, "und"][i % 4], "".join(f"W{x}" + ends[int(rng.integers(0, len(ends)))] for x in w)))
    docs += [("en", "new york city hall, say it")] * 130 + [("de", None), ("de", "")]
    monkeypatch.setattr(collocations, "SEGMENT", segment)
    monkeypatch.setattr(collocations, "_phrases", Segments(flush))
    d = spark.createDataFrame(docs, "lang string, text string").repartition(20)
    got = rows(collocations.collocations(d, slots=slots))
    assert got == brute(docs) and len(got) > 50
    assert rows(collocations.collocations(d, top=3, slots=slots)) == brute(docs, 3)


def test_odd_rows(spark, odd):
    many = odd.select("text", "lang").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(60))))
    docs = [(r["lang"], r["text"]) for r in many.collect()]
    assert rows(collocations.collocations(many.repartition(60))) == brute(docs)
    crowded = many.select("*", *[F.lit(1).alias(c) for c in ("key", "place", "phrase", "a", "n", "segment", "chunk", "lang_hash")])
    assert rows(collocations.collocations(crowded)) == brute(docs)
    assert collocations.collocations(odd.limit(0)).count() == 0 and collocations.collocations(odd).count() == 0


def test_long_text(spark):
    text = " ".join(f"w{k % 997}" for k in range(400_000))
    docs = [("en", text), ("en", "x" * 3_000_000)]
    assert rows(collocations.collocations(spark.createDataFrame(docs, "lang string, text string"))) == brute(docs)


def test_perfect_hash():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 100, 5000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        levels, slot = collocations.perfect_hash(keys)
        assert sorted(slot.tolist()) == list(range(len(keys))) and sum(int(v.sum()) for v in levels) == len(keys)


def test_tree_sum(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 40, (300, 5, 4))
    rows_ = [(c, p, x[p, c].astype(np.int64).tobytes()) for p in range(300) for c in range(5) if (p + c) % 3]
    got = collocations.tree_sum(spark.createDataFrame(rows_, "chunk long, part long, counts binary").repartition(7), 300).collect()
    assert {r["chunk"]: np.frombuffer(r["counts"], np.int64).tolist() for r in got} == {c: sum(x[p, c] for p in range(300) if (p + c) % 3).tolist() for c in range(5)}
