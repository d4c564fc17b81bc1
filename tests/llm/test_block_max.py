"""Ranked lexical search against SQL and brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import _tokens, block_max, queries
from tests.parity import connect, differences

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in TERM.findall(text or "")]


def brute(docs, items, k=20):
    bags = [(doc, Counter(terms(t))) for doc, t in docs]
    bags = [(doc, b, sum(b.values())) for doc, b in bags if b]
    n, total = len(bags), sum(x[2] for x in bags)
    df = Counter(w for _, b, _ in bags for w in b)
    out = []
    for item, text in items:
        scores = []
        for doc, b, size in bags:
            m = 100 - 25 + (25 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * b[w]) // (1000 * b[w] + 12 * m)) for w in terms(text) if b[w])
            scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(x for x in scores if x[0] < 0)[:k])]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_against_sql(spark, sf):
    assert not differences(queries.op12_lexical_search(spark, sf), connect(sf), block_max.ORACLE_SQL)


class Small:
    """Shards of a few terms and blocks of a few postings, in tasks too."""

    def __init__(self, shard, block):
        self.shard, self.block = shard, block

    def __call__(self, batches, docs, n, real=block_max._indexed):
        block_max.SHARD, block_max.BLOCK = self.shard, self.block
        yield from real(batches, docs, n)


@pytest.mark.parametrize("shard,block", [(60, 2), (5000, 3), (1 << 20, 128)])
@pytest.mark.parametrize("most", [40, 1 << 19])
def test_random_texts(spark, monkeypatch, shard, block, most):
    rng = np.random.default_rng(8)
    say = lambda n: " ".join(f"w{int(x)}" for x in rng.zipf(1.3, n) % 60)
    docs = [(int(i), say(int(rng.integers(0, 50)))) for i in rng.permutation(500)] + [(7, "w1 w2 w3")] * 30
    items = [(i, say(int(rng.integers(0, 25)))) for i in range(12)] + [(50, "none of these"), (51, "W1 w1 w59")]
    monkeypatch.setattr(block_max, "_indexed", Small(shard, block))
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    x = block_max.search(d, b.withColumnRenamed("item_id", "item"), most_terms=most).withColumnRenamed("item", "item_id")
    assert rows(x) == brute(docs, items)


def test_blocks_below_the_threshold_stay_packed():
    """A rare term's documents decide; most blocks of frequent terms aren't decompressed."""
    rng = np.random.default_rng(9)
    n = 60_000
    hashes, lengths = [], np.full(n, 3)
    for d in range(n):
        hashes += [1, 2 if d % 2 else 3, 4 if 300 <= d < 360 and d % 2 else 10 + int(rng.integers(0, 50))]
    total = int(lengths.sum())
    p = block_max.Postings(block_max.Postings.built(np.array(hashes, np.uint64), lengths, n, total) | {"lengths": lengths}, list(range(n)))
    best = block_max.Best(20)
    p.search(np.array([1, 2, 4], np.uint64), np.array([1, 500, 7000]), best, n, total)
    assert [d for _, d in best.rows] == list(range(301, 341, 2))
    assert p.known.mean() < 0.1


def test_packing():
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.integers(0, 1 << int(b), 200) for b in range(1, 62)] + [[0, 127, 128, 1 << 62]]).astype(np.int64)
    data, start = _tokens.pack(x)
    assert (_tokens.unpack(data) == x).all() and len(start) == len(x)


def test_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "One two"), (None, "the same words"), (3, None), (4, "é ü 4111"), (5, "")], "item_id long, text string")
    docs, items = [(r["doc_id"], r["text"]) for r in odd.collect()], [tuple(r) for r in bench.collect()]
    assert rows(block_max.ranked(odd.repartition(60), bench)) == brute(docs, items)
    assert block_max.ranked(odd.limit(0), bench).count() == 0 and block_max.ranked(odd, bench.limit(0)).count() == 0
    extra = odd.select("*", *[F.lit(k).alias(n) for k, n in enumerate(("item", "rank", "score", "term"))])
    assert rows(block_max.ranked(extra, bench.withColumn("item", F.lit(1)))) == brute(docs, items)


def test_stored_index(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 300"), spark.read.parquet(f"{sf}/benchmark.parquet").selectExpr("item_id as item", "text")
    n, total, _ = block_max.counts(docs, np.zeros(0, np.uint64))
    index = block_max.block_max_index(docs, n, total).checkpoint()
    a, b = (sorted(map(repr, x.collect())) for x in (block_max.search(docs, bench, index=index), block_max.search(docs, bench)))
    assert a == b and len(a) > 100


def test_long_text(spark):
    text = " ".join(f"w{k % 9973}" for k in range(900_000))
    docs = [(1, text), (2, "w1 w2 w3"), (3, "x" * 3_000_000)]
    got = block_max.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "w1 w3"), (2, "x" * 3_000_000)], "item_id long, text string"))
    assert rows(got) == brute(docs, [(1, "w1 w3"), (2, "x" * 3_000_000)])
