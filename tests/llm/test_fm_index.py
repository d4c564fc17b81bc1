"""Benchmark decontamination against SQL, brute force, and the definition of a suffix order."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import fm_index, queries
from tests.parity import connect, differences

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[x]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=repr)


def test_against_sql(spark, sf):
    assert not differences(queries.op11_benchmark_decontamination(spark, sf), connect(sf), fm_index.ORACLE_SQL)


def random_tables(seed):
    rng = np.random.default_rng(seed)
    say = lambda n: " ".join(f"w{int(x)}" for x in rng.integers(0, 4, n))
    docs = [(i, say(int(rng.integers(0, 120)))) for i in range(150)] + [(7, say(30)), (7, say(30))]
    items = [(i, say(int(rng.integers(0, 14)))) for i in range(40)]
    return docs, items


@pytest.mark.parametrize("shard", [40, 1000, 1 << 20])
@pytest.mark.parametrize("block", [60, 1 << 17])
def test_random_texts(spark, monkeypatch, shard, block):
    """Few different words, so that windows occur often and everywhere; long documents in parts; phrases in blocks."""
    import os

    docs, items = random_tables(3)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)

    class Shards:  # tasks import the module anew, so the size goes with the function
        def __init__(self, n):
            self.n = n

        def __call__(self, batches, real=fm_index._indexed):
            fm_index.SHARD = self.n
            yield from real(batches)

    monkeypatch.setattr(fm_index, "_indexed", Shards(shard))
    assert rows(fm_index.contamination(d, b, block=block)) == want
    assert os.environ["PYTHONPATH"]


def test_spans_are_merged(spark):
    text = " ".join(f"a{k}" for k in range(100))
    items = [(1, " ".join(f"a{k}" for k in range(5, 20))), (2, " ".join(f"A{k}" for k in range(18, 40))), (3, "a50, a51!"), (4, "a52"), (5, "nothing here"), (6, "")]
    got = fm_index.occurrences(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block=20).first()
    assert [tuple(s) for s in got["spans"]] == [(5, 40), (50, 53)] and got["items"] == ["1", "2", "3", "4"]


def test_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "One"), (None, "the same words"), (1, "two"), (2, None), (3, "…"), (4, "é"), (5, "12 34 56")], "item_id long, text string")
    docs, items = [(r["doc_id"], r["text"]) for r in odd.collect()], [tuple(r) for r in bench.collect()]
    assert rows(fm_index.contamination(odd.repartition(60), bench)) == brute(docs, items)
    assert fm_index.contamination(odd.limit(0), bench).count() == 0
    none = fm_index.contamination(odd, bench.limit(0))
    assert rows(none) == brute(docs, [])
    extra = odd.select("*", *[F.lit(k).alias(n) for k, n in enumerate(("row", "spans", "items", "parts", "size"))])
    assert rows(fm_index.contamination(extra, bench)) == brute(docs, items)


def test_stored_index_serves_any_benchmark(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 200"), spark.read.parquet(f"{sf}/benchmark.parquet")
    index = fm_index.fm_index(docs).checkpoint()
    for part in (bench, bench.filter("item_id % 3 = 0")):
        a, b = (sorted(map(repr, x.drop("row").collect())) for x in (fm_index.occurrences(None, part, index), fm_index.occurrences(docs, part)))
        assert a == b


def test_long_text(spark):
    """A document longer than a shard, with a passage across the cut."""
    n = fm_index.SHARD + 40
    text = " ".join(f"x{k % 50021}" for k in range(n))
    start = fm_index.SHARD - 5
    passage = " ".join(f"x{k % 50021}" for k in range(start, start + 12))
    got = fm_index.occurrences(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(9, passage)], "item_id long, text string")).first()
    spans = [tuple(s) for s in got["spans"]]
    assert got["n_words"] == n and (start, start + 12) in spans and len(spans) == len([k for k in range(start % 50021, n - 11, 50021)])


def test_suffix_order():
    rng = np.random.default_rng(5)
    for k in range(60):
        text = np.append(rng.integers(0, int(rng.integers(1, 5)) + 1, int(rng.integers(0, 200))), 0)
        gaps = np.cumsum(text == 0)
        key = lambda i: [*(int(x) for x in text[i : i + int(np.argmax(text[i:] == 0))] + 1000), int(gaps[i + int(np.argmax(text[i:] == 0))])]  # noqa: B023,E731
        assert fm_index.suffixes(text.astype(np.int64)).tolist() == sorted(range(len(text)), key=key)


def test_ranks_and_positions():
    rng = np.random.default_rng(6)
    lengths = rng.integers(0, 60, 30)
    hashes = rng.integers(0, 9, int(lengths.sum())).astype(np.uint64)
    size = int((lengths + 1).sum())
    index = fm_index.FMIndex(fm_index.FMIndex.built(hashes, lengths), size)
    at = np.sort(index.positions(np.arange(size)))
    assert at.tolist() == list(range(size))
