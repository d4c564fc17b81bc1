"""12. Ranked lexical search: Block-Max WAND over an inverted index of every shard of documents.

A shard holds the posting lists of some documents, about SHARD terms of text.  Lists are cut into blocks of BLOCK postings,
compressed to bytes (gaps of document numbers and frequencies in seven bits a byte); beside them lie each block's first
and last document and its maximum impact.  A query moves over these shallow pointers only: between two ends of blocks the sum of
the maximum impacts that cover a document is constant, and bounds the scores there.  Stretches below the threshold, the
score of the query's best K documents so far, are skipped before anything of them is decompressed; of the others, the ones
with the greatest bound come first, so that the threshold rises early.  In these, pivots are the documents in the lists of those terms
without which a score can't reach the threshold; blocks of the other terms are decompressed only where they span a pivot.

Scores are those of a saturated term frequency with document lengths, in whole numbers.  Counts of all documents come first, in a
pass of their own.  Queries are sent in blocks of at most QUERY_TERMS terms; a task sends back K documents a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm._spark import checkpoint
from lorekeep.llm._tokens import LETTERS, pack, slices, unpack

K = 20
BLOCK = 128  # postings of a block
SHARD = 1 << 20  # terms of a shard, about: it ends with the document that reaches them
QUERY_TERMS = 1 << 19  # of the queries that are sent at once: about 16 MB
SALTS = 256
_ARRAYS = {"vocabulary": np.uint64, "lists": np.int64, "first": np.int32, "last": np.int32, "most": np.int64, "at": np.int64, "data": np.uint8}
INDEX = "doc_ids array<long>, " + ", ".join(f"{k} binary" for k in _ARRAYS)
HITS = "item long, doc_id long, score long"
_HITS = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def impact(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """What a term that occurs tf times in a document of n terms scores, but for its weight."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * (100 - 25 + 25 * n * docs // max(1, terms)))


class Postings:
    """The posting lists of a shard; blocks are decompressed when they are first asked for, and kept."""

    def __init__(self, arrays: dict[str, np.ndarray], doc_ids: list):
        self.__dict__.update(arrays)
        self.doc_ids = doc_ids
        self.known = np.zeros(len(self.first), bool)
        self.docs = np.zeros((len(self.first), BLOCK), np.int32)
        self.tf = np.zeros((len(self.first), BLOCK), np.int32)  # 0 where a block is shorter
        self.n = arrays["lengths"]

    @staticmethod
    def built(hashes: np.ndarray, lengths: np.ndarray, docs: int, terms: int) -> dict[str, np.ndarray]:
        vocabulary, term = np.unique(hashes, return_inverse=True)
        many = max(1, len(lengths))
        pair, tf = np.unique(term * many + np.repeat(np.arange(len(lengths)), lengths), return_counts=True)
        term, doc = np.divmod(pair, many)
        start = np.searchsorted(term, np.arange(len(vocabulary)))
        within = np.arange(len(term)) - (start[term] if len(term) else 0)
        opens = within % BLOCK == 0
        block = np.flatnonzero(opens)
        gap = np.diff(doc, prepend=0)
        gap[opens] = 0
        data, at = pack(np.column_stack([gap, tf]).ravel())
        score = impact(tf, lengths[doc], docs, terms)
        most = np.maximum.reduceat(score, block) if len(block) else score
        out = {"vocabulary": vocabulary, "lists": np.searchsorted(term[block], np.arange(len(vocabulary) + 1)), "first": doc[block], "last": doc[np.append(block[1:], len(doc)) - 1], "most": most, "at": np.append(at[::2][block], len(data)), "data": data}
        return {k: np.ascontiguousarray(v, _ARRAYS[k]) for k, v in out.items()}

    def open(self, blocks: np.ndarray) -> None:
        """Decompress those of blocks that aren't yet."""
        new = np.unique(blocks[~self.known[blocks]])
        if not len(new):
            return
        size = self.at[new + 1] - self.at[new]
        raw = self.data[np.repeat(self.at[new] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        x = unpack(raw)
        gap, tf = x[::2], x[1::2]
        ends = (raw < 128).cumsum()[np.cumsum(size) - 1] // 2  # blocks end where their bytes do
        n = np.diff(ends, prepend=0)
        row, col = np.repeat(new, n), np.arange(len(gap)) - np.repeat(ends - n, n)
        total = np.cumsum(gap)
        self.docs[row, col] = self.first[row] + total - np.repeat(total[ends - n], n)
        self.tf[row, col] = tf
        self.known[new] = True

    def search(self, terms: np.ndarray, weights: np.ndarray, best: "Best", docs: int, all_terms: int) -> None:
        """Put the shard's documents that may be among the best for a query into best; terms are hashes."""
        if not len(self.vocabulary):
            return
        place = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1)
        here = (self.vocabulary[place] == terms) & (weights > 0)
        place, weights = place[here], weights[here]
        many = self.lists[place + 1] - self.lists[place]
        if not many.sum():
            return
        block = np.repeat(self.lists[place] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        weight = np.repeat(weights, many)
        some = np.flatnonzero(many)
        owner = np.repeat(np.arange(len(some)), many[some])
        ceiling = np.maximum.reduceat(weight * self.most[block], np.cumsum(many[some]) - many[some])  # of each term in the shard
        by_ceiling = np.argsort(ceiling)
        edges = np.unique(np.concatenate([self.first[block], self.last[block] + 1]))
        begin, end = np.searchsorted(edges, self.first[block]), np.searchsorted(edges, self.last[block] + 1)
        bound = np.zeros(len(edges), np.int64)
        np.add.at(bound, begin, weight * self.most[block])
        np.subtract.at(bound, end, weight * self.most[block])
        bound = np.cumsum(bound)
        order, a, step = np.argsort(-bound, kind="stable"), 0, 16
        while a < len(order) and bound[order[a]] > 0 and bound[order[a]] >= best.threshold:
            stretch = order[a : a + step]
            stretch = stretch[bound[stretch] >= max(1, best.threshold)]
            chosen = np.zeros(len(edges) + 1, np.int64)
            chosen[stretch + 1] = 1
            before = np.cumsum(chosen)
            on = np.flatnonzero(before[end] > before[begin])
            # a document that holds only the terms before the pivot, whose ceilings stay below the threshold in all, can't be among the best
            leads = np.zeros(len(some), bool)
            leads[by_ceiling[np.cumsum(ceiling[by_ceiling]) >= best.threshold]] = True
            lead = on[leads[owner[on]]]
            self.open(block[lead])
            doc = self.docs[block[lead]][self.tf[block[lead]] > 0]
            pivots = np.unique(doc[chosen[np.searchsorted(edges, doc, side="right")] > 0])
            on = on[np.searchsorted(pivots, self.last[block[on]], side="right") > np.searchsorted(pivots, self.first[block[on]])]
            self.open(block[on])
            doc, tf, w = self.docs[block[on]].ravel(), self.tf[block[on]].ravel(), np.repeat(weight[on], BLOCK)
            wanted = np.zeros(len(self.doc_ids), bool)
            wanted[pivots] = True
            keep = (tf > 0) & wanted[doc]
            doc, tf, w = doc[keep], tf[keep].astype(np.int64), w[keep]
            score = np.zeros(len(self.doc_ids), np.int64)
            np.add.at(score, doc, w * impact(tf, self.n[doc], docs, all_terms))
            found = np.flatnonzero(score >= max(1, best.threshold))
            best.add([(int(score[d]), self.doc_ids[d]) for d in found])
            a, step = a + step, step * 4


class Best:
    """The K best (score, doc_id) of a query so far: greater scores first, then smaller ids, null last."""

    def __init__(self, k: int):
        self.k, self.rows, self.threshold = k, [], 0

    def add(self, rows: list) -> None:
        self.rows = sorted(self.rows + rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[: self.k]
        if len(self.rows) == self.k:
            self.threshold = self.rows[-1][0]


def _terms(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long"), "text")


def _indexed(batches, docs: int, terms: int):
    """(doc_ids, arrays) of shard after shard; documents without terms are in none."""
    ids, hashes, lengths, total = [], [], [], 0

    def flush():
        n = np.concatenate(lengths)
        return ids, Postings.built(np.concatenate(hashes), n, docs, terms) | {"lengths": n}

    for b in batches:
        doc = b.column(0).to_pylist()
        for lo, hi, words in slices(b.column(1), of_word=LETTERS):
            n = np.diff(words.first)
            some = np.flatnonzero(n)
            ids += [doc[lo + i] for i in some.tolist()]
            hashes.append(words.hashes())
            lengths.append(n[some])
            total += len(words.start)
            if total >= SHARD:
                yield flush()
                ids, hashes, lengths, total = [], [], [], 0
    if total:
        yield flush()


def counts(docs: DataFrame, wanted: np.ndarray) -> tuple[int, int, np.ndarray]:
    """(documents with terms, terms, documents that hold each of the wanted hashes), of all docs."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(np.sort(wanted))

    def run(batches):
        want, n, total = sent.value, 0, 0
        df = np.zeros(len(want) + 1, np.int64)
        for b in batches:
            for _, _, words in slices(b.column(0), of_word=LETTERS):
                h, many = words.hashes(), np.diff(words.first)
                n, total = n + int((many > 0).sum()), total + len(h)
                place = np.searchsorted(want, h)
                hit = np.flatnonzero(want[np.minimum(place, len(want) - 1)] == h) if len(want) else np.zeros(0, np.int64)
                pair = np.unique(np.repeat(np.arange(len(many)), many)[hit] * (len(want) + 1) + place[hit])
                df += np.bincount(pair % (len(want) + 1), minlength=len(want) + 1)
        at = np.flatnonzero(df[:-1])
        term = pa.array([None, *want[at].view(np.int64).tolist()], pa.int64())
        yield pa.RecordBatch.from_arrays([term, pa.array([n, *df[at].tolist()], pa.int64()), pa.array([total, *[0] * len(at)], pa.int64())], names=["term", "docs", "terms"])

    rows = docs.select("text").mapInArrow(run, "term long, docs long, terms long").groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).collect()  # a row a wanted term
    df = {r["term"]: r["docs"] for r in rows}
    n, total = next(((r["docs"], r["terms"]) for r in rows if r["term"] is None), (0, 0))
    return n, total, np.array([df.get(x, 0) for x in wanted.view(np.int64).tolist()], np.int64)


def query_terms(queries: DataFrame) -> DataFrame:
    """(item, term, times) of queries (item, text): term is a hash."""

    def run(batches):
        for b in batches:
            item = b.column(0).to_numpy()
            for lo, hi, words in slices(b.column(1), of_word=LETTERS):
                who = np.repeat(item[lo:hi], np.diff(words.first))
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(words.hashes().view(np.int64))], names=["item", "term"])

    return queries.select("item", "text").mapInArrow(run, "item long, term long").groupBy("item", "term").agg(F.count("*").alias("times"))


def block_max_index(docs: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The index of docs (doc_id, text) as a table, a row for each shard: see ``search_index``."""

    def run(batches):
        for ids, arrays in _indexed(batches, n_docs, n_terms):
            cols = [pa.array([ids], pa.list_(pa.int64())), *[pa.array([arrays[k].tobytes()], pa.binary()) for k in _ARRAYS], pa.array([arrays["lengths"].astype(np.int64).tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_ids", *_ARRAYS, "lengths"])

    return _terms(docs).mapInArrow(run, INDEX + ", lengths binary")


def _stored(batches):
    kinds = _ARRAYS | {"lengths": np.int64}
    for b in batches:
        for k in range(b.num_rows):
            yield b.column(0)[k].as_py(), {name: np.frombuffer(b.column(1 + i)[k].as_buffer(), kind) for i, (name, kind) in enumerate(kinds.items())}


def _search(shards, block, n_docs: int, n_terms: int, k: int):
    items, first, terms, weights = block
    best = [Best(k) for _ in items]
    for ids, arrays in shards:
        p = Postings(arrays, ids)
        for i, found in enumerate(best):
            p.search(terms[first[i] : first[i + 1]], weights[first[i] : first[i + 1]], found, n_docs, n_terms)
    rows = [(int(item), doc, score) for item, found in zip(items, best) for score, doc in found.rows]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _HITS)], schema=_HITS)


def search(docs: DataFrame, queries: DataFrame, k: int = K, index: DataFrame | None = None, most_terms: int = QUERY_TERMS) -> DataFrame:
    """item, rank, doc_id, score: the k best of all docs (doc_id, text) for each row of queries (item long, text).

    A term that repeats in a query counts as often.  Scores above 0 only; of equal scores the smaller doc_id comes first, null last.
    Null texts have no terms; a query without terms, or without any that a document holds, has no rows; rows that
    repeat are ranked one after the other.  index is a stored index of the same docs, if there is one.
    """
    spark = docs.sparkSession
    asked = checkpoint(query_terms(queries), fewer=16)
    blocks = max(1, -(-asked.count() // most_terms))
    found = None
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).orderBy("item", "term").toArrow()
        items, first = np.unique(rows["item"].to_numpy(), return_index=True)
        terms = rows["term"].to_numpy().view(np.uint64) if rows.num_rows else np.zeros(0, np.uint64)
        wanted, back = np.unique(terms, return_inverse=True)
        n, total, df = counts(docs, wanted)
        w = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
        weights = w[back] * rows["times"].to_numpy() if rows.num_rows else np.zeros(0, np.int64)
        sent = spark.sparkContext.broadcast((items, np.append(first, len(terms)), terms, weights))
        if index is None:
            x = _terms(docs).mapInArrow(lambda batches, s=sent, n=n, t=total: _search(_indexed(batches, n, t), s.value, n, t, k), HITS)
        else:
            x = index.mapInArrow(lambda batches, s=sent, n=n, t=total: _search(_stored(batches), s.value, n, t, k), HITS)
        found = x if found is None else found.unionByName(x)
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    # the best of many tasks meet in parts of a query first
    part = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    part = part.withColumn("r", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("r") <= k)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    return part.select("item", rank.alias("rank"), "doc_id", "score").filter(F.col("rank") <= k)


def ranked(docs: DataFrame, benchmark: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents for each row of benchmark (item_id, text); see ``search``."""
    items = checkpoint(benchmark.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()))
    names = items.select(F.col("item").alias("item_"), "item_id")
    return search(docs, items, k).join(names, F.col("item") == F.col("item_")).select("item_id", "rank", "doc_id", "score")


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
q AS (
  SELECT item_id, w, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark)
  GROUP BY ALL),
c AS (SELECT count(*) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_terms FROM t WHERE len(ws) > 0),
p AS (SELECT doc_id, n, w, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS w FROM t) GROUP BY ALL),
d AS (SELECT w, count(*) AS df FROM p GROUP BY w),
s AS (
  SELECT item_id, doc_id, CAST(sum(times * CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN d USING (w) JOIN p USING (w), c GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 20"""
