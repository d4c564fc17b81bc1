"""11. Benchmark decontamination: an FM-index for every shard of the training texts.

A shard is the words of some documents, SHARD at most, each document closed by a separator; longer documents are
cut into parts that overlap by WINDOW - 1 words.  Its suffixes are sorted, their preceding words make the Burrows-Wheeler
transform, and a wavelet tree (in its pointerless layout, a bit vector a level) answers how often a word occurs before a
row.  A test phrase is searched from its last word to its first, two ranks a step, for all phrases at once; the rows
that are left are located by walking back to the next sampled suffix position, SAMPLE words away at most.  Occurrences
become removal spans, merged where they touch or overlap.

The index holds no text and needs no benchmark: ``fm_index`` makes a table of it that any number of benchmarks can search.
Phrases go to the shards in blocks of at most BLOCK windows, so that what is sent has a bound whatever the benchmark's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm._spark import checkpoint
from lorekeep.llm._tokens import LETTERS, slices

WINDOW = 10  # words of a test phrase
SHARD = 1 << 20  # words of a shard, at most
SAMPLE = 4  # every so many text positions have their place stored
BLOCK = 1 << 17  # windows that are searched at once: 10 MB
_PARTS = ["row", "doc_id", "offset", "fresh", "place", "length"]
_ARRAYS = {"vocabulary": np.uint64, "below": np.int32, "turn": np.int32, "bits": np.uint64, "ranks": np.int32, "zeros": np.int64, "marks": np.uint64, "mark_ranks": np.int32, "sampled": np.int32}
INDEX = "parts array<struct<row:long,doc_id:long,offset:long,fresh:long,place:long,length:long>>, size long, " + ", ".join(f"{k} binary" for k in _ARRAYS)
FOUND = "row long, doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
_FOUND = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])


def suffixes(text: np.ndarray) -> np.ndarray:
    """The sorted suffixes of text, words as numbers from 1 and separators as 0, one at the end.

    A suffix ends at its first separator, and of suffixes that are equal up to there the earlier comes first.
    Three words sort them first, then twice as many each round, of those suffixes only that still tie.
    """
    n = len(text)
    gap = text == 0
    rank = np.where(gap, np.cumsum(gap) - 1, text + int(gap.sum())).astype(np.int64)
    wide = max(1, int(rank.max()).bit_length())
    far = np.concatenate([rank, np.zeros(2, np.int64)])
    if 3 * wide <= 63:
        h, key = 3, far[:n] << 2 * wide | far[1 : n + 1] << wide | far[2:]
    else:
        h, key = 1, rank
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    at = np.arange(n)
    while True:
        # a suffix's rank is the place where its group starts
        start = np.maximum.accumulate(np.where(new, at, 0))
        if h in (1, 3):
            rank[order] = start
            act = at
        else:
            rank[order[act]] = act[start]
        tied = ~new
        tied[:-1] |= ~new[1:]
        act = act[tied]
        if not len(act):
            return order
        who = order[act]
        key = rank[who] << 32 | rank[who + h]
        by = np.argsort(key)
        order[act] = who[by]
        key = key[by]
        new = np.ones(len(act), bool)
        new[1:] = key[1:] != key[:-1]
        at = np.arange(len(act))
        h *= 2


def _packed(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bit vector in words of 64, one more than needed, and the ones before each word."""
    words = np.zeros((len(bits) >> 6) + 1, np.uint64)
    raw = np.packbits(bits, bitorder="little")
    words.view(np.uint8)[: len(raw)] = raw
    ones = np.bitwise_count(words)
    return words, (np.cumsum(ones, dtype=np.int64) - ones).astype(np.int32)


def _ones(words: np.ndarray, ranks: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Ones before place i."""
    w = i >> 6
    return ranks[w] + np.bitwise_count(words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))


class FMIndex:
    """The index of one shard; ``arrays`` are what it is stored as."""

    def __init__(self, arrays: dict[str, np.ndarray], size: int):
        self.size = size
        self.__dict__.update(arrays)
        self.levels = len(self.zeros)
        self.bits = self.bits.reshape(self.levels, -1)
        self.ranks = self.ranks.reshape(self.levels, -1)

    @staticmethod
    def built(hashes: np.ndarray, lengths: np.ndarray) -> dict[str, np.ndarray]:
        """Arrays of the index of parts with so many words, whose hashes follow each other."""
        vocabulary, words = np.unique(hashes, return_inverse=True)
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(int(ends[-1]) + 1, np.int64)
        is_word = np.ones(len(text), bool)
        is_word[ends] = False
        text[is_word] = words + 1
        sa = suffixes(text)
        last = text.astype(np.int32)[sa - 1]  # of the first suffix, the closing separator
        count = np.bincount(text, minlength=len(vocabulary) + 1)
        below = np.concatenate([[0], np.cumsum(count)])
        levels = max(1, len(vocabulary).bit_length())
        bits, ranks, zeros = [], [], []
        for k in range(levels):
            one = (last >> (levels - 1 - k) & 1).astype(bool)
            w, r = _packed(one)
            bits.append(w)
            ranks.append(r)
            zeros.append(int((~one).sum()))
            last = np.concatenate([last[~one], last[one]])
        base = np.zeros(len(vocabulary) + 1, np.int64)  # where each word's run starts below the last level
        first = np.ones(len(last), bool)
        first[1:] = last[1:] != last[:-1]
        base[last[first]] = np.flatnonzero(first)
        start = np.zeros(len(text), bool)
        start[0] = True
        start[1:] = ~is_word[:-1]
        kept = (sa % SAMPLE == 0) | start[sa]
        marks, mark_ranks = _packed(kept)
        out = {"vocabulary": vocabulary, "below": below, "turn": below[:-1] - base, "bits": np.concatenate(bits), "ranks": np.concatenate(ranks), "zeros": np.array(zeros), "marks": marks, "mark_ranks": mark_ranks, "sampled": sa[kept]}
        return {k: np.ascontiguousarray(v, _ARRAYS[k]) for k, v in out.items()}

    def down(self, word: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Rows of the suffixes that follow, with word before them, those of the rows before i."""
        c = word
        for k in range(self.levels):
            one = _ones(self.bits[k], self.ranks[k], i)
            i = np.where(c >> (self.levels - 1 - k) & 1, self.zeros[k] + one, i - one)
        return i + self.turn[word]

    def back(self, row: np.ndarray) -> np.ndarray:
        """Rows of the suffixes that start a word earlier."""
        i, c = row, np.zeros(len(row), np.int64)
        for k in range(self.levels):
            one = _ones(self.bits[k], self.ranks[k], i)
            bit = (self.bits[k][i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            i = np.where(bit, self.zeros[k] + one, i - one)
            c = c << 1 | bit
        return i + self.turn[c]

    def intervals(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, first row, end row) of the phrases that occur: phrases [n, WINDOW], hashes of words, set to the right."""
        place = np.minimum(np.searchsorted(self.vocabulary, phrases), max(0, len(self.vocabulary) - 1))
        inside = np.arange(WINDOW) >= WINDOW - lengths[:, None]
        known = self.vocabulary[place] == phrases if len(self.vocabulary) else np.zeros(phrases.shape, bool)
        live = np.flatnonzero((known | ~inside).all(axis=1))
        symbol = place[live] + 1
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.size)
        for k in range(WINDOW - 1, -1, -1):
            on = lengths[live] >= WINDOW - k
            c = symbol[on, k]
            if k == WINDOW - 1:
                lo[on], hi[on] = self.below[c], self.below[c + 1]
            else:
                both = self.down(np.concatenate([c, c]), np.concatenate([lo[on], hi[on]]))
                lo[on], hi[on] = both[: len(c)], both[len(c) :]
            some = hi > lo
            live, symbol, lo, hi = live[some], symbol[some], lo[some], hi[some]
        return live, lo, hi

    def positions(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of the suffixes in these rows."""
        out = np.zeros(len(rows), np.int64)
        left, row, steps = np.arange(len(rows)), rows, 0
        while len(left):
            here = (self.marks[row >> 6] >> (row & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            out[left[here]] = self.sampled[_ones(self.marks, self.mark_ranks, row[here])] + steps
            left, row, steps = left[~here], row[~here], steps + 1
            row = self.back(row) if len(row) else row
        return out


def _indexed(batches):
    """(parts [n, 6], index arrays, size) of shard after shard of (row, doc_id, text); a null doc_id is masked in parts."""
    hashes, parts, total, ids = [], [], 0, []

    def flush():
        x = np.array(parts, np.int64).reshape(-1, 4)
        lengths = x[:, 3]
        place = np.cumsum(lengths + 1) - lengths - 1
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        return x, ids, place, FMIndex.built(h, lengths), int((lengths + 1).sum())

    for b in batches:
        row, doc = b.column(0).to_numpy(), b.column(1).to_pylist()
        for lo, hi, words in slices(b.column(2), of_word=LETTERS):
            h, first = words.hashes(), words.first.tolist()
            for i in range(hi - lo):
                a, z = first[i], first[i + 1]
                at = a
                while True:
                    end = min(z, at + SHARD)
                    begin = max(a, at - (WINDOW - 1))
                    if parts and total + end - begin + 1 > SHARD:
                        yield flush()
                        hashes, parts, total, ids = [], [], 0, []
                    parts.append((row[lo + i], begin - a, end - at, end - begin))
                    ids.append(doc[lo + i])
                    hashes.append(h[begin:end])
                    total += end - begin + 1
                    at = end
                    if at >= z:
                        break
    if parts:
        yield flush()


def fm_index(docs: DataFrame) -> DataFrame:
    """The index of docs (doc_id, text): a row for each shard, with the parts of documents in it."""

    def run(batches):
        for x, ids, place, arrays, size in _indexed(batches):
            fields = [pa.array(x[:, 0]), pa.array(ids, pa.int64()), pa.array(x[:, 1]), pa.array(x[:, 2]), pa.array(place), pa.array(x[:, 3])]
            parts = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.StructArray.from_arrays(fields, _PARTS))
            yield pa.RecordBatch.from_arrays([parts, pa.array([size], pa.int64()), *[pa.array([v.tobytes()], pa.binary()) for v in arrays.values()]], names=["parts", "size", *_ARRAYS])

    return _texts(docs).mapInArrow(run, INDEX)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long"), "text")


def _stored(batches):
    """What ``_indexed`` gives, of rows of a stored index."""
    for b in batches:
        for k in range(b.num_rows):
            fields = b.column(0).slice(k, 1).flatten().flatten()
            x = np.column_stack([fields[i].to_numpy() for i in (0, 2, 3, 5)]) if len(fields[0]) else np.zeros((0, 4), np.int64)
            arrays = {name: np.frombuffer(b.column(2 + i)[k].as_buffer(), kind) for i, (name, kind) in enumerate(_ARRAYS.items())}
            yield x, fields[1].to_pylist(), fields[4].to_numpy(), arrays, b.column(1)[k].as_py()


def _search(shards, block, count_words: bool):
    """Record batches of FOUND: the spans and items of every part of a document; n_words only if they count here."""
    phrases, lengths, first_item, items, names = block
    for x, ids, place, arrays, size in shards:
        index = FMIndex(arrays, size)
        which, lo, hi = index.intervals(phrases, lengths)
        edge = np.zeros(size + 1, np.int64)
        seen = [np.zeros(0, np.int64)]
        ends = np.cumsum(hi - lo)
        a = 0
        while a < len(which):  # about SHARD occurrences at once
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SHARD, side="right")))
            many = hi[a:b] - lo[a:b]
            owner = np.repeat(np.arange(a, b), many)
            rows = np.repeat(lo[a:b] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            at = index.positions(rows)
            np.add.at(edge, at, 1)
            np.subtract.at(edge, at + lengths[which[owner]], 1)
            part = np.searchsorted(place, at, side="right") - 1
            seen.append(np.unique(part * len(phrases) + which[owner]))
            a = b
        covered = np.zeros(size + 2, bool)
        covered[1:] = np.cumsum(edge) > 0
        turns = np.flatnonzero(covered[1:] != covered[:-1])
        start, end = turns[::2], turns[1::2]
        owner = np.searchsorted(place, start, side="right") - 1
        shift = x[owner, 1] - place[owner]
        pair = np.unique(np.concatenate(seen))
        part, w = np.divmod(pair, max(1, len(phrases)))
        many = first_item[w + 1] - first_item[w]
        item = items[np.repeat(first_item[w] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        pair = np.unique(np.repeat(part, many) * len(names) + item) if len(names) else np.zeros(0, np.int64)
        part, item = np.divmod(pair, max(1, len(names)))
        n = len(x)
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(start + shift), pa.array(end + shift)], ["start", "end"]))
        found = pa.ListArray.from_arrays(pa.array(np.searchsorted(part, np.arange(n + 1)), pa.int32()), names.take(pa.array(item)))
        out = pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(ids, pa.int64()), pa.array(x[:, 2] * count_words), spans, found], schema=_FOUND)
        yield out if count_words else out.filter(pa.array(np.diff(np.searchsorted(owner, np.arange(n + 1))) > 0))


def phrases(benchmark: DataFrame) -> DataFrame:
    """(phrase, item): the windows of WINDOW consecutive words of each item of benchmark (item_id, text), as hashes; of an item of fewer words, all of them."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            for lo, hi, words in slices(b.column(1), of_word=LETTERS):
                h, first = words.hashes(), words.first.tolist()
                out = {(h[k : min(z, k + WINDOW)].tobytes(), ids[lo + i]) for i, (a, z) in enumerate(zip(first[:-1], first[1:])) for k in range(a, max(a + 1, z - WINDOW + 1)) if z > a}
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.binary()), pa.array([i for _, i in out], pa.string())], names=["phrase", "item"])

    ids = F.coalesce(benchmark["item_id"].cast("string"), F.lit(""))
    return benchmark.select(ids, "text").mapInArrow(run, "phrase binary, item string").distinct()


def _blocks(windows: DataFrame, most: int) -> list[DataFrame]:
    """windows in parts of at most most rows by the hash of the phrase, more rows only if one phrase has more items."""
    spark, n, rows = windows.sparkSession, 1, windows.count()
    while True:
        which = F.pmod(F.xxhash64("phrase"), F.lit(n))
        largest = windows.groupBy(which.alias("k")).agg(F.count("*").alias("n"), F.count_distinct("phrase").alias("p")).filter("p > 1").agg(F.max("n")).first()[0] or 0
        if largest <= most:
            return [windows.filter(which == k) for k in range(n)]
        n = max(2 * n, -(-2 * rows // most))


def _sent(block: DataFrame):
    """A block of windows for the tasks: hashes set to the right, lengths, and the numbers of the items of each."""
    rows = block.groupBy("phrase").agg(F.collect_set("item").alias("items")).toArrow()
    names = pa.array(sorted({i for x in rows["items"].to_pylist() for i in x}), pa.string())
    number = {x: k for k, x in enumerate(names.to_pylist())}
    table, lengths = np.zeros((rows.num_rows, WINDOW), np.uint64), np.zeros(rows.num_rows, np.int64)
    items: list[int] = []
    first = [0]
    for k, (p, its) in enumerate(zip(rows["phrase"].to_pylist(), rows["items"].to_pylist())):
        h = np.frombuffer(p, np.uint64)
        lengths[k] = len(h)
        table[k, WINDOW - len(h) :] = h
        items += [number[i] for i in its]
        first.append(len(items))
    return table, lengths, np.array(first), np.array(items, np.int64), names


def occurrences(docs: DataFrame | None, benchmark: DataFrame, index: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, spans (start and end in words, merged) and items of every row of docs, or of those that a stored index was made of.

    Null texts and ids of items are empty; texts without words have no windows; items of the same id are one; rows that repeat
    each get a row; an empty benchmark hits nothing, and an empty table gives no rows.
    """
    blocks = _blocks(checkpoint(phrases(benchmark), fewer=16), block)
    if index is None and len(blocks) > 1:
        index = checkpoint(fm_index(docs))
    found = None
    for k, b in enumerate(blocks):
        sent = benchmark.sparkSession.sparkContext.broadcast(_sent(b))
        first = k == 0
        if index is None:
            x = _texts(docs).mapInArrow(lambda batches, sent=sent, first=first: _search(_indexed(batches), sent.value, first), FOUND)
        else:
            x = index.mapInArrow(lambda batches, sent=sent, first=first: _search(_stored(batches), sent.value, first), FOUND)
        found = x if found is None else found.unionByName(x)
    x = found.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n_words").alias("n_words"), F.count_if(F.size("spans") > 0).alias("n"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    # parts of a document overlap, and spans of several blocks meet
    new = F.struct(F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))
    last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1)), new)
    grown = lambda acc, s: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], s["end"]).alias("end"))))
    merged = F.aggregate(F.array_sort("spans"), F.slice("spans", 1, 0), lambda acc, s: F.when(s["start"] <= last(acc)["end"], grown(acc, s)).otherwise(F.concat(acc, F.array(s))))
    return x.select("row", "doc_id", "n_words", F.when(F.col("n") > 1, merged).otherwise(F.col("spans")).alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and spans (start-end in words, comma-joined) of every row of docs; see ``occurrences``."""
    x = occurrences(docs, benchmark, block=block)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return x.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), spans.alias("spans"))


ORACLE_SQL = r"""
WITH lower_case AS (
  SELECT 'd' AS side, CAST(row_number() OVER () AS VARCHAR) AS id, doc_id, text FROM documents UNION ALL SELECT 'b', coalesce(CAST(item_id AS VARCHAR), ''), NULL, text FROM benchmark),
w AS (SELECT side, id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM lower_case),
p AS (SELECT DISTINCT id AS item, unnest(list_transform(range(1, greatest(2, len(ws) - 8)), lambda i: array_to_string(ws[i:i + 9], ' '))) AS phrase, least(10, len(ws)) AS k FROM w WHERE side = 'b' AND len(ws) > 0),
g AS (
  SELECT id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM (SELECT id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT DISTINCT k FROM p) WHERE side = 'd' AND len(ws) >= k)),
h AS (SELECT id, i, k, item FROM g JOIN p USING (phrase, k)),
n AS (SELECT id, count(DISTINCT j) AS n_hit FROM (SELECT id, unnest(range(i, i + k)) AS j FROM h) GROUP BY id),
t AS (SELECT id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT id, item FROM h) GROUP BY id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM w LEFT JOIN n USING (id) LEFT JOIN t USING (id) WHERE side = 'd'"""
