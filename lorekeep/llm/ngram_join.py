"""3. N-gram Jaccard join, exact, of all documents with each other.

Texts become sets of hashed 4-word shingles; equal sets are one node.  Nodes meet in tiles: a tile is
a band of sizes, narrow enough that linked sets lie in the same or the next band, and one of the band's
segments of the hash range with its exact content.  A band has more segments than linked sets of its
sizes can differ in elements, so that linked sets agree on a segment and share a tile, while a passage that
many documents have fills no segment on its own.  Empty segments make no tiles: a set that has more of them than the band
allows for is cut again, by other hashes, up to LAYERS times, and then puts its least elements in tiles.

Of tiles with the same nodes one is kept.  In every tile, all nodes are compared with a pivot, the node that
shares most tiles; what is then not in one component is compared block by block.  A comparison first
bounds the overlap from above by bit counts of hashed bitmap signatures, which are small and travel with
the nodes; the sorted arrays are made only for nodes of pairs that pass, and intersected.  Nothing
is capped; only pairs that are linked already, through others, are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm._spark import checkpoint, without_rows
from lorekeep.llm._tokens import mix, slices
from lorekeep.llm.components import components

NGRAM = 4
PERCENT = 85
BITMAP_LOG2 = 24  # bits of the map of texts to make arrays of: 2 MB, whatever the input
SALTS = 64  # copies of a node's row, at most, for the pairs that it is in
BLOCK = 512  # nodes in a block of what is compared without a pivot
LAYERS = 6  # ways of cutting a set of which too many segments are empty


def shingles(words, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a slice; a text of fewer than n words is one shingle, of none the empty set."""
    h = words.hashes()
    many = max(0, len(h) - n + 1)
    s = np.zeros(many, dtype=np.uint64)
    for k in range(n):
        s = mix(s + h[k : k + many], k + 1) if k else mix(h[:many], 1)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(s[a : b - n + 1]))
        elif b > a:
            x = h[a : a + 1]
            for k in range(1, b - a):
                x = mix(x + h[a + k : a + k + 1], 100 + k)
            out.append(mix(x, 200 + b - a))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def node_of(s: np.ndarray) -> int:
    """One signed 64-bit name of a set."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s, 7).sum(dtype=np.uint64) + np.uint64(len(s))], dtype=np.uint64), 11).view(np.int64)[0])


class Bands:
    """Bands of set sizes for a threshold in percent, and the segments of each."""

    def __init__(self, percent: int):
        self.percent = percent
        lo = [1, 2]
        while lo[-1] < 1 << 40:
            lo.append(max(lo[-1] + 1, (lo[-1] - 1) * 100 // percent + 1))
        self.lo = np.array(lo)
        self._kept: dict[int, tuple[int, int, np.ndarray]] = {}

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.lo, n, side="right")) - 1

    def segments(self, band: int) -> tuple[int, int, np.ndarray]:
        """(number, empty ones allowed for, inner bounds) of a band's segments.

        Linked sets whose smaller one is in the band differ in at most d elements, so of d + 1 + e segments they agree
        on e + 1, one of which isn't empty if either set has at most e empty ones.
        """
        if band not in self._kept:
            d = self.differ(band)
            e = 1 + int(2 * (d + 1) * np.exp(-float(self.lo[band]) / (d + 1))) if d else 0
            m = d + 1 + e
            bounds = np.array([(k << 64) // m for k in range(1, m)], dtype=np.uint64)
            if len(self._kept) > 64:
                self._kept.clear()
            self._kept[band] = (m, e, bounds)
        return self._kept[band]

    def differ(self, band: int) -> int:
        """Elements in which linked sets can differ at most, the smaller one being in the band."""
        most = int(self.lo[band + 1]) - 1
        return (most * 100 // self.percent) * (100 - self.percent) // 100

    def tiles(self, s: np.ndarray) -> np.ndarray:
        """Signed 64-bit names of a set's tiles, in its own band and the band below.

        Two linked sets that both have too many empty segments in every layer share one of their least d + 1
        elements: before the least element that they share, each has at most d.
        """
        own, out = self.of(len(s)), []
        for band in {own, max(0, own - 1)}:
            m, e, bounds = self.segments(band)
            for layer in range(LAYERS + 1):
                if layer == LAYERS:
                    out.append(mix(s[: self.differ(band) + 1] + mix(np.array([band], dtype=np.uint64), 6), 10))
                    break
                x = np.sort(mix(s, 70 + layer)) if layer else s
                total = np.zeros(len(x) + 1, dtype=np.uint64)
                np.cumsum(mix(x, 3), out=total[1:])
                edge = np.concatenate([[0], np.searchsorted(x, bounds), [len(x)]])
                full = np.flatnonzero(edge[1:] > edge[:-1])
                content = total[edge[full + 1]] - total[edge[full]]
                out.append(mix(content + mix(full.astype(np.uint64) + np.uint64((band << 40) + (layer << 56)), 5), 9))
                if m - len(full) <= e:
                    break
        return np.concatenate(out).view(np.int64)


def _sets(batches, n):
    """(column arrays of the rows, sets) of slices of the batches' texts, which are the last column."""
    for b in batches:
        for lo, hi, words in slices(b.column(b.num_columns - 1)):
            yield [c.slice(lo, hi - lo) for c in b.columns[:-1]], shingles(words, n)


def set_rows(docs: DataFrame, n: int = NGRAM) -> DataFrame:
    """doc_id, text_hash, n_shingles, node, bits (see ``signature``) of every row."""
    names = ["doc_id", "text_hash", "n_shingles", "node", "bits"]

    def run(batches):
        for cols, sets in _sets(batches, n):
            own = [pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([*cols, *own], names=names)

    return docs.select(docs["doc_id"].cast("long"), F.xxhash64("text"), "text").mapInArrow(run, "doc_id long, text_hash long, n_shingles long, node long, bits binary")


def shared_tiles(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """(tile, node) of every tile with two nodes or more.

    Tiles' rows are sorted by tile and streamed, so a tile of any size takes no memory.
    """

    def emit(batches):
        bands, seen = Bands(percent), set()
        for _, sets in _sets(batches, n):
            tiles, nodes = [], []
            for s in sets:
                if len(s) and (node := node_of(s)) not in seen:
                    seen.add(node)  # copies in a partition count once
                    tiles.append(bands.tiles(s))
                    nodes.append(np.full(len(tiles[-1]), node, dtype=np.int64))
            if tiles:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tiles)), pa.array(np.concatenate(nodes))], names=["tile", "node"])

    def keep(batches):
        tile, node, shares = np.zeros(0, np.int64), np.zeros(0, np.int64), False  # the last row, and whether it shares its tile
        for b in batches:
            t = np.concatenate([tile, b.column(0).to_numpy()])
            v = np.concatenate([node, b.column(1).to_numpy()])
            if len(t) == 0:
                continue
            new = np.ones(len(t), dtype=bool)
            new[1:] = (t[1:] != t[:-1]) | (v[1:] != v[:-1])
            t, v = t[new], v[new]
            same = np.zeros(len(t) + 1, dtype=bool)
            same[1:-1] = t[1:] == t[:-1]
            same[0] = shares
            on = same[:-1] | same[1:]
            yield pa.RecordBatch.from_arrays([pa.array(t[:-1][on[:-1]]), pa.array(v[:-1][on[:-1]])], names=["tile", "node"])
            tile, node, shares = t[-1:], v[-1:], bool(same[len(t) - 1])
        if shares:
            yield pa.RecordBatch.from_arrays([pa.array(tile), pa.array(node)], names=["tile", "node"])

    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select("text").mapInArrow(emit, "tile long, node long")
    return rows.repartition(parts, "tile").sortWithinPartitions("tile", "node").mapInArrow(keep, "tile long, node long")


def distinct_tiles(tiles: DataFrame) -> DataFrame:
    """(tile, node) of one tile for every set of nodes that tiles have: documents with a passage in common share many tiles."""
    x = tiles.groupBy("tile").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("h1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("h2"))
    one = x.groupBy("n", "h1", "h2").agg(F.min("tile").alias("t")).select("t")
    return tiles.join(one, F.col("tile") == F.col("t"), "left_semi")


def _text_map(wanted: DataFrame):
    """Broadcast bitmap of fixed size of the text hashes in wanted (text_hash): made in pieces, on the executors."""
    at = F.expr(f"text_hash & {(1 << BITMAP_LOG2) - 1}L")
    pieces = wanted.select(F.bitmap_bucket_number(at + 1).alias("k"), F.bitmap_bit_position(at + 1).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("bits")).collect()
    size = 4096
    bitmap = bytearray(((1 << BITMAP_LOG2) // (8 * size) + 2) * size)
    for r in pieces:
        bitmap[(r["k"] - 1) * size : r["k"] * size] = bytes(r["bits"])
    return wanted.sparkSession.sparkContext.broadcast(bytes(bitmap))


def _on_map(have: np.ndarray, hashes: pa.Array) -> pa.Array:
    k = hashes.to_numpy() & ((1 << BITMAP_LOG2) - 1)
    return pa.array((have[k >> 3] >> (k & 7) & 1) == 1)


def node_arrays(docs: DataFrame, wanted: DataFrame, n: int = NGRAM) -> DataFrame:
    """(node, elements): the sorted sets of the wanted nodes (node, text_hash), text_hash being that of one of a node's texts.

    Which texts those are goes to the tasks as a bitmap of fixed size, so that the other texts aren't
    looked into; what passes it by chance is joined away.
    """
    sent = _text_map(wanted)

    def run(batches):
        have, seen = np.frombuffer(sent.value, np.uint8), set()
        for b in batches:
            for _, sets in _sets([b.filter(_on_map(have, b.column(0)))], n):
                out = []
                for s in sets:
                    if len(s) and (node := node_of(s)) not in seen:
                        seen.add(node)
                        out.append((node, np.sort(s.view(np.int64))))
                for i in range(0, len(out), 64):
                    x = out[i : i + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in x], pa.int64()), pa.array([r[1] for r in x], pa.list_(pa.int64()))], names=["node", "elements"])

    found = docs.select(F.xxhash64("text"), "text").mapInArrow(run, "node long, elements array<long>")
    return found.join(wanted.select(F.col("node").alias("want")), F.col("node") == F.col("want"), "left_semi").dropDuplicates(["node"])


def signature(s: np.ndarray) -> bytes:
    """A bitmap of 2**8 to 2**15 bits, four to eight for an element: with fewer, many pairs pass that aren't linked."""
    bits = 1 << min(15, max(8, int(4 * len(s) - 1).bit_length()))
    x = np.zeros(bits, dtype=np.uint8)
    x[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(x, bitorder="little").tobytes()


def _matrix(bits: pa.Array, words: int = 0) -> np.ndarray:
    """[rows, words]: signatures as integers, folded to the shortest of them or to so many words."""
    off = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits) + 1].astype(np.int64)
    data, size = np.frombuffer(bits.buffers()[2], np.uint8), np.diff(off)
    words = words or int(size.min()) // 8
    out = np.empty((len(bits), words), np.uint64)
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        out[at] = np.bitwise_or.reduce(data[off[at][:, None] + np.arange(n)].view(np.uint64).reshape(len(at), -1, words), axis=1)
    return out


def _needed(na, nb, percent: int):
    """The least intersection with which sets of these sizes are linked."""
    return -(-percent * (na + nb) // (100 + percent))


def _may_link(na, nb, x, y, percent: int) -> np.ndarray:
    """Can sets of these sizes and signatures (in the last axis) be linked?  Bits that only one side has bound the intersection from above."""
    both = np.bitwise_count(x & y).sum(axis=-1, dtype=np.int64)
    most = np.minimum(na + both - np.bitwise_count(x).sum(axis=-1, dtype=np.int64), nb + both - np.bitwise_count(y).sum(axis=-1, dtype=np.int64))
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (most >= _needed(na, nb, percent))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Is 100 * intersection >= percent * union, of sorted arrays?"""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum()) >= _needed(len(a), len(b), percent)


def _with_sides(pairs: DataFrame, nodes: DataFrame, *cols: str) -> DataFrame:
    """pairs (a, b) with the columns of nodes of both ends, as <column>_a and <column>_b.

    a may be in very many pairs: they are dealt out over SALTS copies of its row, of which only those that
    some pair asks for are made.
    """
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    asked = dealt.select(F.col("a").alias("node_a"), F.col("salt").alias("salt_a")).distinct()
    side_a = nodes.join(asked, F.col("node") == F.col("node_a")).select("node_a", "salt_a", *[F.col(c).alias(f"{c}_a") for c in cols])
    side_b = nodes.select(F.col("node").alias("node_b"), *[F.col(c).alias(f"{c}_b") for c in cols])
    x = dealt.join(side_b, F.col("b") == F.col("node_b")).join(side_a, (F.col("a") == F.col("node_a")) & (F.col("salt") == F.col("salt_a")))
    return x.select("a", "b", *[f"{c}_{e}" for c in cols for e in "ab"])


def candidates(pairs: DataFrame, info: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that may be linked by the sizes and signatures in info (node, n_shingles, bits)."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                a_, b_, na, nb, xa, xb = b.slice(lo, 512).columns
                na, nb, ok = na.to_numpy(), nb.to_numpy(), np.zeros(len(a_), bool)
                words = np.minimum(*(pa.compute.binary_length(x).to_numpy() for x in (xa, xb))) // 8
                for w in np.unique(words).tolist():
                    at = np.flatnonzero(words == w)
                    ok[at] = _may_link(na[at], nb[at], _matrix(xa.take(pa.array(at)), w), _matrix(xb.take(pa.array(at)), w), percent)
                yield pa.RecordBatch.from_arrays([a_.filter(pa.array(ok)), b_.filter(pa.array(ok))], names=["a", "b"])

    return _with_sides(pairs, info, "n_shingles", "bits").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, info: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that are linked, by their sorted arrays, which are made anew for the nodes that pairs name."""
    named = pairs.select(F.col("a").alias("named")).unionByName(pairs.select(F.col("b").alias("named"))).distinct()
    wanted = checkpoint(info.join(named, F.col("node") == F.col("named"), "left_semi").select("node", "text_hash"), fewer=16)
    arrays = checkpoint(node_arrays(docs, wanted, n), fewer=4)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                p = b.slice(lo, 256)
                a_, b_, la, lb = p.columns
                ok = pa.array([linked(la[i].values.to_numpy(), lb[i].values.to_numpy(), percent) for i in range(p.num_rows)], pa.bool_())
                yield pa.RecordBatch.from_arrays([a_.filter(ok), b_.filter(ok)], names=["a", "b"])

    return _with_sides(pairs, arrays, "elements").mapInArrow(run, "a long, b long")


def _rest(tiles: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes that share a tile, may be linked and aren't in one component yet: tiles (tile, node, comp), blocks against blocks."""
    mixed = tiles.groupBy("tile").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("n")).filter("c0 != c1").select(F.col("tile").alias("t"), "n")
    rows = tiles.join(mixed, F.col("tile") == F.col("t"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(k, mine).alias("i"), F.greatest(k, mine).alias("j"))))
    side = info.select(F.col("node").alias("node_"), "n_shingles", "bits")
    rows = rows.join(side, F.col("node") == F.col("node_")).select("tile", "node", "comp", "n_shingles", "bits", mine.alias("mine"), pair.alias("at"))

    def run(batches):
        held = None  # the last block's rows so far
        for b in batches:
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            if b.num_rows:
                last = int(_starts(b)[-1])
                yield _block_pairs(b.slice(0, last), percent)
                held = b.slice(last)
        if held is not None:
            yield _block_pairs(held, percent)

    rows = rows.select("tile", "at.i", "at.j", "node", "comp", "n_shingles", "mine", "bits")
    parts = max(1, int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, "tile", "i", "j").sortWithinPartitions("tile", "i", "j").mapInArrow(run, "a long, b long")


def _starts(b: pa.RecordBatch) -> np.ndarray:
    """First rows of the runs of equal (tile, i, j)."""
    keys = np.column_stack([b.column(k).to_numpy() for k in range(3)])
    return np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))


def _block_pairs(b: pa.RecordBatch, percent: int) -> pa.RecordBatch:
    """Pairs of nodes in each block of a batch of whole blocks: row r meets row r + d of its block, in the order of sizes, for all blocks at once."""
    found = [np.zeros((2, 0), np.int64)]
    if b.num_rows:
        first = _starts(b)
        block = np.repeat(np.arange(len(first)), np.diff(np.append(first, b.num_rows)))
        within, node, comp, size, mine = (b.column(1).to_numpy() == b.column(2).to_numpy(), *(b.column(k).to_numpy() for k in range(3, 7)))
        words = np.minimum.reduceat(pa.compute.binary_length(b.column(7)).to_numpy() // 8, first)[block]
        for w in np.unique(words).tolist():
            at = np.flatnonzero(words == w)
            at = at[np.lexsort((size[at], block[at]))]
            x, n, g = _matrix(b.column(7).take(pa.array(at)), w), size[at], block[at]
            left, d = np.arange(len(at)), 1
            while len(left := left[left + d < len(at)]):
                left = left[(g[left] == g[left + d]) & (percent * n[left + d] <= 100 * n[left])]  # those behind are larger still
                p, q = at[left], at[left + d]
                test = left[(comp[p] != comp[q]) & (within[p] | (mine[p] != mine[q]))]
                for lo in range(0, len(test), (1 << 19) // w):
                    k = test[lo : lo + (1 << 19) // w]
                    k = k[_may_link(n[k], n[k + d], x[k], x[k + d], percent)]
                    found.append(np.stack([node[at[k]], node[at[k + d]]]))
                d += 1
    pairs = np.concatenate(found, axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=0)), pa.array(pairs.max(axis=0))], names=["a", "b"])


def set_components(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(rows, roots): set_rows of docs, and (node, root) of the nodes that are linked with a smaller one."""
    rows = checkpoint(set_rows(docs, n), fewer=4)
    tiles = checkpoint(shared_tiles(docs, n, percent), fewer=4)
    weight = tiles.groupBy("node").count().select(F.col("node").alias("node_"), "count")
    info = checkpoint(rows.join(weight, F.col("node") == F.col("node_"), "left_semi").groupBy("node").agg(F.min("n_shingles").alias("n_shingles"), F.min("text_hash").alias("text_hash"), F.min("bits").alias("bits")), fewer=4)
    tiles = checkpoint(distinct_tiles(tiles).join(weight, F.col("node") == F.col("node_")).select("tile", "node", "count"), fewer=4)
    pivot = tiles.groupBy("tile").agg(F.max(F.struct("count", "node")).alias("p")).select(F.col("tile").alias("t"), F.col("p.node").alias("a"))
    pairs = tiles.join(pivot, F.col("tile") == F.col("t")).filter("a != node").select("a", F.col("node").alias("b")).distinct()
    edges = checkpoint(verified(checkpoint(candidates(pairs, info, percent), fewer=16), docs, info, n, percent), fewer=16)
    roots = components(edges)
    known = tiles.join(roots.withColumnRenamed("node", "node_"), F.col("node") == F.col("node_"), "left").select("tile", "node", F.coalesce("root", "node").alias("comp"))
    more = checkpoint(_rest(known, info, percent).distinct(), fewer=16)
    if more.first() is not None:
        more = checkpoint(verified(more, docs, info, n, percent), fewer=16)
        if more.first() is not None:
            roots = components(edges.unionByName(more))
    return rows.drop("bits"), roots


def near_duplicates(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row of docs (doc_id, text).

    Null texts and texts without words have the empty set, and are linked with nothing.  Rows with
    equal sets, repeated rows among them, are linked.  A null doc_id is reachable but never the
    smallest, unless alone.  An empty table gives no rows.
    """
    rows, roots = set_components(docs, n, percent)
    full = rows.filter("n_shingles > 0")
    ids = full.groupBy("node").agg(F.min("doc_id").alias("least_id")).join(roots.withColumnRenamed("node", "node_"), F.col("node") == F.col("node_"), "left").select("node", "least_id", F.coalesce("root", "node").alias("root"))
    least = ids.groupBy(F.col("root").alias("r")).agg(F.min("least_id").alias("component_id"))
    of = checkpoint(ids.join(least, F.col("root") == F.col("r")).select(F.col("node").alias("of_node"), "component_id"), fewer=16)
    found = full.join(of, F.col("node") == F.col("of_node")).select("doc_id", "n_shingles", "component_id")
    return found.unionByName(rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def without_near_duplicates(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT) -> DataFrame:
    """Rows of docs, whole, less all but one (the smallest doc_id) of each group of linked documents.

    Of rows that repeat in doc_id and text, one stays; extra columns stay as they are.  Only decisions on rows
    that go, or repeat one that stays, are joined with the documents.
    """
    rows, roots = set_components(docs, n, percent)
    full = rows.filter("n_shingles > 0")
    who = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    ids = full.groupBy("node").agg(F.min(who).alias("who"), F.count("*").alias("rows")).join(roots.withColumnRenamed("node", "node_"), F.col("node") == F.col("node_"), "left").select("node", "who", "rows", F.coalesce("root", "node").alias("root"))
    stay = ids.groupBy(F.col("root").alias("r")).agg(F.min("who").alias("first"), F.sum("rows").alias("rows_in_all")).filter("rows_in_all > 1")
    of = checkpoint(ids.join(stay, F.col("root") == F.col("r")).select(F.col("node").alias("of_node"), F.col("first.id").alias("first_id"), F.col("first.hash").alias("first_hash")), fewer=16)
    x = full.join(of, F.col("node") == F.col("of_node"))
    stays = F.max(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))).alias("stays")
    touched = x.groupBy("doc_id", "text_hash").agg(stays, F.count("*").alias("n")).filter("not stays or n > 1").select("doc_id", "text_hash", "stays")
    return without_rows(docs, checkpoint(touched, fewer=16))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT c.doc_id, e.b FROM c JOIN e ON c.root = e.a)
SELECT c.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id FROM c LEFT JOIN n ON n.doc_id = c.doc_id GROUP BY c.doc_id"""
