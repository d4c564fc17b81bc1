"""13. Phrase collocation mining by a minimal perfect hash over Apriori-safe candidates.

Candidates come first: a phrase can occur SUPPORT times only if its parts do, so words are tested, then pairs of words that
pass, then phrases of three to five words whose pairs all pass.  A test sums counts that each task caps at SUPPORT, which
says whether a phrase has enough, not how many; what passed goes to the next test as a bitmap of fixed size.

A minimal perfect hash (levels of bit vectors, each taking the keys that meet no other there) gives every candidate a slot, in which
its key is stored, to turn away the phrases that aren't candidates.  Mappers bincount their slots into numpy arrays, which are summed
as a tree, FAN at a time, in chunks of slots.  Each candidate is spelled out once, with the keys of the two parts of its
cuts, whose counts are read from the summed arrays by slot.

Slots are worked on in blocks of at most SLOTS, each with a pass over the texts, so that neither a task nor the driver ever holds more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm._spark import bitmap, checkpoint, coalesced
from lorekeep.llm._tokens import Words, mix, pack, slices, unpack

SUPPORT = 100
LONGEST = 5
TOP = 2000
SLOTS = 1 << 22  # candidates that are counted in one pass over the texts: 80 MB of keys, counts and places in a task
SEGMENT = 1 << 16  # candidates of one perfect hash, about
CHUNK = 1024  # slots of a piece of an array of counts
FAN = 16  # arrays that are summed at once
FLUSH = 1 << 21  # phrases that a task sorts at once
HASH_BITS = 40  # of a key, in the tests: keys that agree in these only make a candidate more
RANGES = 2  # ranges of the hash for each shuffle partition, added up one after the other
MAP_LOG2 = 27  # bits of the bitmap of what passed a test: 16 MB
ENDS = np.ones(256, dtype=bool)  # bytes that words are made of
ENDS[[*b" \t\n\x0b\x0c\r.,;:!?"]] = False
_CUT = np.zeros(256, dtype=bool)  # bytes that end a piece
_CUT[[*b"\n\x0b\x0c\r.,;:!?"]] = True


class Phrases:
    """Phrases of a slice of texts: keys[k][i] names the k words from word i on, in the text's language; room[i] words are left in the piece."""

    def __init__(self, words: Words, lang: np.ndarray):
        h, n = words.hashes(), len(words.start)
        self.words, self.room = words, np.zeros(n, np.int64)
        text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
        ends = np.cumsum(_CUT[words.data])[words.start] if n else np.zeros(0, np.int64)
        last = np.ones(n, bool)
        last[:-1] = (ends[1:] != ends[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(last)
        self.room = np.repeat(at, np.diff(at, prepend=-1)) - np.arange(n) + 1
        self.text = text
        keys = [mix(h + mix(lang.view(np.uint64), 21)[text], 22)]
        for k in range(1, LONGEST):
            ahead = np.zeros(n, np.uint64)
            ahead[: max(0, n - k)] = h[k:]
            keys.append(mix(keys[-1] + ahead, 22 + k))
        self.keys = [None, *keys]

    def all_of(self, k: int, ok: np.ndarray, of: int) -> np.ndarray:
        """Where the k words from a word on lie in one piece, and all phrases of ``of`` words in them are ok."""
        out = self.room >= k
        for j in range(k - of + 1):
            out[: max(0, len(ok) - j)] &= ok[j:]
        return out


def _texts(docs: DataFrame) -> DataFrame:
    """lang (null: und), its hash, place (15 bits of a hash of the text) and text of each row."""
    lang = F.coalesce(docs["lang"], F.lit("und"))
    return docs.select(lang.alias("lang"), F.xxhash64(lang).alias("lang_hash"), F.xxhash64(docs["text"]).bitwiseAND(0x7FFF).cast("short").alias("place"), "text")


def _phrases(batches):
    for b in batches:
        lang, place = b.column(1).to_numpy(), b.column(2).to_numpy()
        for lo, hi, words in slices(b.column(3), of_word=ENDS):
            yield b, lo, place[lo:hi], Phrases(words, lang[lo:hi])


def _tested(x: Phrases, level: int, maps: list[np.ndarray]):
    """(k, places) of the phrases of a level whose parts passed the tests before it: one word (level 1), two (2), three to five (3)."""
    if level == 1:
        yield 1, np.flatnonzero(x.room >= 1)
        return
    ok = _on_map(maps[level - 2], x.keys[level - 1]) & (x.room >= level - 1)
    for k in {2: [2], 3: range(3, LONGEST + 1)}[level]:
        yield k, np.flatnonzero(x.all_of(k, ok, level - 1))


def _support(docs: DataFrame, level: int, passed: list) -> DataFrame:
    """(hash): the leading HASH_BITS bits of the keys that, all keys with these bits together, occur SUPPORT times or more.

    Tasks send the hashes sorted, as gaps, with their counts, in seven bits a byte: about four bytes for a distinct phrase.
    """
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = RANGES * parts

    def send(batches):
        keys, n = [], 0
        maps = [np.frombuffer(m.value, np.uint8) for m in passed]

        def flush():
            h = np.sort(np.concatenate(keys)).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            many = np.minimum(np.diff(np.append(first, len(h))), SUPPORT)
            h = h[first]
            of = h * ranges >> HASH_BITS
            opens = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            gaps = np.diff(h, prepend=0)
            gaps[opens] = h[opens]
            data, start = pack(np.column_stack([gaps, many]).ravel())
            cut = np.append(start[::2][opens], len(data))
            raw = data.tobytes()
            for a in range(0, len(opens), 1000):
                some = slice(a, min(a + 1000, len(opens)))
                yield pa.RecordBatch.from_arrays([pa.array(of[opens[some]]), pa.array([raw[i:j] for i, j in zip(cut[some], cut[a + 1 : some.stop + 1])], pa.binary())], names=["range", "data"])

        for _, _, _, x in _phrases(batches):
            for k, at in _tested(x, level, maps):
                keys.append(x.keys[k][at] >> np.uint64(64 - HASH_BITS))
                n += len(at)
            if n >= FLUSH:
                yield from flush()
                keys, n = [], 0
        if n:
            yield from flush()

    def add(batches):
        now, held = None, []

        def close():
            x = [unpack(np.frombuffer(d, np.uint8)) for d in held]
            h, many = np.concatenate([np.cumsum(v[::2]) for v in x]), np.concatenate([v[1::2] for v in x])
            h, back = np.unique(h, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(h[np.bincount(back, weights=many) >= SUPPORT])], names=["hash"])

        for b in batches:
            for r, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if r != now and held:
                    yield close()
                    held = []
                now = r
                held.append(d)
        if held:
            yield close()

    rows = _texts(docs).mapInArrow(send, "range long, data binary")
    return rows.repartition(parts, "range").sortWithinPartitions("range").mapInArrow(add, "hash long")


def _on_map(have: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys >> np.uint64(64 - HASH_BITS) & np.uint64((1 << MAP_LOG2) - 1)).astype(np.int64)
    return (have[at >> 3] >> (at & 7) & 1).astype(bool)


def candidates(docs: DataFrame) -> DataFrame:
    """(key, place) of all phrases of one to LONGEST words that occur SUPPORT times or more; place is the least that a text with it has."""
    passed: list = []
    for level in (1, 2, 3):
        passed.append(bitmap(_support(docs, level, passed), MAP_LOG2))

    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = RANGES * parts

    def send(batches):
        keys, places, n = [], [], 0
        maps = [np.frombuffer(m.value, np.uint8) for m in passed]

        def flush():
            k, many, p = _summed(np.concatenate(keys), np.ones(n, np.int64), np.concatenate(places))
            of = ((k >> np.uint64(64 - HASH_BITS)).astype(np.int64) * ranges) >> HASH_BITS
            cut = np.append(np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])), len(of))
            pieces = [(k[i:j].tobytes(), np.minimum(many[i:j], SUPPORT).astype(np.uint8).tobytes(), p[i:j].tobytes()) for i, j in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(of[cut[:-1]]), *[pa.array(c, pa.binary()) for c in zip(*pieces)]], names=["range", "keys", "n", "places"])

        for _, _, place, x in _phrases(batches):
            for level in (1, 2, 3):
                for k, at in _tested(x, level, maps):
                    at = at[_on_map(maps[level - 1], x.keys[k][at])]
                    keys.append(x.keys[k][at])
                    places.append(place[x.text[at]])
                    n += len(at)
            if n >= FLUSH:
                yield from flush()
                keys, places, n = [], [], 0
        if n:
            yield from flush()

    def add(batches):
        now, held = None, []

        def close():
            k, many, p = (np.concatenate([np.frombuffer(x[i], kind) for x in held]) for i, kind in enumerate((np.uint64, np.uint8, np.int16)))
            k, many, p = _summed(k, many.astype(np.int64), p)
            on = many >= SUPPORT
            return pa.RecordBatch.from_arrays([pa.array(k[on].view(np.int64)), pa.array(p[on])], names=["key", "place"])

        for b in batches:
            for r, *x in zip(*(c.to_pylist() for c in b.columns)):
                if r != now and held:
                    yield close()
                    held = []
                now = r
                held.append(x)
        if held:
            yield close()

    rows = _texts(docs).mapInArrow(send, "range long, keys binary, n binary, places binary")
    return checkpoint(rows.repartition(parts, "range").sortWithinPartitions("range").mapInArrow(add, "key long, place short"), fewer=4)


def _summed(keys: np.ndarray, many: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, their sums of many, and their least places."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(many[order], first), np.minimum.reduceat(places[order], first)


# ---- minimal perfect hash


def perfect_hash(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(bit vectors of the levels, slot of each key) of distinct keys."""
    levels, slot, left, base = [], np.zeros(len(keys), np.int64), np.arange(len(keys)), 0
    while len(left):
        size = 2 * len(left) + 1
        at = (mix(keys[left], 100 + len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        mine = alone[at]
        slot[left[mine]] = base + (np.cumsum(alone) - 1)[at[mine]]
        levels.append(alone)
        base += int(mine.sum())
        left = left[~mine]
    return levels, slot


def _segment(keys: np.ndarray, n: int) -> np.ndarray:
    return (mix(keys, 77) % np.uint64(n)).astype(np.int64)


def hashed(found: DataFrame) -> tuple[DataFrame, int]:
    """(segments, how many): a row for each segment of the candidates found, which can be read twice: its hash's levels, and keys and places by slot."""
    n = max(1, -(-found.count() // SEGMENT))

    def segment(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_segment(b.column(0).to_numpy().view(np.uint64), n)), *b.columns], names=["segment", "key", "place"])

    def run(batches):
        held = None
        for b in batches:
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            if b.num_rows:
                last = int(np.searchsorted(b.column(0).to_numpy(), b.column(0)[b.num_rows - 1].as_py()))
                yield from built(b.slice(0, last))
                held = b.slice(last)
        if held is not None:
            yield from built(held)

    def built(b):
        of = b.column(0).to_numpy()
        for s in np.unique(of).tolist():
            x = b.slice(int(np.searchsorted(of, s)), int((of == s).sum()))
            keys = x.column(1).to_numpy().view(np.uint64)
            levels, slot = perfect_hash(keys)
            by_slot, place = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.int16)
            by_slot[slot], place[slot] = keys, x.column(2).to_numpy()
            bits = [np.packbits(v, bitorder="little").tobytes() for v in levels]
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([[len(v) for v in levels]], pa.list_(pa.int64())), pa.array([bits], pa.list_(pa.binary())), pa.array([by_slot.tobytes()], pa.binary()), pa.array([place.tobytes()], pa.binary())], names=["segment", "n", "sizes", "bits", "by_slot", "places"])

    parts = max(1, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = found.mapInArrow(segment, "segment long, key long, place short").repartition(parts, "segment").sortWithinPartitions("segment", "key")
    return checkpoint(x.mapInArrow(run, "segment long, n long, sizes array<long>, bits array<binary>, by_slot binary, places binary")), n


class Slots:
    """The perfect hash of some segments: slots from 0, with the keys stored in them."""

    def __init__(self, rows: list, n: int):
        self.n, bits, ranks, offset = n, [], [], 0
        deep = max([len(r["sizes"]) for r in rows], default=0)
        self.size, self.start = np.ones((n, deep), np.uint64), np.zeros((n, deep), np.int64)
        self.keys = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(r["by_slot"], np.uint64) for r in rows]])
        self.places = np.concatenate([np.zeros(0, np.int16), *[np.frombuffer(r["places"], np.int16) for r in rows]])
        empty = 64  # no key of a segment, or of a level of it, that isn't here
        bits.append(np.zeros(empty, np.uint8))
        for r in rows:
            for k, (size, raw) in enumerate(zip(r["sizes"], r["bits"])):
                self.size[r["segment"], k] = size
                self.start[r["segment"], k] = empty + offset
                bits.append(np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=size))
                offset += size
        flat = np.concatenate(bits)
        pad = -len(flat) % 64
        self.bits = np.packbits(np.append(flat, np.zeros(pad, np.uint8)), bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.bits)
        self.ranks = np.cumsum(ones, dtype=np.int64) - ones

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 of those that have none."""
        out = np.full(len(keys), -1, np.int64)
        left, segment = np.arange(len(keys)), _segment(keys, self.n)
        for k in range(self.size.shape[1]):
            if not len(left):
                break
            s = segment[left]
            at = self.start[s, k] + (mix(keys[left], 100 + k) % self.size[s, k]).astype(np.int64)
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            slot = self.ranks[at[hit] >> 6] + np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            same = self.keys[slot] == keys[left[hit]]
            out[left[hit][same]] = slot[same]
            left = left[~hit]
        return out


# ---- counting


_COUNTED = pa.schema([("chunk", pa.int64()), ("counts", pa.binary()), ("lang", pa.string()), ("words", pa.int64()), ("key", pa.int64()), ("phrase", pa.string()), ("lefts", pa.list_(pa.int64())), ("rights", pa.list_(pa.int64()))])
COUNTED = "chunk long, counts binary, lang string, words long, key long, phrase string, lefts array<long>, rights array<long>"


def _counted(docs: DataFrame, sent) -> DataFrame:
    """Rows of three kinds from each task: pieces of its array of counts, words a language, and phrases spelled out."""

    def rows(**cols):
        n = len(next(iter(cols.values())))
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in _COUNTED], schema=_COUNTED)

    def run(batches):
        slots = sent.value
        n = len(slots.keys)
        counts, seen, told = np.zeros(n, np.int64), [], np.zeros(n, bool)
        words: dict[str, int] = {}
        for b, lo, place, x in _phrases(batches):
            langs = b.column(0).slice(lo, len(place)).to_pylist()
            for i, m in enumerate(np.diff(x.words.first).tolist()):
                words[langs[i]] = words.get(langs[i], 0) + m
            spelled = []
            for k in range(1, LONGEST + 1):
                at = np.flatnonzero(x.room >= k)
                slot = slots.of(x.keys[k][at])
                at, slot = at[slot >= 0], slot[slot >= 0]
                seen.append(slot)
                if k > 1:
                    here = np.flatnonzero((slots.places[slot] == place[x.text[at]]) & ~told[slot])
                    _, one = np.unique(slot[here], return_index=True)
                    told[slot[here[one]]] = True
                    spelled += [(i, k) for i in at[here[one]].tolist()]
            if spelled:
                d, s, e = x.words.data.tobytes(), x.words.start, x.words.end
                keys = [v.view(np.int64) if v is not None else None for v in x.keys]
                yield rows(
                    lang=[langs[x.text[i]] for i, _ in spelled],
                    key=[int(keys[k][i]) for i, k in spelled],
                    phrase=[b" ".join(d[s[j] : e[j]] for j in range(i, i + k)).decode() for i, k in spelled],
                    lefts=[[int(keys[c][i]) for c in range(1, k)] for i, k in spelled],
                    rights=[[int(keys[k - c][i + c]) for c in range(1, k)] for i, k in spelled],
                )
            if sum(map(len, seen)) >= FLUSH // 4:
                counts += np.bincount(np.concatenate(seen), minlength=n)
                seen = []
        if seen:
            counts += np.bincount(np.concatenate(seen), minlength=n)
        some = [c for c in range(-(-n // CHUNK)) if counts[c * CHUNK : (c + 1) * CHUNK].any()]
        for a in range(0, len(some), 256):
            yield rows(chunk=some[a : a + 256], counts=[counts[c * CHUNK : (c + 1) * CHUNK].tobytes() for c in some[a : a + 256]])
        yield rows(lang=list(words), words=list(words.values()))

    return checkpoint(coalesced(_texts(docs), 1).mapInArrow(run, COUNTED))


def tree_sum(pieces: DataFrame, parts: int) -> DataFrame:
    """(chunk, counts): sums of the arrays of parts tasks, pieces (chunk, part, counts), FAN of them at a time."""

    def run(batches):
        held = None  # (chunk, part), sum
        for b in batches:
            out = []
            for chunk, part, counts in zip(*(c.to_pylist() for c in b.columns)):
                x = np.frombuffer(counts, np.int64)
                if held and held[0] == (chunk, part):
                    held = (held[0], held[1] + x)
                else:
                    if held:
                        out.append(held)
                    held = ((chunk, part), x)
            yield batch(out)
        if held:
            yield batch([held])

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0][0] for r in rows], pa.int64()), pa.array([r[0][1] for r in rows], pa.int64()), pa.array([r[1].tobytes() for r in rows], pa.binary())], names=["chunk", "part", "counts"])

    n = max(1, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    while True:
        up = pieces.withColumn("part", F.floor(F.col("part") / FAN).cast("long"))
        pieces = up.repartition(n, "chunk", "part").sortWithinPartitions("chunk", "part").mapInArrow(run, "chunk long, part long, counts binary")
        parts = -(-parts // FAN)
        if parts <= 1:
            return pieces.select("chunk", "counts")


def _read(spelled: DataFrame, sent) -> DataFrame:
    """spelled with a, ls and rs filled in where their slots are in the block that is sent (slots, counts)."""

    def run(batches):
        slots, counts = sent.value
        for b in batches:

            def read(keys, old, counts=counts):
                slot = slots.of(keys.to_numpy(zero_copy_only=False).view(np.uint64))
                return pa.array(np.where(slot >= 0, counts[np.maximum(slot, 0)] if len(counts) else 0, old.to_numpy(zero_copy_only=False)))

            cols = {n: b.column(k) for k, n in enumerate(b.schema.names)}
            cols["a"] = read(cols["key"], cols["a"])
            for keys, sums in (("lefts", "ls"), ("rights", "rs")):
                flat = read(cols[keys].flatten(), cols[sums].flatten())
                off = np.concatenate([[0], np.cumsum(cols[keys].value_lengths().to_numpy())])
                cols[sums] = pa.ListArray.from_arrays(pa.array(off, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return spelled.mapInArrow(run, spelled.schema)


def phrase_counts(docs: DataFrame, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(phrases, words): lang, key, phrase, lefts, rights, a, ls, rs of each phrase of 2 to LONGEST words with a >= SUPPORT, and lang, n.

    lefts[c - 1] and rights[c - 1] are the keys of the parts of the cut after c words, ls and rs their counts.
    """
    spark = docs.sparkSession
    segments, n = hashed(candidates(docs))
    per_block = max(1, slots // SEGMENT)
    blocks, told = [], []
    for b in range(-(-n // per_block)):
        mine = segments.filter(F.floor(F.col("segment") / per_block) == b).orderBy("segment").collect()  # slots keys, about
        sent = spark.sparkContext.broadcast(Slots(mine, n))
        rows = _counted(docs, sent)
        pieces = rows.filter("chunk is not null").select("chunk", F.spark_partition_id().cast("long").alias("part"), "counts")
        total = np.zeros(len(sent.value.keys), np.int64)
        for r in tree_sum(pieces, rows.rdd.getNumPartitions()).collect():  # slots counts, about
            total[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.int64)
        blocks.append(spark.sparkContext.broadcast((sent.value, total)))
        told.append(rows)
    zeros = lambda c: F.transform(c, lambda _: F.lit(0).cast("long"))
    spelled = told[0]
    for x in told[1:]:
        spelled = spelled.unionByName(x)
    words = told[0].filter("words is not null").groupBy("lang").agg(F.sum("words").alias("n"))
    spelled = spelled.filter("key is not null").select("lang", "key", "phrase", "lefts", "rights").dropDuplicates(["key"])
    spelled = spelled.select("*", F.lit(0).cast("long").alias("a"), zeros("lefts").alias("ls"), zeros("rights").alias("rs"))
    for sent in blocks:
        spelled = _read(spelled, sent)
    return checkpoint(spelled, fewer=4), words


def _scored(batches):
    """The lowest cut of each phrase, in whole numbers of any size."""
    for b in batches:
        lang, phrase, key, a, ls, rs, n = (c.to_pylist() for c in b.columns)
        cuts = [min((1000 * a[i] * n[i] // (x * y), k) for k, (x, y) in enumerate(zip(ls[i], rs[i]))) for i in range(len(a))]
        out = [b.column(0), b.column(1), b.column(2), b.column(3), pa.array([ls[i][k] for i, (_, k) in enumerate(cuts)], pa.int64()), pa.array([rs[i][k] for i, (_, k) in enumerate(cuts)], pa.int64()), b.column(6), pa.array([s for s, _ in cuts], pa.int64())]
        yield pa.RecordBatch.from_arrays(out, names=["lang", "phrase", "key", "a", "l", "r", "n", "score"])


def collocations(docs: DataFrame, top: int = TOP, slots: int = SLOTS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the top phrases of each language of docs (text, lang).

    Null texts are empty; a null lang is ``und``; repeated rows count as often as they are there; ties go by a, then by the phrase's
    bytes; texts without phrases that are frequent enough, and empty tables, give no rows.
    """
    phrases, words = phrase_counts(docs, slots)
    # a phrase inside a longer one as frequent is inside one that is longer by a word, and as frequent
    longer = phrases.filter(F.size("lefts") >= 2)
    inside = longer.filter(F.col("a") >= F.element_at("ls", -1)).select(F.element_at("lefts", -1).alias("in_key"))
    inside = inside.unionByName(longer.filter(F.col("a") >= F.col("rs")[0]).select(F.col("rights")[0].alias("in_key"))).distinct()
    left = phrases.join(inside, F.col("key") == F.col("in_key"), "left_anti")
    of = words.select(F.col("lang").alias("lang_"), "n")
    x = left.join(of, F.col("lang") == F.col("lang_")).select("lang", "phrase", "key", "a", "ls", "rs", "n")
    x = x.mapInArrow(_scored, "lang string, phrase string, key long, a long, l long, r long, n long, score long")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return x.withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(ps) AS piece FROM t)),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND f >= 100),
inside AS (
  SELECT DISTINCT d.lang, d.phrase FROM (
    SELECT lang, k, a, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))))) AS phrase FROM c) s
  JOIN c d ON d.lang = s.lang AND d.phrase = s.phrase AND d.k < s.k AND 100 * s.a >= 100 * d.a),
cuts AS (SELECT lang, phrase, a, j, array_to_string(ws[1:j], ' ') AS first_part, array_to_string(ws[j + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (
  SELECT lang, cuts.phrase, a, j, x.f AS l, y.f AS r, n, CAST((1000 * CAST(a AS HUGEINT) * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts JOIN f x USING (lang) JOIN f y USING (lang) JOIN n USING (lang) WHERE x.phrase = first_part AND y.phrase = rest
  QUALIFY row_number() OVER (PARTITION BY lang, cuts.phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM s ANTI JOIN inside USING (lang, phrase) QUALIFY rank <= 2000"""
