"""Similarity join of names by their trigrams: many names against many at once, without comparing all pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.expr import similarity, trigrams
from lorekeep.functions.recovery import written

BLOCK = 2048  # prefix rows of one trigram (of a hot one: with a further trigram) and side that meet in one group
HOT = 16  # texts of the other side that a text meets by a trigram, from which on it meets them by two trigrams instead
ALONE = -1  # what stands for the further trigram of a hot one, for texts that may be similar by it alone
LOOKS = (0.7, 0.6)  # thresholds by which ``best_of_all`` looks for a seed's best before it looks by the one asked for
GRAMS = 37**3  # trigrams of letters, digits and blanks
ENTRIES, FACTS = 1 << 23, 1 << 19  # entries of the index of seeds, and facts, that meet in one task, about and at most
AT_ONCE = 1 << 18  # pairs that a task looks at at once, and that it keeps before it drops those that aren't among the best


def _sets(df: DataFrame, text: Column) -> DataFrame:
    """text, grams of each distinct text, written out: trigrams are cut once, whatever is done with them."""
    return written(df.select(text.alias("text")).filter("text is not null").distinct().withColumn("grams", trigrams(F.col("text"))))


def _ranks(left: DataFrame, right: DataFrame, hot: int) -> DataFrame:
    """gram, rank, hot of the trigrams that both sides have, those that the fewest pairs share first.  Trigrams are of letters, digits and blanks, so there are at most 37 ** 3."""
    count = lambda df: df.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").cast("double").alias("n"))
    n = count(left).withColumnRenamed("n", "l_n").join(count(right).withColumnRenamed("n", "r_n"), "gram")
    pairs = F.col("l_n") * F.col("r_n")
    return n.select("gram", F.row_number().over(Window.orderBy(pairs, "gram")).alias("rank"), (pairs > hot * (F.col("l_n") + F.col("r_n"))).alias("hot"))


def _prefixes(sets: DataFrame, ranks: DataFrame, least: float) -> DataFrame:
    """text, grams (ranks of those that the other side has, ascending), n (of all), and rows (rank, next, at) of the grams that a similar text may share first.

    next is 0, but a hot gram has a row for each gram that may be the second that is shared, and one with ALONE if the text is so small that a
    similar one may share no second.  at is the place of the row's last gram among all; those that the other side lacks come first.
    """
    x = sets.select("text", F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(F.broadcast(ranks), "gram")
    x = x.groupBy("text").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("rank", "hot"))).alias("known"))
    x = x.withColumn("need", F.ceil(F.col("n") * least - 1e-9).cast("int")).withColumn("lacks", F.col("n") - F.size("known"))
    ahead = lambda shared: F.greatest(F.lit(0), F.col("n") - F.greatest("need", F.lit(shared)) + shared - F.col("lacks"))
    x = x.select("text", F.col("known.rank").alias("grams"), "n", "need", "lacks", ahead(2).alias("ahead"), F.posexplode(F.slice("known", F.lit(1), ahead(1))).alias("place", "gram"))
    none = F.array().cast("array<int>")
    seconds = F.slice("grams", F.col("place") + 2, F.greatest(F.lit(0), F.col("ahead") - F.col("place") - 1))
    nexts = F.when(F.col("gram.hot"), F.concat(seconds, F.when(F.col("need") <= 1, F.array(F.lit(ALONE))).otherwise(none))).otherwise(F.array(F.lit(0)))
    x = x.select("text", "grams", "n", "lacks", "place", F.col("gram.rank").alias("rank"), F.explode(nexts).alias("next"))
    at = F.when(F.col("next") > 0, F.array_position("grams", F.col("next")).cast("int") - 1).otherwise(F.col("place"))
    return x.select("text", "grams", "n", (F.col("lacks") + at).alias("at"), "rank", "next")


def similar_texts(left: DataFrame, right: DataFrame, least: float, left_text: Column, right_text: Column, strict: bool = False, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """left_text, right_text, similarity of all pairs of distinct texts that share at least (strict: more than) ``least`` of their trigrams.

    Two such texts share one of their rarest trigrams; they meet on the rarest one that they share, if their sizes and its places leave room
    for enough others, and then their whole sets are compared.  By a trigram that is hot, by which texts would meet about ``hot`` others or more, only those meet
    that share a second one, too, or are so small that they need none.  What many texts still share is dealt out over blocks of texts of both
    sides, so that no group holds more than about block * block pairs.  NULL texts and those without trigrams are similar to nothing.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    return _similar(_sets(left, left_text), _sets(right, right_text), least, strict, block, hot)


def _similar(lefts: DataFrame, rights: DataFrame, least: float, strict: bool, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """``similar_texts`` of written sets of trigrams."""
    ranks = written(_ranks(lefts, rights, hot))
    a = written(_prefixes(lefts, ranks, least).toDF("l_text", "l_grams", "l_n", "l_at", "rank", "next"))
    b = written(_prefixes(rights, ranks, least).toDF("r_text", "r_grams", "r_n", "r_at", "rank", "next"))
    key = ["rank", "next"]
    counts = a.groupBy(key).agg(F.count("*").alias("l_rows")).join(b.groupBy(key).agg(F.count("*").alias("r_rows")), key)
    counts = counts.filter(F.greatest("l_rows", "r_rows") > block)  # one row a key of so many texts
    blocks = F.broadcast(written(counts.select(*key, F.ceil(F.col("l_rows") / block).cast("int").alias("l_blocks"), F.ceil(F.col("r_rows") / block).cast("int").alias("r_blocks"))))
    many = lambda n: F.coalesce(n, F.lit(1))
    every = lambda n: F.explode(F.sequence(F.lit(0), many(n) - 1))
    own = lambda t, n: F.pmod(F.xxhash64(t), many(n)).cast("int")
    a = a.join(blocks, key, "left").withColumn("l_block", own("l_text", "l_blocks")).withColumn("r_block", every("r_blocks")).drop("l_blocks", "r_blocks")
    b = b.join(blocks, key, "left").withColumn("r_block", own("r_text", "r_blocks")).withColumn("l_block", every("l_blocks")).drop("l_blocks", "r_blocks")
    need = F.ceil((F.col("l_n") + F.col("r_n")) * (least / (1 + least)) - 1e-9)
    room = F.least(F.col("l_n") - F.col("l_at"), F.col("r_n") - F.col("r_at")) + (F.col("next") > 0).cast("int") >= need
    # rows of alike sets shuffle to few bytes and unpack to many: neither side may be taken for small and sent through the driver, nor
    # tasks made few by their bytes
    met = [*key, "l_block", "r_block"]
    parts = int(lefts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = a.repartition(parts, *met).hint("merge").join(b.repartition(parts, *met), met).filter(room)
    x = x.withColumn("shared", F.array_intersect("l_grams", "r_grams"))  # in the order of l_grams
    second = F.get("shared", F.lit(1))
    x = x.filter((F.get("shared", F.lit(0)) == F.col("rank")) & F.when(F.col("next") > 0, second == F.col("next")).otherwise((F.col("next") == 0) | second.isNull()))
    s = F.size("shared") / (F.col("l_n") + F.col("r_n") - F.size("shared"))
    x = x.select(F.col("l_text").alias("left_text"), F.col("r_text").alias("right_text"), s.alias("similarity"))
    return x.filter((F.col("similarity") > least) if strict else (F.col("similarity") >= least))


def near_names_of_all(entities: DataFrame, names: DataFrame, least: float = 0.4, shortest: int = 4) -> DataFrame:
    """asked, id, name, exact, similarity: what ``search.near_names`` gives, for all names of a table (column name) in one job.

    Names that are equal but for case and blanks around are near whatever their length; similar ones only if the name is long enough to tell.
    """
    asked = names.select(F.col("name").alias("asked")).filter("asked is not null").distinct()
    there = entities.select(F.col("name").alias("there")).filter("there is not null").distinct()
    key = lambda c: F.lower(F.trim(F.col(c)))
    same = asked.withColumn("k", key("asked")).join(there.withColumn("k", key("there")), "k").select("asked", "there")
    near = similar_texts(asked.filter(F.length(F.trim("asked")) >= shortest), there, least, F.col("asked"), F.col("there"))
    pairs = near.select(F.col("left_text").alias("asked"), F.col("right_text").alias("there"), "similarity")
    pairs = pairs.unionByName(same.withColumn("similarity", similarity(trigrams(F.col("asked")), trigrams(F.col("there")))))
    pairs = pairs.groupBy("asked", "there").agg(F.max("similarity").alias("similarity"))
    found = entities.select("id", "name").join(pairs, F.col("name") == F.col("there"))
    return found.select("asked", "id", "name", (key("asked") == key("name")).alias("exact"), F.round("similarity", 6).alias("similarity"))


def _ragged(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... count - 1 of each count, one after another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _distinct(x: np.ndarray) -> np.ndarray:
    """``np.unique``, which hashes and is many times slower on these."""
    x = np.sort(x)
    return x[np.diff(x, prepend=-1) > 0]


def _cuts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """From and to of stretches whose sizes make AT_ONCE at most, or of one."""
    total, a = np.append(0, np.cumsum(sizes)), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(total, total[a] + AT_ONCE, "right")) - 1)
        yield a, b
        a = b


def _cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and trigram, as a number below GRAMS, of every trigram of lower-case texts without NULLs, repeats too: those of ``trigrams``."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    sign = np.zeros(256, np.int32)
    sign[[*range(48, 58), *range(97, 123)]] = range(1, 37)
    x = np.zeros(ends[-1] - ends[0] + len(texts) + 2, np.int32)  # two blanks, then each text with a blank behind it
    of = np.repeat(np.arange(len(texts)), np.diff(ends) + 1)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    x[np.arange(len(data)) + np.repeat(np.arange(len(texts)), np.diff(ends)) + 2] = sign[data]
    one = x[1:-1]
    two = np.where(one > 0, x[:-2], 0)
    at = np.flatnonzero((x[2:] > 0) | (one > 0))
    return of[at], (two[at] * 37 + one[at]) * 37 + x[2:][at]


class _Sets:
    """Sets of trigrams by their order's places: n of all, of a text's known ones (places below ``known``) one after another, and signatures."""

    def __init__(self, texts: pa.Array, order: np.ndarray, known: int) -> None:
        of, gram = _cut(texts)
        each = _distinct(of << 16 | order[gram])
        self.n = np.bincount(each >> 16, minlength=len(texts)).astype(np.int32)
        self.each = each[(each & 0xFFFF) < known]
        self.rank = (self.each & 0xFFFF).astype(np.int32)
        self.has = np.bincount(self.each >> 16, minlength=len(texts)).astype(np.int32)
        self.start = np.append(0, np.cumsum(self.has))
        self.signs = []
        for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            sign, some = np.zeros(len(texts), np.uint64), self.has > 0
            if some.any():
                bits = np.uint64(1) << (self.rank.astype(np.uint64) * np.uint64(k) >> np.uint64(58))
                sign[some] = np.bitwise_or.reduceat(bits, self.start[:-1][some])
            self.signs.append(sign)

    def keys(self, least: float, smallest: int, largest: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, key and largest n of the other side, of the pairs of trigrams that texts a to b may share first with a similar text, whose n is from smallest to largest.

        Sets of l and m trigrams are similar if they share (l + m) * least / (1 + least).  A pair is the first two that are shared only if its second has so many
        behind it that the rest suffices; trigrams that the other side lacks come first.  Where one shared trigram suffices, each is a key alone.
        """
        share, rank = least / (1 + least), self.rank[self.start[a] : self.start[b]]
        of = np.repeat(np.arange(a, b), self.has[a:b])
        place, n = _ragged(self.has[a:b]), self.n[of]
        low = np.maximum(np.ceil(n * least - 1e-9), smallest)
        high = lambda shared: np.floor(np.minimum((shared + 1e-6) / share - n, n / least + 1e-6))
        pairs, alone = high(self.has[of] - place + 1), high(1)
        times = np.where((pairs >= low) & (low <= largest), place, 0)
        second = np.repeat(np.arange(len(n)), times)
        first = second - np.repeat(place, times) + _ragged(times)
        one = np.flatnonzero((alone >= low) & (low <= largest))
        key = np.concatenate([rank[first] * 65536 + rank[second].astype(np.int64), rank[one] * 65536 + np.int64(65535)])
        return np.concatenate([of[second], of[one]]), key, np.concatenate([pairs[second], alone[one]])


class _Seeds(_Sets):
    """Sets of seeds with an index by their keys, of which those for the largest other sides come first."""

    def __init__(self, texts: pa.Array, order: np.ndarray, known: int, least: float) -> None:
        super().__init__(texts, order, known)
        self.least, self.share, entries = least, least / (1 + least), []
        self.log2 = max(8, min(24, (4 * len(self.rank)).bit_length()))
        for a in range(0, len(texts), 1 << 14):
            of, key, high = self.keys(least, 2, 1 << 30, a, min(a + (1 << 14), len(texts)))
            entries.append((self.slot(key) << 8 | (255 - np.minimum(high, 255).astype(np.int64))) << 31 | of)  # in slots, by falling n, then owner
        entries = np.concatenate(entries)
        entries.sort()
        self.owner, self.high = (entries & 0x7FFFFFFF).astype(np.int32), (255 - (entries >> 31 & 255)).astype(np.uint8)
        self.begin = np.append(0, np.cumsum(np.bincount(entries >> 39, minlength=1 << self.log2))).astype(np.int32)
        self.top = np.zeros(1 << self.log2, np.uint8)
        some = self.begin[:-1] < self.begin[1:]
        self.top[some] = self.high[self.begin[:-1][some]]
        self.smallest, self.largest = self.n[self.n > 0].min(initial=1 << 30), self.n.max(initial=0)
        self.each = None

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.log2)).astype(np.int64)

    def similar(self, facts: _Sets) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Seed, fact and similarity of all pairs at or above the threshold, in parts; no pair is in two."""
        most = np.where(facts.n * self.least <= self.largest, (facts.n * (1 - self.least) + 2) ** 2 / 2, 1)
        for a, b in _cuts(most):
            of, key, _ = facts.keys(self.least, self.smallest, self.largest, a, b)
            slot, n = self.slot(key), np.minimum(facts.n, 255).astype(np.uint8)[of]
            there = np.flatnonzero(self.top[slot] >= n)
            there = there[np.argsort(of[there], kind="stable")]
            of, n, begin, end = of[there] - a, n[there], self.begin[slot[there]], self.begin[slot[there] + 1]
            low, many = begin.copy(), int((end - begin).max(initial=0))
            while many:  # to the first entry of the slot that is for smaller texts only
                mid = (low + end) >> 1
                on = (low < end) & (self.high[np.minimum(mid, len(self.high) - 1)] >= n)
                low, end, many = np.where(on, mid + 1, low), np.where(on, end, mid), many >> 1
            times = (low - begin).astype(np.int64)
            for c, d in _cuts(np.bincount(of, times, b - a)):
                x = slice(*np.searchsorted(of, [c, d]))
                yield self._met(facts, np.repeat(of[x], times[x]) + a, self.owner[np.repeat(begin[x], times[x]) + _ragged(times[x])])

    def _met(self, facts: _Sets, fact: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        needs = np.ceil(np.arange(int(self.n.max()) + int(facts.n.max()) + 1) * self.share - 1e-9).astype(np.int32)
        for mine, theirs in zip(self.signs, facts.signs):  # each bit that one side lacks is a trigram that isn't shared
            x, y, need = mine[seed], theirs[fact], needs[self.n[seed] + facts.n[fact]]
            may = np.flatnonzero((np.bitwise_count(x & ~y) <= self.has[seed] - need) & (np.bitwise_count(y & ~x) <= facts.has[fact] - need))
            fact, seed = fact[may], seed[may]
        both = _distinct(fact * len(self.n) + seed)
        fact, seed = both // len(self.n), both % len(self.n)
        times = self.has[seed].astype(np.int64)
        asked = np.repeat(fact, times) << 16 | self.rank[np.repeat(self.start[seed], times) + _ragged(times)]
        found = np.minimum(np.searchsorted(facts.each, asked), max(0, len(facts.each) - 1))
        hit = np.append(0, np.cumsum(facts.each[found] == asked))
        ends = np.cumsum(times)
        shared = hit[ends] - hit[ends - times]
        s = shared / (self.n[seed] + facts.n[fact] - shared)
        return seed[s >= self.least], fact[s >= self.least], s[s >= self.least]


def _counts(texts: DataFrame) -> np.ndarray:
    """How many texts (column text, lower-case, not NULL) have each trigram; behind these, how many texts there are, and their sum of squares of the numbers of trigrams."""

    def run(batches):
        n = np.zeros(GRAMS + 2, np.int64)
        for b in batches:
            of, gram = _cut(b.column(0))
            each = _distinct(of << 16 | gram)
            n[:GRAMS] += np.bincount(each & 0xFFFF, minlength=GRAMS)
            n[GRAMS:] += b.num_rows, (np.bincount(each >> 16) ** 2).sum()
        some = np.flatnonzero(n)
        yield pa.record_batch({"gram": pa.array(some, pa.int32()), "n": pa.array(n[some])})

    found = texts.select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()  # at most GRAMS + 2 rows
    n = np.zeros(GRAMS + 2, np.int64)
    n[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    return n


def _best(table: pa.Table, k: int) -> pa.Table:
    """The k best rows of each seed, by similarity, then by id."""
    table = table.take(pc.sort_indices(table, [("seed", "ascending"), ("sim_score", "descending"), ("id", "ascending")], null_placement="at_start"))
    seed = table.column("seed").to_numpy()
    first = np.flatnonzero(np.diff(seed, prepend=-1))
    return table.filter(pa.array(np.arange(len(seed)) - np.repeat(first, np.diff(first, append=len(seed))) < k))


def _slots(spark, n: int) -> Column:
    """An array of n longs that a shuffle by them deals to n partitions, one each."""
    x = spark.range(64 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("part")).agg(F.min("id").alias("id")).collect()
    free = {r["id"] for r in x}
    own = sorted(free) + [i for i in range(64 * n) if i not in free][: n - len(free)]
    return F.array(*map(F.lit, own)).cast("array<long>")


def _look(seeds: DataFrame, facts: DataFrame, counts: np.ndarray, look: float, strict: bool, k: int) -> DataFrame:
    """seed, place, id, sim_score of the k best facts (id, text; their ``_counts``) of each seed (seed, text) by a threshold, written out.

    Facts and seeds are dealt into parts, by ENTRIES and FACTS, and each two parts meet in a task: it indexes its seeds by the two rarest trigrams that a similar text
    may share with them, and streams the facts by.
    """
    spark = facts.sparkSession
    asked = _counts(seeds)
    pairs, many, rows = counts[:GRAMS].astype(float) * asked[:GRAMS], int(asked[GRAMS]), int(counts[GRAMS])
    order, known = np.empty(GRAMS, np.int64), int(np.count_nonzero(pairs))
    order[np.argsort(np.where(pairs > 0, pairs, np.inf), kind="stable")] = np.arange(GRAMS)  # places: those that the fewest pairs share, those that none does
    kind = facts.schema["id"].dataType.simpleString()
    entries = ((1 - look) ** 2 * int(asked[GRAMS + 1]) + 4 * (1 - look) * int(asked[:GRAMS].sum()) + 4 * many) / 2  # pairs among the first trigrams of a seed
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    f_parts = max(1, -(-rows // FACTS), min(tasks, math.isqrt(tasks * rows // max(1, many))))
    s_parts = max(1, math.ceil(entries / ENTRIES), min(many, tasks // f_parts))
    slots = _slots(spark, s_parts * f_parts)
    slot = lambda s, f: F.element_at(slots, (s * f_parts + f + 1).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n))
    left = seeds.select("seed", "text", every(f_parts).alias("f"), own(s_parts, "seed").alias("s"))
    right = facts.select("id", "text", own(f_parts, "id", "text").alias("f"), every(s_parts).alias("s"))
    left = left.select(slot(F.col("s"), F.col("f")).alias("slot"), F.lit(0).alias("side"), "text", "seed", F.lit(None).cast(kind).alias("id"))
    right = right.select(slot(F.col("s"), F.col("f")).alias("slot"), F.lit(1).alias("side"), "text", F.lit(None).cast("string").alias("seed"), "id")
    x = left.unionByName(right).repartition(s_parts * f_parts, "slot")
    # of facts of one text, those with the k least ids may be among the k best
    w = Window.partitionBy("slot", "side", "text", "seed").orderBy("id")
    x = x.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k).drop("place").sortWithinPartitions("slot", "side", "text", "seed", "id")

    def run(batches):
        texts, names, index, best, new, kept, at = [], [], None, [], 0, 0, None

        def told():
            if best:
                t = _best(pa.concat_tables(best), k)
                yield from t.set_column(0, "seed", pa.chunked_array([named.take(t.column("seed").combine_chunks())])).to_batches()

        for b in (b for b in batches if b.num_rows):
            place = b.column("slot").to_numpy() * 2 + b.column("side").to_numpy()
            for i, j in pairwise([0, *np.flatnonzero(np.diff(place)) + 1, len(place)]):
                part = b.slice(i, j - i)
                if at != place[i] >> 1:
                    yield from told()
                    texts, names, index, best, new, kept, at = [], [], None, [], 0, 0, place[i] >> 1
                if not place[i] & 1:
                    texts.append(part.column("text"))
                    names.append(part.column("seed"))
                elif texts:
                    if index is None:
                        named = pa.concat_arrays(names)
                        index = _Seeds(pa.concat_arrays(texts), order, known, look)
                    for seed, fact, s in index.similar(_Sets(part.column("text"), order, known)):
                        if strict:
                            seed, fact, s = seed[s > look], fact[s > look], s[s > look]
                        if len(seed):
                            best.append(pa.table({"seed": pa.array(seed), "id": part.column("id").take(pa.array(fact)), "sim_score": pa.array(s)}))
                            new += len(seed)
                        if new > max(AT_ONCE, kept):
                            best = [_best(pa.concat_tables(best), k)]
                            new, kept = 0, best[0].num_rows
        yield from told()

    found = x.mapInArrow(run, f"seed string, id {kind}, sim_score double")
    w = Window.partitionBy("seed").orderBy(F.desc("sim_score"), "id")
    return written(found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k))


def best_of_all(facts: DataFrame, seeds: DataFrame, k: int, least: float = 0.3, text: Column | None = None) -> DataFrame:
    """seed, place, id, sim_score of the k facts most like each seed (column seed), above the threshold: ``search.fuzzy`` for all seeds.

    Seeds look for facts above the thresholds of LOOKS first, and only those that find fewer than k there look lower: k facts above any threshold hold the k best.
    """
    said = F.concat_ws(" ", "subject", "predicate", "object") if text is None else text
    f = facts.select("id", F.lower(said).alias("text")).filter("text is not null")
    s = seeds.select(F.trim(F.col("seed")).alias("seed")).filter("seed is not null").distinct()
    asked, counts, parts = written(s.withColumn("text", F.lower("seed"))), _counts(f), []
    for look in [*(x for x in LOOKS if x > least), least]:
        best = _look(asked, f, counts, look, look == least, k)
        if look == least:
            parts.append(best)
            break
        enough = best.filter(F.col("place") == k).select("seed")
        parts.append(best.join(enough, "seed", "left_semi"))
        asked = written(asked.join(enough, "seed", "left_anti"))
        if asked.isEmpty():
            break
    return reduce(DataFrame.unionByName, parts).select("seed", "place", "id", "sim_score")


def fuzzy_of_all(facts: DataFrame, seeds: DataFrame, k: int, least: float = 0.3, text: Column | None = None) -> DataFrame:
    """``best_of_all`` with the columns of the facts."""
    said = F.concat_ws(" ", "subject", "predicate", "object") if text is None else text
    best = best_of_all(facts, seeds, k, least, text).select("seed", F.col("id").alias("best_id"), "sim_score").distinct()
    x = facts.withColumn("said_text", said).join(best, F.col("id").eqNullSafe(F.col("best_id")))
    x = x.filter(similarity(trigrams(F.col("said_text")), trigrams(F.col("seed"))) == F.col("sim_score")).drop("said_text", "best_id")  # ids that repeat have other texts, too
    w = Window.partitionBy("seed").orderBy(F.desc("sim_score"), "id")
    return x.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
