"""5. LM scoring: a hashed maximum-entropy model with class-factored softmax.

A token's probability is that of its class given the history, times that of the token in its class
given the history.  Classes: the OWN most frequent tokens (the end among them) are their own class, all others
share classes by their last bytes, so that an unknown word has a class too.  In a shared class, its SLOTS - 1 most
frequent tokens have slots of their own; the last slot leads to all others, the rest of the class.
Both factors are softmaxes over weights of hashed features of the two tokens before: each alone (the further one is
the skip feature), for classes also both together, and a bias.  The sufficient statistics, how often a class and slot
follow a history, are counted over all training documents; every round, tasks make the gradient of their share
of the counts, which is summed by feature blocks and applied.  The tables of classes, slots and contexts have a
fixed size (OWN, SUFFIXES, SLOTS, CONTEXT).

Every token of the rest, however many there are, has weights of its own in a third softmax: a bias, the log of its smoothed
share p of the rest, and a weight for each context that it was seen to follow.  A history has one context, so that no two of
these features meet and the most likely weights need no rounds: with c of the context's C tokens of the rest, and
PRIOR * p more by the prior, the weight is ln(1 + c / (PRIOR * p)) and the sum over the rest is 1 + C / PRIOR.

The counts of the TOP most frequent tokens and the weights of the PAIRS most frequent pairs of a context and a token of
the rest go to the tasks (bounded tables); the others are joined by hash, so that any vocabulary works.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm._spark import checkpoint
from lorekeep.llm._tokens import Words, mix, slices

TOP = 400_000  # tokens with counts in the tasks' table, at most
PAIRS = 400_000  # pairs of a context and a token with weights in the tasks' table, at most
OWN = 64  # tokens with a class of their own
SUFFIXES = 64  # classes of all others
CONTEXT = 192  # tokens that are told apart in histories; others by suffix class
SLOTS = 32  # tokens of a shared class that are told apart, the last slot being for all others
CLASSES = OWN + SUFFIXES
OUTCOMES = OWN + SUFFIXES * SLOTS  # of a token: its own class, or a shared class and a slot
CONTEXTS = CONTEXT + SUFFIXES  # the last suffix context also stands for the start
FEATURES = 1 << 14
INNER = 1 + 2 * CONTEXTS  # features of the softmax in a class: bias, the token before, the one before it
ROUNDS = 12
L2 = 0.5
ADD = 0.1
PRIOR = 1000.0  # tokens of the rest that a context has seen by the prior
END = -(2**63)  # the hash that stands for the end token
BLOCK = 256  # features of classes in a block of the gradient
INNER_BLOCK = 1024  # pairs of a feature and a shared class in a block
EVENTS = 200_000  # counts that a task works on at once
SHARD = 1_000_000  # counts that a task learns from in a round: each sends a gradient, of a fixed size
SALTS = np.random.default_rng(41).integers(-(2**63), 2**63, CONTEXTS)  # of the hashes of contexts and tokens


def held_out(doc_id):
    """crc32 of the id as text, mod 10, is 0; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(10)) == 0, F.lit(False))


def _tokens(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, suffix class, first token of each text) of all tokens of a slice, an end token after each text."""
    h = words.hashes().view(np.int64)
    h = np.where(h == END, 0, h)
    d, e = words.data, words.end
    last = d[e - 1].astype(np.uint64)
    two = np.where(e - words.start > 1, d[np.maximum(e - 2, 0)], 0).astype(np.uint64)
    sfx = (mix(last * np.uint64(256) + two, 21) % np.uint64(SUFFIXES)).astype(np.int64)
    at = words.first[1:]
    return np.insert(h, at, END), np.insert(sfx, at, 0), words.first + np.arange(len(words.first))


def _merged(parts):
    """Sum of (key, n, extras) arrays by key."""
    k, n, *extras = (np.concatenate(x) for x in zip(*parts))
    u, first, back = np.unique(k, return_index=True, return_inverse=True)
    return u, np.bincount(back, weights=n).astype(np.int64), *(x[first] for x in extras)


def _counted(batches, count, names, most: int = 600_000):
    """Batches of summed (key, n, extras): count(words) gives those of a slice; a task holds a bounded number of keys."""
    parts, held = [], 0
    for b in batches:
        for _, _, words in slices(b.column(b.num_columns - 1)):
            parts.append(count(words))
            held += len(parts[-1][0])
            if held > most:
                parts = [_merged(parts)]
                held = len(parts[0][0])
                if held > most // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], names=names)
                    parts, held = [], 0
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _merged(parts)], names=names)


def token_counts(training: DataFrame) -> DataFrame:
    """(h, n, sfx) of each token of the training texts, the end included."""

    def run(batches):
        def count(words):
            h, sfx, _ = _tokens(words)
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            return u, n.astype(np.int64), sfx[first]

        yield from _counted(batches, count, ["h", "n", "sfx"])

    return training.select("text").mapInArrow(run, "h long, n long, sfx long").groupBy("h").agg(F.sum("n").alias("n"), F.min("sfx").alias("sfx"))


def frequent(counts: DataFrame, most: int) -> tuple:
    """(which rows are among the most frequent, at most so many; rows and sum of n), by levels of n of a checkpointed table."""
    level = F.floor(F.log2("n") * 16).cast("int")
    top_level, room = 0, most
    per_level = counts.groupBy(level.alias("level")).agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect()  # at most 16 * 63 rows
    for r in sorted(per_level, key=lambda r: -r["level"]):
        room -= r["v"]
        if room < 0:
            top_level = r["level"] + 1
            break
    return level >= top_level, sum(r["v"] for r in per_level), sum(r["n"] for r in per_level)


class Tables:
    """What the tasks need of the corpus: counts of frequent tokens, classes, slots, contexts, and what the last slots hold.

    class_n and class_v are the counts of tokens, and of distinct ones, by suffix class, own classes included.
    """

    def __init__(self, top_h, top_n, top_sfx, class_n, class_v, total: int, distinct: int):
        order = np.argsort(top_h)
        self.h, self.n, sfx = top_h[order], top_n[order], top_sfx[order]
        rank = np.lexsort((self.h, -self.n))
        ends = np.flatnonzero(self.h == END)
        rank = np.concatenate([ends, rank[~np.isin(rank, ends)]])  # the end has the first class
        self.own = np.full(len(self.h), -1, np.int16)  # small types: the tables are held by the driver, too
        self.own[rank[:OWN]] = np.arange(min(OWN, len(rank)))
        self.context = np.full(len(self.h), -1, np.int16)
        self.context[rank[:CONTEXT]] = np.arange(min(CONTEXT, len(rank)))
        self.slot = np.full(len(self.h), SLOTS - 1, np.int16)
        shared = rank[self.own[rank] < 0]
        by_class = shared[np.argsort(sfx[shared], kind="stable")]
        place = np.arange(len(by_class)) - np.searchsorted(sfx[by_class], sfx[by_class])
        self.slot[by_class] = np.minimum(place, SLOTS - 1)
        told = (self.own >= 0) | (self.slot < SLOTS - 1)
        rest_n = class_n - np.bincount(sfx[told], weights=self.n[told], minlength=SUFFIXES).astype(np.int64)
        rest_v = class_v - np.bincount(sfx[told], minlength=SUFFIXES)
        self.total, self.distinct = total, distinct
        self.log_n = np.log10(self.n + ADD)
        self.rest = rest_n + ADD * (rest_v + 1)
        self.log_rest = np.log10(self.rest)
        self.log_total = math.log10(total + ADD * (distinct + 1))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the table, is it there) of hashes."""
        if not len(self.h):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        u, back = np.unique(h, return_inverse=True)
        at = np.minimum(np.searchsorted(self.h, u), len(self.h) - 1)
        return at[back], (self.h[at] == u)[back]

    def classes(self, h, sfx, first):
        """(outcome, history, place, found) of a slice's tokens."""
        at, found = self.find(h)
        own = np.where(found, self.own[at] if len(self.own) else -1, -1)
        slot = np.where(found, self.slot[at] if len(self.slot) else 0, SLOTS - 1)
        out = np.where(own >= 0, own, OWN + sfx * SLOTS + slot)
        ctx = np.where(found, self.context[at] if len(self.context) else -1, -1)
        ctx = np.where(ctx >= 0, ctx, CONTEXT + sfx)
        start = CONTEXTS - 1
        one, two = np.empty_like(ctx), np.empty_like(ctx)
        one[1:], two[2:] = ctx[:-1], ctx[:-2]
        begin = first[:-1]
        one[begin] = start
        two[begin] = start
        two[np.minimum(begin + 1, len(ctx) - 1)] = start
        one[:1] = two[:2] = start
        return out, two * CONTEXTS + one, at, found


def feature_rows(hist: np.ndarray) -> np.ndarray:
    """[histories, 4] feature numbers: bias, the token before, the one before it, both."""
    two, one = np.divmod(hist, CONTEXTS)
    room = FEATURES - 1 - 2 * CONTEXTS
    both = (mix(hist.astype(np.uint64), 31) % np.uint64(room)).astype(np.int64)
    return np.stack([np.zeros_like(hist), 1 + one, 1 + CONTEXTS + two, 1 + 2 * CONTEXTS + both], axis=1)


def class_logits(weights: np.ndarray, hist: np.ndarray) -> np.ndarray:
    """Natural log-probabilities of all classes for each history."""
    f = feature_rows(hist)
    z = weights[f[:, 0]] + weights[f[:, 1]] + weights[f[:, 2]] + weights[f[:, 3]]
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def class_of(out: np.ndarray) -> np.ndarray:
    """Classes of outcomes."""
    return np.where(out < OWN, out, OWN + (out - OWN) // SLOTS)


def inner_rows(hist: np.ndarray, sfx: np.ndarray) -> np.ndarray:
    """[histories, 3] rows of the in-class weights: feature * SUFFIXES + shared class."""
    two, one = np.divmod(hist, CONTEXTS)
    return np.stack([np.zeros_like(hist), 1 + one, 1 + CONTEXTS + two], axis=1) * SUFFIXES + sfx[:, None]


def slot_logits(inner: np.ndarray, hist: np.ndarray, sfx: np.ndarray) -> np.ndarray:
    """Natural log-probabilities of all slots of a shared class for each history."""
    f = inner_rows(hist, sfx)
    z = inner[f[:, 0]] + inner[f[:, 1]] + inner[f[:, 2]]
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def history_counts(training: DataFrame, tables, parts: int) -> DataFrame:
    """(hist, out, n): how often an outcome follows a history, over all training texts.

    Tasks send counts that they have summed; one shuffle sums them over as many tasks as the input asks for.
    """

    def run(batches):
        t = tables.value

        def count(words):
            h, sfx, first = _tokens(words)
            out, hist, _, _ = t.classes(h, sfx, first)
            u, n = np.unique(hist * OUTCOMES + out, return_counts=True)
            return u, n.astype(np.int64), np.zeros(len(u), np.int64)

        yield from _counted(batches, count, ["event", "n", "none"])

    x = training.select("text").mapInArrow(run, "event long, n long, none long").select(F.floor(F.col("event") / OUTCOMES).alias("hist"), F.pmod("event", F.lit(OUTCOMES)).alias("out"), "n")
    return x.repartition(parts, "hist").groupBy("hist", "out").agg(F.sum("n").alias("n")).sortWithinPartitions("hist", "out")


def in_rest(out: np.ndarray) -> np.ndarray:
    """Which outcomes are the last slot of a shared class."""
    return (out >= OWN) & ((out - OWN) % SLOTS == SLOTS - 1)


def pair_keys(h: np.ndarray, hist: np.ndarray) -> np.ndarray:
    """64-bit hashes of the context before and the token."""
    return h ^ SALTS[hist % CONTEXTS]


def pair_weights(training: DataFrame, tables, rest: list[float], parts: int) -> DataFrame:
    """(key, n, gain) of each pair of a context and a token of the rest that occurs in training: its count, and its weight in powers of ten.

    rest: smoothed counts of the rest of each shared class.  Contexts and classes travel as one small number.

    All pairs of a token meet in one task, as many as there are contexts at most, and sum to its count.
    """

    def run(batches):
        t = tables.value

        def count(words):
            h, sfx, first = _tokens(words)
            out, hist, _, _ = t.classes(h, sfx, first)
            k = np.flatnonzero(in_rest(out))
            u, at, n = np.unique(pair_keys(h[k], hist[k]), return_index=True, return_counts=True)
            return u, n.astype(np.int64), h[k][at], (sfx[k] * CONTEXTS + hist[k] % CONTEXTS)[at].astype(np.int16)

        yield from _counted(batches, count, ["key", "n", "h", "place"])

    x = training.select("text").mapInArrow(run, "key long, n long, h long, place short").select("h", "place", "n")
    x = x.repartition(parts, "h").groupBy("h", "place").agg(F.sum("n").alias("n"))
    of = lambda values, at: F.array(*[F.lit(v) for v in values])[at.cast("int")]
    share = (F.sum("n").over(Window.partitionBy("h")) + ADD) / of(rest, F.floor(F.col("place") / CONTEXTS))
    key = F.col("h").bitwiseXOR(of(SALTS.tolist(), F.col("place") % CONTEXTS))
    return x.select(key.alias("key"), "n", F.log10(1 + F.col("n") / (PRIOR * share)).alias("gain"))


class Rest:
    """What the tasks need of the third softmax: the weights of frequent pairs, and the sums by context and shared class.

    seen: [CONTEXTS, SUFFIXES] tokens of the rest of a class after each context.
    """

    def __init__(self, key, gain, seen: np.ndarray):
        order = np.argsort(key)
        self.key, self.gain = key[order], gain[order].astype(np.float32)
        self.log_sum = np.log10(1 + seen / PRIOR)

    def parts(self, h, sfx, hist) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 of a token's probability in the rest less that of its share, without weights that aren't in the table; key; is it in the table) of tokens of the rest."""
        key = pair_keys(h, hist)
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        have = self.key[at] == key if len(self.key) else np.zeros(len(key), bool)
        gain = np.where(have, self.gain[at] if len(self.key) else 0.0, 0.0)
        return gain - self.log_sum[hist % CONTEXTS, sfx], key, have


def add_rows(sums: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> None:
    """sums[rows[i]] += counts[i], for rows that may repeat."""
    order = np.argsort(rows, kind="stable")
    u, first = np.unique(rows[order], return_index=True)
    sums[u] += np.add.reduceat(counts[order], first, axis=0)


def count_events(hist, out, n, weights, sums: np.ndarray, inner_sums: np.ndarray) -> None:
    """Add to sums [FEATURES, CLASSES] and inner_sums [INNER * SUFFIXES, SLOTS] the counts of some events, or with weights those that the model expects."""
    u, back = np.unique(hist, return_inverse=True)
    for lo in range(0, len(u), 8192):
        hi = min(len(u), lo + 8192)
        mine = (back >= lo) & (back < hi)
        counts = np.bincount((back[mine] - lo) * CLASSES + class_of(out[mine]), weights=n[mine], minlength=(hi - lo) * CLASSES).reshape(-1, CLASSES).astype(np.float32)
        if weights is not None:
            counts = np.exp(class_logits(weights[0], u[lo:hi])).astype(np.float32) * counts.sum(axis=1, keepdims=True)
        for f in feature_rows(u[lo:hi]).T:
            add_rows(sums, f, counts)
    shared = out >= OWN
    sfx, slot = np.divmod(out[shared] - OWN, SLOTS)
    u, back = np.unique(hist[shared] * SUFFIXES + sfx, return_inverse=True)
    if len(u):
        counts = np.bincount(back * SLOTS + slot, weights=n[shared], minlength=len(u) * SLOTS).reshape(-1, SLOTS).astype(np.float32)
        h, sfx = np.divmod(u, SUFFIXES)
        if weights is not None:
            counts = np.exp(slot_logits(weights[1], h, sfx)).astype(np.float32) * counts.sum(axis=1, keepdims=True)
        for f in inner_rows(h, sfx).T:
            add_rows(inner_sums, f, counts)


def _count_rows(batches, weights):
    """(block, counts) of the feature blocks that a task's events touch; blocks of in-class features have negative numbers."""
    sums, inner, held, size = np.zeros((FEATURES, CLASSES), np.float32), np.zeros((INNER * SUFFIXES, SLOTS), np.float32), [], 0
    for b in batches:
        held.append([b.column(i).to_numpy() for i in range(3)])
        size += b.num_rows
        if size > EVENTS:
            count_events(*(np.concatenate(x) for x in zip(*held)), weights, sums, inner)
            held, size = [], 0
    if size:
        count_events(*(np.concatenate(x) for x in zip(*held)), weights, sums, inner)
    for sign, table, step in ((1, sums, BLOCK), (-1, inner, INNER_BLOCK)):
        for k in range(0, len(table), step):
            if table[k : k + step].any():
                yield pa.RecordBatch.from_arrays([pa.array([sign * (k + 1)], pa.int64()), pa.array([table[k : k + step].tobytes()])], names=["block", "counts"])


def _sum_blocks(key, t):
    total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in t.column("counts").to_pylist()).astype(np.float32).tobytes()
    return pa.table({"block": [key[0].as_py()], "counts": [total]}, schema=pa.schema([("block", pa.int64()), ("counts", pa.binary())]))


def feature_counts(events: DataFrame, weights) -> tuple[np.ndarray, np.ndarray]:
    """[FEATURES, CLASSES] and [INNER * SUFFIXES, SLOTS] counts over all events, summed by blocks on the executors: arrays of fixed size."""
    kind = "block long, counts binary"
    sent = events.sparkSession.sparkContext.broadcast(weights)
    out, inner = np.zeros((FEATURES, CLASSES), np.float32), np.zeros((INNER * SUFFIXES, SLOTS), np.float32)
    sums = events.mapInArrow(lambda batches: _count_rows(batches, sent.value), kind).groupBy("block").applyInArrow(_sum_blocks, kind).toArrow()
    for block, counts in zip(sums.column("block").to_pylist(), sums.column("counts")):
        table, k = (out, block - 1) if block > 0 else (inner, -block - 1)
        x = np.frombuffer(counts.as_buffer(), np.float32).reshape(-1, table.shape[1])
        table[k : k + len(x)] = x
    sent.destroy()
    return out, inner


def train(events: DataFrame, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights of classes [FEATURES, CLASSES], and of slots in shared classes [INNER * SUFFIXES, SLOTS], after rounds of distributed gradient updates.

    The first round counts what was seen, which stays.
    """
    seen = feature_counts(events, None)
    weights = [np.zeros_like(x) for x in seen]
    if seen[0].any():  # biases start at the shares
        weights[0][0] = np.log((seen[0][0] + 1) / (seen[0][0].sum() + CLASSES))
        shares = seen[1][:SUFFIXES]
        weights[1][:SUFFIXES] = np.log((shares + 0.1) / (shares.sum(axis=1, keepdims=True) + 0.1 * SLOTS))
    for _ in range(rounds - 1):
        want = feature_counts(events, tuple(weights))
        for k in range(2):
            step = 0.5 * (seen[k] - want[k] - L2 * weights[k]) / (0.5 * (seen[k] + want[k]) + 1)
            weights[k] = np.where(seen[k].any(axis=1, keepdims=True), weights[k] + step, weights[k]).astype(np.float32)
    return weights[0], weights[1]


def token_scores(t: Tables, log_p: np.ndarray, inner: np.ndarray, out, hist, at, found) -> np.ndarray:
    """log10 probability of each token, less log10(count + ADD) of those that aren't in the table.

    log_p: log10 probabilities of classes by history, over all histories.
    """
    score = log_p[hist, class_of(out)].astype(np.float64)
    k = np.flatnonzero(out >= OWN)
    if len(k):
        sfx, slot = np.divmod(out[k] - OWN, SLOTS)
        u, back = np.unique(hist[k] * SUFFIXES + sfx, return_inverse=True)
        score[k] += slot_logits(inner, *np.divmod(u, SUFFIXES))[back, slot] / math.log(10)
        last = slot == SLOTS - 1
        score[k[last]] -= t.log_rest[sfx[last]]
        last &= found[k]
        score[k[last]] += t.log_n[at[k[last]]] if len(t.h) else 0.0
    return score


def lm_scores(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text).

    A null text is empty: one token, its end.  Rows with a null doc_id train and aren't held out;
    repeated rows each count.  Without training rows every class is equally likely.  An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    x = docs.select(docs["doc_id"].cast("long"), "text").withColumn("held_out", held_out(F.col("doc_id")))
    training = x.filter("not held_out")
    counts = checkpoint(token_counts(training))
    often, distinct, total = frequent(counts, TOP)
    top = counts.filter(often).select("h", "n", "sfx").toArrow()
    h, n, sfx = (top.column(c).to_numpy() for c in ("h", "n", "sfx"))
    class_n, class_v = np.zeros(SUFFIXES, np.int64), np.zeros(SUFFIXES, np.int64)
    for r in counts.groupBy("sfx").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        class_n[r["sfx"]], class_v[r["sfx"]] = r["n"], r["v"]
    tables = Tables(h, n, sfx, class_n, class_v, total, distinct)
    sent, rest = spark.sparkContext.broadcast(tables), tables.rest.tolist()
    del top, h, n, sfx, tables
    cores = max(1, spark.sparkContext.defaultParallelism)
    parts = max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))
    events = checkpoint(history_counts(training, sent, parts))
    events = events.coalesce(max(1, min(cores, -(-events.count() // SHARD))))  # summed by many tasks, learned from by as few as the counts need
    model = spark.sparkContext.broadcast(train(events, rounds))
    pairs = checkpoint(pair_weights(training, sent, rest, parts))
    often_met, _, _ = frequent(pairs, PAIRS)
    seen = np.zeros((CONTEXTS, SUFFIXES))
    last = (F.col("out") >= OWN) & (F.pmod(F.col("out") - OWN, F.lit(SLOTS)) == SLOTS - 1)
    by_context = events.filter(last).groupBy(F.pmod("hist", F.lit(CONTEXTS)).alias("one"), F.floor((F.col("out") - OWN) / SLOTS).alias("sfx")).agg(F.sum("n").alias("n"))
    one, sfx, n = (c.to_numpy() for c in by_context.toArrow().columns)  # at most CONTEXTS * SUFFIXES rows
    seen[one, sfx] = n
    met = pairs.filter(often_met).select("key", "gain").toArrow()
    third_sent = spark.sparkContext.broadcast(Rest(met.column("key").to_numpy(), met.column("gain").to_numpy(), seen))
    del met

    def run(batches):
        t, third = sent.value, third_sent.value
        weights, inner = model.value
        log_p = np.empty((CONTEXTS * CONTEXTS, CLASSES), np.float32)
        for lo in range(0, len(log_p), 4096):
            log_p[lo : lo + 4096] = class_logits(weights, np.arange(lo, lo + 4096)) / math.log(10)
        for b in batches:
            for lo, hi, words in slices(b.column(1)):
                h, sfx, first = _tokens(words)
                out, hist, at, found = t.classes(h, sfx, first)
                known = np.where(found, t.log_n[at] if len(t.h) else 0.0, math.log10(ADD))
                model_part = token_scores(t, log_p, inner, out, hist, at, found) + np.where(found, 0.0, math.log10(ADD))
                k = np.flatnonzero(in_rest(out))
                more, key, have = third.parts(h[k], sfx[k], hist[k])
                model_part[k] += more
                sums = [np.add.reduceat(v, first[:-1]) for v in (known - t.log_total, model_part, found.astype(np.int64))]
                asked, of = np.concatenate([h[~found], key[~have]]), np.concatenate([np.flatnonzero(~found), k[~have]])
                order = np.argsort(of, kind="stable")
                ends = np.searchsorted(of[order], first)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(asked[order]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(np.diff(first).astype(np.int64)), pa.array(sums[2]), pa.array(sums[0]), pa.array(sums[1]), lists], names=["doc_id", "held_out", "n_tokens", "found", "base_part", "part", "asked"])

    scored = x.select("doc_id", "text", "held_out").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, found long, base_part double, part double, asked array<long>")
    scored = checkpoint(scored.withColumn("row", F.monotonically_increasing_id()))
    # tokens and pairs that aren't in the tasks' tables
    known = counts.filter(~often).select(F.col("h").alias("k"), (F.log10(F.col("n") + ADD) - math.log10(ADD)).alias("log_n"), F.lit(0.0).alias("gain"), F.lit(1).alias("known"))
    known = known.unionAll(pairs.filter(~often_met).select("key", F.lit(0.0), "gain", F.lit(0)))
    more = scored.select("row", F.explode("asked").alias("asked")).join(known, F.col("asked") == F.col("k"))
    more = more.groupBy(F.col("row").alias("row_")).agg(*[F.sum(c).alias(c) for c in ("log_n", "gain", "known")])
    out = scored.drop("asked").join(more, F.col("row") == F.col("row_"), "left")
    log_n, gain, n_more = (F.coalesce(c, F.lit(0)) for c in ("log_n", "gain", "known"))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("found") + n_more).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_part") + log_n).alias("base_score"), (F.col("part") + log_n + gain).alias("score"),
    )
