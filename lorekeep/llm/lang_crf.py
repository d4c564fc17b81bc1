"""10. Language ID by a linear-chain conditional random field over words.

Each word of a text gets a label.  Emission weights: hashed prefixes and suffixes (one to three
bytes), byte bigrams and trigrams, and the word itself (lexicon); transitions are learned.  The
forward-backward algorithm gives every word's label probabilities, also where a text switches
languages, and their mean over the words with letters decides the text's language.

Training takes a bounded sample, PER_LANG labelled documents of each language by hash, in whole
texts that are cut and interleaved so that the model sees switches; every round, tasks make the
gradient of their share and the driver sums these arrays of fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.llm._spark import checkpoint, free, row_hash, without_rows
from lorekeep.llm._tokens import Words, mix, slices

PER_LANG = 300  # labelled documents of a language that are learned from, at most
BITS = 16  # of feature numbers
ROUNDS = 12
RATE = 0.4
SHARDS = 6  # tasks of a round, each of which sends the driver one gradient
SALTS = 64
MOST_LABELS = 256  # labels that a model may have: its weights take 256 KB for each, in the driver and every task
MIN_CERTAINTY = 0.5  # what a document must reach to be kept by ``accepted``


class Features:
    """Feature numbers of the distinct words of a slice."""

    def __init__(self, words: Words):
        h = words.hashes()
        _, pick, self.back = np.unique(h, return_index=True, return_inverse=True)
        d, s, e = words.data, words.start[pick], words.end[pick]
        n = e - s
        mask = np.uint64((1 << BITS) - 1)
        lead = lambda k: d[np.minimum(s + k, len(d) - 1)].astype(np.uint64) * (n > k)
        tail = lambda k: d[np.maximum(e - 1 - k, 0)].astype(np.uint64) * (n > k)
        p1, s1 = lead(0), tail(0)
        p2, s2 = p1 * np.uint64(256) + lead(1), s1 * np.uint64(256) + tail(1)
        p3, s3 = p2 * np.uint64(256) + lead(2), s2 * np.uint64(256) + tail(2)
        whole = [h[pick], p1, p2, p3, s1, s2, s3]
        self.whole = [(mix(x, 40 + k) & mask).astype(np.int64) for k, x in enumerate(whole)]
        total = int(n.sum())
        self.first = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else np.zeros(0, np.int64)
        at = np.repeat(s - self.first, n) + np.arange(total)
        far = np.repeat(e, n)
        b0 = d[at].astype(np.uint64)
        b1 = d[np.minimum(at + 1, len(d) - 1)].astype(np.uint64) * (at + 1 < far)
        b2 = d[np.minimum(at + 2, len(d) - 1)].astype(np.uint64) * (at + 2 < far)
        two = b0 * np.uint64(256) + b1
        self.grams = [(mix(x, 50 + k) & mask).astype(np.int64) for k, x in enumerate((two, two * np.uint64(256) + b2))]
        self.inverse = (1.0 / np.maximum(n, 1)).astype(np.float32)
        letter = (d[at] - 97 < 26) | (d[at] >= 0x80)
        self.letters = np.logical_or.reduceat(letter, self.first) if total else np.zeros(0, bool)
        self.n = n

    def scores(self, w: np.ndarray) -> np.ndarray:
        """[distinct words, labels]: sums of weights; 0 for words without letters."""
        if not len(self.n):
            return np.zeros((0, w.shape[1]), np.float32)
        z = sum(w[f] for f in self.whole)
        z += np.add.reduceat(w[self.grams[0]] + w[self.grams[1]], self.first, axis=0) * self.inverse[:, None]
        return z * self.letters[:, None]

    def spread(self, g: np.ndarray) -> np.ndarray:
        """Gradient of the weights, from that of the distinct words' scores."""
        g = g * self.letters[:, None]
        owner = np.repeat(np.arange(len(self.n)), self.n)
        idx = np.concatenate([*self.whole, *self.grams])
        per_gram = (g * self.inverse[:, None])[owner]
        val = np.concatenate([*[g] * len(self.whole), per_gram, per_gram])
        return np.stack([np.bincount(idx, weights=val[:, k], minlength=1 << BITS) for k in range(g.shape[1])], axis=1)


def forward_backward(z: np.ndarray, first: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Label probabilities of each word, [words, labels], and the expected transitions if asked for.

    z: the words' scores; first[i]:first[i+1] are the words of text i.  All texts of a slice advance
    together, the longest first, so that the active ones are always a leading block.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    n = n[order]
    labels = z.shape[1]
    if not len(n):
        return np.zeros_like(z), np.zeros((labels, labels))
    active = len(n) - np.searchsorted(n[::-1], np.arange(n[0]), side="right")
    base = np.concatenate([[0], np.cumsum(active)])
    step = np.repeat(np.arange(n[0]), active)
    place = first[order][np.arange(base[-1]) - base[step]] + step
    e = z[place]
    e -= e.max(axis=1, keepdims=True)
    np.exp(e, out=e)
    a = np.exp(trans).astype(e.dtype)
    alpha, beta = np.empty_like(e), np.empty_like(e)
    at, k = base.tolist(), active.tolist()
    now = e[: k[0]] / e[: k[0]].sum(axis=1, keepdims=True)
    alpha[: k[0]] = now
    for t in range(1, n[0]):
        now = (now[: k[t]] @ a) * e[at[t] : at[t + 1]]
        now /= now.sum(axis=1, keepdims=True)
        alpha[at[t] : at[t + 1]] = now
    a_back = a.T.copy()
    now = np.ones((k[-1], labels), e.dtype)
    beta[at[-2] : at[-1]] = now
    expected = np.zeros((labels, labels))
    for t in range(n[0] - 2, -1, -1):
        ahead = now * e[at[t + 1] : at[t + 2]]
        if pairs:
            joint = alpha[at[t] : at[t] + k[t + 1], :, None] * a * ahead[:, None, :]
            expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        now = ahead @ a_back
        now /= now.sum(axis=1, keepdims=True)
        if k[t] > k[t + 1]:
            now = np.concatenate([now, np.ones((k[t] - k[t + 1], labels), e.dtype)])
        beta[at[t] : at[t + 1]] = now
    alpha *= beta
    alpha /= alpha.sum(axis=1, keepdims=True)
    out = np.zeros_like(z)
    out[place] = alpha
    return out, expected


def _switching(words: Words, label: np.ndarray, seed: int):
    """(word numbers, first, label of each word) of training sequences: runs of 3 to 40 words, ten runs of any texts each."""
    rng = np.random.default_rng(seed)
    runs = []
    for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
        while a < b:
            c = min(b, a + int(rng.integers(3, 41)))
            runs.append((a, c, label[i]))
            a = c
    order = rng.permutation(len(runs))
    picked = [runs[i] for i in order]
    where = np.concatenate([np.arange(a, b) for a, b, _ in picked]) if picked else np.zeros(0, np.int64)
    marks = np.repeat([x for *_, x in picked], [b - a for a, b, _ in picked]) if picked else np.zeros(0, np.int64)
    ends = np.cumsum([b - a for a, b, _ in picked])
    return where, np.concatenate([[0], ends[9:-1:10], ends[-1:]]).astype(np.int64), marks.astype(np.int64)


def _gradient(batches, weights, trans):
    w_grad, t_grad, words_seen = np.zeros_like(weights, dtype=np.float64), np.zeros_like(trans, dtype=np.float64), 0
    for b in batches:
        labels = b.column(1).to_numpy()
        for lo, hi, words in slices(b.column(0)):
            f = Features(words)
            where, first, marks = _switching(words, labels[lo:hi], lo)
            if not len(where):
                continue
            word = f.back[where]
            p, expected = forward_backward(f.scores(weights)[word], first, trans, pairs=True)
            p[np.arange(len(marks)), marks] -= 1
            g = np.stack([np.bincount(word, weights=p[:, k], minlength=len(f.n)) for k in range(p.shape[1])], axis=1)
            w_grad += f.spread(g)
            inside = np.ones(len(marks), bool)
            inside[first[:-1]] = False
            to = np.flatnonzero(inside)
            np.add.at(expected, (marks[to - 1], marks[to]), -1.0)
            t_grad += expected
            words_seen += len(marks)
    yield pa.RecordBatch.from_arrays([pa.array([w_grad.astype(np.float32).tobytes()]), pa.array([t_grad.tobytes()]), pa.array([words_seen], pa.int64())], names=["w", "t", "n"])


def training_sample(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """(text, lang): per_lang rows of each language, by hash, of those whose crc32 of the id mod 4 isn't 2.

    The least hashes are found in SALTS parts of a language first, so that no task's rows grow with the table.
    """
    k = F.xxhash64("doc_id", "text")
    x = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~_held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    part = Window.partitionBy("lang", "part").orderBy("k", "doc_id")
    whole = Window.partitionBy("lang").orderBy("k", "doc_id")
    few = x.select("doc_id", "lang", k.alias("k")).withColumn("part", F.pmod("k", F.lit(SALTS))).withColumn("r", F.row_number().over(part)).filter(F.col("r") <= per_lang)
    chosen = few.withColumn("r", F.row_number().over(whole)).filter(F.col("r") <= per_lang).select(F.col("k").alias("k_")).distinct()
    return x.join(F.broadcast(chosen), k == F.col("k_"), "left_semi").select("text", "lang")


def _held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, per_lang: int = PER_LANG, rounds: int = ROUNDS, langs: int | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, emission weights, transitions) learned from labelled documents.

    All languages are learned, or the ``langs`` most frequent ones if that is given.  More than MOST_LABELS
    are refused with an error, as their weights wouldn't fit: the caller then says how many to learn.
    """
    spark = docs.sparkSession
    labelled = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~_held_out(F.col("doc_id")))
    most = MOST_LABELS if langs is None else langs
    counted = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most + 1).collect()
    if most > MOST_LABELS or langs is None and len(counted) > most:
        raise ValueError(f"more than {MOST_LABELS} languages: give langs, the number of the most frequent ones to learn")
    langs = sorted(r["lang"] for r in counted[:most])
    sample = checkpoint(training_sample(labelled.filter(F.col("lang").isin(langs)), per_lang), fewer=16)
    weights, trans = np.zeros((1 << BITS, len(langs)), np.float32), np.zeros((len(langs), len(langs)))
    if not langs:
        return langs, weights, trans
    number = F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")) - 1
    shards = checkpoint(sample.select("text", number.alias("label")).repartition(SHARDS, F.xxhash64("text")).sortWithinPartitions(F.xxhash64("text"), "text", "label")).coalesce(SHARDS)
    w_sum, t_sum = np.zeros(weights.shape), np.zeros(trans.shape)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((weights, trans))
        rows = shards.mapInArrow(lambda batches, sent=sent: _gradient(batches, *sent.value), "w binary, t binary, n long").collect()  # SHARDS rows of fixed size
        n = max(1, sum(r["n"] for r in rows))
        g = sum(np.frombuffer(r["w"], np.float32).reshape(weights.shape).astype(np.float64) for r in rows) / n + 1e-6 * weights
        gt = sum(np.frombuffer(r["t"], np.float64).reshape(trans.shape) for r in rows) / n + 1e-6 * trans
        w_sum += g * g
        t_sum += gt * gt
        weights = (weights - RATE * g / (np.sqrt(w_sum) + 1e-7)).astype(np.float32)
        trans = trans - RATE * gt / (np.sqrt(t_sum) + 1e-9)
        sent.destroy()
    return langs, weights, trans


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray] | None = None, keep: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (doc_id, text, lang), or with keep all of its columns but text, lang_pred and certainty.

    A null text, or one without letters, is ``und`` with score 0, as is every text if there are no
    labelled rows to learn from.  Score is the mean probability of the language over the words with
    letters; certainty the mean of each such word's greatest probability, whichever its language is, which is high also
    where a text switches languages.  Rows with a null doc_id may be learned from; repeated rows each get a row; an empty
    table gives none.
    """
    langs, weights, trans = model or train(docs)
    sent = docs.sparkSession.sparkContext.broadcast((langs, weights, trans))
    pred, score = ("lang_pred", "score")
    if keep:
        pred, score = free(docs, pred, "certainty")
        rows = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c != "text"], docs["text"])
        schema = T.StructType([*rows.schema.fields[:-1], T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    else:
        rows = docs.select(docs["doc_id"].cast("long"), _held_out(docs["doc_id"]).alias("held_out"), "text")
        schema = "doc_id long, held_out boolean, lang_pred string, score double"

    def run(batches):
        langs, weights, trans = sent.value
        for b in batches:
            texts = b.column(b.num_columns - 1)
            for lo, hi, words in slices(texts):
                n = hi - lo
                found, value = ["und"] * n, np.zeros(n)
                if langs and len(words.start):
                    f = Features(words)
                    p, _ = forward_backward(f.scores(weights)[f.back], words.first, trans)
                    p *= f.letters[f.back][:, None]
                    sure = p.max(axis=1, keepdims=True)
                    total = np.concatenate([np.zeros((1, len(langs) + 1)), np.cumsum(np.concatenate([p, sure], axis=1), axis=0, dtype=np.float64)])
                    per = total[words.first[1:]] - total[words.first[:-1]]
                    best, size = per[:, :-1].argmax(axis=1), per[:, :-1].sum(axis=1)
                    of = np.full(n, len(langs)) if keep else best
                    for i in np.flatnonzero(size > 0.5).tolist():
                        if _has_letter(texts[lo + i].as_py()):
                            found[i], value[i] = langs[best[i]], min(1.0, max(0.0, float(per[i, of[i]] / size[i])))
                cols = [c.slice(lo, n) for c in b.columns[:-1]]
                names = [*b.schema.names[:-1], pred, score]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(found, pa.string()), pa.array(value, pa.float64())], names=names)

    return rows.mapInArrow(run, schema)


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def accepted(docs: DataFrame, min_certainty: float = MIN_CERTAINTY) -> DataFrame:
    """The rows of docs, whole, with letters, whose words have certain labels: min_certainty on average at least.

    Documents in several languages stay, as each of their words is labelled with certainty.  Only what is rejected is joined
    with the documents, which never leave the JVM whole.
    """
    rows = docs.select(docs["doc_id"], row_hash(docs).alias("row_hash"), docs["text"])
    x = identify(rows, train(docs), keep=True)
    rejected = x.filter((F.col("lang_pred") == "und") | (F.col("certainty") < min_certainty)).select("doc_id", "row_hash").distinct()
    return without_rows(docs, checkpoint(rejected.withColumn("stays", F.lit(False)), fewer=16))
