"""1. Mixing sources to target weights, with DataFrame functions only.

Rows get a hash-random 63-bit key and are range-sorted by it within their source.  Ranges of the
key are nested, 2**8 in each range of the level above, and only as many levels as the largest
source needs.  Totals go up the levels and prefix sums come down, so that no window ever holds
more than one small range, however large a source is.  Each source is cut at its exact budget;
a budget beyond the source's size repeats it in whole epochs first.  Rows that repeat have one key; they
count as one entry for each partition that they lie in, so that a row repeated any number of times makes no large range.

As keys are hashes of the rows, the mix itself needs only a row for each source (how many epochs, and
the key at the cut): documents are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm._spark import checkpoint, free, small

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
RANGE_ROWS = 128  # about so many rows of the largest source in a range of the lowest level
FAN_BITS = 8
MOST_REPEATS = 3


def word_count(text: Column) -> Column:
    """Words of a text; 0 of a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Add ``target`` to (s, s_null, source_size), one row for each source.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes.  A
    target stops at ``most`` times its source's size, and the excess is shared anew by weight.  In
    closed form: sources fill up in the order of size by weight, so the first whose share of what
    is left stays below its limit, and all after it, share what is left by weight.  The table has
    a row a source; it alone is sorted in one task.
    """
    order = Window.orderBy("s_null", "s")
    fill = Window.orderBy(F.col("source_size") / F.col("w"), "s_null", "s").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    x = (
        sources.withColumn("w", w)
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("left_size", F.col("total") - F.coalesce(F.sum("source_size").over(fill), F.lit(0)) * most)
        .withColumn("left_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(fill), F.lit(0.0)))
        .withColumn("share", F.col("left_size") / F.col("left_w"))
        .withColumn("full", F.col("share") * F.col("w") >= F.col("source_size") * most)
        .withColumn("open_share", F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("w"), F.col("s_null"), F.col("s"), F.col("share")))).over(every))
    )
    return x.select("s", "s_null", "source_size", F.when(F.col("full"), F.col("source_size") * float(most)).otherwise(F.col("open_share.share") * F.col("w")).alias("target"))


def mix_entries(rows: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """rows, read twice: doc_id, s, s_null, size, key (63 bits, >= 0) and part, the partition that a row lay in.

    One entry for all rows that agree in these columns: n, how many there are; whole, the epochs that are taken of all rows
    of the source; and rest, what the last, partial epoch has left for this entry and those after it.  With source_size and target.
    """
    rows = rows.groupBy("doc_id", "s", "s_null", "size", "key", "part").agg(F.count("*").alias("n"))
    rows = rows.withColumn("sort_id", F.coalesce(F.col("doc_id"), F.lit(-(2**63) + 1))).withColumn("words", F.col("size") * F.col("n"))
    largest = rows.groupBy("s", "s_null").count().agg(F.max("count")).first()[0] or 0
    levels = 1
    while largest / RANGE_ROWS > 2 ** (FAN_BITS * levels):
        levels += 1
    bits = max(0, (max(1, -(-largest // RANGE_ROWS)) - 1).bit_length())  # ranges of the lowest level, as a power of 2
    shifts = [63 - max(0, bits - FAN_BITS * k) for k in range(levels)]  # lowest level first

    def at(shift: int) -> Column:
        return F.shiftright(F.col("key"), shift) if shift < 63 else F.lit(0).cast("long")

    rows = rows.withColumn("r0", at(shifts[0]))
    ranges = [rows.groupBy("s", "s_null", "r0").agg(F.sum("words").alias("words"), F.min("key").alias("key"))]
    for k in range(1, levels):
        ranges.append(ranges[-1].withColumn(f"r{k}", at(shifts[k])).groupBy("s", "s_null", f"r{k}").agg(F.sum("words").alias("words"), F.min("key").alias("key")))
    sources = ranges[-1].groupBy("s", "s_null").agg(F.sum("words").alias("source_size"))
    above = checkpoint(targets(sources, weights, most), fewer=16).withColumn("sum_before", F.lit(0).cast("long"))
    on = ["s", "s_null"]
    for k in reversed(range(levels)):
        w = Window.partitionBy(*on).orderBy(f"r{k}").rowsBetween(Window.unboundedPreceding, -1)
        here = ranges[k] if k == levels - 1 else ranges[k].withColumn(f"r{k + 1}", at(shifts[k + 1]))
        here = here.withColumn("in_range", F.coalesce(F.sum("words").over(w), F.lit(0)))
        above = here.join(above, on).select("s", "s_null", f"r{k}", "source_size", "target", (F.col("sum_before") + F.col("in_range")).alias("sum_before"))
        on = ["s", "s_null", f"r{k}"]
    w = Window.partitionBy(*on).orderBy("key", "sort_id", "size", "part").rowsBetween(Window.unboundedPreceding, -1)
    x = rows.withColumn("in_range", F.coalesce(F.sum("words").over(w), F.lit(0))).join(above, on)
    budget = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - whole * F.col("source_size") - F.col("sum_before") - F.col("in_range")
    return x.select("doc_id", "s", "s_null", "size", "key", "n", "source_size", "target", whole.cast("long").alias("whole"), rest.cast("long").alias("rest"))


def _key(docs: DataFrame, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), docs["doc_id"], docs["text"]), 1)


def keyed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, s, s_null, key and part of each row, written out."""
    rows = docs.select(
        docs["doc_id"],
        word_count(docs["text"]).alias("size"),
        F.coalesce(docs["source"], F.lit("")).alias("s"),
        docs["source"].isNull().alias("s_null"),
        _key(docs, seed).alias("key"),
        F.spark_partition_id().alias("part"),
    )
    return checkpoint(rows, fewer=4)


def mix_sources(docs: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of docs (doc_id, text, source).

    ``taken`` is how many words the mix takes of the row, repeats counted: whole epochs, and in the
    last, partial epoch all words up to the source's budget, so that a source's sum is its target
    rounded to a word.  Null texts, and texts without words, have size 0 and are taken 0 times; a
    null source is a source of its own; repeated rows each count; an empty table gives no rows.
    """
    x = mix_entries(keyed(docs, seed), weights, most).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("i") * F.col("size")))
    return x.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + last).cast("long").alias("taken"))


def source_cuts(rows: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """A row for each source (s, s_null): whole epochs, the greatest key that the last epoch takes (or null), how many rows with it, and of how many."""
    entries = checkpoint(mix_entries(rows, weights, most).filter("size > 0"), fewer=16)
    took = F.greatest(F.lit(0), F.least(F.col("n"), F.ceil(F.col("rest") / F.col("size"))))
    per = entries.groupBy("s", "s_null").agg(F.max("whole").alias("whole"), F.max(F.when(F.col("rest") > 0, F.col("key"))).alias("cut"))
    at = entries.join(per.select(F.col("s").alias("s_"), F.col("s_null").alias("s_null_"), F.col("cut")), (F.col("s") == F.col("s_")) & (F.col("s_null") == F.col("s_null_")) & (F.col("key") == F.col("cut")))
    at = at.groupBy(F.col("s").alias("s_"), F.col("s_null").alias("s_null_")).agg(F.sum(took).alias("taken_at_cut"), F.sum("n").alias("rows_at_cut"))
    out = per.join(at, (F.col("s") == F.col("s_")) & (F.col("s_null") == F.col("s_null_")), "left")
    return out.select("s", "s_null", "whole", "cut", F.coalesce("taken_at_cut", F.lit(0)).alias("taken_at_cut"), F.coalesce("rows_at_cut", F.lit(0)).alias("rows_at_cut"))


def mixed(docs: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS, seed: int = 0) -> DataFrame:
    """The mix itself: rows of docs, whole, as often as they are taken (the one at the cut is whole too).

    Rows without words aren't taken.  Where the cut falls among rows that repeat in doc_id, text and source, one of them
    stands for all that are taken.  Extra columns stay as they are, whatever their names.
    """
    names = free(docs, "mix_s", "mix_null", "mix_whole", "mix_cut", "mix_taken", "mix_rows", "mix_key", "mix_copy", "mix_place")
    s, null, whole, cut, taken, rows, key, copy, place = names
    cuts = checkpoint(source_cuts(keyed(docs, seed), weights, most), fewer=16).toDF(*names[:6])
    words = docs.filter(docs["text"].rlike(WORD))
    x = words.withColumn(key, _key(words, seed))
    on = (F.coalesce(x["source"], F.lit("")) == F.col(s)) & (x["source"].isNull() == F.col(null))
    x = x.join(small(cuts), on)
    at_cut = F.coalesce(F.col(key) == F.col(cut), F.lit(False))
    some = F.col(taken) < F.col(rows)
    extra = F.when((F.col(key) < F.col(cut)) | (at_cut & ~some), 1).otherwise(0)

    def repeated(x: DataFrame, copies: Column) -> DataFrame:
        # sequence would count down from 1 to 0
        return x.withColumn(copy, F.explode(F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies.cast("long"))))).select(*[x[f"`{c}`"] for c in docs.columns])

    out = repeated(x, F.col(whole) + extra)
    if cuts.filter(some).first() is None:
        return out
    one = x.filter(at_cut & some).withColumn(place, F.row_number().over(Window.partitionBy(s, null).orderBy(F.lit(1)))).filter(F.col(place) == 1)
    return out.unionByName(repeated(one, F.col(taken)))
