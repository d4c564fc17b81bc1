"""7. Exact dedup: a tree-merge of sorted digest runs.

Every partition's rows, sorted by digest, make a run of one entry for each text: the best row and the
number of rows.  In each round, FAN neighbouring runs are exchanged and merged into one, and as runs get
fewer they are cut into as many more ranges of the digest, so that every round keeps all tasks busy and no task
ever holds more than its share (a butterfly of log(partitions) rounds).  A merge reads its runs in digest order
as a stream; entries are merged only when digest, length and a second, independent hash agree, and the best row
is settled again at every level.  A text of which a third of all rows are copies thus reaches any task of a
round as at most FAN entries; of the rows, a task gets those of FAN partitions at most.  What the last round finds of
texts with copies goes back down the levels to the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm._spark import checkpoint, coalesced, row_hash, without_rows

SPACE = r"[\x20\x09-\x0D]"
FAN = 16  # runs that are merged at once
RANGE_BITS = 32  # leading bits of the digest that ranges are made of
_TEXT = ["digest", "check_hash", "check_len"]
_BEST = ["best_points", "best_id", "best_row"]
ENTRY = "run long, place long, digest binary, check_hash long, check_len int, best_points int, best_id long, best_row long, n long"


def normalised(text: Column) -> Column:
    """Without white space; null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, points, row_hash, digest, check_hash, check_len and row (which has the partition in its leading bits) of each row, written out."""
    norm = normalised(docs["text"])
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        F.coalesce(F.length(docs["text"]), F.lit(0)).alias("points"),
        row_hash(docs).alias("row_hash"),
        F.unhex(F.sha2(norm, 256)).alias("digest"),
        F.xxhash64(norm).alias("check_hash"),
        F.length(norm).alias("check_len"),
    )
    # numbered after the coalesce, so that the partition in the leading bits is the one that is written
    return checkpoint(coalesced(rows, 4).withColumn("row", F.monotonically_increasing_id()))


def _words(digest: pa.Array) -> np.ndarray:
    """[rows, 4]: a column of 32-byte digests as integers."""
    start = np.frombuffer(digest.buffers()[1], np.int32)[digest.offset] if len(digest) else 0
    return np.frombuffer(digest.buffers()[2] or b"", np.uint64)[start // 8 : start // 8 + 4 * len(digest)].reshape(-1, 4)


def _merged(batches):
    """Entries of sorted runs, merged: rows of one run and text follow each other, the best first; only n is summed."""
    held = None  # the last entry so far, which the next batch may go on with
    for b in batches:
        if b.num_rows == 0:
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        keys = np.column_stack([_words(b.column(2)).view(np.int64), *(b.column(i).to_numpy().astype(np.int64) for i in (0, 3, 4))])
        first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        n = pa.array(np.add.reduceat(b.column(8).to_numpy(), first))
        out = pa.RecordBatch.from_arrays([*b.take(pa.array(first)).columns[:8], n], schema=b.schema)
        if len(first) > 1:
            yield out.slice(0, len(first) - 1)
        held = out.slice(len(first) - 1)
    if held is not None:
        yield held


def _sorted_merge(entries: DataFrame) -> DataFrame:
    order = ["run", *_TEXT, *(F.desc(c) for c in _BEST)]
    return entries.sortWithinPartitions(*order).mapInArrow(_merged, ENTRY)


def tree_merge(rows: DataFrame) -> list[DataFrame]:
    """The levels of the tree, runs of single partitions first: entries (run, place, the text, its best row, n), each text once a run.

    ``best_id`` and ``best_row`` are complements, so that the greatest has the smallest doc_id, null last, then the first row.
    ``place`` is the run's range of digests that an entry was merged in.
    """
    leading = F.conv(F.hex(F.substring("digest", 1, RANGE_BITS // 8)), 16, 10).cast("long")
    runs = many = 1 + (rows.agg(F.max(F.shiftright("row", 33))).first()[0] or 0)
    leaf = rows.select(
        F.shiftright("row", 33).alias("run"), F.lit(0).cast("long").alias("place"), *_TEXT, F.col("points").alias("best_points"),
        F.bitwise_not("doc_id").alias("best_id"), F.bitwise_not("row").alias("best_row"), F.lit(1).cast("long").alias("n"),
    )
    levels = [_sorted_merge(leaf)]
    while runs > 1:
        runs = -(-runs // FAN)
        ranges = -(-many // runs)
        place = F.shiftright(leading * ranges, RANGE_BITS)
        up = levels[-1].withColumn("run", F.floor(F.col("run") / FAN)).withColumn("place", place)
        levels.append(checkpoint(_sorted_merge(up.repartition(many, "run", "place"))))
    return levels


def decided(rows: DataFrame) -> DataFrame:
    """The rows whose text has copies, with best_id, best_row and group_size of their text.

    The last level's entries of more than one row go down again, from a merged run to the FAN runs it came from.
    """
    levels = tree_merge(rows)
    found = levels[-1].filter("n > 1").select("run", *_TEXT, "best_id", "best_row", F.col("n").alias("group_size"))
    for level in reversed(levels[:-1]):
        below = level.select("run", F.floor(F.col("run") / FAN).alias("up"), *_TEXT)
        found = below.join(found.withColumnRenamed("run", "up"), ["up", *_TEXT]).drop("up")
    return rows.withColumn("run", F.shiftright("row", 33)).join(found, ["run", *_TEXT]).select("row", "doc_id", "row_hash", "best_id", "best_row", "group_size")


def dedup_decisions(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs (doc_id, text).

    Texts are equal when they are identical without white space.  Of equal texts the row with the
    most code points stays, then the smallest doc_id (null last); of rows that repeat both, one
    stays.  Null texts count as empty, and all empty texts are equal.  An empty table gives no rows.
    """
    rows = digests(docs)
    more = decided(rows).select(F.col("row").alias("row_"), "best_id", "best_row", "group_size")
    single = F.col("row_").isNull()
    return rows.join(more, F.col("row") == F.col("row_"), "left").select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.bitwise_not("best_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("row") == F.bitwise_not("best_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, whole, with any extra columns as they are.

    Only decisions on rows that have copies are joined with the documents.
    """
    copies = decided(digests(docs))
    stays = F.max(F.col("row") == F.bitwise_not("best_row")).alias("stays")
    touched = copies.groupBy("doc_id", "row_hash").agg(stays, F.count("*").alias("n")).filter("not stays or n > 1").select("doc_id", "row_hash", "stays")
    return without_rows(docs, checkpoint(touched, fewer=16))


ORACLE_SQL = r"""
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
