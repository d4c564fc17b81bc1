"""Checkpoints in the shared folder, free column names, and rows of documents by decisions on them."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000  # rows of a small table, about 50 bytes each, that may be sent to all executors
MAP_LOG2 = 27  # bits of the map of keys that is sent to all executors: 16 MB, whatever the input


def checkpoint_folder(spark: SparkSession) -> None:
    """Take spark.checkpoint.dir from the session; only where it is unset and Spark is local (tests) make a folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lorekeep-"))


def checkpoint(df: DataFrame, fewer: int = 0) -> DataFrame:
    """df written to the shared checkpoint folder: its lineage is cut, and later reads agree with each other.

    fewer, for tables much smaller than documents, makes fewer files (see ``coalesced``): tiny files cost more than they hold.
    """
    checkpoint_folder(df.sparkSession)
    return (coalesced(df, fewer) if fewer else df).checkpoint(eager=True)


def coalesced(df: DataFrame, fewer: int) -> DataFrame:
    """df in at most fewer times fewer partitions than there are shuffle partitions, but two for each core."""
    spark = df.sparkSession
    return df.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // fewer))


def free(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with no column of df, whatever its case."""
    used, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in used:
            n = "_" + n
        used.add(n.lower())
        out.append(n)
    return out


def small(df: DataFrame) -> DataFrame:
    """df, a table that can be read twice, for the side of a join with documents: broadcast if its rows are few, else hashed where they are shuffled to."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df.hint("shuffle_hash")


def bitmap(keys: DataFrame, log2: int):
    """Broadcast bytes of a bitmap of 2**log2 bits of keys (one long column, its lowest bits): made in pieces on the executors."""
    at = (F.col(keys.columns[0]).bitwiseAND((1 << log2) - 1) + 1).cast("long")
    dealt = keys.select(F.bitmap_bucket_number(at).alias("k"), F.bitmap_bit_position(at).alias("p")).repartition("k")
    size = 4096
    out = bytearray(max(1, (1 << log2) // (8 * size)) * size)
    for r in dealt.groupBy("k").agg(F.bitmap_construct_agg("p").alias("bits")).toLocalIterator():
        out[(r["k"] - 1) * size : r["k"] * size] = bytes(r["bits"])
    return keys.sparkSession.sparkContext.broadcast(bytes(out))


def row_hash(docs: DataFrame):
    """What with doc_id tells rows of docs apart."""
    return F.xxhash64(docs["text"])


def _maybe_in(docs: DataFrame, keys: DataFrame, key: Column, mark: str) -> DataFrame:
    """docs with the boolean ``mark``: false where key (a 64-bit hash) is certainly not in keys (one column, its name free in docs).

    What is sent to all executors is a bitmap of 2**MAP_LOG2 bits at most, 16 MB, however many keys there are.
    """
    b, bits = free(docs, "map_bucket", "map_bits")
    at = lambda c: (c.bitwiseAND((1 << MAP_LOG2) - 1) + 1).cast("long")
    one = at(F.col(keys.columns[0]))
    dealt = keys.select(F.bitmap_bucket_number(one).alias(b), F.bitmap_bit_position(one).alias("p")).repartition(b)  # keys are shuffled, not bitmaps
    pieces = dealt.groupBy(b).agg(F.bitmap_construct_agg("p").alias(bits))
    place = F.bitmap_bit_position(at(key)).cast("int")
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, place.bitwiseAND(7)).bitwiseAND(1) == 1
    x = docs.join(F.broadcast(pieces), F.bitmap_bucket_number(at(key)) == F.col(b), "left")
    return x.select(*[x[f"`{c}`"] for c in docs.columns], F.coalesce(hit, F.lit(False)).alias(mark))


def without_rows(docs: DataFrame, touched: DataFrame) -> DataFrame:
    """Rows of docs, whole, less those that touched names: touched (doc_id, row_hash, stays), each key once, can be read twice.

    Of rows with a key that stays, one stays; rows with other keys go; rows that touched doesn't name all stay.
    A bitmap of fixed size of touched lets rows that it certainly doesn't name pass where they are; only the others
    are shuffled, and joined with touched by their keys.
    """
    d, h, stays, hit, whole = free(docs, "key_id", "key_hash", "stays", "maybe_touched", "whole_row")
    t = touched.toDF(d, h, stays)
    key = F.xxhash64(docs["doc_id"], row_hash(docs))
    hashed = lambda x: x.select(F.xxhash64(d, h).alias(h))
    marked = _maybe_in(docs, hashed(t), key, hit)
    own = lambda x: x.select(*[x[f"`{c}`"] for c in docs.columns])
    maybe = marked.filter(F.col(hit))
    on = maybe["doc_id"].eqNullSafe(F.col(d)) & (row_hash(maybe) == F.col(h))
    out = own(marked.filter(~F.col(hit))).unionByName(own(maybe.join(t.hint("merge"), on, "left_anti")))
    again = t.filter(F.col(stays))
    if again.first() is None:
        return out
    # rows that repeat become one in each task before they are shuffled
    named = _maybe_in(docs, hashed(again), key, hit).filter(F.col(hit))
    one = named.groupBy(named["doc_id"].alias(d), row_hash(named).alias(h)).agg(F.first(F.struct(*[named[f"`{c}`"] for c in docs.columns])).alias(whole))
    a = again.toDF("again_id", "again_hash", "again_stays")
    one = one.join(a.hint("merge"), F.col(d).eqNullSafe(F.col("again_id")) & (F.col(h) == F.col("again_hash")), "left_semi")
    return out.unionByName(one.select(*[F.col(whole)[c].alias(c) for c in docs.columns]))
