"""4. WARC: a Merkle fixity audit of two replicas, with DataFrame functions.

Records lie in archive files at ordered offset ranges.  A leaf is the hash of one record and its
offset range; FAN neighbouring nodes are hashed, in order, into a node of the next level, up to one
root.  The roots are compared first, then only the children of nodes that differ, so that an audit of
sound replicas reads one row, and one of a few corrupt records a few nodes a level.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm._spark import checkpoint
from lorekeep.operators.alignment import pairs

FAN = 16
FILE_RECORDS = 256  # records of an archive file


def warc_record(uri: Column, record_id: Column, payload: Column) -> Column:
    """The bytes of a WARC/1.1 resource record; a null payload is empty, a null address an empty one."""
    body = F.coalesce(payload, F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:"),
        F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(uri, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def archive(pages: DataFrame) -> DataFrame:
    """page_id, file, pos (in the file), offset, length, record_sha256 of pages (page_id, url, html) laid out in archive files.

    Records of a file lie in the order of page_id, url and html's hash (nulls first), FILE_RECORDS ids a file;
    pages without an id spread by hash over negative files.
    """
    rec = warc_record(F.col("url"), F.col("page_id"), F.col("html"))
    loose = F.when(F.col("page_id").isNull(), -1 - F.pmod(F.xxhash64("url", "html"), F.lit(1 << 20)))
    x = pages.select("page_id", F.coalesce(loose, F.floor(F.col("page_id") / FILE_RECORDS)).cast("long").alias("file"), F.octet_length(rec).cast("long").alias("length"), F.sha2(rec, 256).alias("record_sha256"))
    w = Window.partitionBy("file").orderBy("page_id", "record_sha256")
    return x.withColumn("pos", F.row_number().over(w).cast("long") - 1).withColumn("offset", F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def tree(leaves: DataFrame, top: int) -> list[DataFrame]:
    """Levels 0 (leaves) to ``top`` of the tree, each with node, parent and hash; leaves has file, pos, offset, length, record_sha256.

    Below a file, nodes are numbered in the file; above, files are numbered among files: (file, node) names a node.
    """
    leaf = F.sha2(F.concat_ws(" ", "offset", F.col("offset") + F.col("length"), "record_sha256"), 256)
    levels = [leaves.select("file", F.col("pos").alias("node"), leaf.alias("hash"))]
    for _ in range(top):
        levels.append(_above(levels[-1]))
    return levels


def _above(level: DataFrame) -> DataFrame:
    """FAN children a node at most: in a file until it has one node, then over files."""
    kids = F.sort_array(F.collect_list(F.struct("file", "node", "hash")))
    return level.groupBy(*_parent(level)).agg(F.sha2(F.array_join(F.transform(kids, lambda k: F.concat_ws(":", k["file"], k["node"], k["hash"])), ","), 256).alias("hash"))


def _parent(level: DataFrame) -> tuple[Column, Column]:
    return F.col("file").alias("file"), F.floor(F.col("node") / FAN).alias("node")


def _over_files(level: DataFrame) -> DataFrame:
    """One node a file; from here on, files are the nodes of one archive."""
    return level.select(F.lit(0).cast("long").alias("file"), F.col("file").alias("node"), "hash")


def audit(one: DataFrame, two: DataFrame, records_a_file: int = FILE_RECORDS) -> DataFrame:
    """one's and two's records that differ or are missing on a side: page ids, files, offsets and hashes of both sides.

    one and two are archives (see ``archive``), read more than once.
    """
    inside = 1
    while FAN**inside < records_a_file:
        inside += 1
    sides = []
    for x in (one, two):
        most = x.groupBy("file").count().agg(F.max("count")).first()[0] or 1
        sides.append((x, most))
    while FAN**inside < max(m for _, m in sides):
        inside += 1
    trees = []
    span = [x.agg(F.min("file"), F.max("file")).first() for x, _ in sides]
    far = max([abs(v) for r in span for v in r if v is not None], default=1) + 1
    over = 1
    while FAN**over < far:
        over += 1
    for x, _ in sides:
        low = [checkpoint(level) if k == 0 else level for k, level in enumerate(tree(x, 0))]
        for _ in range(inside):
            low.append(_above(low[-1]))
        high = [checkpoint(_over_files(low[-1]))]
        for _ in range(over):
            high.append(_above(high[-1]))
        trees.append((low, high))
    (low1, high1), (low2, high2) = trees

    def differ(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select(F.col("file").alias("file2"), F.col("node").alias("node2"), F.col("hash").alias("hash2"))
        j = a.join(b, (F.col("file") == F.col("file2")) & (F.col("node") == F.col("node2")), "full_outer")
        return j.filter(~F.col("hash").eqNullSafe(F.col("hash2"))).select(F.coalesce("file", "file2").alias("file"), F.coalesce("node", "node2").alias("node"))

    def under(level: DataFrame, bad: DataFrame) -> DataFrame:
        up = bad.select(F.col("file").alias("bad_file"), F.col("node").alias("bad_node"))
        return level.join(up, (F.col("file") == F.col("bad_file")) & (F.floor(F.col("node") / FAN) == F.col("bad_node")), "left_semi")

    bad = checkpoint(differ(high1[-1], high2[-1]))
    for a, b in zip(reversed(high1[:-1]), reversed(high2[:-1])):
        bad = checkpoint(differ(under(a, bad), under(b, bad)))
    bad = bad.select(F.col("node").alias("file"), F.lit(0).cast("long").alias("node"))
    for a, b in zip(reversed(low1[:-1]), reversed(low2[:-1])):
        bad = checkpoint(differ(under(a, bad), under(b, bad)))
    at = bad.select(F.col("file").alias("bad_file"), F.col("node").alias("bad_pos"))

    def found(x: DataFrame, n: str) -> DataFrame:
        x = x.join(at, (F.col("file") == F.col("bad_file")) & (F.col("pos") == F.col("bad_pos")), "left_semi")
        return x.select("file", "pos", *[F.col(c).alias(f"{c}{n}") for c in ("page_id", "offset", "length", "record_sha256")])

    return found(one, "_1").join(found(two, "_2"), ["file", "pos"], "full_outer")


def moved(one: DataFrame, two: DataFrame, bad: DataFrame) -> DataFrame:
    """(file, pos) of one's records that two has whole, in the same order, at another place of the same file: of the files in bad (file) only.

    The record hashes of a file, FILE_RECORDS ids at most, are aligned side by side: what is kept lies in both.
    """
    files = bad.select(F.col("file").alias("bad_file")).distinct()
    side = lambda x: x.join(files, F.col("file") == F.col("bad_file"), "left_semi").select("file", "pos", "record_sha256")

    def run(mine: pa.Table, other: pa.Table) -> pa.Table:
        a, b = (sorted(zip(t["pos"].to_pylist(), t["record_sha256"].to_pylist())) for t in (mine, other))
        kept = [a[i][0] for i, _ in pairs([h for _, h in a], [h for _, h in b])]
        return pa.table({"file": pa.array([mine["file"][0].as_py()] * len(kept), pa.int64()), "pos": pa.array(kept, pa.int64())})

    def aligned(mine: pa.Table, other: pa.Table) -> pa.Table:
        return run(mine, other) if mine.num_rows and other.num_rows else pa.table({"file": pa.array([], pa.int64()), "pos": pa.array([], pa.int64())})

    return side(one).groupBy("file").cogroup(side(two).groupBy("file")).applyInArrow(aligned, "file long, pos long")


def fixity_report(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """page_id, file, pos, offset, length, record_sha256, intact and moved of every record of pages, audited against a replica.

    A record is intact when the descent from the roots doesn't reach it, or when its file's records, aligned with the replica's, have it whole at
    another place: then it is moved too, as records before it are missing, longer or new there.  Records that only the
    replica has, with no counterpart at their place, follow with their own place and intact false.  Null ids, addresses and payloads are
    allowed (see ``archive``); equal rows are records of their own; of two empty sides nothing comes.
    """
    one, two = checkpoint(archive(pages)), checkpoint(archive(replica))
    bad = checkpoint(audit(one, two))
    cols = ["page_id", "file", "pos", "offset", "length", "record_sha256"]
    found = checkpoint(moved(one, two, bad)).select(F.col("file").alias("mf"), F.col("pos").alias("mp"))
    hit = bad.filter(F.col("length_1").isNotNull()).select(F.col("file").alias("f"), F.col("pos").alias("p"), F.lit(True).alias("reached"))
    reached = F.coalesce("reached", F.lit(False))
    mine = one.join(hit, (F.col("file") == F.col("f")) & (F.col("pos") == F.col("p")), "left").join(found, (F.col("file") == F.col("mf")) & (F.col("pos") == F.col("mp")), "left")
    mine = mine.select(*cols, (~reached | F.col("mp").isNotNull()).alias("intact"), (reached & F.col("mp").isNotNull()).alias("moved"))
    # what only the replica has: records of its files that no record of ours is aligned with
    back = checkpoint(moved(two, one, bad)).select(F.col("file").alias("mf"), F.col("pos").alias("mp"))
    theirs = two.join(bad.filter(F.col("length_1").isNull()).select(F.col("file").alias("f"), F.col("pos").alias("p")), (F.col("file") == F.col("f")) & (F.col("pos") == F.col("p")), "left_semi")
    extra = theirs.join(back, (F.col("file") == F.col("mf")) & (F.col("pos") == F.col("mp")), "left_anti").select(*cols, F.lit(False).alias("intact"), F.lit(False).alias("moved"))
    return reduce(DataFrame.unionByName, [mine, extra])


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with planted damage, for the audit to find: the middle character of every 97th page (5, 102, ...) is
    overwritten, byte for byte, and every 211th page (11, 222, ...) is missing, so that the records after it lie elsewhere."""
    half = F.floor(F.length("html") / 2).cast("int")
    hit = (F.pmod(F.col("page_id"), F.lit(97)) == 5) & (F.length("html") > 0)
    middle = F.substring("html", half + 1, F.lit(1))
    other = F.when(middle == "~", "#").otherwise(F.repeat(F.lit("~"), F.octet_length(middle)))
    flipped = F.concat(F.substring("html", F.lit(1), half), other, F.expr("substring(html, cast(floor(length(html) / 2) as int) + 2)"))
    left = pages.filter(~F.coalesce(F.pmod(F.col("page_id"), F.lit(211)) == 11, F.lit(False)))
    return left.withColumn("html", F.when(hit, flipped).otherwise(F.col("html")))


ORACLE_SQL = r"""
WITH r AS (
  SELECT page_id, CAST(floor(page_id / 256.0) AS BIGINT) AS file,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:record:' || page_id || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec,
    (page_id % 97 = 5 AND length(html) > 0) OR page_id % 211 = 11 AS hit
  FROM pages)
SELECT page_id, file, row_number() OVER w - 1 AS pos, CAST(coalesce(sum(strlen(rec)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
  strlen(rec) AS length, sha256(rec) AS record_sha256, NOT hit AS intact,
  NOT hit AND count(*) FILTER (page_id % 211 = 11) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) > 0 AS moved
FROM r WINDOW w AS (PARTITION BY file ORDER BY page_id, sha256(rec))"""
