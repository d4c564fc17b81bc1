"""Line alignment of two versions of a text, with the line numbers of both sides."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ROWS = pa.schema([("change", pa.string()), ("old_line", pa.int64()), ("new_line", pa.int64()), ("line", pa.string())])


def pairs(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of lines that are kept, rising on both sides.

    Equal lines at both ends of a stretch are kept; in what is left, lines that occur once on either side are anchors, of which the longest
    rising run is kept; the stretches between anchors are worked on alike, until one has no anchor.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        once_a, once_b = Counter(a[i:m]), Counter(b[j:n])
        where = {b[k]: k for k in range(j, n) if once_b[b[k]] == 1}
        anchors = [(k, where[a[k]]) for k in range(i, m) if once_a[a[k]] == 1 and a[k] in where]
        run = _longest_run(anchors)
        if not run:
            continue
        ends = [(i, j), *[(x + 1, y + 1) for x, y in run]]
        todo += [(s, x, t, y) for (s, t), (x, y) in zip(ends, [*run, (m, n)])]
        out += run
    return sorted(out)


def _longest_run(anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence with rising second places."""
    tails, last, before = [], [], [-1] * len(anchors)
    for k, (_, y) in enumerate(anchors):
        at = bisect_left(tails, y)
        before[k] = last[at - 1] if at else -1
        tails[at : at + 1], last[at : at + 1] = [y], [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(anchors[k])
        k = before[k]
    return out[::-1]


def aligned_lines(old: DataFrame, new: DataFrame, key: str, text: str = "body") -> DataFrame:
    """key, change (kept, removed, added), old_line, new_line (from 0, NULL on the side that lacks it) and line of both versions of every text.

    key is unique on either side.  A NULL or missing version has no lines, an empty one a single empty line.
    """
    o, n = old.select(F.col(key), F.col(text).alias("old_text")), new.select(F.col(key).alias("new_key"), F.col(text).alias("new_text"))
    both = o.join(n, F.col(key) == F.col("new_key"), "full_outer").select(F.coalesce(key, "new_key").alias(key), "old_text", "new_text")

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                a, z = ([] if (t := b.column(c)[k].as_py()) is None else t.split("\n") for c in (1, 2))
                rows, i, j = [], 0, 0
                for x, y in [*pairs(a, z), (len(a), len(z))]:
                    rows += [("removed", r, None, a[r]) for r in range(i, x)] + [("added", None, r, z[r]) for r in range(j, y)]
                    rows += [("kept", x, y, a[x])] if x < len(a) and y < len(z) else []
                    i, j = x + 1, y + 1
                cols = [pa.array([r[c] for r in rows], f.type) for c, f in enumerate(_ROWS)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([k] * len(rows), pa.int64())), *cols], names=["key", *_ROWS.names])

    kind = both.schema[key].dataType.simpleString()
    return both.mapInArrow(run, f"key {kind}, change string, old_line long, new_line long, line string").withColumnRenamed("key", key)


def patched(changes: DataFrame, key: str) -> DataFrame:
    """key and body of the new version, from what is kept and added."""
    rows = changes.filter("change != 'removed'").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("new_line", "line"))).alias("rows"))
    return rows.select(key, F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("body"))
