"""Compare a query with its oracle, as the driver does: columns by name, types, rows as a multiset of values."""

from __future__ import annotations

from collections import Counter

import duckdb
import pyarrow as pa

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def _kind(t: pa.DataType) -> str:
    if pa.types.is_large_string(t) or pa.types.is_string(t) or "string_view" in str(t):
        return "string"
    if pa.types.is_timestamp(t):
        return "timestamp"
    return str(t)


def _rows(t: pa.Table) -> Counter:
    cols = [t.column(c).to_pylist() for c in sorted(t.column_names)]
    return Counter(map(repr, zip(*cols)))


def differences(df, duck: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What is unequal, in words; nothing if all is equal."""
    got, want = df.toArrow(), duck.sql(sql).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return [f"columns {sorted(got.column_names)} and {sorted(want.column_names)}"]
    out = [f"{c}: {_kind(got.schema.field(c).type)} and {_kind(want.schema.field(c).type)}" for c in sorted(got.column_names) if _kind(got.schema.field(c).type) != _kind(want.schema.field(c).type)]
    a, b = _rows(got), _rows(want)
    if a != b:
        out.append(f"{got.num_rows} and {want.num_rows} rows; only here {list((a - b).items())[:3]}; only there {list((b - a).items())[:3]}")
    return out
