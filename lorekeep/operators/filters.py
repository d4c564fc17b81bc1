"""Filters and pages over facts and logs; every parameter that is None adds no predicate."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.expr import live, micros_of, not_pinned

PAGE, MOST = 200, 1000


def all_of(conditions: list[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def where_given(df: DataFrame, **equal) -> DataFrame:
    """Rows whose columns equal the parameters that are given."""
    return df.filter(all_of([F.col(k) == v for k, v in equal.items() if v is not None]))


def matching(df: DataFrame, prefix: dict[str, str] | None = None, contains: dict[str, str] | None = None) -> DataFrame:
    """LIKE p% and case-blind LIKE %s%; wildcards in the parameters keep their meaning."""
    tests = [F.col(c).like(p + "%") for c, p in (prefix or {}).items()] + [F.col(c).ilike(f"%{s}%") for c, s in (contains or {}).items()]
    return df.filter(all_of(tests))


def among(column: str, values: list) -> Column:
    """In the list; of an empty list nothing is."""
    return F.col(column).isin(*values) if values else F.lit(False)


def not_among(column: str, values: list) -> Column:
    """Not in the list; an empty list excludes nothing."""
    return ~F.col(column).isin(*values) if values else F.lit(True)


def within_days(column: str, as_of: Column, days: int) -> Column:
    return micros_of(F.col(column)) >= micros_of(as_of) - days * 86_400_000_000


def older_than_days(column: str, as_of: Column, days: int) -> Column:
    return micros_of(F.col(column)) < micros_of(as_of) - days * 86_400_000_000


def prune_criteria(project: str, as_of: Column, suppressed: bool | None = None, kind: str | None = None, subject: str | None = None, older_than: int | None = None) -> Column:
    """AND of the given criteria of a manual prune."""
    tests = [F.col("project_id") == project]
    if suppressed is not None:
        tests.append(F.col("suppressed") == suppressed)
    if kind is not None:
        tests.append(F.col("suppression_kind") == kind)
    if subject is not None:
        tests.append(F.col("subject") == subject)
    if older_than is not None:
        tests.append(older_than_days("last_reinforced", as_of, older_than))
    return all_of(tests)


def prune_preview(facts: DataFrame, criteria: Column) -> DataFrame:
    """What a prune would look at, pinned facts included."""
    return facts.filter(criteria).select("id", "subject", "predicate", "object", "pinned")


def pruned(facts: DataFrame, criteria: Column, include_pinned: bool = False) -> DataFrame:
    """The facts that remain after a prune, which skips pinned ones unless told otherwise."""
    goes = criteria if include_pinned else criteria & not_pinned()
    return facts.filter(~F.coalesce(goes, F.lit(False)))


def live_facts(facts: DataFrame) -> DataFrame:
    return facts.filter(live())


def page(df: DataFrame, order: list[str], limit: int | None = None, offset: int = 0) -> DataFrame:
    """Limit and offset in a total order; the limit is PAGE, 1 to MOST."""
    n = PAGE if limit is None else max(1, min(MOST, limit))
    return df.orderBy(*order).offset(max(0, offset)).limit(n)


def keyset_page(log: DataFrame, after: tuple[int, int] | None, limit: int = 50) -> DataFrame:
    """Rows after a compound cursor (milliseconds, id), in its order.  No row is read twice: the cursor's order is total."""
    ms = F.floor(F.col("created_us") / 1000)
    rows = log.withColumn("created_ms", ms)
    if after is not None:
        rows = rows.filter((ms > after[0]) | ((ms == after[0]) & (F.col("id") > after[1])))
    return rows.orderBy("created_ms", "id").limit(limit)


def without_vectors(df: DataFrame) -> DataFrame:
    """df less its columns of number arrays (vectors)."""
    return df.drop(*[n for n, t in df.dtypes if t in ("array<float>", "array<double>")])


def findings(df: DataFrame, status: str | None = None, source: str | None = None, severity: str | None = None) -> DataFrame:
    """Findings by what is given (severity in any case), the most severe first, then the oldest."""
    from lorekeep.functions.expr import severity_rank

    x = where_given(df, status=status, source=source, severity=None if severity is None else severity.upper())
    return x.orderBy(severity_rank(F.col("severity")), "created_at", "id")


def latest(df: DataFrame, n: int, at: str = "created_at", where: Column | None = None, key: str = "id") -> DataFrame:
    """The n newest rows: a report."""
    return (df if where is None else df.filter(where)).orderBy(F.desc(at), F.desc(key)).limit(n)


def sampled(df: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """n rows at random, the same ones for the same seed, whatever the partitioning: a sampling operator."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def raw_sql(tables: dict[str, DataFrame], sql: str) -> DataFrame:
    """The user's SQL over the tables, which are bound by name for this query alone."""
    return next(iter(tables.values())).sparkSession.sql(sql, **tables)


def stale_markers(markers: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Markers older than the limit."""
    return markers.filter(micros_of(F.col("ts")) < micros_of(as_of) - hours * 3_600_000_000)
