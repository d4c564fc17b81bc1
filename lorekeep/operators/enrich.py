"""Columns from outside services: vectors and generated lines, in batches, with the caller's function."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.expr import norm

BATCH = 32


def _batches(pdf: pd.DataFrame, size: int):
    for at in range(0, len(pdf), size):
        yield pdf.iloc[at : at + size]


def embedded(df: DataFrame, text: str, embedder: Callable[[list[str]], list[list[float]]], dims: int, vector: str = "embedding", size: int = BATCH) -> DataFrame:
    """df whose missing vectors are made, of rows whose text isn't blank, and cut to ``dims`` numbers.

    A batch that the embedder refuses is tried row by row, and a row that it refuses keeps NULL; a wrong
    number of vectors, an empty or a zero one counts as refused.
    """
    cols = [c for c in df.columns if c != vector]

    def asked(texts: list[str]) -> list[list[float] | None]:
        got = embedder(texts)
        if len(got) != len(texts):
            raise ValueError("the embedder must give a vector for each text")
        return [[float(x) for x in v[:dims]] if len(v) and np.any(v) else None for v in got]

    def one(t: str):
        try:
            return asked([t])[0]
        except Exception:  # noqa: BLE001  the service's failure, which the plan counts as still pending
            return None

    def run(batches):
        for pdf in batches:
            out = pdf[vector].tolist()
            need = [i for i, (v, t) in enumerate(zip(out, pdf[text])) if v is None and isinstance(t, str) and t.strip()]
            for at in range(0, len(need), size):
                part = need[at : at + size]
                texts = [pdf[text].iloc[i] for i in part]
                try:
                    vectors = asked(texts)
                except Exception:  # noqa: BLE001
                    vectors = [one(t) for t in texts]
                for i, v in zip(part, vectors):
                    out[i] = v
            yield pdf.assign(**{vector: pd.Series(out, index=pdf.index, dtype=object)})[[*cols, vector]]

    schema = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in cols) + f", `{vector}` array<float>"
    return df.select(*cols, F.col(vector).cast("array<float>").alias(vector)).mapInPandas(run, schema)


def generated(df: DataFrame, text: str, write: Callable[[str], str], into: str = "blurb", most: int = 800) -> DataFrame:
    """df with a generated line of at most ``most`` characters; NULL where the writer fails or says nothing."""

    @F.pandas_udf("string")
    def line(texts: pd.Series) -> pd.Series:
        def said(t):
            try:
                return (write(t) or "").strip()[:most] or None if isinstance(t, str) else None
            except Exception:  # noqa: BLE001
                return None

        return texts.map(said).astype(object)

    return df.withColumn(into, line(F.col(text)))


def normalised(v: Column, dims: int | None = None) -> Column:
    """v at length 1, then cut to its first ``dims`` numbers; NULL of a zero vector."""
    n = norm(v)
    x = F.when(n > 0, F.transform(v, lambda x: x / n))
    return x if dims is None else F.slice(x, 1, dims)


def mean_pooled(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """key and the mean of its rows' vectors, by position: sums are partial before the shuffle."""
    x = df.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("m"))
    return x.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias(vector))


def one_provider(df: DataFrame, provider: str = "provider", vector: str = "embedding") -> None:
    """Refuse vectors of more than one provider in one table."""
    names = [r[0] for r in df.filter(F.col(vector).isNotNull()).select(provider).distinct().limit(3).collect()]
    if len(names) > 1:
        raise ValueError(f"vectors of several providers: {sorted(map(str, names))}")
