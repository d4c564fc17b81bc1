"""Vector, full-text, hybrid and fuzzy search; decay ranking; resurrection; views and contracts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.expr import cosine, decayed, live, similarity, text_rank, tier_rank, token_estimate, trigrams
from lorekeep.operators.graph import traverse

TEXT_SHARE, VECTOR_SHARE = 0.3, 0.7
FUZZY_LEAST = 0.3
HITS = "source_table string, id string, label string, snippet string, score double"


def vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def nearest(df: DataFrame, query: list[float], k: int, column: str = "embedding", key: str = "id", places: int | None = None) -> DataFrame:
    """The k rows of the greatest cosine; rows without a vector don't count.  A top-k needs no shuffle of vectors.

    With ``places``, cosines are rounded before they are ranked: those that are equal then go by key.
    """
    score = cosine(F.col(column), vector(query))
    score = score if places is None else F.round(score, places)
    return df.withColumn("score", score).filter("score is not null").drop(column).orderBy(F.desc("score"), key).limit(k)


def full_text(df: DataFrame, query: str, k: int, text: str = "text", key: str = "id", places: int | None = None) -> DataFrame:
    """The k best rows of those that match all terms; with ``places``, ranks are rounded before they are compared."""
    x = df.withColumn("score", text_rank(F.col(text), query)).filter("score > 0")
    x = x if places is None else x.withColumn("score", F.round("score", places))
    return x.orderBy(F.desc("score"), key).limit(k)


@dataclass(frozen=True)
class Searchable:
    """How a table is searched: its id, label and snippet columns, its full text (if any), and which rows count."""

    id: str
    label: str
    snippet: Column
    text: Column | None = None
    where: Column | None = None
    needs: tuple[str, ...] = ()
    vector: str = "embedding"


def availability(table: DataFrame | None, d: Searchable) -> str:
    """ok, table_missing, column_missing, type_mismatch or no_full_text."""
    if table is None:
        return "table_missing"
    types = dict(table.dtypes)
    if any(c not in types for c in (*d.needs, d.id, d.label)):
        return "column_missing"
    if types.get(d.vector, "array<float>") not in ("array<float>", "array<double>"):
        return "type_mismatch"
    return "ok" if d.text is not None else "no_full_text"


def hits(name: str, table: DataFrame, d: Searchable, query: str, vec: list[float] | None, k: int) -> DataFrame:
    """One table's k best rows by 0.3 text rank + 0.7 cosine, or by text rank alone (zeros too) without a vector."""
    rank = text_rank(d.text, query) if d.text is not None else F.lit(0.0)
    x = table if d.where is None else table.filter(d.where)
    if vec is not None:
        score = rank * TEXT_SHARE + cosine(F.col(d.vector), vector(vec)) * VECTOR_SHARE
        order = [F.desc("score"), F.desc("id")]
    else:
        score, order = rank, [F.desc("score"), F.desc("id")]  # ids compare as text
    x = x.select(F.lit(name).alias("source_table"), F.col(d.id).cast("string").alias("id"), F.col(d.label).cast("string").alias("label"), d.snippet.alias("snippet"), score.alias("score"))
    return x.filter("score is not null").orderBy(*order).limit(k)


def memory_search(tables: dict[str, DataFrame], descriptors: dict[str, Searchable], query: str, vec: list[float] | None = None, names: list[str] | None = None, k: int = 10) -> DataFrame:
    """The k best hits over many tables, in one plan.  Every table's own top k hold all of them.

    names: None means every table, an empty list none; an unknown name is an error; repeats count once.
    """
    asked = list(descriptors) if names is None else list(dict.fromkeys(names))
    unknown = [n for n in asked if n not in descriptors]
    if unknown:
        raise ValueError(f"unknown tables: {unknown}")
    ready = [n for n in asked if availability(tables.get(n), descriptors[n]) in ("ok", "no_full_text")]
    if asked and not ready:
        raise ValueError("none of the tables can be searched")
    parts = [hits(n, tables[n], descriptors[n], query, vec, k) for n in ready]
    if not parts:
        return next(iter(tables.values())).sparkSession.createDataFrame([], HITS)
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("score"), "source_table", F.desc("id")).limit(k)


def fuzzy(facts: DataFrame, seed: str, k: int, least: float = FUZZY_LEAST, text: Column | None = None) -> DataFrame:
    """The k facts whose trigrams are most like the seed's, above the threshold."""
    if not seed.strip():
        return facts.withColumn("sim_score", F.lit(0.0)).limit(0)
    said = F.concat_ws(" ", "subject", "predicate", "object") if text is None else text
    s = similarity(trigrams(said), trigrams(F.lit(seed.strip())))
    return facts.withColumn("sim_score", s).filter(F.col("sim_score") > least).orderBy(F.desc("sim_score"), "id").limit(k)


def any_word(facts: DataFrame, seed: str, k: int) -> DataFrame:
    """Facts that contain any of the seed's words, by subject."""
    said = F.lower(F.concat_ws(" ", "subject", "predicate", "object"))
    tests = [F.contains(said, F.lit(w)) for w in seed.lower().split()]
    return facts.filter(reduce(lambda a, b: a | b, tests, F.lit(False))).orderBy("subject", "id").limit(k)


def near_names(entities: DataFrame, name: str, least: float = 0.4, shortest: int = 4) -> DataFrame:
    """Entities of the same name but for case, and of similar ones if the name is long enough to tell."""
    exact = F.lower(F.trim("name")) == name.strip().lower()
    s = similarity(trigrams(F.col("name")), trigrams(F.lit(name)))
    near = (s >= least) if len(name.strip()) >= shortest else F.lit(False)
    return entities.filter(exact | near).select("id", "name", exact.alias("exact"), F.round(s, 6).alias("similarity"))


def reranked(found: DataFrame, scorer: Callable[[list[str]], list[float]], pool: int = 20, k: int = 5) -> DataFrame:
    """The k best of a pool of hits (id, snippet, score) by an outside scorer, which gets the snippets in batches."""

    def run(batches):
        for pdf in batches:
            scores = scorer(pdf["snippet"].tolist())
            if len(scores) != len(pdf):
                raise ValueError("the scorer must score every snippet")
            yield pdf.assign(rerank=pd.Series(scores, index=pdf.index, dtype="float64"))

    top = found.orderBy(F.desc("score"), "id").limit(pool)
    schema = ", ".join(f"{n} {t}" for n, t in top.dtypes) + ", rerank double"
    return top.mapInPandas(run, schema).orderBy(F.desc("rerank"), "id").limit(k)


def decay_ranked(facts: DataFrame, as_of: Column, k: int = 30, tiers: bool = True, bias: bool = False) -> DataFrame:
    """The k live facts of the greatest decayed confidence; tiers first, outcomes' bias added, if asked for."""
    score = decayed(as_of) + (F.coalesce("outcome_bias", F.lit(0.0)) if bias else F.lit(0.0))
    order = ([tier_rank(F.col("tier"))] if tiers else []) + [F.desc("decayed_score"), F.desc("last_reinforced"), F.asc("id")]
    return facts.filter(live()).withColumn("decayed_score", score).orderBy(*order).limit(k)


def history(facts: DataFrame, subject: str, k: int = 20) -> DataFrame:
    """The suppressed trail of a subject, the latest first."""
    return facts.filter(F.col("suppressed") & (F.col("subject") == subject)).orderBy(F.desc("created_at"), F.desc("id")).limit(k)


def resurrected(facts: DataFrame, edges: DataFrame, seeds: list[str], per_subject: int = 5, overall: int = 50, depth: int = 2) -> DataFrame:
    """Facts downvoted on probation that may come back: of subjects near the seeds which have a live, verified or pinned fact."""
    near = traverse(edges, seeds, depth).select(F.col("entity_name").alias("near")).unionByName(facts.sparkSession.createDataFrame([(s,) for s in seeds], "near string")).distinct()
    anchored = facts.filter(live() & ((F.col("reality_check") == "verified") | F.col("pinned"))).select(F.col("subject").alias("anchor")).distinct()
    x = facts.filter(F.col("suppression_kind") == "downvoted_probation")
    x = x.join(near, F.col("subject") == F.col("near"), "left_semi").join(anchored, F.col("subject") == F.col("anchor"), "left_semi")
    order = [F.desc("confidence"), F.desc("last_reinforced"), F.asc("id")]
    w = Window.partitionBy("subject").orderBy(*order)
    return x.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= per_subject).orderBy(*order).limit(overall)


def packed(items: DataFrame, budget: int, text: str = "snippet", order: tuple[str, ...] = ("place",)) -> DataFrame:
    """Items in order as long as their token estimates fit into the budget (running sums; a report of few items)."""
    w = Window.partitionBy("kind").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("tokens", token_estimate(F.col(text))).withColumn("used", F.sum("tokens").over(w)).filter(F.col("used") <= budget)


def packed_skipping(items: DataFrame, budget: int, text: str = "snippet", order: tuple[str, ...] = ("place",), kind: str = "kind") -> DataFrame:
    """Items of each kind in order, each that still fits into the budget: one that is too large is passed over, not the end.

    Adds tokens, and used, the tokens of the kind's items taken so far.  A kind is one sorted stream in one task, of which only its sum is held.
    NULL texts take no tokens, and items of a NULL kind are a kind of their own.
    """
    x = items.withColumn("tokens", F.coalesce(token_estimate(F.col(text)), F.lit(0)).cast("long")).withColumn("used", F.lit(0).cast("long"))
    at, cost = x.columns.index(kind), x.columns.index("tokens")

    def run(batches):
        now, used = None, 0  # the kind in a tuple, and what it has taken
        for b in batches:
            keep, sums = [], []
            for k, (name, tokens) in enumerate(zip(b.column(at).to_pylist(), b.column(cost).to_pylist())):
                if now != (name,):
                    now, used = (name,), 0
                if used + tokens <= budget:
                    used += tokens
                    keep.append(k)
                    sums.append(used)
            out = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns[:-1], pa.array(sums, pa.int64())], names=b.schema.names)

    parts = max(1, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return x.repartition(parts, kind).sortWithinPartitions(kind, *order).mapInArrow(run, x.schema)


LIMITS = {"entity": 20, "assertion": 20, "recency": 20, "vector": 10, "graph": 25, "history": 20}


@dataclass
class Query:
    """One query of a view or contract: its kind, filter parameters and token budget."""

    kind: str
    params: dict = field(default_factory=dict)
    budget: int | None = None


def run_query(q: Query, tables: dict[str, DataFrame], as_of: Column) -> DataFrame:
    """kind, place, id, label, snippet of one query's items."""
    if q.kind not in LIMITS:
        raise ValueError(f"unknown kind {q.kind!r}")
    n, p = q.params.get("limit", LIMITS[q.kind]), q.params
    say = lambda df, *order: df.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # noqa: E731  at most ``limit`` rows
    if q.kind == "entity":
        x = tables["entities"].filter(~F.col("suppressed") & F.col("name").ilike(f"%{p.get('name', '')}%")).orderBy("name", "id").limit(n)
        x = say(x, "name", "id").select("place", "id", F.col("name").alias("label"), F.col("entity_type").alias("snippet"))
    elif q.kind == "assertion":
        f = tables["facts"] if "predicates" not in p else tables["facts"].filter(F.col("predicate").isin(*p["predicates"]))
        x = decay_ranked(f, as_of, n)
        x = say(x, tier_rank(F.col("tier")), F.desc("decayed_score"), F.desc("last_reinforced"), "id").select("place", "id", F.col("subject").alias("label"), F.col("object").alias("snippet"))
    elif q.kind == "recency":
        x = tables["facts"].filter(live()).orderBy(F.desc("created_at"), F.desc("id")).limit(n)
        x = say(x, F.desc("created_at"), F.desc("id")).select("place", "id", F.col("subject").alias("label"), F.col("object").alias("snippet"))
    elif q.kind == "history":
        x = say(history(tables["facts"], p["subject"], n), F.desc("created_at"), F.desc("id")).select("place", "id", F.col("subject").alias("label"), F.col("object").alias("snippet"))
    elif q.kind == "vector":
        x = nearest(tables["vectors"], p["vector"], n)
        x = say(x, F.desc("score"), "id").select("place", "id", F.col("label").cast("string").alias("label"), F.col("label").cast("string").alias("snippet"))
    else:
        x = traverse(tables["edges"], p["seeds"], p.get("depth", 2), p.get("direction", "out"), n)
        x = say(x, "min_depth", F.desc_nulls_first("max_weight"), "entity_name").select("place", F.lit(None).cast("long").alias("id"), F.col("entity_name").alias("label"), F.col("rep_edge_type").alias("snippet"))
    return x.select(F.lit(q.kind).alias("kind"), "place", F.col("id").cast("long").alias("id"), "label", "snippet")


# fixed values: the predicates that a session starts from
SESSION_PREDICATES = ("open_thread", "session_tldr", "quick_reference")


def session_intent(queries: list[Query], facts: DataFrame, as_of: Column, k: int = 30) -> DataFrame:
    """Live facts that a session starts from, by decayed confidence: of SESSION_PREDICATES, and none if the contract asks for facts itself.

    A contract that has an assertion or a recency query brings what it wants.
    """
    asked = any(q.kind in ("assertion", "recency") for q in queries)
    return decay_ranked(facts.filter(F.lit(not asked) & F.col("predicate").isin(*SESSION_PREDICATES)), as_of, k, tiers=False)


def run_contract(queries: list[Query], tables: dict[str, DataFrame], as_of: Column) -> DataFrame:
    """All queries' items in the contract's order, each kind packed into its own token budget; what doesn't fit is passed over."""
    parts = []
    for k, q in enumerate(queries):
        x = run_query(q, tables, as_of)
        fits = packed_skipping(x, q.budget).withColumn("place", F.row_number().over(Window.orderBy("place"))) if q.budget else None  # at most ``limit`` rows
        parts.append((fits if q.budget else x.withColumn("tokens", token_estimate(F.col("snippet"))).withColumn("used", F.lit(None).cast("long"))).withColumn("ord", F.lit(k)))
    return reduce(DataFrame.unionByName, parts)
