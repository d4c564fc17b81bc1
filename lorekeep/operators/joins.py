"""Joins with the store's own meaning: orphans, containment, fallback chains, pairs in groups, mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


FEW_WINDOWS = 1000


def renamed(df: DataFrame, suffix: str) -> DataFrame:
    return df.select([F.col(c).alias(c + suffix) for c in df.columns])


def chunk_hits(chunks: DataFrame, entries: DataFrame) -> DataFrame:
    """Chunks with their entry's name and the number of its chunks.

    The count is an aggregate that is joined back, not a window: one entry may have any number of chunks.
    """
    totals = chunks.groupBy(F.col("entry_id").alias("t_entry")).agg(F.count("*").alias("total_chunks"))
    names = entries.select(F.col("id").alias("e_id"), F.col("name").alias("label")).join(totals, F.col("e_id") == F.col("t_entry"))
    x = chunks.join(names, F.col("entry_id") == F.col("e_id"))
    return x.select("entry_id", "chunk_idx", "total_chunks", "label", F.substring("content", 1, 300).alias("snippet"), "content")


def with_chunk_counts(entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Entries with how many chunks they have, 0 included; chunks are counted before they are joined."""
    n = chunks.groupBy(F.col("entry_id").alias("c_entry")).agg(F.count("*").alias("n"))
    return entries.join(n, F.col("id") == F.col("c_entry"), "left").withColumn("n_chunks", F.coalesce("n", F.lit(0))).drop("n", "c_entry")


def written_in_window(rows: DataFrame, windows: DataFrame, at: str, now: Column) -> DataFrame:
    """Rows written inside any window [enabled, disabled or now].

    Up to FEW_WINDOWS windows go to all tasks; more are dealt out by the days that they touch, and rows meet those of their day.
    """
    w = windows.select(F.col("enabled_at").alias("w0"), F.coalesce(F.col("disabled_at"), now).alias("w1")).filter("w0 <= w1").distinct()
    inside = (F.col(at) >= F.col("w0")) & (F.col(at) <= F.col("w1"))
    if w.limit(FEW_WINDOWS + 1).count() <= FEW_WINDOWS:
        return rows.join(F.broadcast(w), inside, "left_semi")
    days = w.withColumn("w_day", F.explode(F.sequence(F.to_date("w0"), F.to_date("w1"))))
    return rows.join(days, (F.to_date(F.col(at)) == F.col("w_day")) & inside, "left_semi")


def missing(rows: DataFrame, other: DataFrame, left: str, right: str) -> DataFrame:
    """Rows whose key other lacks; rows without a key stay."""
    return rows.join(other.select(F.col(right).alias("other_key")).distinct(), F.col(left) == F.col("other_key"), "left_anti")


def orphan_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with an end that is no entity of the project, and which end."""
    names = entities.select(F.col("project_id").alias("np"), "name").distinct()
    a, b = names.select(F.col("np").alias("pa"), F.col("name").alias("na")), names.select(F.col("np").alias("pb"), F.col("name").alias("nb"))
    x = edges.join(a, (F.col("project_id") == F.col("pa")) & (F.col("from_entity") == F.col("na")), "left").join(b, (F.col("project_id") == F.col("pb")) & (F.col("to_entity") == F.col("nb")), "left")
    x = x.filter(F.col("na").isNull() | F.col("nb").isNull())
    return x.withColumn("missing_from", F.col("na").isNull()).withColumn("missing_to", F.col("nb").isNull()).drop("pa", "pb", "na", "nb")


def orphan_entities(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities at neither end of any edge, suppressed ones too."""
    ends = edges.select("project_id", F.col("from_entity").alias("end")).unionByName(edges.select("project_id", F.col("to_entity").alias("end"))).distinct()
    ends = ends.select(F.col("project_id").alias("ep"), "end")
    return entities.join(ends, (F.col("project_id") == F.col("ep")) & (F.col("name") == F.col("end")), "left_anti")


def contradictions(facts: DataFrame, predicates: list[str], value: Column) -> DataFrame:
    """Live facts of a subject and a 1:1 predicate that say different things.

    Each of a group's facts is set against the first fact of every other value in it, so that a group of n
    facts and v values gives at most n * (v - 1) rows instead of n * n; a and b name the smaller and greater id.
    """
    x = facts.filter(F.col("predicate").isin(*predicates)).withColumn("said", value).withColumn("who", F.lower(F.trim(F.coalesce("subject", F.lit("")))))
    firsts = x.groupBy("project_id", "who", "predicate", "said").agg(F.min("id").alias("first"))
    firsts = firsts.select(F.col("project_id").alias("p2"), F.col("who").alias("w2"), F.col("predicate").alias("r2"), F.col("said").alias("s2"), "first")
    j = x.join(firsts, (F.col("project_id") == F.col("p2")) & (F.col("who") == F.col("w2")) & (F.col("predicate") == F.col("r2")) & ~F.col("said").eqNullSafe(F.col("s2")))
    return j.select(F.col("project_id"), F.col("who").alias("subject"), "predicate", F.least("id", "first").alias("a"), F.greatest("id", "first").alias("b")).distinct()


def mentions(facts: DataFrame, entities: DataFrame, edges: DataFrame, shortest: int = 4) -> DataFrame:
    """Facts about an entity that name another one, with which no edge links it.

    Texts and names meet on a name's first word instead of in a cross join; the whole name is then looked for.
    """
    names = entities.filter(F.length("name") >= shortest).select(F.col("project_id").alias("mp"), F.col("name").alias("mentioned")).distinct()
    names = names.withColumn("word", F.regexp_extract(F.lower("mentioned"), r"[\p{L}\p{N}_]+", 0))
    own = entities.select(F.col("project_id").alias("op"), F.col("name").alias("own_name")).distinct()
    x = facts.withColumn("entity", F.trim(F.coalesce("subject", F.lit(""))))
    x = x.join(own, (F.col("project_id") == F.col("op")) & (F.col("entity") == F.col("own_name")), "left_semi")
    x = x.select("id", "project_id", "entity", "object", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("object"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("w"))
    x = x.join(names, (F.col("project_id") == F.col("mp")) & (F.col("w") == F.col("word"))).filter("mentioned != entity")
    quoted = F.concat(F.lit(r"(?i)\b\Q"), F.col("mentioned"), F.lit(r"\E\b"))
    x = x.filter(F.regexp_like("object", quoted)).select("id", "project_id", "entity", "mentioned").distinct()
    both = edges.select("project_id", "from_entity", "to_entity").unionByName(edges.select("project_id", F.col("to_entity").alias("from_entity"), F.col("from_entity").alias("to_entity"))).distinct()
    both = both.select(F.col("project_id").alias("lp"), F.col("from_entity").alias("lf"), F.col("to_entity").alias("lt"))
    return x.join(both, (F.col("project_id") == F.col("lp")) & (F.col("entity") == F.col("lf")) & (F.col("mentioned") == F.col("lt")), "left_anti")


def dangling_references(facts: DataFrame, entities: DataFrame, shaped) -> DataFrame:
    """id, field, candidate, reason of subjects and objects: linked, case_mismatch, cross_project, no_match, not_entity or blank."""
    f = facts.select("id", "project_id", F.expr("stack(2, 'subject', subject, 'object', object)").alias("field", "raw")).withColumn("candidate", F.trim(F.coalesce("raw", F.lit(""))))
    names = entities.select(F.col("project_id").alias("np"), "name").distinct()
    exact = names.select(F.col("np").alias("xp"), F.col("name").alias("xn"))
    same = names.select(F.col("np").alias("sp"), F.lower("name").alias("sl")).distinct()
    # a name of another project: one that more than one project has, or one whose only project differs
    other = names.groupBy(F.lower("name").alias("ol")).agg(F.min("np").alias("p_min"), F.max("np").alias("p_max"))
    low = F.lower("candidate")
    x = f.join(exact, (F.col("project_id") == F.col("xp")) & (F.col("candidate") == F.col("xn")), "left").join(same, (F.col("project_id") == F.col("sp")) & (low == F.col("sl")), "left").join(other, low == F.col("ol"), "left")
    elsewhere = F.col("ol").isNotNull() & ((F.col("p_min") != F.col("project_id")) | (F.col("p_max") != F.col("project_id")))
    reason = F.when(F.col("candidate") == "", "blank").when(F.col("xn").isNotNull(), "linked").when(F.col("sl").isNotNull(), "case_mismatch").when(elsewhere, "cross_project").when(shaped(F.col("candidate")), "no_match").otherwise("not_entity")
    return x.select("id", "field", "candidate", reason.alias("reason"))


def resolved_routes(requests: DataFrame, overrides: DataFrame, pins: DataFrame, default: str) -> DataFrame:
    """The first of: session override, the project's active pin, the global (*) pin, the recommendation.

    pins may hold many versions; the latest active one of each (project, role) counts.
    """
    active = pins.filter("active").groupBy(F.col("project_id").alias("pp"), F.col("role").alias("pr")).agg(F.max(F.struct("version", "model")).alias("pin"))
    own = active.select(F.col("pp").alias("p1"), F.col("pr").alias("r1"), F.col("pin").alias("own_pin"))
    every = active.filter("pp = '*'").select(F.col("pr").alias("r2"), F.col("pin").alias("all_pin"))
    o = overrides.select(F.col("project_id").alias("op"), F.col("session_id").alias("os"), F.col("role").alias("orole"), F.col("model").alias("o_model"))
    x = requests.join(o, (F.col("project_id") == F.col("op")) & (F.col("session_id") == F.col("os")) & (F.col("role") == F.col("orole")), "left")
    x = x.join(own, (F.col("project_id") == F.col("p1")) & (F.col("role") == F.col("r1")), "left").join(every, F.col("role") == F.col("r2"), "left")
    why = F.when(F.col("o_model").isNotNull(), "session override").when(F.col("own_pin").isNotNull(), F.concat(F.lit("project pin v"), F.col("own_pin.version"))).when(F.col("all_pin").isNotNull(), "global default pin").otherwise("recommended")
    return x.select(*requests.columns, F.coalesce("o_model", "own_pin.model", "all_pin.model", F.lit(default)).alias("model"), why.alias("rationale"))
