"""Sources: Markdown folders, JSON-lines transcripts, payloads, databases, catalogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators.text import front_matter

TRANSCRIPT = "type string, message struct<role:string,content:string>, timestamp string, sessionId string"
PAYLOAD = "session_id string, tldr string, open_threads array<string>, quick_references string, confirm_claude_md_promotion boolean, entities array<struct<name:string,entity_type:string,description:string>>, assertions array<struct<subject:string,predicate:string,object:string,confidence:double,source:string>>, edges array<struct<from_entity:string,edge_type:string,to_entity:string,weight:double>>, resolved_threads array<string>, retrieval_outcome string, retrieval_outcome_notes string, decisions array<struct<topic:string,decision:string,reason:string,session_num:double>>"
#: what a payload's fields hold, as a variant's type starts
KINDS = {"session_id": "STRING", "tldr": "STRING", "quick_references": "STRING", "retrieval_outcome": "STRING", "retrieval_outcome_notes": "STRING", "confirm_claude_md_promotion": "BOOLEAN"} | dict.fromkeys(("open_threads", "resolved_threads", "entities", "assertions", "edges", "decisions"), "ARRAY")
PART = "array<struct<type:string,text:string>>"


def database(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """Any JDBC database whose driver is on the class path; pass partitionColumn, lowerBound, upperBound and numPartitions to read in parallel."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """source_file, name (the file's stem, or the front matter's name), description, type and text of every *.md file below path."""
    x = spark.read.text(path, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True).withColumn("source_file", F.input_file_name())
    stem = F.regexp_extract("source_file", r"([^/]+)\.md$", 1)
    body = F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n*", "")
    title = F.nullif(F.regexp_extract(body, r"\A# ([^\n]+)", 1), F.lit(""))
    return x.select("source_file", F.coalesce(front_matter(F.col("value"), "name"), stem).alias("name"), F.coalesce(front_matter(F.col("value"), "description"), title).alias("description"), F.coalesce(front_matter(F.col("value"), "type"), F.lit("reference")).alias("type"), body.alias("text"))


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """source_file, session_id, role, text of the messages of JSON-lines files; lines that aren't JSON are skipped.

    Content is a string, or an array of parts of which those of text count.
    """
    x = spark.read.text(path, recursiveFileLookup=True).select(F.input_file_name().alias("source_file"), F.from_json("value", TRANSCRIPT, {"mode": "PERMISSIVE"}).alias("m"))
    content = F.col("m.message.content")
    parts = F.filter(F.from_json(content, PART), lambda p: p["type"] == "text")
    said = F.when(content.rlike(r"\A\s*\["), F.array_join(F.transform(parts, lambda p: p["text"]), "\n")).otherwise(content)
    return x.select("source_file", F.col("m.sessionId").alias("session_id"), F.col("m.message.role").alias("role"), said.alias("text")).filter("text is not null and text != ''")


# fixed values: the longest texts of a payload, by field, the longest lists, and the words that a field may hold
TEXT_MOST = {"tldr": 4000, "session_id": 4000, "quick_references": 4000, "retrieval_outcome_notes": 4000}
THREADS_MOST = {"open_threads": 4000, "resolved_threads": 4000}
ITEMS_MOST = {
    "entities": {"name": 1000, "entity_type": 1000, "description": 1000},
    "assertions": {"subject": 1000, "predicate": 1000, "object": 1000, "source": 1000},
    "edges": {"from_entity": 1000, "edge_type": 1000, "to_entity": 1000},
    "decisions": {"topic": 2000, "decision": 1000, "reason": 1000},
}
LIST_MOST = 200
OUTCOMES = ("success", "failure", "irrelevant")
ORIGINS = ("user_stated", "model_extracted", "doc_quoted", "retrieved_from_prior")


def _messages(items: Column, of: Callable[[Column, Column], list[Column]]) -> Column:
    """What is wrong with the items of a list: of(item, place) gives messages, or NULLs."""
    return F.array_compact(F.flatten(F.transform(F.coalesce(items, F.array()), lambda t, i: F.array(*of(t, i)))))


def payloads(raw: DataFrame, column: str = "value", predicates: list[str] | None = None, strict: bool = False) -> DataFrame:
    """raw with the parsed close payload p, errors, an array of what is wrong with it, and warnings, its predicates that aren't registered.

    Errors name the field, and in lists the place, from 0.  A field of another type than it should have, and one that payloads don't
    have, is an error; names that start with an underscore are remarks.  With strict, unregistered predicates are errors.
    """
    x = raw.withColumn("p", F.from_json(column, PAYLOAD))
    a = F.coalesce("p.assertions", F.array())
    checks = [
        F.when(F.col("p").isNull() | F.col("p.session_id").isNull(), "session_id is missing"),
        F.when(F.exists(a, lambda t: t["subject"].isNull() | t["predicate"].isNull() | t["object"].isNull()), "an assertion is incomplete"),
        F.when(F.exists(a, lambda t: ~F.coalesce(t["confidence"], F.lit(5.0)).between(1, 10)), "a confidence is out of range"),
        F.when(F.exists(F.coalesce("p.edges", F.array()), lambda t: t["from_entity"].isNull() | t["edge_type"].isNull() | t["to_entity"].isNull()), "an edge is incomplete"),
    ]
    p = lambda c: F.col(f"p.{c}")
    at = lambda name, i, *rest: F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("]"), *map(F.lit, rest))
    checks += [F.when(F.length(p(c)) > most, f"{c} is too long") for c, most in TEXT_MOST.items()]
    checks += [F.when(F.size(p(c)) > LIST_MOST, f"{c} has too many items") for c in (*THREADS_MOST, *ITEMS_MOST)]
    checks.append(F.when(~p("retrieval_outcome").isin(*OUTCOMES), "retrieval_outcome is unknown"))
    whole = F.try_parse_json(column)
    kind_of = lambda c: F.schema_of_variant(F.try_variant_get(whole, f"$.{c}", "variant"))
    checks += [F.when(~kind_of(c).startswith(kind) & (kind_of(c) != "VOID"), f"{c} has the wrong type") for c, kind in KINDS.items()]
    names = F.filter(F.coalesce(F.json_object_keys(column), F.array()), lambda n: ~n.startswith("_") & ~n.isin(*KINDS))
    extra = F.transform(names, lambda n: F.concat(n, F.lit(" is not a field of a payload")))
    lists = [extra, *(_messages(p(c), lambda t, i, c=c: [F.when(t.isNull(), at(c, i, " is no text"))]) for c in THREADS_MOST)]
    lists += [_messages(p(c), lambda t, i, c=c, most=most: [F.when(F.length(t) > most, at(c, i, " is too long"))]) for c, most in THREADS_MOST.items()]
    for c, fields in ITEMS_MOST.items():
        size = F.octet_length if c == "decisions" else F.length
        lists.append(_messages(p(c), lambda t, i, c=c, fields=fields, size=size: [F.when(size(t[f]) > most, at(c, i, f".{f} is too long")) for f, most in fields.items()]))
    lists.append(_messages(p("entities"), lambda t, i: [F.when(t["name"].isNull() | t["entity_type"].isNull(), at("entities", i, " is incomplete"))]))
    lists.append(_messages(p("assertions"), lambda t, i: [F.when(~t["source"].isin(*ORIGINS), at("assertions", i, ".source is unknown"))]))
    unknown = F.array().cast("array<string>")
    if predicates is not None:
        unknown = _messages(p("assertions"), lambda t, i: [F.when(~t["predicate"].isin(*predicates), F.concat(at("assertions", i, ".predicate is not registered: "), t["predicate"]))])
    errors = F.concat(F.array_compact(F.array(*checks)), *lists, *([unknown] if strict else []))
    return x.withColumn("errors", errors).withColumn("warnings", F.array().cast("array<string>") if strict else unknown)


def columns_of(df: DataFrame) -> DataFrame:
    """ordinal, column_name, data_type of a table."""
    return df.sparkSession.createDataFrame([(i, n, t) for i, (n, t) in enumerate(df.dtypes)], "ordinal int, column_name string, data_type string")


def missing_columns(df: DataFrame, expected: dict[str, str]) -> list[str]:
    """What a table lacks of what is expected: names, and name:type where the type differs."""
    have = dict(df.dtypes)
    return [n if n not in have else f"{n}:{have[n]}" for n, t in expected.items() if have.get(n) != t]
