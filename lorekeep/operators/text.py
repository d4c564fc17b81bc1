"""Chunks, sections, links, markers, secrets and status words of texts."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CEILING, OVERLAP = 1400, 0.14
_HEADING = re.compile(r"(?m)^(?=#{1,6} )")
_SENTENCE = re.compile(r"[.!?](?=\s+[A-Z])")
_FENCE = re.compile(r"(?m)^```.*$")
_CHUNKS = "chunk_idx int, content string"


def _cut(text: str, ceiling: int, tool_result: bool) -> tuple[int, bool]:
    """(where to cut, is it a hard cut) the first ceiling characters: after a closed fence, a paragraph, a sentence, or anywhere."""
    window = text[:ceiling]
    fences = list(_FENCE.finditer(window))
    if len(fences) > 1:
        return fences[len(fences) // 2 * 2 - 1].end() + 1, False
    at = window.rfind("\n\n")
    if at >= 0:
        return at + 2, False
    if not tool_result and (ends := [m.end() for m in _SENTENCE.finditer(window)]):
        return ends[-1], False
    return ceiling, True


def chunk_text(text: str | None, ceiling: int = CEILING, tool_result: bool = False) -> list[str]:
    """Chunks of at most about ``ceiling`` characters: headings always begin one; hard cuts repeat 14 % of the chunk before."""
    out = []
    for section in filter(None, _HEADING.split(text or "")):
        rest = section.removesuffix("\n") if section is not section.rstrip("\n") else section
        while rest:
            if len(rest) <= ceiling:
                out.append(rest)
                break
            at, hard = _cut(rest, ceiling, tool_result)
            out.append(rest[:at])
            rest = (rest[at - int(ceiling * OVERLAP) : at] if hard else "") + rest[at:].lstrip("\n")
    return [c for x in out if (c := x.rstrip())]


def chunked(docs: DataFrame, key: str, text: str = "text", ceiling: int = CEILING, tool_result: bool = False) -> DataFrame:
    """key, chunk_idx, content of every chunk of every text; Arrow batches in, small batches out."""
    kind = dict(docs.dtypes)[key]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                rows = [(k, i, c) for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for i, c in enumerate(chunk_text(t, ceiling, tool_result))]
                cols = list(zip(*rows)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], part.schema.types[0]), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], names=[key, "chunk_idx", "content"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, {_CHUNKS}")


def sections(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, ord, level, number, title, content of a document's sections: split at headings outside fences; text before the first is (preamble)."""
    plain = F.regexp_replace(F.col(text), r"(?ms)^```.*?^```[^\n]*$", "")
    parts = F.split(plain, r"(?m)^(?=#{1,6} )")
    x = docs.select(key, F.posexplode(parts).alias("ord", "part")).filter(F.trim("part") != "")
    head = F.regexp_extract("part", r"^(#{1,6}) +([^\n]*)", 1)
    title = F.regexp_extract("part", r"^(#{1,6}) +([^\n]*)", 2)
    number = F.regexp_extract(title, r"^(\d+(?:\.\d+)*)", 1)
    return x.select(
        key, "ord", F.length(head).alias("level"), F.when(head == "", "0").otherwise(number).alias("number"),
        F.when(head == "", "(preamble)").otherwise(F.trim(title)).alias("title"), F.regexp_replace(F.when(head == "", F.col("part")).otherwise(F.regexp_replace("part", r"^[^\n]*\n?", "")), r"^\s+|\s+$", "").alias("content"),
    )


def wiki_links(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, target, anchor, alias of every [[target#anchor|alias]] outside code."""
    plain = F.regexp_replace(F.regexp_replace(F.col(text), r"(?s)```.*?```", ""), r"`[^`\n]*`", "")
    x = docs.select(key, F.explode(F.regexp_extract_all(plain, F.lit(r"\[\[([^\]\n]+)\]\]"), F.lit(1))).alias("link"))
    left = F.split_part("link", F.lit("|"), F.lit(1))
    part = lambda c: F.nullif(F.trim(c), F.lit(""))
    return x.select(key, part(F.split_part(left, F.lit("#"), F.lit(1))).alias("target"), part(F.split_part(left, F.lit("#"), F.lit(2))).alias("anchor"), part(F.split_part("link", F.lit("|"), F.lit(2))).alias("alias"))


def front_matter(text: Column, name: str) -> Column:
    """The value of a key in the lines between a text's leading --- marks; NULL without it."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)
    return F.nullif(F.trim(F.regexp_extract(block, rf"(?m)^{re.escape(name)}:[ \t]*(.*)$", 1)), F.lit(""))


def table_cells(line: Column) -> Column:
    """Cells of a Markdown table row, split at pipes that aren't escaped."""
    inner = F.regexp_replace(F.trim(line), r"^\||(?<!\\)\|$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|"))))


def cell_escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " ")


def status_of(cell: Column) -> Column:
    """closed, open or unknown by the words of a status cell; a cell that says both is unknown."""
    shut, open_ = cell.rlike(r"(?i)\b(done|closed|resolved|fixed|shipped|merged)\b"), cell.rlike(r"(?i)\b(open|todo|pending|blocked|in progress|wip)\b")
    return F.when(shut & ~open_, "closed").when(open_ & ~shut, "open").otherwise("unknown")


#: kind -> pattern of what must not leave the store
SECRETS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}",
    "uuid": r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b",
    "home_path": r"(?:/home/|/Users/|C:\\Users\\)[A-Za-z0-9._-]+",
    "connection": r"(?i)\b(?:postgres(?:ql)?|mysql|mongodb|redis)://[^\s:@/]+:[^\s@/]+@",
    "token": r"\b(?:sk|pk|ghp|xox[bp])[-_][A-Za-z0-9_-]{16,}",
}


DECODINGS = 5  # rounds of percent-decoding


#: kind -> strings of which a text with a match has one: looked for first
_SECRET_SIGNS = {"email": ("@",), "uuid": ("-",), "home_path": ("/home/", "/Users/", "C:\\Users\\"), "connection": ("://",), "token": ("sk", "pk", "ghp", "xox")}


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once, however often use has it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _every_form(raw: Column) -> Column:
    """A text, its decoded forms if it has percent or plus signs, and its decoded base64 runs, as lines."""
    decoded_once = lambda v, _: F.coalesce(F.try_url_decode(F.replace(v, F.lit("+"), F.lit("%2B"))), v)
    spaced = lambda v: F.replace(v, F.lit("+"), F.lit(" "))
    percent = F.aggregate(F.sequence(F.lit(1), F.lit(DECODINGS)), raw, decoded_once)
    whole = _once(percent, lambda p: F.concat_ws("\n", raw, p, F.coalesce(F.try_url_decode(raw), raw), spaced(p)))
    plain = F.when(F.contains(raw, F.lit("%")), whole).when(F.contains(raw, F.lit("+")), F.concat_ws("\n", raw, spaced(raw))).otherwise(raw)
    runs = F.regexp_extract_all(raw, F.lit(r"\b[A-Za-z0-9+/]{24,}={0,2}"), F.lit(0))
    decoded = F.array_join(F.transform(runs, lambda r: F.coalesce(F.try_validate_utf8(F.try_to_binary(r, F.lit("base64")).cast("string")), F.lit(""))), "\n")
    return F.concat_ws("\n", plain, F.nullif(decoded, F.lit("")))


def secret_kinds(text: Column) -> Column:
    """Kinds of secrets in a text, as it is, percent-decoded up to DECODINGS times, with plus signs as spaces too, or in base64 runs, sorted."""

    def kinds(every: Column) -> Column:
        sign = lambda k: reduce(lambda a, b: a | b, [F.contains(every, F.lit(x)) for x in _SECRET_SIGNS[k]])
        return F.array_compact(F.array(*[F.when(sign(k) & every.rlike(p), F.lit(k)) for k, p in sorted(SECRETS.items())]))

    return _once(_once(F.coalesce(text, F.lit("")), _every_form), kinds)


# fixed values: the words that count as function words
FUNCTION_WORDS = (
    "a", "an", "the",
    "is", "are", "was", "were", "be", "been", "being",
    "of", "to", "in", "for", "and", "or", "but",
    "with", "that", "this", "it", "as", "at", "on", "by",
    "we", "he", "she", "they", "i",
    "have", "has", "had", "do", "does", "did",
    "if", "so", "its", "our",
    "from", "also", "about", "after", "where", "which", "who",
    "there", "when", "than", "into", "up",
)


def _any_of(words: Iterable[str]) -> str:
    """A pattern of exactly these words that reads each letter once: words of one first letter share it."""
    tails: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        tails.setdefault(w[:1], []).append(w[1:])
    last = tails.pop("", None) is not None
    each = [first + _any_of(rest) for first, rest in tails.items()]
    return f"(?:{'|'.join(each)}){'?' if last else ''}" if each else ""


_WORD = "[a-z0-9']"
_FUNCTION_WORD = f"(?<!{_WORD}){_any_of(FUNCTION_WORDS)}(?!{_WORD})"


def function_word_ratio(text: Column) -> Column:
    """Share of function words among a text's words; 0 without words.  Words are counted by patterns, which Spark compiles, not cut out one by one."""
    low = F.lower(text)
    n = F.regexp_count(low, F.lit(f"{_WORD}+"))
    return F.when(n > 0, F.regexp_count(low, F.lit(_FUNCTION_WORD)) / n).otherwise(0.0)


# fixed values: the families of tokens that carry a text's load; word ends are those of ASCII
LOAD_BEARING = {
    "sha_hex": r"(?i)(?<![A-Za-z0-9_])[0-9a-f]{7,40}(?![A-Za-z0-9_])",
    "file_line": r"(?<![A-Za-z0-9_])[A-Za-z0-9_.-]+\.[A-Za-z0-9]+:[0-9]+(?![A-Za-z0-9_])",
    "file_path": r"(?:[A-Za-z]:[\\/])?(?:[A-Za-z0-9_.-]+[\\/])+[A-Za-z0-9_.-]+\.[A-Za-z0-9]+(?::[0-9]+)?",
    "pr_ref": r"(?i)(?<![A-Za-z0-9_])PR\s*#[0-9]+(?![A-Za-z0-9_])",
    "issue_ref": r"(?<![A-Za-z0-9_])#[0-9]+(?![A-Za-z0-9_])",
    "iso_date": r"(?<![A-Za-z0-9_])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![A-Za-z0-9_])",
    "url": r"(?<![A-Za-z0-9_])https?://[^\s)\"'`]+",
    "quoted": r"\"[^\"\n]{2,}\"|'[^'\n]{2,}'|`[^`\n]{2,}`",
    "number": r"(?<![A-Za-z0-9_])[0-9]+(?:\.[0-9]+)*(?![A-Za-z0-9_])",
    "negation": r"(?i)(?<![A-Za-z0-9_])(?:not|no|never)(?![A-Za-z0-9_])|n't(?![A-Za-z0-9_])",
}
# fixed values: what a text that was cut off ends in
_ENDED = r"[.!?)\]]\s*$"


def load_bearing(text: Column) -> Column:
    """Distinct tokens of all families of LOAD_BEARING, by where they first stand in the text, the longer first of those that start together."""
    t = F.coalesce(text, F.lit(""))
    every = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in LOAD_BEARING.values()])))
    placed = F.array_sort(F.transform(every, lambda w: F.struct(F.position(w, t).alias("at"), (-F.length(w)).alias("size"), w.alias("w"))))
    return F.transform(placed, lambda x: x["w"])


def truncation_smells(text: Column) -> Column:
    """Names of the ways in which a text looks cut off, in a fixed order; a NULL text has none."""
    t = F.coalesce(text, F.lit(""))
    odd = lambda q: F.pmod(F.length(t) - F.length(F.replace(t, F.lit(q), F.lit(""))), F.lit(2)) == 1
    whole_path = F.lit(False)
    for name in ("file_path", "file_line"):
        whole_path = whole_path | t.rlike(LOAD_BEARING[name])
    smells = {
        "dangling_quote": ~t.rlike(_ENDED) & (odd('"') | odd("`")),
        "dangling_pr_ref": t.rlike(r"(?i)PR\s*#\s*$"),
        "dangling_path": ~t.rlike(_ENDED) & t.rlike(r"(?:[\\/][A-Za-z0-9_-]+){2,}$") & whole_path,
        "dangling_url": t.rlike(r"https?://[A-Za-z0-9_-]*$"),
        "dangling_sha": t.rlike(r"(?i)(?:sha|commit)[:\s]+[0-9a-f]{1,6}$"),
        "dangling_date": t.rlike(r"(?<![A-Za-z0-9_])[0-9]{4}-(?:[0-9]{2})?-?$"),
    }
    return F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in smells.items()]))


JSON_MOST = 1_000_000  # characters of an object that is looked at
JSON_DEEP = 100  # braces and brackets inside each other
_JSON_PART = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]', re.S)


def _json_object(reply: str | None) -> str | None:
    """The first balanced object of a text, if it is valid JSON."""
    at = -1 if reply is None else reply.find("{")
    if at < 0:
        return None
    open_ = []
    for m in _JSON_PART.finditer(reply, at, at + JSON_MOST):
        if m[0] in "{[":
            open_.append(m[0])
            if len(open_) > JSON_DEEP:
                return None
        elif m[0] in "}]":
            if not open_ or open_.pop() != {"}": "{", "]": "["}[m[0]]:
                return None
            if not open_:
                found = reply[at : m.end()]
                try:
                    json.loads(found, parse_constant=_refused)
                except ValueError:
                    return None
                return found
    return None


def _refused(name: str) -> None:
    raise ValueError(name)


def json_of_reply(reply: Column) -> Column:
    """The first JSON object in a model's reply, whatever stands before and after it; NULL without a valid one.

    Braces in strings don't count, escapes are known; objects of more than JSON_MOST characters or JSON_DEEP levels are NULL.
    """

    @F.pandas_udf("string")
    def scan(replies: pd.Series) -> pd.Series:
        return replies.map(_json_object)

    return scan(reply)


EXTRACTION = "struct<entities:array<struct<name:string,entity_type:string,description:string>>,assertions:array<struct<subject:string,predicate:string,object:string,confidence:double>>,edges:array<struct<from_entity:string,edge_type:string,to_entity:string,weight:double>>>"


def extracted(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """replies with the parsed extraction; NULL of what can't be parsed."""
    return replies.withColumn("extraction", F.from_json(json_of_reply(F.col(reply)), EXTRACTION))


def marker_counts(raw: DataFrame, column: str = "raw") -> DataFrame:
    """owner, dropped, coerced: of the elements of a marker list, those without a text as their time, and of the others those whose session is there but no name."""
    each = F.coalesce(F.try_variant_get(F.try_parse_json(column), "$", "array<variant>"), F.array().cast("array<variant>"))
    kind = lambda e, name: F.coalesce(F.schema_of_variant(F.try_variant_get(e, f"$.{name}", "variant")), F.lit("VOID"))
    timed = F.filter(each, lambda e: kind(e, "ts") == "STRING")
    odd = F.filter(timed, lambda e: (kind(e, "session_id") != "VOID") & ((kind(e, "session_id") != "STRING") | (F.try_variant_get(e, "$.session_id", "string") == "")))
    return raw.select("owner", (F.size(each) - F.size(timed)).alias("dropped"), F.size(odd).alias("coerced"))


def markers(raw: DataFrame, column: str = "raw") -> DataFrame:
    """owner, ord, session_id, host, ts of session markers: a JSON array, or a bare string as its only time; elements without a time go."""
    is_list = F.col(column).rlike(r"\A\s*\[") & F.try_parse_json(column).isNotNull()
    other = F.try_parse_json(column).isNotNull()
    listed = F.from_json(column, "array<struct<session_id:string,host:string,ts:string>>")
    legacy = F.array(F.struct(F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("string").alias("host"), F.col(column).alias("ts")))
    each = F.when(is_list, listed).when(F.col(column).isNull() | (F.col(column) == "") | other, F.lit(None)).otherwise(legacy)
    x = raw.select("owner", F.posexplode(each).alias("ord", "m")).select("owner", "ord", F.nullif("m.session_id", F.lit("")).alias("session_id"), "m.host", "m.ts")
    return x.filter("ts is not null")
