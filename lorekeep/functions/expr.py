"""Column expressions shared by the operators: JVM-side built-ins, but for the composed form of texts (``nfc``)."""

from __future__ import annotations

from unicodedata import normalize

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that never count in full-text ranking; fixed values.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "with")
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
TIERS = ("low", "mid", "high")


def live() -> Column:
    """A fact that is neither suppressed nor superseded."""
    return ~F.col("suppressed") & F.col("invalid_at").isNull()


def not_pinned() -> Column:
    return ~F.coalesce(F.col("pinned"), F.lit(False))


def micros_of(t: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone (UTC)."""
    return F.unix_micros(t.cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Fractional seconds, to the microsecond."""
    return (micros_of(later) - micros_of(earlier)) / F.lit(1e6)


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days, to the microsecond."""
    return (micros_of(later) - micros_of(earlier)) / F.lit(86400e6)


def decayed(as_of: Column) -> Column:
    """Confidence aged exponentially since the last reinforcement; it ranks, and never excludes."""
    return F.col("confidence") * F.exp(-F.col("decay_rate") * days_between(as_of, F.col("last_reinforced")))


def tier_rank(tier: Column) -> Column:
    """0 for consolidated facts and those older than tiers (NULL), 1 for probationary ones."""
    return F.when(tier == "probationary", 1).otherwise(0)


def severity_rank(severity: Column) -> Column:
    """Place in SEVERITIES, others last."""
    out = F.lit(len(SEVERITIES) + 1)
    for k, s in enumerate(SEVERITIES):
        out = F.when(F.upper(severity) == s, k + 1).otherwise(out)
    return out


def capability_rank(tier: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TIERS)), tier).cast("int")


def day_bucket(t: Column) -> Column:
    """UTC day as text."""
    return F.date_format(t, "yyyy-MM-dd")


def token_estimate(text: Column) -> Column:
    """About one token for four characters."""
    return F.ceil(F.length(text) / 4).cast("long")


def cost_of(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    """Cost at rates per million tokens, to six places; NULL if a rate is unknown."""
    return F.round((F.coalesce(tokens_in, F.lit(0)) * rate_in + F.coalesce(tokens_out, F.lit(0)) * rate_out) / 1e6, 6)


def collapse(text: Column) -> Column:
    """White space trimmed and collapsed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def nfc(text: Column) -> Column:
    """Text in Unicode's composed form, in Arrow batches; NULL stays."""

    @F.arrow_udf("string")
    def composed(texts: pa.Array) -> pa.Array:
        return pa.array([t if t is None or t.isascii() else normalize("NFC", t) for t in texts.to_pylist()], pa.string())

    return composed(text)


def compare_key(text: Column) -> Column:
    """Text as compared: composed, trimmed, lower case, white space collapsed, closing punctuation off."""
    return F.regexp_replace(F.lower(collapse(nfc(F.coalesce(text, F.lit(""))))), r"[.!?;]+$", "")


def label_key(label: Column) -> Column:
    """A label as written to a registry: composed, trimmed, white space collapsed, its case kept; NULL stays."""
    return collapse(nfc(label))


def subject_key(subject: Column, aliases: dict[str, str] | None = None) -> Column:
    """Canonical subject: trimmed, lower case, collapsed, then through the alias map."""
    key = F.lower(collapse(subject))
    if not aliases:
        return key
    pairs = F.create_map(*[F.lit(x) for kv in sorted(aliases.items()) for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), key)


KEY_BYTES = 1000


def intent_key(text: Column) -> Column:
    """``KEY`` of "KEY: rest" (a colon in the first 60 characters, followed by a space); otherwise the collapsed text,
    cut at a word to KEY_BYTES bytes with a digest of the whole text if it is longer."""
    t = collapse(F.coalesce(text, F.lit("")))
    at = F.instr(t, ":")
    digest = F.concat(F.lit(" …#"), F.substring(F.sha2(t, 256), 1, 8))
    room = KEY_BYTES - 13
    # the longest prefix of at most ``room`` bytes: at most ``room`` characters, less what their bytes exceed it by
    chars = F.aggregate(
        F.transform(F.split(F.substring(t, 1, room), ""), lambda c: F.octet_length(c)),
        F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("n")),
        lambda acc, b: F.when(acc["bytes"] + b <= room, F.struct((acc["bytes"] + b).alias("bytes"), (acc["n"] + 1).alias("n"))).otherwise(F.struct(F.lit(1 << 30).alias("bytes"), acc["n"].alias("n"))),
        lambda acc: acc["n"],
    )
    cut = F.left(t, chars)
    cut = F.rtrim(F.when(F.instr(cut, " ") > 0, F.regexp_replace(cut, r" [^ ]*$", "")).otherwise(cut))
    capped = F.when(F.octet_length(t) <= KEY_BYTES, t).otherwise(F.concat(cut, digest))
    return F.when((at > 1) & (at <= 60) & (F.substring(t, at + 1, F.lit(1)) == " "), F.trim(F.left(t, at - 1))).otherwise(capped)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; NULL if one is NULL, empty or zero, or their sizes differ."""
    sizes = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (sizes > 0), dot(a, b) / sizes)


def lexemes(text: Column) -> Column:
    """Lower-case alphanumeric words that aren't stop words."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def query_terms(query: str) -> list[str]:
    """Distinct lexemes of a query, in order."""
    import re

    return list(dict.fromkeys(w for w in re.findall("[a-z0-9]+", query.lower()) if w not in STOP_WORDS))


def text_rank(text: Column, query: str) -> Column:
    """Mean of tf / (tf + 1) over a query's terms; 0 unless all of them occur.  A query without terms ranks all 0."""
    terms = query_terms(query)
    if not terms:
        return F.lit(0.0)
    low = F.lower(F.coalesce(text, F.lit("")))
    tfs = [F.regexp_count(low, F.lit(f"(?<![a-z0-9]){t}(?![a-z0-9])")) for t in terms]
    total, every = F.lit(0.0), F.lit(True)
    for tf in tfs:
        total, every = total + tf / (tf + 1), every & (tf > 0)
    return F.when(every, total / len(terms)).otherwise(0.0)


def trigrams(text: Column) -> Column:
    """Distinct 3-grams of the text's alphanumeric words, each with two blanks before it and one after."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Shared share of two sets of trigrams; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every > 0, both / every).otherwise(0.0)


def row_hash(*cols: str) -> Column:
    """Digest of a row's values as text, NULLs told apart from any text."""
    return F.md5(F.to_json(F.array(*[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("NULL")) for c in cols])))


def entity_shaped(text: Column) -> Column:
    """One to four words, no closing punctuation of a sentence, and not just a number."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return words.between(1, 4) & ~text.rlike(r"[.?!]$") & ~text.rlike(r"^-?\d+(\.\d+)?$")
