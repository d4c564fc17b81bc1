"""8. Personal data, with DataFrame functions only.

Regular expressions propose spans, checksum and range validators confirm them, and words nearby
raise or lower a span's score.  The base kinds email, ip, card (Luhn) and phone stay whenever they are
confirmed; the others, iban (mod-97), ssn and secret, stay from a score of KEEP on, so that words
around them decide: a long key alone isn't kept, one behind "token =" is, and one behind "commit" isn't.

Positions come without Python: a text split at the matches of a pattern gives the pieces between
them, and running sums of the lengths of pieces and matches are the ends of the matches.  The sums go by
blocks, and a span's surroundings are read from chunks of the text, so that a text of very many
matches costs little more than in proportion to its length.  Quantifiers that need no
backtracking are possessive, so that long runs of one character cost linear time and no stack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind -> (pattern, cheap necessary pattern, words that raise the score, words that lower it, base score)
KINDS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@", r"mail|contact|write|reply", r"example", 0.8),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", r"\bip\b|host|server|address|login", r"version|release", 0.6),
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])", r"[0-9](?:[\x20-]?[0-9]){13}", r"card|visa|payment|credit", r"order|invoice|serial|isbn", 0.7),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", r"phone|tel|call|mobile|fax", r"order|invoice|serial", 0.6),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]", r"iban|bank|account|konto|transfer", r"example|sample|specimen|serial|part no", 0.75),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]{4}", r"\bssn\b|social security|taxpayer", r"order|invoice|serial|example", 0.55),
    "secret": (r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{24,128}+={0,2}+(?![A-Za-z0-9_+/=-])", r"[A-Za-z0-9_+/-]{24}", r"token|secret|passw|api.?key|bearer|auth|credential", r"commit|sha-?[0-9]|md5|digest|checksum|hash", 0.55),
}
BASE_KINDS = ("email", "ip", "card", "phone")
NEARBY = 40  # code points on either side of a span in which context words count
CHUNK = 64  # code points of a chunk of the text, from which surroundings are read
RAISE, LOWER = 0.2, 0.3
KEEP = 0.7
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_SPANS = "array<struct<start:int,ord:int,end:int,kind:string,score:double>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once, also where use reads it in a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sums_from(x: Column, start: Column) -> Column:
    """start, and start plus each running sum of x: for short arrays, as each step copies what it has."""
    return F.aggregate(x, F.array(start), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))


def running_sums(x: Column) -> Column:
    """Running sums of an array of n ints, by blocks of the root of n, so that n * sqrt(n) numbers are copied at most."""

    def of(x: Column) -> Column:
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x)))).cast("int")
        last = F.greatest(F.lit(0), F.ceil(F.size(x) / size).cast("int") - 1)
        blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(x, k * size + 1, size))
        total = lambda b: F.aggregate(b, F.lit(0), lambda acc, v: acc + v)
        before = lambda bs: _sums_from(F.transform(bs, total), F.lit(0))
        within = lambda b, s: F.slice(_sums_from(b, s), 2, F.size(b))
        return _let(blocks, lambda bs: F.flatten(F.zip_with(bs, F.slice(before(bs), 1, F.size(bs)), within)))

    return _let(x, of)


def _mod97(account: Column) -> Column:
    """Remainder mod 97 of an account number whose first four characters are moved behind and letters count from 10."""
    plain = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def step(acc: Column, ch: Column) -> Column:
        v = F.ascii(ch)
        v = F.when(v >= 65, v - 55).otherwise(v - 48)
        return F.pmod(acc * F.when(v >= 10, 100).otherwise(10) + v, F.lit(97))

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, ch: F.when(ch == "", acc).otherwise(step(acc, ch)))


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(m, " ", "")).between(15, 34) & (_mod97(m) == 1)
    if kind == "ssn":  # numbers that are never given out
        return ~m.rlike("^(?:000|666|9)|-00-|-0000$")
    if kind == "secret":
        return m.rlike("[0-9].*[0-9].*[0-9]") & m.rlike("[A-Za-z].*[A-Za-z].*[A-Za-z]")
    return F.lit(True)


def _around(chunks: Column, start: Column, end: Column) -> Column:
    """NEARBY code points before a span, a line feed, and as many after it, from the text's chunks."""
    a = F.greatest(start - NEARBY, F.lit(0))
    first = F.floor(a / CHUNK).cast("int")
    last = F.floor((end + NEARBY) / CHUNK).cast("int")
    near = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")
    return _let(near, lambda x: F.concat(x.substr(a - first * CHUNK + 1, start - a), F.lit("\n"), x.substr(end - first * CHUNK + 1, F.lit(NEARBY))))


def _spans(text: Column, kind: str) -> Column:
    """Confirmed spans of a kind: array of (start, ord, end, kind, score)."""
    pattern, needs, better, worse, base = KINDS[kind]
    order = list(KINDS).index(kind)
    none = F.array().cast(_SPANS)

    def placed(found: Column) -> Column:
        pieces = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        ends = running_sums(F.zip_with(pieces, found, lambda g, m: F.length(g) + F.length(m)))
        spans = F.zip_with(found, ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("m")))
        return F.filter(spans, lambda x: _valid(kind, x["m"]))

    def scored(chunks: Column, spans: Column) -> Column:
        def one(x: Column) -> Column:
            def score(near: Column) -> Column:
                up = F.when(near.rlike(f"(?i){better}"), RAISE).otherwise(0.0)
                down = F.when(near.rlike(f"(?i){worse}"), LOWER).otherwise(0.0)
                return F.round(F.lit(base) + up - down, 2)

            s = _let(_around(chunks, x["start"], x["end"]), score)
            return F.struct(x["start"].alias("start"), F.lit(order).alias("ord"), x["end"].alias("end"), F.lit(kind).alias("kind"), s.alias("score"))

        out = F.transform(spans, one)
        return out if kind in BASE_KINDS else F.filter(out, lambda x: x["score"] >= KEEP)

    def whole(spans: Column) -> Column:
        chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
        return F.when(F.size(spans) > 0, _let(chunks, lambda c: scored(c, spans))).otherwise(none)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    some = _let(found, lambda f: F.when(F.size(f) > 0, _let(placed(f), whole)).otherwise(none))
    return F.when(text.rlike(needs), some).otherwise(none)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and pii, an array of (start, ord, end, kind, score) by start, then kind, for every row of docs (doc_id, text).

    Offsets are code points, end exclusive.  A null text counts as empty and, like any text without
    personal data, has an empty array.  Repeated rows each give a row; an empty table gives none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    per_kind = docs.select("doc_id", *[_spans(text, k).alias(k) for k in KINDS])
    return per_kind.select("doc_id", F.sort_array(F.concat(*KINDS)).alias("pii"))


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and their scores; n_other counts spans of other kinds."""
    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    said = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    base = F.filter("pii", lambda x: x["kind"].isin(*BASE_KINDS))
    return find_pii(docs).select(
        F.col("doc_id"),
        *map(count, BASE_KINDS),
        F.sha2(F.array_join(F.transform(base, said), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("pii", said), ",").alias("spans"),
        F.array_join(F.transform("pii", lambda x: x["score"].cast("string")), ",").alias("scores"),
        F.size(F.filter("pii", lambda x: ~x["kind"].isin(*BASE_KINDS))).cast("long").alias("n_other"),
    )
