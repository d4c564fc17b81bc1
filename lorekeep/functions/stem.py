"""Porter's stemmer (1980) as a column expression, and the same rules as DuckDB SQL.

A step is a list of rules (ending, what replaces it, what the rest must match, what it must not match): the first rule whose ending
the word has decides, whether or not its conditions hold.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
ONCE = f"^({_C})?{_V}{_C}"  # a vowel group followed by a consonant group
TWICE = f"^({_C})?{_V}{_C}{_V}{_C}"
JUST_ONCE = f"^({_C})?{_V}{_C}({_V})?$"
VOWEL = f"^({_C})?[aeiouy]"
SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"  # consonants, a vowel, a consonant
ION = f"^({_C})?{_V}{_C}{_V}.*[st]$"
BEFORE_LL = f"^({_C})?{_V}{_C}{_V}"
CUT = "~"  # marks a word whose -ed or -ing has just gone; no word has it

# Porter's published endings: fixed values.
DOUBLE_ENDINGS = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
LONG_ENDINGS = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
LAST_ENDINGS = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

Rule = tuple[str, str, str | None, str | None]


def _longest(rules: list[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: -len(r[0]))


STEPS: list[list[Rule]] = [
    [("sses", "ss", None, None), ("ies", "i", None, None), ("ss", "ss", None, None), ("s", "", None, None)],
    [("eed", "ee", ONCE, None), ("ing", CUT, VOWEL, None), ("ed", CUT, VOWEL, None)],
    [("at" + CUT, "ate", None, None), ("bl" + CUT, "ble", None, None), ("iz" + CUT, "ize", None, None), *[(c * 2 + CUT, c, None, None) for c in "bcdfghjkmnpqrtvwx"]],
    [(CUT, "e", SHORT, None)],
    [(CUT, "", None, None)],
    [("y", "i", VOWEL, None)],
    _longest([(a, b, ONCE, None) for a, b in DOUBLE_ENDINGS]),
    _longest([(a, b, ONCE, None) for a, b in LONG_ENDINGS]),
    _longest([(a, "", TWICE, None) for a in LAST_ENDINGS] + [("ion", "", ION, None)]),
    [("e", "", TWICE, None)],
    [("e", "", JUST_ONCE, SHORT)],
    [("ll", "l", BEFORE_LL, None)],
]
SHORTEST = 3  # shorter words are their own stems


def stem(word: str) -> str:
    """A word's stem, for the few words of a query."""
    if len(word) < SHORTEST:
        return word
    for rules in STEPS:
        for ending, other, need, bar in rules:
            if word.endswith(ending):
                rest = word[: len(word) - len(ending)]
                if (need is None or re.search(need, rest)) and not (bar and re.search(bar, rest)):
                    word = rest + other
                break
    return word


def _step(rules: list[Rule]) -> Callable[[Column], Column]:
    def step(w: Column) -> Column:
        out = None
        for ending, other, need, bar in rules:
            rest = F.left(w, F.length(w) - len(ending))
            to = F.concat(rest, F.lit(other))
            if need or bar:
                fits = rest.rlike(need) if need else F.lit(True)
                to = F.when(fits & ~rest.rlike(bar) if bar else fits, to).otherwise(w)
            hit = F.endswith(w, F.lit(ending))
            out = F.when(hit, to) if out is None else out.when(hit, to)
        return out.otherwise(w)

    return step


def stem_of(word: Column) -> Column:
    """The stem of a lower-case word; NULL stays.

    Each step is a function of its word, applied to an array of one: so a step's result is computed once, and filters on stems stay small.
    """
    x = F.array(word)
    for rules in STEPS:
        x = F.transform(x, _step(rules))
    return F.when(F.length(word) < SHORTEST, word).otherwise(F.get(x, F.lit(0)))


def stem_sql(words: str, last: str = "stems") -> str:
    """Common table expressions that end in ``last`` (word, stem) of a table ``words`` (word)."""
    parts = [f"stem_0 AS (SELECT DISTINCT word, word AS w FROM {words})"]
    for k, rules in enumerate(STEPS):
        cases = []
        for ending, other, need, bar in rules:
            rest = f"left(w, length(w) - {len(ending)})"
            fits = " AND ".join(([f"regexp_matches({rest}, '{need}')"] if need else []) + ([f"NOT regexp_matches({rest}, '{bar}')"] if bar else []))
            to = f"{rest} || '{other}'"
            cases.append(f"WHEN suffix(w, '{ending}') THEN " + (f"CASE WHEN {fits} THEN {to} ELSE w END" if fits else to))
        parts.append(f"stem_{k + 1} AS (SELECT word, CASE {' '.join(cases)} ELSE w END AS w FROM stem_{k})")
    return ",\n".join(parts) + f",\n{last} AS (SELECT word, CASE WHEN length(word) < {SHORTEST} THEN word ELSE w END AS stem FROM stem_{len(STEPS)})"
