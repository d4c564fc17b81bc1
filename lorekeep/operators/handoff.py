"""Hand-off files in Markdown: sections, threads, facts and references of whole texts, in one Arrow pass.

Lines are read once by a machine that knows fences, comments, quotes, headings, tables and lists.  It gives typed rows; what they
mean for a store (``threads``, ``facts``, ``flags``) are filters on these.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the words of a status cell, the names of a table's columns, dashes that separate and dashes that are only reported
CLOSED_WORDS = ("DONE", "MERGED", "SHIPPED", "SOLVED", "RESOLVED", "COMPLETE", "COMPLETED", "FIXED")
OPEN_WORDS = ("OPEN", "NOT RUN", "NOT BUILT", "UNEXERCISED", "PENDING", "BLOCKED", "TODO", "DEFERRED", "OWNER-GATED")
CLOSED_MARKS, OPEN_MARKS = ("✅",), ("❌", "⏳")
COLUMN_NAMES = {"item": ("item", "subject", "thread", "carry-over", "carryover"), "status": ("status", "state"), "notes": ("notes", "note", "detail", "details")}
ODD_DASHES = "‐‑‒―﹘﹣⸺⸻⁓−"
DURABLE = {"quick references": "quick_reference", "decisions": "decision"}

_DASH = r"\s+(?:--|[—–-])\s+"
_DATED = re.compile(rf"session\s+(\d{{4}}-\d\d-\d\d)\s*(?:\([^)]*\))?{_DASH}(.+)", re.I)
_NUMBERED = re.compile(rf"session\s+(\d+){_DASH}(.+?){_DASH}(.+)", re.I)
_NEXT = re.compile(r"next\s+session(?:\s*\([^)]*\))?", re.I)
_CARRY = re.compile(r"open\s+carry-?overs(?:\s*(?:\(.*\)|(?:--|[—–-]).*))?", re.I)
_FENCE, _HEADING = re.compile(r"(`{3,}|~{3,})"), re.compile(r"(#{1,6})\s+(.*)")
_RULE = re.compile(r"\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?")
_ITEM = re.compile(r"(?:[-*+]|\d+[.)])\s+(?:\[[ xX]\]\s+)?(.*)")
_LINK = re.compile(r"\[([^\]\n]*)\]\(([^)\s]+)\)")
_PIPE = re.compile(r"(?<!\\)\|")
ROWS = pa.schema([("kind", pa.string()), ("line", pa.int64()), ("section", pa.int64()), ("name", pa.string()), ("value", pa.string()), ("status", pa.string()), ("notes", pa.string())])


def _words(words: tuple[str, ...], marks: tuple[str, ...], text: Column) -> Column:
    return text.rlike(r"(?i)(?<![\w-])(?:" + "|".join(map(re.escape, words)) + r")(?![\w-])|" + "|".join(marks))


def status_class(cell: Column) -> Column:
    """closed, open or unknown by the words and marks of a cell; one that says both is unknown."""
    shut, still = _words(CLOSED_WORDS, CLOSED_MARKS, cell), _words(OPEN_WORDS, OPEN_MARKS, cell)
    return F.when(shut & ~still, "closed").when(still & ~shut, "open").otherwise("unknown")


def _cells(line: str) -> list[str]:
    parts = _PIPE.split(line.strip())
    parts = parts[1:] if parts and not parts[0].strip() else parts
    parts = parts[:-1] if len(parts) > 1 and not parts[-1].strip() else parts
    return [p.strip().replace("\\|", "|") for p in parts]


class _Reader:
    """The machine: one file's lines to rows (kind, line, section, name, value, status, notes)."""

    def __init__(self, durable: dict[str, str]):
        self.durable = durable

    def read(self, text: str | None) -> list[tuple]:
        self.rows, self.section, self.predicate, self.list_kind, self.table = [], None, None, None, None
        self.body: list[str] = []
        lines = [x.rstrip(" \t") for x in (text or "").removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n").split("\n")]
        fence, fence_line, comment = None, 0, False
        for n, line in enumerate(lines, 1):
            for c in line:
                if c in ODD_DASHES or c == "﻿":
                    self.say("flag", n, "stray-mark" if c == "﻿" else "odd-dash", c)
            bare = line.strip()
            mark = _FENCE.match(bare)
            if mark and fence in (None, mark[1][0]) and not comment:
                fence, fence_line = (mark[1][0], n) if fence is None else (None, 0)
                self.plain(n, line, "")
                continue
            if fence:
                self.plain(n, line, "")
                continue
            visible, comment = self.uncommented(line, comment)
            if bare.startswith(">"):
                self.plain(n, line, "")
            elif heading := _HEADING.match(visible.strip()):
                self.heading(n, len(heading[1]), " ".join(heading[2].split()))
            else:
                self.plain(n, line, visible, lines[n] if n < len(lines) else "")
        if fence:
            self.say("flag", fence_line, "unclosed-fence", fence)
        self.close()
        return self.rows

    def say(self, kind, line, name=None, value=None, status=None, notes=None):
        self.rows.append((kind, line, self.section, name, value, status, notes))

    @staticmethod
    def uncommented(line: str, inside: bool) -> tuple[str, bool]:
        out, at = [], 0
        while at < len(line):
            end = line.find("-->" if inside else "<!--", at)
            stop = len(line) if end < 0 else end
            if not inside:
                out.append(line[at:stop])
            if end < 0:
                break
            at, inside = end + (3 if inside else 4), not inside
        return "".join(out), inside

    def close(self):
        """End a section that is a fact."""
        self.item = None
        if self.predicate:
            said = "\n".join(self.body).strip("\n")
            if said.strip():
                self.say("fact", self.section, self.predicate, said)
        self.predicate, self.body = None, []

    def heading(self, n: int, level: int, title: str):
        self.table = self.list_kind = None
        if level == 3 and _CARRY.fullmatch(title):
            self.item, self.table = None, {"columns": None, "ended": False}
            return
        if level == 3 and "carry" in title.lower() and "over" in title.lower():
            self.say("flag", n, "carry-over-variant", title)
        if level > 2:
            if self.predicate:
                self.body.append(title)
            return
        self.close()
        self.section = n
        if level == 1:
            self.say("section", n, "title", title)
        elif predicate := self.durable.get(title.lower()):
            self.say("section", n, predicate, title)
            self.predicate = predicate
        elif m := _DATED.fullmatch(title):
            self.say("section", n, "session", m[2].strip(), None, m[1])
            self.predicate = "session_tldr"
        elif m := _NUMBERED.fullmatch(title):
            self.say("section", n, "session", m[3].strip(), None, m[2].strip())
            self.predicate = "session_tldr"
        elif _NEXT.fullmatch(title):
            self.say("section", n, "next_session", title)
            self.list_kind = "next"
        else:
            self.say("section", n, "other", title)
            if "session" in title.lower():
                self.say("flag", n, "session-shaped", title)

    def plain(self, n: int, line: str, visible: str, after: str = ""):
        """A line that is no heading; visible is empty in fences and quotes."""
        for label, target in _LINK.findall(visible):
            self.say("reference", n, label, target)
        if self.table is not None:
            self.row(n, visible, after)
            return
        if self.predicate:
            self.body.append(line)
        elif self.list_kind and visible.strip():
            nested = visible[0] in " \t"
            m = _ITEM.fullmatch(visible.strip())
            if m and not nested:
                self.item = len(self.rows)
                self.say("thread", n, "next", m[1].strip(), "")
            elif nested and self.item is not None:
                old = self.rows[self.item]
                self.rows[self.item] = (*old[:4], f"{old[4]} {m[1] if m else visible.strip()}".strip(), *old[5:])

    def row(self, n: int, visible: str, after: str):
        t, bare = self.table, visible.strip()
        if not bare:
            t["ended"] = t["ended"] or t["columns"] is not None
            return
        if "|" not in bare:
            return
        if t["ended"]:
            self.say("flag", n, "orphan-row", bare)
            return
        if _RULE.fullmatch(bare):
            return
        cells = _cells(bare)
        if t["columns"] is None:
            if _RULE.fullmatch(after.strip() or "x"):
                roles = [next((r for r, names in COLUMN_NAMES.items() if c.lower() in names), None) for c in cells]
                t["columns"] = roles
                if "item" not in roles:
                    self.say("flag", n, "no-item-column", bare)
                return
            t["columns"] = ["item", *["notes"] * (len(cells) - 1)]
        roles = t["columns"]
        if "item" not in roles:
            return
        if len(cells) != len(roles):
            self.say("flag", n, "uneven-row", bare)
            return
        item, status = cells[roles.index("item")], cells[roles.index("status")] if "status" in roles else ""
        rest = [c for k, c in enumerate(cells) if c and k != roles.index("item") and not ("status" in roles and k == roles.index("status"))]
        self.say("thread", n, "carry_over", item, status, "; ".join(rest))


def parsed(files: DataFrame, key: str, text: str = "text", durable: dict[str, str] | None = None) -> DataFrame:
    """key, kind, line, section, name, value, status, notes of every section, thread, fact, reference and flag of whole files.

    line counts from 1; section is the line of the heading above.  durable maps headings to predicates.  What lies in fences, comments
    or quotes is no heading, row or item; a fence that isn't closed reaches to the end of the file and is flagged.  A NULL text
    is empty and has no rows.
    """
    names = DURABLE if durable is None else durable
    spec = files.select(F.col(key)).schema[0]

    def run(batches):
        reader = _Reader(names)
        for b in batches:
            for k in range(0, b.num_rows, 64):
                owner, rows = [], []
                for i in range(k, min(k + 64, b.num_rows)):
                    got = reader.read(b.column(1)[i].as_py())
                    rows += got
                    owner += [i] * len(got)
                cols = [pa.array([r[j] for r in rows], f.type) for j, f in enumerate(ROWS)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int64())), *cols], names=["key", *ROWS.names])

    schema = f"key {spec.dataType.simpleString()}, kind string, line long, section long, name string, value string, status string, notes string"
    return files.select(F.col(key), F.col(text)).mapInArrow(run, schema).withColumnRenamed("key", key)


def threads(rows: DataFrame) -> DataFrame:
    """Open, closed and unknown threads of parsed rows: name is carry_over or next; items for the next session are open."""
    state = F.when(F.col("name") == "next", "open").otherwise(status_class(F.col("status")))
    return rows.filter("kind = 'thread'").withColumn("state", state).drop("kind")


def facts(rows: DataFrame) -> DataFrame:
    """Facts of parsed rows: predicate, and object as it stands in the section."""
    return rows.filter("kind = 'fact'").drop("kind", "status", "notes").withColumnsRenamed({"name": "predicate", "value": "object"})
