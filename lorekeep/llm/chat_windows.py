"""6. Chat formatting: budgeted, turn-aligned windows with limited history and a loss mask.

Prefix sums of the turns' tokens choose the windows of a conversation: a window starts with the
system turns before it, all and whole, repeats up to HISTORY tokens of the other turns just before,
and goes on with new turns up to BUDGET tokens, at least one: a turn that exceeds the room left gets
a window of its own, whole.  System turns aren't charged to the history.
As stored (``repeat_system`` off) a window leaves out the system turns before it, which are those of earlier windows'
new turns, so that the output grows with the conversation and no more; ``expanded`` puts them in front again when windows are
read for training.  With ``repeat_system`` each window holds them.
Only new assistant turns are under the loss mask, so each is a target exactly once.

Template: ``<|turn N ROLE|>`` LF text ``<|end|>`` LF.  In roles and texts, a backslash goes before
every backslash and inside every control string, so that no text can forge a mark; dropping those
backslashes gives the text back.  Rows stream through sorted partitions: of a conversation of any
length, only the system turns and a window are held.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUDGET = 2048
HISTORY = 512
_CONTROL = re.compile(r"\\|<(?=[|/sS]|<)|\[(?=/?INST\])|\|(?=>)|>(?=>)")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<\|turn (\d+) ((?:[^\\|]+|\\.|\|(?!>))*)\|>\n((?:[^\\<]+|\\.|<(?!\|))*)<\|end\|>\n", re.S)
WINDOWS = "conv_id long, no_conv boolean, window long, text string, first_new long, mask array<struct<start:long,end:long>>, tokens long"


def escape(text: str) -> str:
    """A backslash after the first character of control strings (<|, |>, <s, </s, [INST], [/INST], <<, >>) and before backslashes."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_tokens(text: str | None) -> int:
    """Tokens that a turn is counted as: about four characters each, and four for its marks."""
    return 4 + (len(text or "") + 3) // 4


def _sorted(conversations: DataFrame) -> DataFrame:
    n = max(1, int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # whether a turn comes from the system goes first, so that system turns lead their windows only if they lead the conversation
    return x.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


class _Windows:
    """Windows of one conversation after another, from a stream of its turns."""

    def __init__(self, budget: int, history: int, repeat_system: bool = True):
        self.budget, self.history, self.repeat_system = budget, history, repeat_system
        self.out: list[tuple] = []

    def begin(self, conv) -> None:
        self.conv, self.n, self.window = conv, 0, 0
        self.system: list[tuple[int, str, str]] = []
        self.past: list[tuple[int, str, str]] = []
        self.fresh: list[tuple[int, str, str]] = []
        self.sum = self.fresh_from = self.lead = 0
        self.room = self.budget

    def turn(self, role: str, text: str) -> None:
        cost = turn_tokens(text)
        if self.fresh and self.sum + cost - self.fresh_from > self.room:
            self.flush()
        self.fresh.append((self.n, role, text))
        self.sum += cost
        self.n += 1

    def flush(self) -> None:
        """Write a window out; what follows repeats the system turns and as much history as the limit allows."""
        if not self.fresh:
            return
        parts, mask, at, tokens = [], [], 0, 0
        new_from = self.fresh[0][0]
        for k, role, text in [*self.system, *self.past, *self.fresh]:
            head, body = f"<|turn {k} {escape(role)}|>\n", escape(text)
            if k >= new_from and role == "assistant":
                mask.append({"start": at + len(head), "end": at + len(head) + len(body)})
            parts += [head, body, "<|end|>\n"]
            at += len(head) + len(body) + 8
            tokens += turn_tokens(text)
        self.out.append((self.conv, self.conv is None, self.window, "".join(parts), new_from, mask, tokens))
        self.window += 1
        for t in self.fresh:
            if t[1] == "system":
                if self.repeat_system:
                    self.system.append(t)
                self.lead += turn_tokens(t[2])
        kept, used = [], 0
        for t in reversed([*self.past, *self.fresh]):
            if t[1] == "system":
                continue
            used += turn_tokens(t[2])
            if used > self.history:
                break
            kept.append(t)
        self.past, self.fresh = kept[::-1], []
        self.fresh_from = self.sum
        self.room = max(1, self.budget - self.lead - sum(turn_tokens(t[2]) for t in self.past))


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, repeat_system: bool = True) -> DataFrame:
    """Windows (conv_id, window, text, first_new, mask, tokens) of conversations (conv_id, turn, role, text).

    The same turns are new in the same windows with repeat_system or without; tokens are those of what a window holds.

    Turns go by turn, then role, then text (nulls first); a null role or text is empty; repeated rows
    are turns of their own; rows without conv_id make one conversation (no_conv); an empty table has
    no windows.  mask holds the spans (code points of text, end exclusive) of new assistant texts.
    """

    def run(batches):
        w, now = _Windows(budget, history, repeat_system), None
        for b in batches:
            for conv, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if now is None or now[0] != conv:
                    if now is not None:
                        w.flush()
                    now = (conv,)
                    w.begin(conv)
                w.turn(role, text)
                if len(w.out) >= 500:
                    yield _batch(w.out)
                    w.out = []
        if now is not None:
            w.flush()
        if w.out:
            yield _batch(w.out)

    return _sorted(conversations).mapInArrow(run, WINDOWS)


_KIND = pa.schema([("conv_id", pa.int64()), ("no_conv", pa.bool_()), ("window", pa.int64()), ("text", pa.string()), ("first_new", pa.int64()), ("mask", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("tokens", pa.int64())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _KIND)], schema=_KIND)


def parse(text: str) -> list[tuple[int, str, str, int]]:
    """(number, role, text, where the escaped text starts) of each turn of a formatted window."""
    return [(int(m[1]), unescape(m[2]), unescape(m[3]), m.start(3)) for m in _TURN.finditer(text)]


def _with_lead(batches):
    """Batches of stored windows, sorted by conversation and window, with the system turns before each window in front of it."""
    now, lead, cost = None, [], 0
    for b in batches:
        out = []
        for conv, none, window, text, first_new, mask, tokens in zip(*(c.to_pylist() for c in b.columns)):
            if now != (conv,):
                now, lead, cost = (conv,), [], 0
            front = "".join(lead)
            shifted = [{"start": m["start"] + len(front), "end": m["end"] + len(front)} for m in mask]
            out.append((conv, none, window, front + text, first_new, shifted, tokens + cost))
            for k, role, said, _ in parse(text):
                if k >= first_new and role == "system":
                    lead.append(f"<|turn {k} {escape(role)}|>\n{escape(said)}<|end|>\n")
                    cost += turn_tokens(said)
            if len(out) >= 100:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)


def expanded(windows: DataFrame) -> DataFrame:
    """Windows that were stored without the system turns before them, with these in front: what ``format_windows`` gives with repeat_system.

    Only a conversation's system turns are held; the windows stream by in their order.
    """
    n = max(1, int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = windows.select("conv_id", "no_conv", "window", "text", "first_new", "mask", "tokens").repartition(n, "conv_id").sortWithinPartitions("conv_id", "window")

    return x.mapInArrow(_with_lead, WINDOWS)


def read_back(windows: DataFrame, stored: bool = False) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, from its windows alone.

    stored windows, without the system turns before them, are read as ``expanded`` gives them, one after the other in the same task: whole windows are neither shuffled nor held.
    """
    n = max(1, int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = windows.select("conv_id", "no_conv", "window", "text", "first_new", "mask", "tokens").repartition(n, "conv_id").sortWithinPartitions("conv_id", "window")

    def run(batches):
        now, state, out = None, None, []

        def close():
            out.append((now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for b in _with_lead(batches) if stored else batches:
            for conv, _, _, text, first_new, mask, _ in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or now[0] != conv:
                    if now is not None:
                        close()
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for k, role, said, _ in parse(text):
                    if k >= first_new:
                        state[0] += 1
                        state[1].update(f"{role}\n{said}\n".encode())
                for span in mask:
                    target = unescape(text[span["start"] : span["end"]])
                    state[2] += len(target)
                    state[3].update(target.encode())
                state[4] += len(text)
            if len(out) >= 1000:
                yield _rows(out)
                out.clear()
        if now is not None:
            close()
        if out:
            yield _rows(out)

    return x.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


ORACLE_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256
FROM c GROUP BY conv_id"""
