"""The life of session markers: open, stale after a day, due for a prompt after a week; as a batch rule and as a stream with timers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HOUR = 3_600_000_000  # microseconds
LIMITS = (("stale", 24 * HOUR), ("prompt", 7 * 24 * HOUR))
EVENTS = "session string, event string, opened_us long, at_us long"


def life(rows: DataFrame, as_of_us: Column) -> DataFrame:
    """session, event (stale or prompt), opened_us, at_us: what has come of markers by ``as_of_us``.

    rows: session, kind ('open' or 'close'), us (microseconds since the epoch, UTC).  An open marker is stale a day after it, and due for a prompt
    a week after it, unless a row of its session came before or at that moment: another open begins anew, a close ends it.  Of rows of one moment
    the close counts last.  Rows with a NULL session or time count for nothing.
    """
    w = Window.partitionBy("session").orderBy("us", F.desc("kind"))
    x = rows.filter("session is not null and us is not null").select("session", "kind", "us").withColumn("next_us", F.lead("us").over(w)).filter("kind = 'open'")
    each = F.explode(F.array(*[F.struct(F.lit(e).alias("event"), (F.col("us") + n).alias("at_us")) for e, n in LIMITS])).alias("e")
    x = x.select("session", F.col("us").alias("opened_us"), "next_us", each).select("session", "e.event", "opened_us", "e.at_us", "next_us")
    return x.filter((F.col("at_us") <= as_of_us) & (F.col("next_us").isNull() | (F.col("next_us") > F.col("at_us")))).drop("next_us")


def life_stream(rows: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The same events as a stream: each comes once, when the watermark has passed its moment.

    rows is a stream of session, kind, us.  Rows wait in their session's state until the watermark passes them, so they may come in any order
    within the delay; state is the rows that wait and one open marker a session, and is removed when nothing is to come.
    """
    stamped = rows.filter("session is not null and us is not null").withColumn("time", F.timestamp_micros("us")).withWatermark("time", delay)
    return stamped.groupBy("session").applyInPandasWithState(_step, EVENTS, "waiting array<struct<us:bigint,kind:string>>, opened long, told long", "append", GroupStateTimeout.EventTimeTimeout)


def _step(key: tuple, batches, state: GroupState):
    waiting, opened, told = state.get if state.exists else ([], None, 0)
    waiting = [(r[0], r[1]) for r in waiting]
    for pdf in batches if not state.hasTimedOut else ():
        waiting += list(zip(pdf["us"].tolist(), pdf["kind"].tolist()))
    mark = state.getCurrentWatermarkMs() * 1000
    ready = sorted((r for r in waiting if r[0] < mark), key=lambda r: (r[0], r[1] == "close"))
    waiting = [r for r in waiting if r[0] >= mark]
    out = []

    def tell(until: int) -> int:
        """Events of the open marker before ``until``."""
        n = told
        while opened is not None and n < len(LIMITS) and opened + LIMITS[n][1] < until:
            out.append((key[0], LIMITS[n][0], opened, opened + LIMITS[n][1]))
            n += 1
        return n

    for us, kind in ready:
        tell(us)
        opened, told = (us, 0) if kind == "open" else (None, 0)
    told = tell(mark)
    if opened is not None and told == len(LIMITS):
        opened = None
    moments = [r[0] for r in waiting] + ([opened + LIMITS[told][1]] if opened is not None else [])
    if moments:
        state.update((waiting, opened, told))
        state.setTimeoutTimestamp(max(min(moments) // 1000, mark // 1000) + 1)
    elif state.exists:
        state.remove()
    yield pd.DataFrame(out, columns=["session", "event", "opened_us", "at_us"])
