"""Operators over streams whose samples come out of order, with a buffer, event-time timers and a side output of late samples.

A sample waits in the state of its channel's slot (``slots``) until the watermark has passed its time; then all that are due are put in order of their place
and go through the operator. Timers do this, one of a slot, so a channel that has gone silent is worked off too. What comes when the
watermark has passed its time is late: it is returned as a row with ``late`` = true and changes nothing else.

The state holds the samples of the time that the watermark lags behind, whatever the length of the stream. The session needs
``spark.sql.streaming.stateStore.providerClass`` = ``PROVIDER``, which has timers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.filters import Filter
from .sliding import advanced
from .slots import SLOTS, named, packed, slotted, together, unpacked
from .trigger import stepped

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ROWS = "rows binary"


class Reordered(StatefulProcessor):
    """``work(rows, state)`` takes rows (channel, i, v) of several channels, each place once, with the state it returned before (at first None), and
    returns rows (channel and ``columns``) and the new state. Both states are tables."""

    def __init__(self, columns: list[str], work: Callable):
        self.columns, self.work = columns, work

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting, self.state = handle.getListState("waiting", _ROWS), handle.getValueState("state", _ROWS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, some = timerValues.getCurrentWatermarkInMs(), []
        for frame in rows:
            late = (frame["t"] <= now * 1000) & (now > 0)
            some.append(frame.loc[~late, ["channel", "i", "v", "t"]])
            if late.any():
                yield self._rows(key, frame.loc[late, ["channel", "i"]].rename(columns={"i": self.columns[0]}), True)
        if any(map(len, some)):
            self.waiting.appendValue((packed(together(some)),))
            self.handle.registerTimer(now + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        parts = [unpacked(p[0]) for p in self.waiting.get()]
        if not parts:
            return
        rows = together(parts)
        due = rows["t"] <= now * 1000
        self.waiting.clear()
        if not due.all():
            self.waiting.appendValue((packed(rows[~due]),))
            self.handle.registerTimer(now + 1)
        if due.any():
            once = rows.loc[due, ["channel", "i", "v"]].drop_duplicates(["channel", "i"])
            found, state = self.work(once, unpacked(self.state.get()[0]) if self.state.exists() else None)
            self.state.update((packed(state),))
            yield self._rows(key, found, False)

    def _rows(self, key, rows: pd.DataFrame, late: bool) -> pd.DataFrame:
        return named(key, rows.reindex(columns=["channel", *self.columns]).assign(late=late))

    def close(self) -> None:
        pass


def _through(samples: DataFrame, late: str, columns: dict[str, str], work: Callable, slots: int, only: str | None = None) -> DataFrame:
    spark = samples.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
    rows = samples.withWatermark("ts", late)
    # the time as a number isn't the watermark's column, so late rows get as far as the buffer
    rows = rows.select("channel", F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("v"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).where("i is not null and t is not null")
    rows = rows.where(only) if only else rows
    kind = samples.schema["channel"].dataType.simpleString()
    schema = f"channel {kind}, {', '.join(f'{c} {k}' for c, k in columns.items())}, late boolean"
    return slotted(rows, slots).transformWithStateInPandas(Reordered(list(columns), work), schema, "Append", "EventTime")


def hits(samples: DataFrame, threshold: float, rearm: float, holdoff: int = 0, late: str = "1 minute", slots: int = SLOTS) -> DataFrame:
    """channel, i, late: the hits of ``trigger.hits`` in a stream (ts, channel, i, v) whose samples come in any order within ``late``, and the late samples.

    Samples that are neither above nor below change nothing and don't leave the JVM, nor are they counted when late. Of a place that comes twice one sample counts.
    """
    low = rearm * threshold
    return _through(samples, late, {"i": "long"}, lambda rows, state: stepped(rows, state, threshold, holdoff), slots, f"v > {threshold!r} or v < {low!r}")


def sliding(samples: DataFrame, f: Filter, ddof: int = 2, late: str = "1 minute", slots: int = SLOTS) -> DataFrame:
    """channel, start, amp, chisq, late: the windows of ``sliding.sliding`` in a stream (ts, channel, i, v) whose samples come in any order within ``late``.

    Late samples are rows with their place as start and no amp and chisq; where one is missing, the channel starts anew. Null values count as 0.
    """

    def work(rows, tails):
        found, tails = advanced(f, ddof, rows, tails)
        return found.round({"amp": 5, "chisq": 5}), tails

    return _through(samples, late, {"start": "long", "amp": "double", "chisq": "double"}, work, slots)
