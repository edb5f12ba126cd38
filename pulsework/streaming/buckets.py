"""Events merged from triggers of any channel, in buckets of time: the keys of the state are buckets, and no key has all triggers.

A bucket holds its own triggers and those within the gap on either side of it. Once the watermark has passed its end and the gap, it is cut into
runs of triggers less than the gap apart. A run that neither begins before the bucket nor goes on after it is an event; the others are pieces
of events, at most two of a bucket, which ``joined`` puts together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.ranks import running
from .ordered import PROVIDER

_PIECE = "start long, stop long, n long, channels array<string>, opens boolean, closes boolean, late boolean"


class Bucket(StatefulProcessor):
    def __init__(self, width: int, gap: int):
        self.width, self.gap = width, gap

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t array<long>, channel array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        end = (int(key[0]) + 1) * self.width
        for frame in rows:
            late = (frame["t"] <= now * 1000) & (now > 0)
            some, own = frame[~late], frame[late & (frame["t"] // self.width == int(key[0]))]
            if len(some):
                self.waiting.appendValue((some["t"].tolist(), some["channel"].tolist()))
                self.handle.registerTimer(-(-(end + self.gap) // 1000))
            if len(own):
                yield pd.DataFrame({"start": own["t"], "stop": own["t"], "n": 1, "channels": [[c] for c in own["channel"]], "opens": False, "closes": False, "late": True})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        parts = list(self.waiting.get())
        self.waiting.clear()
        t = np.concatenate([np.array(p[0], np.int64) for p in parts])
        channel = np.concatenate([np.array(p[1], object) for p in parts])
        order = np.argsort(t, kind="stable")
        t, channel = t[order], channel[order]
        own = t // self.width == int(key[0])
        rows = []
        for run in np.split(np.arange(len(t)), np.flatnonzero(np.diff(t) >= self.gap) + 1):
            mine = run[own[run]]
            if len(mine):
                rows.append((t[mine[0]], t[mine[-1]], len(mine), sorted(set(channel[mine])), mine[0] == run[0], mine[-1] == run[-1], False))
        yield pd.DataFrame(rows, columns=["start", "stop", "n", "channels", "opens", "closes", "late"])

    def close(self) -> None:
        pass


def pieces(triggers: DataFrame, gap: int, width: int, late: str) -> DataFrame:
    """start, stop, n, channels, opens, closes, late: events and pieces of events of a stream (ts, channel) in buckets of ``width`` microseconds, which ``gap`` doesn't exceed.

    Triggers of any channel less than ``gap`` apart are one event. ``opens`` and ``closes``: nothing before or after belongs to it. A trigger that the watermark has
    passed is a row with ``late`` = true and belongs to nothing. Rows without a time or channel are left out.
    """
    if gap > width:
        raise ValueError("a bucket has to be as long as the gap at least")
    if triggers.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != PROVIDER:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
    rows = triggers.withWatermark("ts", late).select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("channel").cast("string").alias("channel")).where("t is not null and channel is not null")
    near = F.array_distinct(F.array(*(F.floor((F.col("t") + shift) / width).cast("long") for shift in (1 - gap, 0, gap - 1))))
    return rows.select(F.explode(near).alias("bucket"), "t", "channel").groupBy("bucket").transformWithStateInPandas(Bucket(width, gap), _PIECE, "Append", "EventTime")


def joined(found: DataFrame) -> DataFrame:
    """start, stop, n, n_channels of the events of a table of ``pieces``: whole ones as they are, pieces put together in order of time. Events that aren't closed yet and late triggers are left out."""
    found = found.where("not late")
    columns = [F.col("start"), F.col("stop"), F.col("n"), F.size("channels").alias("n_channels")]
    parts = running(found.where("not (opens and closes)").withColumn("_one", F.col("opens").cast("long")), [], ["start"], {"event": "_one"})
    whole = parts.groupBy("event").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("channels"))).alias("channels"), F.bool_or("opens").alias("opens"), F.bool_or("closes").alias("closes"))
    return found.where("opens and closes").select(*columns).unionByName(whole.where("opens and closes").select(*columns))
