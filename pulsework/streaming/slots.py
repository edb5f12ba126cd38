"""Channels in slots: a stateful operator is called once for a slot and batch, however many channels the slot has, and keeps their states in one Arrow table.

A slot's state is written anew when one of its channels has samples. ``SLOTS`` slots of some thousand channels are a few MB each; streams of
far more channels take more of them. A running query's number stays as it was: the slots are the keys of its state.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 1024


def slotted(samples: DataFrame, slots: int = SLOTS):
    """The samples by ``slot``. Those without a channel have a slot of their own, so no column of channels has both."""
    slot = F.when(F.col("channel").isNull(), -1).otherwise(F.pmod(F.xxhash64("channel"), F.lit(slots)))
    return samples.withColumn("slot", slot.cast("int")).groupBy("slot")


def packed(rows: pd.DataFrame) -> bytes:
    table, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


def together(tables: list[pd.DataFrame]) -> pd.DataFrame:
    """One table of all; empty ones don't decide about types."""
    return pd.concat([t for t in tables if len(t)] or tables[:1], ignore_index=True)


def named(key, rows: pd.DataFrame) -> pd.DataFrame:
    """The rows of a slot with null channels where it has none."""
    return rows if key[0] != -1 else rows.assign(channel=pd.Series([None] * len(rows), index=rows.index, dtype=object))
