"""Streams of events: rates by period and events merged from triggers. ``ts`` is event time; rows later than the watermark are left out."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rates(stream: DataFrame, period: str, late: str, threshold: float) -> DataFrame:
    """start, channel, n, n_pass, mean of each tumbling period; n_pass counts values above the threshold."""
    groups = stream.withWatermark("ts", late).groupBy(F.window("ts", period).alias("w"), "channel")
    out = groups.agg(F.count("v").alias("n"), F.count_if(F.col("v") > threshold).alias("n_pass"), F.avg("v").alias("mean"))
    return out.select(F.unix_micros("w.start").alias("start"), "channel", "n", "n_pass", F.round("mean", 5).alias("mean"))


def sliding_tops(stream: DataFrame, length: str, hop: str, late: str) -> DataFrame:
    """start, n, top of each sliding period."""
    groups = stream.withWatermark("ts", late).groupBy(F.window("ts", length, hop).alias("w"))
    return groups.agg(F.count("v").alias("n"), F.max("v").alias("top")).select(F.unix_micros("w.start").alias("start"), "n", "top")


def merged(stream: DataFrame, gap: str, late: str, by_channel: bool = False) -> DataFrame:
    """start, stop, n, n_channels of events: triggers of any channel less than ``gap`` apart are one event; it closes when the watermark is
    past its end. With ``by_channel``, channel too: each channel has events of its own. Sessions need a key, so all channels share one
    that is 0 for each: triggers are few beside samples, and partial sessions are merged before they are shuffled."""
    key = F.col("channel") if by_channel else (F.length(F.col("channel").cast("string")) * 0).alias("all")
    groups = stream.withWatermark("ts", late).where("channel is not null").groupBy(F.session_window("ts", gap).alias("w"), key)
    rows = groups.agg(F.count("*").alias("n"), F.max("ts").alias("stop"), F.size(F.collect_set("channel")).alias("n_channels"))
    return rows.select(*(["channel"] if by_channel else []), F.unix_micros("w.start").alias("start"), F.unix_micros("stop").alias("stop"), "n", "n_channels")


def noise_spectra(stream: DataFrame, period: str, late: str, length: int, fs: float = 1.0) -> DataFrame:
    """start, k, n, psd: the one-sided power density of the traces (ts, samples) of each tumbling period, averaged over them. Traces of
    another length are left out; a null sample counts as 0. A trace leaves Python as its power at each frequency; Spark sums and keeps the state."""

    @F.arrow_udf("array<double>")
    def power(samples: pa.Array) -> pa.Array:
        x = pc.fill_null(samples.flatten(), 0.0).to_numpy(zero_copy_only=False).reshape(-1, length)
        p = np.abs(np.fft.rfft(x)) ** 2
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))

    rows = stream.withWatermark("ts", late).where(F.size("samples") == length).select("ts", power(F.col("samples").cast("array<double>")).alias("p"))
    groups = rows.select("ts", F.posexplode("p").alias("k", "p")).groupBy(F.window("ts", period).alias("w"), "k")
    once = (F.col("k") == 0) | (2 * F.col("k") == length)
    out = groups.agg(F.count("*").alias("n"), F.avg("p").alias("p"))
    return out.select(F.unix_micros("w.start").alias("start"), "k", "n", F.round(F.col("p") * F.when(once, 1.0).otherwise(2.0) / (fs * length), 4).alias("psd"))
