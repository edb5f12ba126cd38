"""Statistics of events (traces that share event_id, one for each channel): coincidence, thresholds, efficiency and ROC."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kernels import pooled
from .reduced import doubles, summed


def coincidence(traces: DataFrame, within: int) -> DataFrame:
    """event_id, score: the sum of the two largest channel maxima if they are less than ``within`` samples apart, else the largest.

    Ties go to the lower channel. An event has as many rows as the detector has channels, so its list is small.
    """
    v = doubles()
    peak = F.struct(F.array_max(v).alias("a"), (-F.col("channel")).alias("c"), F.array_position(v, F.array_max(v)).alias("t"))
    two = traces.where("size(samples) > 0").groupBy("event_id").agg(F.slice(F.sort_array(F.collect_list(peak), asc=False), 1, 2).alias("p"))
    first, second = F.col("p")[0], F.get("p", F.lit(1))
    near = F.abs(first["t"] - second["t"]) < within
    return two.select("event_id", F.round(first["a"] + F.when(near, second["a"]).otherwise(0.0), 6).alias("score"))


def multiplicity(traces: DataFrame, threshold: float) -> DataFrame:
    """One row: n events, and the shares with one, two and three or more channels above the threshold."""
    hit = (F.array_max(doubles()) > threshold).cast("int")
    fold = traces.groupBy("event_id").agg(F.coalesce(F.sum(hit), F.lit(0)).alias("fold"))
    return fold.agg(F.count("*").alias("n"), *(F.round(F.avg((F.col("fold") >= k).cast("double")), 6).alias(f"ge{k}") for k in (1, 2, 3)))


def sigma_thresholds(traces: DataFrame, numbers: list[float]) -> DataFrame:
    """channel, n_sigma, threshold: multiples of the sample standard deviation of each channel's samples."""
    sigma = pooled(traces, "channel", v=doubles()).select("channel", F.sqrt(F.expr("try_divide(m2, n - 1)")).alias("s"))
    many = sigma.select("channel", "s", F.explode(F.array(*map(F.lit, map(float, numbers)))).alias("n_sigma"))
    return many.select("channel", "n_sigma", F.round(F.col("n_sigma") * F.col("s"), 6).alias("threshold"))


def any_channel(traces: DataFrame, thresholds: DataFrame) -> DataFrame:
    """n_sigma, n events, n_fired, eff: events with a channel above its own threshold. Thresholds have one row for each channel and n_sigma; channels without one never fire."""
    top = traces.select("event_id", "channel", F.array_max(doubles()).alias("top"))
    fired = top.join(thresholds, "channel").groupBy("n_sigma", "event_id").agg(F.bool_or(F.col("top") > F.col("threshold")).alias("fired"))
    rows = fired.groupBy("n_sigma").agg(F.count("*").alias("n"), F.count_if("fired").alias("n_fired"))
    return rows.withColumn("eff", F.round(F.col("n_fired") / F.col("n"), 6))


def roc(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, tpr, fpr of rows (positive boolean, score) on a grid; one pass of counts for each threshold. Null scores never pass."""
    tests = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.coalesce(F.col("score") > float(t), F.lit(False)).alias("pass")) for t in thresholds)))
    rate = lambda side: F.round(F.avg(F.when(side, F.col("t.pass").cast("double"))), 6)
    rows = scores.select("positive", tests.alias("t"))
    return rows.groupBy(F.col("t.threshold").alias("threshold")).agg(rate(F.col("positive")).alias("tpr"), rate(~F.col("positive")).alias("fpr"))


def moments(traces: DataFrame) -> DataFrame:
    """a, b, n, x, y, xx, yy, xy: sums over the samples that two channels (a <= b) have at the same place of the same event, where neither is null.

    Rows are dealt by event and read event by event (as many traces as the detector has channels). An event is one matrix, and its sums are
    products of matrices; a task adds them up and sends one row for each pair of channels. Rows without an event, a channel or samples are left out.
    """

    def part(batches):
        names: dict = {}
        sums, seen = np.zeros((6, 0, 0)), np.zeros((0, 0), bool)
        now, held = None, []

        def close():
            nonlocal sums, seen
            if not held:
                return
            own = np.array([names.setdefault(c, len(names)) for c, _ in held])
            if len(names) > len(seen):
                wider = (0, len(names) - len(seen))
                sums, seen = np.pad(sums, ((0, 0), wider, wider)), np.pad(seen, (wider, wider))
            x = np.full((len(held), max(len(v) for _, v in held)), np.nan)
            for row, (_, v) in zip(x, held, strict=True):
                row[: len(v)] = v
            known = ~np.isnan(x)
            x, one = np.where(known, x, 0.0), known.astype(float)
            left, square = x @ one.T, (x * x) @ one.T
            at = np.ix_(own, own)
            for k, value in enumerate((one @ one.T, left, left.T, square, square.T, x @ x.T)):
                np.add.at(sums[k], at, value)
            seen[at] = True

        for batch in batches:
            for event, channel, samples in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if event != now:
                    close()
                    now, held = event, []
                held.append((channel, samples.values.to_numpy(zero_copy_only=False)))
        close()
        order = sorted(names)
        pairs = [(a, b) for i, a in enumerate(order) for b in order[i:] if seen[names[a], names[b]]]
        columns = [pa.array([sums[k, names[a], names[b]] for a, b in pairs], pa.float64()) for k in range(6)]
        yield pa.RecordBatch.from_arrays([*(pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)), *columns], ["a", "b", "n", "x", "y", "xx", "yy", "xy"])

    rows = traces.where("event_id is not null and channel is not null and samples is not null").select("event_id", F.col("channel").cast("long").alias("channel"), F.col("samples").cast("array<double>").alias("samples"))
    parts = rows.repartition("event_id").sortWithinPartitions("event_id", "channel").mapInArrow(part, "a long, b long, n double, x double, y double, xx double, yy double, xy double")
    return parts.groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")))


def correlation(traces: DataFrame) -> DataFrame:
    """a, b, corr: correlation of the samples of every two channels (a <= b) at the same place of the same event; null where one doesn't vary."""
    spread = lambda v, vv: f"(n * {vv} - {v} * {v})"
    return moments(traces).select("a", "b", F.round(F.expr(f"try_divide(n * xy - x * y, sqrt({spread('x', 'xx')} * {spread('y', 'yy')}))"), 6).alias("corr"))


def spike(traces: DataFrame) -> DataFrame:
    """event_id, channel, trace_id, top: the trace with the event's largest sample, the lower channel of a tie."""
    rows = traces.where("size(samples) > 0").select("event_id", "channel", "trace_id", F.array_max(doubles()).alias("top"))
    best = rows.groupBy("event_id").agg(F.max_by(F.struct("channel", "trace_id", "top"), F.struct("top", -F.col("channel"))).alias("b"))
    return best.select("event_id", "b.channel", "b.trace_id", F.round("b.top", 6).alias("top"))


def dark_counts(traces: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, n, n_fired, rate: events with a channel above each threshold; events are reduced to one maximum before they meet the grid."""
    top = traces.groupBy("event_id").agg(F.max(F.array_max(doubles())).alias("top"))
    rows = top.select("top", F.explode(F.array(*map(F.lit, map(float, thresholds)))).alias("threshold"))
    out = rows.groupBy("threshold").agg(F.count("*").alias("n"), F.count_if(F.col("top") > F.col("threshold")).alias("n_fired"))
    return out.withColumn("rate", F.round(F.col("n_fired") / F.col("n"), 6))


def leading_spread(traces: DataFrame) -> DataFrame:
    """event_id, spread: samples between the maxima of the two leading channels; null with fewer than two."""
    v = doubles()
    peak = F.struct(F.array_max(v).alias("a"), (-F.col("channel")).alias("c"), F.array_position(v, F.array_max(v)).alias("t"))
    two = traces.where("size(samples) > 0").groupBy("event_id").agg(F.slice(F.sort_array(F.collect_list(peak), asc=False), 1, 2).alias("p"))
    return two.select("event_id", F.abs(F.col("p")[0]["t"] - F.get("p", F.lit(1))["t"]).cast("long").alias("spread"))


def weighted_sum(traces: DataFrame, weights: DataFrame) -> DataFrame:
    """event_id, channel (-1), i, v: the sum of weight * sample over the channels that have a weight (channel, weight); others count as 0."""
    weighted = traces.join(weights, "channel").select("event_id", "channel", F.transform(doubles(), lambda x: x * F.col("weight")).alias("samples"))
    out = summed(weighted, "event_id").select("event_id", F.posexplode("samples").alias("i", "v"))
    return out.select("event_id", F.lit(-1).cast("long").alias("channel"), "i", F.round("v", 5).alias("v"))


def merged_triggers(triggers: DataFrame, gap: int) -> DataFrame:
    """start, stop, n, n_channels: triggers (t, channel) of any channel that are no more than ``gap`` apart, merged into one event.

    A trigger begins an event if none lies in the ``gap`` before it. Time is cut into slices, sorted in each and joined at
    their edges, so no task holds all triggers: only the last time of each slice crosses to the next ones.
    """
    slices = triggers.withColumn("s", F.floor(F.col("t") / (64 * gap)).cast("long"))
    inner = Window.partitionBy("s").orderBy("t", "channel")
    ends = slices.groupBy("s").agg(F.max("t").alias("end"))
    rows = slices.join(ends.select((F.col("s") + 1).alias("s"), "end"), "s", "left").withColumn("before", F.coalesce(F.lag("t").over(inner), F.col("end")))
    begins = rows.withColumn("new", F.coalesce(F.col("t") - F.col("before") > gap, F.lit(True)).cast("long"))
    # The number of an event is a running count of beginnings: over slices first (one row each), then inside.
    # Slices are summed by thousands, so the one window without a key has a row for a thousand slices.
    counts = begins.groupBy("s").agg(F.sum("new").alias("k")).withColumn("block", F.floor(F.col("s") / 1000))
    blocks = counts.groupBy("block").agg(F.sum("k").alias("k")).select("block", (F.sum("k").over(Window.orderBy("block")) - F.col("k")).alias("first"))
    counts = counts.join(blocks, "block").withColumn("base", F.col("first") + F.sum("k").over(Window.partitionBy("block").orderBy("s")) - F.col("k"))
    numbered = begins.join(counts.select("s", "base"), "s").withColumn("event", F.col("base") + F.sum("new").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    out = numbered.groupBy("event").agg(F.min("t").alias("start"), F.max("t").alias("stop"), F.count("*").alias("n"), F.count_distinct("channel").alias("n_channels"))
    return out.drop("event")


def covariance(traces: DataFrame) -> DataFrame:
    """a, b, cov: the sample covariance of the samples of every two channels (a <= b) at the same place of the same event."""
    return moments(traces).select("a", "b", F.round(F.expr("try_divide(xy - try_divide(x * y, n), n - 1)"), 7).alias("cov"))


def top_two(traces: DataFrame) -> DataFrame:
    """event_id, rank (1, 2), channel, amp, place of the two largest channel maxima; ties go to the lower channel."""
    v = doubles()
    peak = F.struct((-F.array_max(v)).alias("a"), F.col("channel"), (F.array_position(v, F.array_max(v)) - 1).alias("t"))
    two = traces.where("size(samples) > 0").groupBy("event_id").agg(F.slice(F.sort_array(F.collect_list(peak)), 1, 2).alias("p"))
    rows = two.select("event_id", F.posexplode("p").alias("rank", "p"))
    return rows.select("event_id", (F.col("rank") + 1).alias("rank"), "p.channel", F.round(-F.col("p.a"), 6).alias("amp"), F.col("p.t").alias("place"))


def triggered_sum(traces: DataFrame, threshold: float) -> DataFrame:
    """event_id, n, samples: the sum of the channels whose maximum is above the threshold; an event without such a channel has no row."""
    return summed(traces.where(F.array_max(doubles()) > threshold), "event_id")


def hits_per_record(hits: DataFrame, records: DataFrame, length: int) -> DataFrame:
    """channel, block, hits: how many hits (channel, i) each record (channel, block) of ``length`` samples has; 0 for those without any."""
    counts = hits.groupBy("channel", F.floor(F.col("i") / length).cast("long").alias("block")).agg(F.count("*").alias("hits"))
    return records.select("channel", "block").join(counts, ["channel", "block"], "left").na.fill(0, ["hits"])
