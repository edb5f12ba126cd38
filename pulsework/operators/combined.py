"""Filters of events: one amplitude from several channels, thresholds, and the events that they let pass."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reduced import summed
from .kernels import pooled, responses
from .sequence import gauss_step


def mixed_score(single: DataFrame, joint: DataFrame) -> DataFrame:
    """event_id, score: the larger of an event's largest single amplitude (event_id, amp) and its joint one; an event may have either alone."""
    top = single.groupBy("event_id").agg(F.max("amp").alias("a"))
    both = top.join(joint.select("event_id", F.col("amp").alias("b")), "event_id", "full")
    return both.select("event_id", F.round(F.greatest("a", "b"), 6).alias("score"))


def acceptance(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """first, second, n: how many keys each of two triggers (key, fired) accepts; a key that one lacks doesn't fire there."""
    both = first.select(key, F.col("fired").alias("first")).join(second.select(key, F.col("fired").alias("second")), key, "full")
    return both.na.fill(False, ["first", "second"]).groupBy("first", "second").agg(F.count("*").alias("n"))


def efficiency_difference(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """One row: mean and largest difference of two efficiency tables (key, eff), on keys that both have."""
    d = F.col("first") - F.col("second")
    both = first.select(key, F.col("eff").alias("first")).join(second.select(key, F.col("eff").alias("second")), key)
    return both.agg(F.round(F.avg(d), 6).alias("mean"), F.round(F.max(F.abs(d)), 6).alias("largest"))


def count_score(traces: DataFrame, threshold: float) -> DataFrame:
    """event_id, n_above: channels whose maximum is above a fixed threshold; null and empty traces never are."""
    above = F.coalesce(F.array_max("samples") > threshold, F.lit(False))
    return traces.groupBy("event_id").agg(F.count_if(above).alias("n_above"))


def channel_statistics(traces: DataFrame) -> DataFrame:
    """channel, mean, std (population) of all samples; sums leave the tasks."""
    all_ = pooled(traces, "channel", v=F.col("samples").cast("array<double>"))
    return all_.select("channel", F.round("mean", 7).alias("mean"), F.round(F.sqrt(F.expr("try_divide(m2, n)")), 7).alias("std"))


def empty_rate(traces: DataFrame, threshold: float) -> DataFrame:
    """energy, n, rate: the share of traces without a sample above the threshold; null and empty traces are empty."""
    empty = ~F.coalesce(F.array_max("samples") > threshold, F.lit(False))
    return traces.groupBy("energy").agg(F.count("*").alias("n"), F.round(F.avg(empty.cast("double")), 6).alias("rate"))


def group_traces(traces: DataFrame, groups: dict[str, tuple[int, int]]) -> DataFrame:
    """event_id, group, i, v: sums of the channels lo..hi (both included) of each named group; groups may overlap."""
    named = F.filter(F.array(*(F.when(F.col("channel").between(lo, hi), F.lit(name)) for name, (lo, hi) in groups.items())), lambda g: g.isNotNull())
    sums = summed(traces.select("event_id", "channel", F.explode(named).alias("group"), "samples"), "event_id", "group")
    return sums.select("event_id", "group", F.posexplode("samples").alias("i", "v")).withColumn("v", F.round("v", 5))


def less_baseline(traces: DataFrame, baseline: int) -> DataFrame:
    """The traces less the mean of their first ``baseline`` samples."""
    v = F.col("samples").cast("array<double>")
    base = F.slice(v, 1, baseline)
    mean = F.aggregate(base, F.lit(0.0), lambda s, x: s + x) / F.size(base)
    return traces.withColumn("base", mean).withColumn("samples", F.transform(v, lambda x: x - F.col("base"))).drop("base")


def missing(expected: DataFrame, there: DataFrame, *keys: str) -> DataFrame:
    """The distinct expected keys without a row."""
    return expected.select(*keys).distinct().join(there.select(*keys).distinct(), list(keys), "left_anti")


def labelled(noise: DataFrame, signal: DataFrame) -> DataFrame:
    """Both tables in one, with ``positive`` (false for noise)."""
    return noise.withColumn("positive", F.lit(False)).unionByName(signal.withColumn("positive", F.lit(True)))


def conservative(amps: DataFrame, noise: DataFrame, group: str, numbers: list[float]) -> DataFrame:
    """n_sigma, threshold, n events, n_fired, eff: events whose largest amplitude is above one threshold, the largest over the groups of n_sigma
    times the sample standard deviation of the group's amplitudes in ``noise``. Both tables have event_id, amp and the group."""
    sigma = noise.groupBy(group).agg(F.stddev_samp("amp").alias("s"))
    grid = sigma.select("s", F.explode(F.array(*map(F.lit, map(float, numbers)))).alias("n_sigma")).groupBy("n_sigma").agg(F.max(F.col("n_sigma") * F.col("s")).alias("threshold"))
    tops = amps.groupBy("event_id").agg(F.max("amp").alias("top"))
    both = tops.join(F.broadcast(grid))  # as many rows as there are numbers
    out = both.groupBy("n_sigma", "threshold").agg(F.count("*").alias("n"), F.count_if(F.col("top") > F.col("threshold")).alias("n_fired"))
    return out.select("n_sigma", F.round("threshold", 6).alias("threshold"), "n", "n_fired", F.round(F.col("n_fired") / F.col("n"), 6).alias("eff"))


def union_of_curves(single: DataFrame, joint: DataFrame, sigma_single: float, sigma_joint: float, numbers: list[float]) -> DataFrame:
    """n_sigma, n events, and the shares whose largest single amplitude (individual), whose joint amplitude (joint), or any of the two
    (either) is above n_sigma times its own sigma. Events that one of them lacks are left out."""
    both = single.groupBy("event_id").agg(F.max("amp").alias("a")).join(joint.select("event_id", F.col("amp").alias("b")), "event_id")
    rows = both.select("a", "b", F.explode(F.array(*map(F.lit, map(float, numbers)))).alias("n_sigma"))
    a, b = F.col("a") > F.col("n_sigma") * sigma_single, F.col("b") > F.col("n_sigma") * sigma_joint
    share = lambda test: F.round(F.avg(test.cast("double")), 6)
    return rows.groupBy("n_sigma").agg(F.count("*").alias("n"), share(a).alias("individual"), share(b).alias("joint"), share(a | b).alias("either"))


def edge_cube(traces: DataFrame, widths: list[int], numbers: list[float], before: int) -> DataFrame:
    """width, n_sigma, energy, n, n_fired, eff: traces whose response to an edge kernel of each width goes above n_sigma times the width's
    sigma, the standard deviation (population) of the first ``before`` responses of channel 0. With noise alone it counts false triggers."""
    made = responses(F.col("samples").cast("array<double>"), {w: gauss_step(w) for w in widths}, before)
    out = traces.select("channel", "energy", F.inline(made))
    quiet = out.where("channel = 0").groupBy("width").agg(F.sum("n").alias("k"), F.sum(F.col("n") * F.col("mean")).alias("s"), F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean")).alias("q"))
    quiet = quiet.select("width", F.sqrt(F.greatest((F.col("q") - F.col("s") * F.col("s") / F.col("k")) / F.col("k"), F.lit(0.0))).alias("sigma"))  # a row for each width
    rows = out.select("width", "energy", "top", F.explode(F.array(*map(F.lit, map(float, numbers)))).alias("n_sigma")).join(F.broadcast(quiet), "width")
    found = rows.groupBy("width", "n_sigma", "energy").agg(F.count("*").alias("n"), F.count_if(F.col("top") > F.col("n_sigma") * F.col("sigma")).alias("n_fired"))
    return found.withColumn("eff", F.round(F.col("n_fired") / F.col("n"), 6))


def configurations(series: DataFrame, thresholds: list[float], key: str) -> DataFrame:
    """threshold, tp, tn, fp of the keys' hits (values above the threshold): one hit is right, none a true negative, every further one false."""
    rows = series.select(key, "v", F.explode(F.array(*map(F.lit, map(float, thresholds)))).alias("threshold"))
    hits = rows.groupBy("threshold", key).agg(F.count_if(F.col("v") > F.col("threshold")).alias("h"))
    return hits.groupBy("threshold").agg(F.count_if(F.col("h") >= 1).alias("tp"), F.count_if(F.col("h") == 0).alias("tn"), F.sum(F.greatest(F.col("h") - 1, F.lit(0))).cast("long").alias("fp"))
