"""Reduced quantities of traces: a row has ``samples``, and every quantity is an expression on that row, without a shuffle."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(samples="samples") -> Column:
    return F.transform(F.col(samples), lambda x: x.cast("double"))


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def reduced(traces: DataFrame, baseline: int = 16) -> DataFrame:
    """trace_id, mean, mean_baseline, amplitude (maximum above the baseline), peak_arg (first maximum), height. Empty and null samples give nulls."""
    rows = traces.withColumn("v", doubles())
    base = F.slice("v", 1, baseline)
    return rows.select(
        "trace_id", F.round(mean(F.col("v")), 6).alias("mean"), F.round(mean(base), 6).alias("mean_baseline"), F.round(F.array_max("v") - mean(base), 6).alias("amplitude"),
        (F.array_position("v", F.array_max("v")) - 1).cast("long").alias("peak_arg"), F.round(F.array_max("v") - F.array_min("v"), 6).alias("height"),
    )


def efficiency(traces: DataFrame, thresholds: list[float]) -> DataFrame:
    """energy, threshold, n, n_pass, eff, err: traces whose maximum is strictly above each threshold, with the binomial error."""
    top = traces.select("energy", F.array_max(doubles()).alias("top"))
    tests = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), (F.col("top") > float(t)).cast("long").alias("pass")) for t in thresholds)))
    rows = top.select("energy", tests.alias("t")).groupBy("energy", "t.threshold").agg(F.count("*").alias("n"), F.sum("t.pass").alias("n_pass"))
    eff = F.col("n_pass") / F.col("n")
    return rows.select("energy", "threshold", "n", "n_pass", F.round(eff, 6).alias("eff"), F.round(F.sqrt(eff * (1 - eff) / F.col("n")), 6).alias("err"))


def fold_maximum(traces: DataFrame, k: int = 2) -> DataFrame:
    """event_id, score: the k-th largest channel maximum of each event; the largest if it has fewer channels."""
    tops = traces.select("event_id", F.array_max(doubles()).alias("top")).groupBy("event_id").agg(F.sort_array(F.collect_list("top"), asc=False).alias("t"))
    return tops.select("event_id", F.round(F.coalesce(F.get("t", F.lit(k - 1)), F.get("t", F.lit(0))), 6).alias("score"))


def pooled_sum(traces: DataFrame) -> DataFrame:
    """event_id, i, v: the summed pseudo-channel of each event, sample by sample."""
    return summed(traces, "event_id").select("event_id", F.posexplode("samples").alias("i", "v")).withColumn("v", F.round("v", 5))


def summed(traces: DataFrame, *keys: str) -> DataFrame:
    """keys, n, samples: the sum of the traces of each key, sample by sample. A trace is one row of the shuffle; a key has as many as the
    detector has channels. Null traces are left out, null samples and the missing end of shorter traces count as 0."""
    rows = traces.where("samples is not null").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("channel", doubles().alias("v")))).alias("t"))
    add = lambda a, x: F.zip_with(a, x["v"], lambda p, q: F.coalesce(p, F.lit(0.0)) + F.coalesce(q, F.lit(0.0)))
    return rows.select(*keys, F.size("t").alias("n"), F.aggregate("t", F.array().cast("array<double>"), add).alias("samples"))
