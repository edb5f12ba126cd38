"""Pulse templates: averages of traces, sample by sample."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels


def mean_trace(traces: DataFrame, *keys: str) -> DataFrame:
    """keys, i, n, t: the mean of the traces (of each key) at every place; partial sums leave the tasks. Null samples don't count."""
    long = traces.select(*keys, F.posexplode(F.col("samples").cast("array<double>")).alias("i", "v"))
    return long.groupBy(*keys, "i").agg(F.count("v").alias("n"), F.avg("v").alias("t"))


def peak_normalised(template: DataFrame, *keys: str) -> DataFrame:
    """The template (of each key) divided by its largest value; one that has no value above 0 gives nulls."""
    top = F.max("t").over(Window.partitionBy(*(keys or [F.lit(0)])))
    return template.withColumn("t", F.col("t") / F.when(top > 0, top))


def min_max(template: DataFrame, *keys: str) -> DataFrame:
    """The template (of each key) moved and scaled to 0..1; a flat one gives nulls."""
    all_ = Window.partitionBy(*(keys or [F.lit(0)]))
    low, high = F.min("t").over(all_), F.max("t").over(all_)
    return template.withColumn("t", (F.col("t") - low) / F.nullif(high - low, F.lit(0.0)))


def self_cleaned(traces: DataFrame, batch: int, factor: float) -> DataFrame:
    """The traces that are like their neighbours: in batches of ``batch`` by trace_id, the sum of squared differences to the next trace (of
    the last: the first) is below ``factor`` times the batch's median."""
    part = Window.partitionBy("batch").orderBy("trace_id")
    rows = traces.withColumn("batch", F.floor(F.col("trace_id") / batch))
    follower = F.coalesce(F.lead("samples").over(part), F.first("samples").over(part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    far = F.aggregate(F.zip_with("samples", "next", lambda a, b: F.pow(a.cast("double") - b.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumn("next", follower).withColumn("far", far)
    median = F.percentile("far", F.lit(0.5)).over(Window.partitionBy("batch"))
    return rows.withColumn("median", median).where(F.col("far") < factor * F.col("median")).select(*traces.columns)


def absolute_normalised(template: DataFrame, *keys: str, least: float = 1e-9) -> DataFrame:
    """The template (of each key) divided by its largest absolute value; one that is below ``least`` everywhere stays as it is."""
    top = F.max(F.abs("t")).over(Window.partitionBy(*(keys or [F.lit(0)])))
    return template.withColumn("t", F.when(top < least, F.col("t")).otherwise(F.col("t") / top))


def pooled(template: DataFrame, key: str) -> DataFrame:
    """i, t: the mean of the keys' normalised templates, normalised again."""
    means = absolute_normalised(template, key).groupBy("i").agg(F.avg("t").alias("t"))
    return absolute_normalised(means)


def offset_removed(template: DataFrame, first: int, *keys: str) -> DataFrame:
    """The template (of each key) less the mean of its ``first`` samples, scaled to a peak of 1."""
    base = F.avg(F.when(F.col("i") < first, F.col("t"))).over(Window.partitionBy(*(keys or [F.lit(0)])))
    return peak_normalised(template.withColumn("t", F.col("t") - base), *keys)


def residuals(traces: DataFrame, template: DataFrame, *keys: str) -> DataFrame:
    """trace_id, i, r: each sample less the template's (of the same keys) at its place, in units of the trace as it is."""
    long = traces.select("trace_id", *keys, F.posexplode(F.col("samples").cast("array<double>")).alias("i", "v"))
    return long.join(template.select(*keys, "i", "t"), [*keys, "i"]).select("trace_id", "i", (F.col("v") - F.col("t")).alias("r"))


def stacked(**named: DataFrame) -> DataFrame:
    """template_id, i, t: several templates in one table."""
    out = None
    for name, t in named.items():
        one = t.select(F.lit(name).alias("template_id"), "i", "t")
        out = one if out is None else out.unionByName(one)
    return out


def stretched(template: DataFrame, length: int, to: int) -> DataFrame:
    """i, t: a template of ``length`` samples at ``to`` places over the same time, by linear interpolation; past the last sample its value stays."""
    old = template.select("i", "t", F.lead("t", 1).over(Window.partitionBy(F.lit(0)).orderBy("i")).alias("next"))
    # place j stands at j * length / to: a sample gives all places up to the next sample
    first, last = F.ceil(F.col("i") * to / length).cast("int"), F.ceil((F.col("i") + 1) * to / length).cast("int") - 1
    rows = old.where(first <= last).select("i", "t", "next", F.explode(F.sequence(first, last)).alias("j"))
    return rows.select(F.col("j").alias("i"), (F.col("t") + F.coalesce(F.col("next") - F.col("t"), F.lit(0.0)) * (F.col("j") * length / to - F.col("i"))).alias("t"))


def spline(y: np.ndarray, to: int) -> np.ndarray:
    """Rows of samples at ``to`` places from the first to the last one, by the cubic spline whose third derivative doesn't jump at the
    second and the last but one sample. Up to three samples: the polynomial through them."""
    n = y.shape[1]
    if n < 2:
        return np.repeat(y[:, :1], to, 1) if n else np.full((len(y), to), np.nan)
    bend = np.zeros_like(y)  # second derivatives
    if n > 2:
        d = y[:, :-2] - 2 * y[:, 1:-1] + y[:, 2:]
        bend[:, 1], bend[:, -2] = d[:, 0], d[:, -1]
        share, right = np.zeros(n), np.zeros_like(y)
        right[:, 1] = bend[:, 1]
        for i in range(2, n - 2):
            share[i] = 1 / (4 - share[i - 1])
            right[:, i] = (6 * d[:, i - 1] - right[:, i - 1]) * share[i]
        for i in range(n - 3, 1, -1):
            bend[:, i] = right[:, i] - share[i] * bend[:, i + 1]
        bend[:, 0] = 2 * bend[:, 1] - bend[:, min(2, n - 2)]
        bend[:, -1] = 2 * bend[:, -2] - bend[:, max(n - 3, 1)]
    x = np.arange(to) * ((n - 1) / (to - 1)) if to > 1 else np.zeros(1)
    at = np.minimum(x.astype(np.int64), n - 2)
    u = x - at
    low, high = bend[:, at] / 6, bend[:, at + 1] / 6
    return low * (1 - u) ** 3 + high * u**3 + (y[:, at] - low) * (1 - u) + (y[:, at + 1] - high) * u


def resampled(templates: DataFrame, to: int, *keys: str) -> DataFrame:
    """keys, i, t: each template (keys, i, t) at ``to`` places over the same time, ends included, by ``spline``. A template is one row of its task. A
    missing sample (null) makes null all that depends on it; an empty table gives an empty one."""

    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        return kernels.mapped(column, lambda y: spline(y, to))

    rows = templates.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "t"))).alias("s")).where(F.size("s") > 0)
    return rows.select(*keys, F.posexplode(run(F.col("s.t").cast("array<double>"))).alias("i", "t"))
