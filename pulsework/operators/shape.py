"""Shapes of traces: expressions on one row each, without a shuffle."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reduced import doubles


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def shape(traces: DataFrame, baseline: int = 16) -> DataFrame:
    """trace_id, std (population), slope (least squares over the first ``baseline`` samples), centre (of mass by absolute values), width (samples
    between the first and the last that reach half the maximum), energy (sum of squares). Null or empty samples give nulls or 0; a centre without mass is null."""
    rows = traces.withColumn("v", doubles()).withColumn("half", F.array_max("v") / 2)
    n, v = F.size("v"), F.col("v")
    mean = total(v) / n
    base = F.slice("v", 1, baseline)
    middle = (F.size(base) - 1) / 2
    high = F.filter(F.transform(v, lambda x, i: F.when(x >= F.col("half"), i)), lambda i: i.isNotNull())
    spread = F.size(base) * (F.size(base) * F.size(base) - 1) / 12
    centre = total(F.transform(v, lambda x, i: i * F.abs(x))) / F.nullif(total(F.transform(v, F.abs)), F.lit(0.0))
    return rows.select(
        "trace_id", F.round(F.sqrt(F.greatest(F.lit(0.0), total(F.transform(v, lambda x: x * x)) / n - mean * mean)), 6).alias("std"),
        F.round(total(F.transform(base, lambda x, i: (i - middle) * x)) / F.nullif(spread, F.lit(0.0)), 6).alias("slope"), F.round(centre, 5).alias("centre"),
        (F.array_max(high) - F.array_min(high)).cast("long").alias("width"), F.round(total(F.transform(v, lambda x: x * x)), 6).alias("energy"),
    )


def exceeding(traces: DataFrame, threshold: float) -> DataFrame:
    """event_id, fired (any sample of any channel is above the threshold), empty (none is); a null trace counts as empty."""
    above = F.coalesce(F.exists(doubles(), lambda x: x > threshold), F.lit(False))
    return traces.groupBy("event_id").agg(F.bool_or(above).alias("fired")).withColumn("empty", ~F.col("fired"))
