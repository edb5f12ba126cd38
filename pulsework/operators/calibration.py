"""Cuts, histograms and percentiles of tables of reduced quantities."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import percentiles


def within(rows: DataFrame, **ranges: tuple[float, float]) -> DataFrame:
    """Rows with every named column inside its range, ends included; the filters reach the scan."""
    for name, (low, high) in ranges.items():
        rows = rows.where(F.col(name).between(low, high))
    return rows


def histogram(rows: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """bin, n: counts in equal bins, the last one closed; values outside are left out, empty bins give no row."""
    width = (high - low) / bins
    place = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
    return rows.where(F.col(column).between(low, high)).groupBy(place.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def summary(rows: DataFrame, group: str, column: str) -> DataFrame:
    """n, mean, std (population), p1 and p99 (exact, linear) of each group."""
    some = rows.groupBy(group).agg(F.count(column).alias("n"), F.round(F.avg(column), 4).alias("mean"), F.round(F.stddev_pop(column), 4).alias("std"))
    return with_percentiles(some, rows, column, {"p1": 0.01, "p99": 0.99}, group)


def with_percentiles(groups: DataFrame, rows: DataFrame, column: str, shares: dict[str, float], *keys: str) -> DataFrame:
    """``groups`` (one row for each key) with the percentiles of the rows, rounded; null for a group without values."""
    found = percentiles(rows, column, shares, *keys)
    found = found.select(*(F.col(k).alias(f"_{k}") for k in keys), *(F.round(n, 4).alias(n) for n in shares))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return groups.join(found, same, "left").drop(*(f"_{k}" for k in keys))


def _place(column: str, low: float, high: float, bins: int):
    return F.least(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("long")


def binned_mean(rows: DataFrame, x: str, y: str, low: float, high: float, bins: int) -> DataFrame:
    """bin, n, mean: the mean of ``y`` in equal bins of ``x``, the last one closed; null ``y`` don't count."""
    inside = rows.where(F.col(x).between(low, high))
    return inside.groupBy(_place(x, low, high, bins).alias("bin")).agg(F.count(y).alias("n"), F.round(F.avg(y), 4).alias("mean"))


def histogram_2d(rows: DataFrame, x: tuple[str, float, float, int], y: tuple[str, float, float, int]) -> DataFrame:
    """x, y, n: counts in equal bins of two columns (column, low, high, bins); rows outside either range are left out."""
    inside = rows.where(F.col(x[0]).between(*x[1:3]) & F.col(y[0]).between(*y[1:3]))
    return inside.groupBy(_place(*x).alias("x"), _place(*y).alias("y")).agg(F.count("*").alias("n"))


def cut_flow(rows: DataFrame, cuts: dict[str, str]) -> DataFrame:
    """One row: n, and for each cut in turn the rows that pass it and all before it; one pass. A null condition doesn't pass."""
    out, passed = [F.count("*").alias("n")], F.lit(True)
    for name, condition in cuts.items():
        passed = passed & F.expr(condition)
        out.append(F.count_if(passed).alias(name))
    return rows.agg(*out)
