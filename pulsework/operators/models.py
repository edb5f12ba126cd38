"""Calibration models: drift, energy scale, line shapes, histograms of data and their chi2.

Bins and parameters are small tables; the rows of data are read once and leave the tasks as counts.
"""

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calibration import histogram, with_percentiles


def describe(rows: DataFrame, column: str, *keys: str) -> DataFrame:
    """keys, n, mean, std (sample), low, q1, median, q3, high; nulls don't count. Quartiles are exact and linear."""
    some = rows.groupBy(*keys).agg(F.count(column).alias("n"), F.round(F.avg(column), 4).alias("mean"), F.round(F.stddev_samp(column), 4).alias("std"), F.min(column).alias("low"), F.max(column).alias("high"))
    return with_percentiles(some, rows, column, {"q1": 0.25, "median": 0.5, "q3": 0.75}, *keys).select(*keys, "n", "mean", "std", "low", "q1", "median", "q3", "high")


def ranged_histogram(rows: DataFrame, column: str, bins: int, *keys: str) -> DataFrame:
    """keys, bin, n, density: counts of equal bins from the least to the largest value of all rows, the last bin closed; groups share the edges.

    The range is one row, joined to all. A table with one distinct value has all in bin 0 and no density.
    """
    c = F.col(column).cast("double")
    ends = rows.agg(F.min(c).alias("low"), F.max(c).alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    place = F.coalesce(F.least(F.floor(F.try_divide(c - F.col("low"), width)), F.lit(bins - 1)), F.lit(0)).cast("long")
    some = rows.where(c.isNotNull()).join(F.broadcast(ends))
    counts = some.groupBy(*keys, place.alias("bin")).agg(F.count("*").alias("n"), F.first(width).alias("w"))
    all_ = counts.groupBy(*keys).agg(F.sum("n").alias("total")) if keys else counts.agg(F.sum("n").alias("total"))
    both = counts.join(all_, list(keys)) if keys else counts.join(F.broadcast(all_))
    return both.select(*keys, "bin", "n", F.round(F.try_divide(F.col("n"), F.col("total") * F.col("w")), 8).alias("density"))


def edge_histogram(rows: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """bin, n: counts between given edges (rising), the last bin closed; values outside are left out. The place is a count of edges, no join."""
    c = F.col(column).cast("double")
    passed = reduce(add, ((c >= float(e)).cast("int") for e in edges))
    place = F.least(passed - 1, F.lit(len(edges) - 2)).cast("long")
    return rows.where(c.between(float(edges[0]), float(edges[-1]))).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))


def drift_line(rows: DataFrame, x: str, y: str, low: float, high: float, bins: int, least: float) -> DataFrame:
    """One row: slope, offset, level. A line through the mean ``y`` of equal bins of ``x``, of the bins whose mean is above ``least``; level is their mean."""
    width = (high - low) / bins
    place = F.least(F.floor((F.col(x) - low) / width), F.lit(bins - 1))
    means = rows.where(F.col(x).between(low, high)).groupBy(place.alias("bin")).agg(F.avg(y).alias("mu")).where(F.col("mu") > least)
    t = low + (F.col("bin") + 0.5) * width
    return means.agg(F.regr_slope("mu", t).alias("slope"), F.regr_intercept("mu", t).alias("offset"), F.avg("mu").alias("level"))


def drift_corrected(rows: DataFrame, line: DataFrame, x: str, y: str) -> DataFrame:
    """The rows with ``corrected``: y / line(x) * level; null where the line is 0 or null."""
    return rows.join(F.broadcast(line)).withColumn("corrected", F.try_divide(F.col(y) * F.col("level"), F.col("slope") * F.col(x) + F.col("offset"))).drop("slope", "offset", "level")


def quadratic(a: Column, e2: float, e1: float, e0: float = 0.0) -> Column:
    return e2 * a * a + e1 * a + e0


def lorentz(x: Column, lines: list[tuple[float, float, float]], scale: float = 1.0, offset: float = 0.0) -> Column:
    """offset + scale * sum of height / (1 + ((x - place) / width)^2) over the lines (height, place, width)."""
    return offset + scale * reduce(add, (h / (1 + F.pow((x - p) / g, 2)) for h, p, g in lines), F.lit(0.0))


def find_line(rows: DataFrame, column: str, low: float, high: float, bins: int, tolerance: float = 0.02) -> DataFrame:
    """One row: centre of the fullest bin of [low, high] (the lower one of a tie), and the edges ``tolerance`` around it."""
    best = histogram(rows, column, low, high, bins).agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("bin"))
    centre = low + (F.col("bin") + 0.5) * (high - low) / bins
    return best.select(F.round(centre, 6).alias("centre"), F.round(centre * (1 - tolerance), 6).alias("lo"), F.round(centre * (1 + tolerance), 6).alias("hi"))


def chi2_scan(bins: DataFrame, grid: DataFrame, model: Column, free: int) -> DataFrame:
    """The grid's rows with chi2, ndof, reduced: bins (x, n) against ``model`` (an expression of x and the grid's columns), with the count as
    variance; empty bins are left out. Every point of the grid meets every bin: both are small, whatever the data."""
    names = grid.columns
    both = bins.where("n > 0").join(F.broadcast(grid))
    out = both.groupBy(*names).agg(F.sum(F.pow(F.col("n") - model, 2) / F.col("n")).alias("c"), (F.count("*") - free).alias("ndof"))
    return out.select(*names, F.round("c", 3).alias("chi2"), "ndof", F.round(F.col("c") / F.nullif("ndof", F.lit(0)), 4).alias("reduced"))


def shares(rows: DataFrame, column: str, *keys: str) -> DataFrame:
    """keys, total, percent of the sum over all groups."""
    groups = rows.groupBy(*keys).agg(F.sum(column).alias("t"))
    all_ = groups.agg(F.sum("t").alias("all"))
    return groups.join(F.broadcast(all_)).select(*keys, F.round("t", 2).alias("total"), F.round(100 * F.try_divide("t", "all"), 6).alias("percent"))


def envelope(rows: DataFrame, x: str, variation: str, y: str) -> DataFrame:
    """x, lower, upper: the least and the largest of the variations' means at every x."""
    means = rows.groupBy(x, variation).agg(F.avg(y).alias("m"))
    return means.groupBy(x).agg(F.round(F.min("m"), 4).alias("lower"), F.round(F.max("m"), 4).alias("upper"))


def best(scan: DataFrame, value: str, *keys: str) -> DataFrame:
    """The row of a scan with the least value; of several, the least by its keys."""
    return scan.agg(F.min_by(F.struct(*scan.columns), F.struct(value, *keys)).alias("b")).select(*(f"b.{c}" for c in scan.columns))


def share_pivot(rows: DataFrame, key: str, column: str, values: list[str]) -> DataFrame:
    """key and for each value the share of the key's rows that have it, of those that have any of the values."""
    counts = rows.where(F.col(column).isin(values)).groupBy(key).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)
    total = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    return counts.select(key, *(F.round(F.col(v) / total, 6).alias(v) for v in values))


def smoothed(counts: DataFrame, bins: int, sigma: float) -> DataFrame:
    """bin, n: a histogram (bin, n) of ``bins`` bins smoothed by a Gaussian of ``sigma`` bins, cut at 4 sigma; at the edges the bins are mirrored.

    A count goes to the bins around it, so there is no join: as many rows as bins times kernel.
    """
    from math import exp

    reach = int(4 * sigma + 0.5)
    bell = [exp(-0.5 * (j / sigma) ** 2) for j in range(-reach, reach + 1)]
    kernel = [b / sum(bell) for b in bell]
    # bin + j and all its mirror images: -1 is bin 0, ``bins`` is bin ``bins`` - 1
    spread = counts.select("bin", "n", F.posexplode(F.array(*map(F.lit, kernel))).alias("j", "w"))
    images = F.array(*(F.lit(2 * m * bins) + s for m in range(-1 - reach // bins, 2 + reach // bins) for s in (F.col("bin"), -F.col("bin") - 1)))
    out = spread.select(F.explode(F.transform(images, lambda b: b + F.col("j") - reach)).alias("bin"), (F.col("n") * F.col("w")).alias("v"))
    return out.where(F.col("bin").between(0, bins - 1)).groupBy("bin").agg(F.round(F.sum("v"), 6).alias("n"))


def fwhm(sigma: Column) -> Column:
    """The full width at half maximum of a Gaussian."""
    return 2 * F.sqrt(2 * F.log(F.lit(2.0))) * sigma


def centre(bin_: Column, low: float, high: float, bins: int) -> Column:
    return low + (bin_ + 0.5) * (high - low) / bins
