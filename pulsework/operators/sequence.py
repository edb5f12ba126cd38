"""Sequences of samples: expressions on one row each (column ``samples``), without a shuffle.

Null and empty traces give null or empty results. What looks at a sample's neighbours is in ``kernels``.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels
from .reduced import doubles
from .shape import total


def first_difference(v: Column) -> Column:
    """v[i + 1] - v[i]; one value fewer than there are samples."""
    return F.zip_with(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))), lambda a, b: a - b)


def area(v: Column) -> Column:
    """Trapezoids with unit spacing."""
    return total(v) - (F.get(v, F.lit(0)) + F.element_at(v, -1)) / 2


def roll(v: Column, by: int) -> Column:
    """Circular: sample i goes to i + by."""
    n = F.size(v)
    cut = F.pmod(F.lit(-by), F.greatest(n, F.lit(1)))
    return F.concat(F.slice(v, cut + 1, n), F.slice(v, F.lit(1), cut))


def shifted(v: Column, by: int) -> Column:
    """Sample i goes to i + by, what leaves the trace is lost, what is missing is null."""
    return F.transform(v, lambda x, i: F.when((i - by >= 0) & (i - by < F.size(v)), F.get(v, i - by)))


def padded(v: Column, length: int) -> Column:
    """Zeros at the end up to ``length``; longer traces stay as they are."""
    return F.concat(v, F.array_repeat(F.lit(0.0), F.greatest(F.lit(length) - F.size(v), F.lit(0))))


def clipped(v: Column, limit: float) -> Column:
    return F.transform(v, lambda x: F.greatest(F.lit(-limit), F.least(F.lit(limit), x)))


def quantised(v: Column, scale: float, limit: int = 32767) -> Column:
    """scale * v as short integers, cut towards zero after clipping."""
    return F.transform(clipped(F.transform(v, lambda x: x * scale), float(limit)), lambda x: x.cast("short"))


def gauss_step(sigma: int, n_sigma: int = 3) -> list[float]:
    """Differences of a Gaussian over +- n_sigma widths, scaled so that a unit step gives a response of 1."""
    from math import exp

    bell = [exp(-0.5 * (x / sigma) ** 2) for x in range(-sigma * n_sigma, sigma * n_sigma + 1)]
    steps = [b - a for a, b in zip(bell, bell[1:])]
    fall = -sum(steps[sigma * n_sigma :])
    return [s / fall for s in steps]


def exploded(rows: DataFrame, values: Column, name: str) -> DataFrame:
    return rows.select("trace_id", F.posexplode(values).alias("i", name))


def edges(traces: DataFrame, low: float = 0.2, high: float = 0.8, baseline: int = 16, average: int = 10) -> DataFrame:
    """trace_id, edge, base, height, rise, peak.

    edge: first place whose second difference is above 5 of its standard deviations, else (also if that place is 0) above 4, else 0.
    base: mean up to the edge (null if the edge is 0). height: mean of ``average`` samples from the maximum on, less the mean of the first
    ``baseline`` samples. rise: samples from the first above ``low`` to the first above ``high`` of (maximum - baseline), both before the
    maximum, 0 where there is none; null if the maximum is the first sample. peak: place of the maximum by a parabola through it and its
    neighbours; at the ends the place itself. Traces with a null sample have nulls.
    """
    rows = traces.where("size(samples) > 2").select("trace_id", kernels.edges(doubles(), low, high, baseline, average).alias("e"))
    return rows.select("trace_id", "e.edge", *(F.round(f"e.{c}", 6).alias(c) for c in ("base", "height")), "e.rise", F.round("e.peak", 5).alias("peak"))


def hop_windows(traces: DataFrame, length: int, hop: int) -> DataFrame:
    """trace_id, start, samples: the windows of ``length`` samples that start at multiples of ``hop`` and lie inside the trace."""
    n = F.size("samples")
    starts = F.when(n >= length, F.sequence(F.lit(0), n - length, F.lit(hop)))
    return traces.select("trace_id", F.explode(starts).alias("start"), "samples").select("trace_id", "start", F.slice("samples", F.col("start") + 1, F.lit(length)).alias("samples"))


def joined_segments(segments: DataFrame) -> DataFrame:
    """trace_id, samples: the segments (trace_id, start, samples) of each trace in order; a trace is one row, so its list is one trace long."""
    parts = segments.groupBy("trace_id").agg(F.sort_array(F.collect_list(F.struct("start", "samples"))).alias("s"))
    return parts.select("trace_id", F.flatten(F.col("s.samples")).alias("samples"))


def time_axis(edge: Column, n: Column, dt: float) -> Column:
    """The time of each sample, 0 at the edge."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i - edge) * dt)


def near_peak(v: Column, reach: int = 2) -> Column:
    """(offset, value) of the samples around the first maximum, at most ``reach`` away; fewer at the ends."""
    top = (F.array_position(v, F.array_max(v)) - 1).cast("int")
    return F.filter(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda k: F.struct(k.alias("k"), F.when(top + k >= 0, F.get(v, top + k)).alias("x"))), lambda z: z["x"].isNotNull())


def unit_area(v: Column) -> Column:
    """The samples divided by their area; null where that is 0."""
    return F.transform(v, lambda x: x / F.nullif(area(v), F.lit(0.0)))