"""Sample kernels in time linear in the length of a trace: Arrow functions over blocks of traces of one length.

Array expressions that name a whole trace inside a lambda are evaluated anew for each sample; here a block of traces is one
matrix, and a step over the places of a kernel takes all samples of all its traces at once. A block holds at most ``BLOCK``
samples or one trace. Null traces give null. A null sample makes null what is computed from it.
"""

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Samples of a block, and taps from which a convolution goes through transforms.
BLOCK, LONG = 1 << 21, 256


def by_length(column: pa.Array):
    """Yields (rows, matrix) for the traces of each length, some at a time; null samples are NaN."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes[sizes >= 0]).tolist():
        rows = np.flatnonzero(sizes == n)
        step = max(1, BLOCK // max(1, n))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            yield some, pc.fill_null(column.take(pa.array(some)).flatten(), np.nan).to_numpy(zero_copy_only=False).reshape(len(some), n)


def _has_null(column: pa.Array) -> np.ndarray:
    """Rows with a null sample."""
    out = np.zeros(len(column), bool)
    flat = column.flatten()
    if flat.null_count:
        owner = np.repeat(np.arange(len(column)), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
        out[owner[flat.is_null().to_numpy(zero_copy_only=False)]] = True
    return out


def mapped(column: pa.Array, kernel: Callable[[np.ndarray], np.ndarray | None]) -> pa.Array:
    """The kernel's matrix for each block as lists; where it gives None, and for null traces, null."""
    sizes, parts = np.full(len(column), -1, np.int64), []
    for rows, x in by_length(column):
        y = kernel(x)
        if y is not None:
            sizes[rows] = y.shape[1]
            parts.append((rows, y))
    offsets = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])
    flat = np.empty(offsets[-1])
    for rows, y in parts:
        flat[offsets[rows][:, None] + np.arange(y.shape[1])] = y
    odd = _has_null(column)
    lost = np.repeat(odd, np.maximum(sizes, 0)) & np.isnan(flat) if odd.any() else None
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, mask=lost), mask=pa.array(sizes < 0))


def _udf(v: Column, kernel) -> Column:
    @F.arrow_udf("array<double>")
    def run(x: pa.Array) -> pa.Array:
        return mapped(x, kernel)

    return run(v)


def gradient(v: Column) -> Column:
    """Central differences, one-sided at both ends; a single sample has none (null)."""

    def kernel(x):
        if x.shape[1] < 2:
            return x * np.nan
        return np.concatenate([x[:, 1:2] - x[:, :1], (x[:, 2:] - x[:, :-2]) / 2, x[:, -1:] - x[:, -2:-1]], 1)

    return F.when(F.size(v) == 1, F.array(F.lit(None).cast("double"))).otherwise(_udf(v, kernel))


def medians(x: np.ndarray, kernel: int) -> np.ndarray:
    half = kernel // 2
    wide = np.pad(x, ((0, 0), (half, half)))
    out = np.empty_like(x)
    step = max(1, BLOCK // kernel // max(1, len(x)))
    for at in range(0, x.shape[1], step):
        windows = np.lib.stride_tricks.sliding_window_view(wide[:, at : min(at + step, x.shape[1]) + 2 * half], kernel, 1)
        out[:, at : at + step] = np.partition(windows, half, 2)[:, :, half]
        out[:, at : at + step][np.isnan(windows).any(2)] = np.nan
    return out


def median_filter(v: Column, kernel: int) -> Column:
    """The median of ``kernel`` (odd) samples around each one; outside the trace there are zeros."""
    return _udf(v, lambda x: medians(x, kernel))


def convolved(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """The places where the taps lie inside the trace; tap by tap, or by transforms of pieces (overlap and add) if there are many."""
    m, n = len(taps), x.shape[1]
    places = max(0, n - m + 1)
    if m < LONG or not places:
        out = np.zeros((len(x), places))
        for j, w in enumerate(taps[::-1].tolist()):
            out += x[:, j : j + places] * w
        return out
    size = 1 << (4 * m - 1).bit_length()
    spectrum, full = np.fft.rfft(taps, size), np.zeros((len(x), n + m - 1))
    for at in range(0, n, size - m + 1):
        part = x[:, at : at + size - m + 1]
        full[:, at : at + part.shape[1] + m - 1] += np.fft.irfft(np.fft.rfft(part, size) * spectrum, size)[:, : part.shape[1] + m - 1]
    return full[:, m - 1 : n]


def weights(taps: Sequence[float], v: Column) -> Column:
    """The 'valid' convolution of ``v`` with the taps: one value for each place where these lie inside the trace. From ``LONG`` taps on, a null or NaN sample
    spoils the piece of the trace that it stands in."""
    taps = np.array(taps, float)
    return _udf(v, lambda x: convolved(x, taps))


def convolution(taps: Sequence[float], v: Column, mode: str = "full") -> Column:
    """The convolution with zeros outside the trace: ``full`` has every place with any overlap, ``same`` as many as the trace, from the middle."""
    taps = np.array(taps, float)
    m = len(taps)
    if mode not in ("full", "same"):
        raise ValueError(mode)

    def kernel(x):
        full = convolved(np.pad(x, ((0, 0), (m - 1, m - 1))), taps)
        return full if mode == "full" else full[:, (m - 1) // 2 : (m - 1) // 2 + x.shape[1]]

    return _udf(v, kernel)


def polynomial_weights(window: int, degree: int) -> np.ndarray:
    """Row i: the weights of a window's samples in the value of their least-squares polynomial at place i of the window."""
    powers = np.vander(np.arange(window) - window // 2, degree + 1, increasing=True).astype(float)
    return powers @ np.linalg.pinv(powers)


def polynomial_smoothed(v: Column, window: int = 51, degree: int = 3) -> Column:
    """Each sample is that of the polynomial through the ``window`` (odd) samples around it; within half a window of an end, of the first or
    last window. Traces that are shorter than the window give null."""
    table, half = polynomial_weights(window, degree), window // 2

    def kernel(x):
        if x.shape[1] < window:
            return None
        middle = convolved(x, table[half][::-1])
        return np.concatenate([x[:, :window] @ table[:half].T, middle, x[:, -window:] @ table[half + 1 :].T], 1)

    return _udf(v, kernel)


def responses(v: Column, kernels: dict[int, Sequence[float]], before: int) -> Column:
    """For each kernel (by its width) width, top (largest response), and of the first ``before`` responses n, mean and m2 (sum of squares about the mean)."""
    made = {width: np.array(taps, float) for width, taps in kernels.items()}

    @F.arrow_udf("array<struct<width:int,top:double,n:long,mean:double,m2:double>>")
    def run(column: pa.Array) -> pa.Array:
        out: list = [None] * len(column)
        for rows, x in by_length(column):
            found = []
            for width, taps in made.items():
                r = convolved(x, taps)
                first = r[:, :before]
                n = first.shape[1]
                mean = first.sum(1) / max(1, n)
                found.append((width, r.max(1).tolist() if r.shape[1] else [None] * len(rows), n, mean.tolist(), ((first - mean[:, None]) ** 2).sum(1).tolist()))
            for k, row in enumerate(rows.tolist()):
                out[row] = [{"width": w, "top": top[k], "n": n, "mean": mean[k], "m2": m2[k]} for w, top, n, mean, m2 in found]
        return pa.array(out, pa.list_(pa.struct([("width", pa.int32()), ("top", pa.float64()), ("n", pa.int64()), ("mean", pa.float64()), ("m2", pa.float64())])))

    return run(v)


def moments(v: Column) -> Column:
    """n, mean and m2 (sum of squares about the mean) of a trace's samples that aren't null; a trace without any has n = 0 and no mean."""

    @F.arrow_udf("struct<n:long,mean:double,m2:double>")
    def run(column: pa.Array) -> pa.Array:
        n, mean, m2 = np.zeros(len(column), np.int64), np.full(len(column), np.nan), np.zeros(len(column))
        nulls = _has_null(column)
        for rows, x in by_length(column):
            known = ~(np.isnan(x) & nulls[rows][:, None])
            many = known.sum(1)
            middle = np.where(known, x, 0).sum(1) / np.maximum(many, 1)
            n[rows], mean[rows] = many, np.where(many > 0, middle, np.nan)
            m2[rows] = (np.where(known, x - middle[:, None], 0) ** 2).sum(1)
        return pa.StructArray.from_arrays([pa.array(n), pa.array(mean, mask=n == 0), pa.array(m2)], ["n", "mean", "m2"])

    return run(v)


def pooled(rows: DataFrame, *keys: str, v: Column) -> DataFrame:
    """keys, n, mean, m2 of all samples of each key's traces: a trace is one row of moments, and these are summed before the shuffle."""
    m = rows.select(*keys, moments(v).alias("m")).select(*keys, "m.*")
    sums = m.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("s"), F.sum("m2").alias("inside"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("q"))
    between = F.greatest(F.col("q") - F.try_divide(F.col("s") * F.col("s"), F.col("n")), F.lit(0.0))
    return sums.select(*keys, "n", F.try_divide("s", "n").alias("mean"), (F.col("inside") + F.coalesce(between, F.lit(0.0))).alias("m2"))


def _first(test: np.ndarray) -> np.ndarray:
    """The first place where it holds, else 0."""
    return test.argmax(1)


def edges(v: Column, low: float, high: float, baseline: int, average: int) -> Column:
    """edge, base, height, rise and peak as ``sequence.edges`` states; null for traces of two samples or fewer, or with a null sample."""

    @F.arrow_udf("struct<edge:int,base:double,height:double,rise:int,peak:double>")
    def run(column: pa.Array) -> pa.Array:
        edge, base, height, rise, peak = (np.full(len(column), np.nan) for _ in range(5))
        for rows, x in by_length(column):
            n = x.shape[1]
            if n < 3:
                continue
            line, at = np.arange(len(x)), np.arange(n)
            d = np.diff(np.diff(x, axis=1), axis=1)
            mean = d.mean(1)
            s = np.sqrt(np.maximum((d * d).mean(1) - mean * mean, 0))[:, None]
            first = _first(d > 5 * s)
            first = np.where(first > 0, first, _first(d > 4 * s))
            top, start = np.nan_to_num(x, nan=-np.inf).argmax(1), x[:, :baseline].mean(1)
            most = x[line, top]
            early = at < top[:, None]
            reach = lambda q: _first(early & (x - start[:, None] > (q * (most - start))[:, None]))  # noqa: E731, B023
            run_sum = np.concatenate([np.zeros((len(x), 1)), np.cumsum(x, 1)], 1)
            ends = np.minimum(top + average, n)
            left, right = x[line, np.maximum(top - 1, 0)], x[line, np.minimum(top + 1, n - 1)]
            down = 2 * (left - 2 * most + right)
            inside = (top > 0) & (top < n - 1) & (down != 0)
            edge[rows] = first
            base[rows] = np.where(first > 0, run_sum[line, first] / np.maximum(first, 1), np.nan)
            height[rows] = (run_sum[line, ends] - run_sum[line, top]) / (ends - top) - start
            rise[rows] = np.where(top > 0, reach(high) - reach(low), np.nan)
            peak[rows] = top + np.where(inside, (left - right) / np.where(inside, down, 1), 0)
        lost = _has_null(column)
        whole = lambda a: pa.array(np.nan_to_num(a).astype(np.int32), mask=np.isnan(a) | lost)
        real = lambda a: pa.array(a, mask=np.isnan(a) | lost)
        return pa.StructArray.from_arrays([whole(edge), real(base), real(height), whole(rise), real(peak)], ["edge", "base", "height", "rise", "peak"])

    return run(v)
