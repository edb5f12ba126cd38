"""Optimum filters: the amplitude of a known pulse shape in noise of a known spectrum, by least squares in the frequency domain.

With the one-sided density p and w = 4 / p (1 / p at Nyquist, 0 at frequency 0 and where p is 0 or null), the inner product of two
traces is <a, b> = sum over k of w Re(conj(A) B) / (fs N). The amplitude is <t, x> / <t, t>, and chi2 is what is left of <x, x>.
Template and density are arrays as long as one trace; they go to the tasks inside the function, whatever the number of traces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reduced import summed as added

#: The longest template that is taken to the driver, in samples.
LONGEST = 1 << 22
BLOCK = 1 << 20
FLOOR = 1e-30


@dataclass(frozen=True)
class Filter:
    template: np.ndarray
    psd: np.ndarray
    fs: float = 1.0
    #: Weigh the bins by 1 / p, the Nyquist one too, with p no less than ``FLOOR``: chi2 is about a quarter, amplitudes differ by the Nyquist bin.
    one_sided: bool = False

    @property
    def length(self) -> int:
        return len(self.template)

    @property
    def weight(self) -> np.ndarray:
        """Weights of the one-sided bins in the inner product, with its 1 / (fs N)."""
        p = np.asarray(self.psd, float)
        if len(p) != self.length // 2 + 1:
            raise ValueError(f"a template of {self.length} samples needs {self.length // 2 + 1} bins, not {len(p)}")
        if self.one_sided:
            w = 1 / np.maximum(np.nan_to_num(p), FLOOR)
        else:
            w = np.divide(4.0, p, out=np.zeros(len(p)), where=np.nan_to_num(p) > 0)
            if self.length % 2 == 0:
                w[-1] /= 4
        w[0] = 0.0
        return w / (self.fs * self.length)

    @property
    def spectrum(self) -> np.ndarray:
        return np.fft.rfft(self.template)

    @property
    def norm(self) -> float:
        return float(self.weight @ np.abs(self.spectrum) ** 2)

    @property
    def kernel(self) -> np.ndarray:
        """Weights of the samples: their dot product with a trace is its amplitude without a shift."""
        return self._back(np.conj(self.spectrum)[None])[0][-np.arange(self.length)] / self.norm

    def _back(self, product: np.ndarray) -> np.ndarray:
        share = np.full(product.shape[1], 0.5)
        share[0] = 1.0
        if self.length % 2 == 0:
            share[-1] = 1.0
        return np.fft.irfft(product * (self.weight * share) * self.length, self.length)

    def overlap(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """<t shifted by s, x> for every s, and <x, x>, of each row of ``x``."""
        spectra = np.fft.rfft(x)
        return self._back(np.conj(self.spectrum) * spectra), np.abs(spectra) ** 2 @ self.weight


    def padded(self, length: int) -> Filter:
        """The filter for traces of ``length`` samples: zeros after the template, and the density at the finer frequencies by linear interpolation."""
        grid = np.arange(length // 2 + 1) * self.length / length
        psd = np.interp(grid, np.arange(len(self.psd)), np.asarray(self.psd, float))
        return Filter(np.concatenate([self.template, np.zeros(length - self.length)]), psd, self.fs, self.one_sided)

    def correlated(self, v: np.ndarray) -> np.ndarray:
        """The amplitude at every place of a longer series where the whole template lies inside it, by one convolution with the kernel."""
        size = 1 << (len(v) - 1).bit_length()
        return np.fft.irfft(np.fft.rfft(v, size) * np.conj(np.fft.rfft(self.kernel, size)), size)[: len(v) - self.length + 1]

    def powers(self, v: np.ndarray) -> np.ndarray:
        """<x, x> of every window of a longer series, by the recurrence of the sliding transform: a step takes one sample away and
        adds one, and the turn that it also makes doesn't change the power. Every block of windows starts from a transform of its own."""
        n, w = self.length, self.weight
        rows = max(2, min(BLOCK // len(w), len(v) - n + 1))
        turns = np.exp(-2j * np.pi * np.outer(np.arange(rows - 1), np.arange(len(w))) / n)
        out = np.empty(len(v) - n + 1)
        for at in range(0, len(out), rows):
            m = min(rows, len(out) - at)
            steps = v[at + n : at + n + m - 1] - v[at : at + m - 1]
            y = np.cumsum(np.concatenate([np.fft.rfft(v[at : at + n])[None], steps[:, None] * turns[: m - 1]]), 0)
            out[at : at + m] = (y.real**2 + y.imag**2) @ w
        return out


def array_of(rows: DataFrame, order: str, value: str) -> np.ndarray:
    """A reference array (a template or a density, one row for each place) on the driver; refuses one longer than ``LONGEST``."""
    got = rows.select(order, value).limit(LONGEST + 1).toPandas()
    if len(got) > LONGEST:
        raise ValueError(f"more than {LONGEST} rows are no reference array")
    return got.sort_values(order)[value].to_numpy(float)


def shifts(length: int, allowed: tuple[int, int] | None) -> np.ndarray:
    """The shifts that are tried, in the order in which ties are settled: all from 0 up, or the negative ones and then the others."""
    if allowed is None:
        return np.arange(length)
    return np.concatenate([np.arange(length + allowed[0], length), np.arange(allowed[1] + 1)])


def signed(shift: np.ndarray, length: int) -> np.ndarray:
    return np.where(shift < length // 2, shift, shift - length)


def _blocks(batch: pa.RecordBatch, length: int):
    """Places and samples of the traces of this length, some at a time; null samples count as 0, other traces are left out."""
    column = batch.column(batch.schema.get_field_index("samples"))
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == length)
    step = max(1, BLOCK // length)
    for at in range(0, len(rows), step):
        some = pa.array(rows[at : at + step])
        yield some, pc.fill_null(column.take(some).flatten(), 0.0).to_numpy(zero_copy_only=False).reshape(-1, length)


def _rows(traces: DataFrame) -> DataFrame:
    return traces.select("trace_id", F.col("samples").cast("array<double>").alias("samples"))


def amplitude(traces: DataFrame, f: Filter) -> DataFrame:
    """trace_id, amp: the amplitude without a shift, a dot product with the kernel. Traces of another length are left out."""
    kernel, n = f.kernel, f.length

    def part(batches):
        for batch in batches:
            for some, x in _blocks(batch, n):
                yield pa.RecordBatch.from_arrays([batch.column("trace_id").take(some), pa.array(x @ kernel)], ["trace_id", "amp"])

    return _rows(traces).mapInArrow(part, "trace_id long, amp double").withColumn("amp", F.round("amp", 6))


def fit(traces: DataFrame, f: Filter, ddof: int = 2) -> DataFrame:
    """trace_id, amp, chisq of the pulse where the template has it. Traces of another length, null ones too, are left out."""
    n, norm = f.length, f.norm

    def part(batches):
        for batch in batches:
            for some, x in _blocks(batch, n):
                series, own = f.overlap(x)
                amp = series[:, 0] / norm
                yield pa.RecordBatch.from_arrays([batch.column("trace_id").take(some), pa.array(amp), pa.array((own - amp**2 * norm) / (n - ddof))], ["trace_id", "amp", "chisq"])

    out = _rows(traces).mapInArrow(part, "trace_id long, amp double, chisq double")
    return out.select("trace_id", F.round("amp", 6).alias("amp"), F.round("chisq", 6).alias("chisq"))


def fit_with_shift(traces: DataFrame, f: Filter, allowed: tuple[int, int] | None = None, ddof: int = 3, wrap: bool = True) -> DataFrame:
    """trace_id, amp, chisq, t0 at the allowed (circular) shift with the least chisq, the first one if several tie.

    t0 is signed: from half the length on it is negative (``wrap=False`` leaves it as it is). Traces of another length are left out.
    """
    n, norm = f.length, f.norm
    tried = shifts(n, allowed)

    def part(batches):
        for batch in batches:
            for some, x in _blocks(batch, n):
                series, own = f.overlap(x)
                amps = series[:, tried] / norm
                chi = own[:, None] - amps**2 * norm
                at = chi.argmin(1)
                line = np.arange(len(at))
                t0 = signed(tried[at], n) if wrap else tried[at]
                yield pa.RecordBatch.from_arrays([batch.column("trace_id").take(some), pa.array(amps[line, at]), pa.array(chi[line, at] / (n - ddof)), pa.array(t0.astype(np.int32))], ["trace_id", "amp", "chisq", "t0"])

    out = _rows(traces).mapInArrow(part, "trace_id long, amp double, chisq double, t0 int")
    return out.select("trace_id", F.round("amp", 6).alias("amp"), F.round("chisq", 6).alias("chisq"), "t0")


def joint(traces: DataFrame, f: Filter, allowed: tuple[int, int] | None = None, ddof: int = 3) -> DataFrame:
    """event_id, n_channels, amp, chisq, t0: one amplitude and one shift for all channels of an event.

    The least squares over the channels have <t, x> summed over them and <t, t> once for each. Channels of one event are as
    many as the detector has; they are summed on the way, so a task holds one row of sums for an event at a time.
    """
    n, norm = f.length, f.norm
    tried = shifts(n, allowed)

    def event(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, own, count = np.zeros(n), 0.0, 0
        for batch in batches:
            for _, x in _blocks(batch, n):
                s, o = f.overlap(x)
                series, own, count = series + s.sum(0), own + o.sum(), count + len(x)
        if count:
            chi = own - series[tried] ** 2 / (count * norm)
            at = tried[chi.argmin()]
            yield pa.RecordBatch.from_pydict({"event_id": [key[0].as_py()], "n_channels": [count], "amp": [series[at] / (count * norm)], "chisq": [chi.min() / (count * n - ddof)], "t0": [int(signed(at, n))]}, out_schema)

    fields = [("event_id", pa.int64()), ("n_channels", pa.int64()), ("amp", pa.float64()), ("chisq", pa.float64()), ("t0", pa.int32())]
    out_schema = pa.schema(fields)
    rows = traces.select("event_id", F.col("samples").cast("array<double>").alias("samples"))
    out = rows.groupBy("event_id").applyInArrow(event, "event_id long, n_channels long, amp double, chisq double, t0 int")
    return out.select("event_id", "n_channels", F.round("amp", 6).alias("amp"), F.round("chisq", 6).alias("chisq"), "t0")


def summed(traces: DataFrame, channels: int, f: Filter) -> DataFrame:
    """event_id, amp, chisq of the sum of an event's channels; its noise density is ``channels`` times that of one."""
    one = added(traces, "event_id").select(F.col("event_id").alias("trace_id"), "samples")
    return fit(one, Filter(f.template, f.psd * channels, f.fs)).withColumnRenamed("trace_id", "event_id")


def line_fit(traces: DataFrame, template: np.ndarray, baseline: int = 16, sigma_power: int = 2) -> DataFrame:
    """trace_id, amp, offset, chisq: amp * template + offset by least squares in the time domain, with the baseline's variance as noise
    (its standard deviation with ``sigma_power`` 1).

    The problem is linear, so sums over the samples give it: no minimiser, no Python. Without spread in template or baseline: null.
    """
    n = len(template)
    v = F.col("v")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    t = template - template.mean()
    shape = F.array(*map(F.lit, t.tolist()))
    rows = traces.where(F.size("samples") == n).select("trace_id", F.col("samples").cast("array<double>").alias("v"))
    base = F.slice(v, 1, baseline)
    sums = rows.select(
        "trace_id", total(v).alias("s"), total(F.transform(v, lambda x: x * x)).alias("ss"), total(F.zip_with(v, shape, lambda x, y: x * y)).alias("st"),
        total(base).alias("b"), total(F.transform(base, lambda x: x * x)).alias("bb"),
    )
    sxx = F.nullif(F.lit(float(t @ t)), F.lit(0.0))
    noise = F.pow(F.nullif(F.col("bb") / baseline - F.pow(F.col("b") / baseline, 2), F.lit(0.0)), F.lit(sigma_power / 2))
    amp = F.col("st") / sxx
    left = F.col("ss") - F.col("s") * F.col("s") / n - F.col("st") * amp
    return sums.select("trace_id", F.round(amp, 6).alias("amp"), F.round(F.col("s") / n - amp * float(template.mean()), 6).alias("offset"), F.round(left / noise / (n - 2), 5).alias("chisq"))


def weighted_amplitude(traces: DataFrame, template: np.ndarray) -> DataFrame:
    """trace_id, amp: least squares of amp * template with the weight 1 / (0.001 + |x|) of each sample. Without weight: null."""
    shape = F.array(*map(F.lit, np.asarray(template, float).tolist()))
    rows = traces.where(F.size("samples") == len(template)).select("trace_id", F.col("samples").cast("array<double>").alias("v"))
    total = lambda f: F.aggregate(F.zip_with("v", shape, lambda x, t: F.struct(x.alias("x"), t.alias("t"), (1 / (0.001 + F.abs(x))).alias("w"))), F.lit(0.0), lambda s, z: s + f(z))
    amp = F.try_divide(total(lambda z: z["w"] * z["x"] * z["t"]), total(lambda z: z["w"] * z["t"] * z["t"]))
    return rows.select("trace_id", F.round(amp, 6).alias("amp"))


def residual(traces: DataFrame, fits: DataFrame, template: np.ndarray, wrap: bool = True) -> DataFrame:
    """trace_id, rms of each trace less amp times the template moved by t0: one join by trace_id, then expressions on the row.

    The template is rolled; without ``wrap``, what leaves the trace is lost and zeros come in.
    """
    n = len(template)
    rows = traces.where(F.size("samples") == n).select("trace_id", F.col("samples").cast("array<double>").alias("v")).join(fits.select("trace_id", "amp", "t0"), "trace_id")
    shape = F.array(*map(F.lit, template.tolist()))
    rolled = F.concat(F.slice(shape, n + 1 - F.pmod("t0", F.lit(n)), F.pmod("t0", F.lit(n))), F.slice(shape, F.lit(1), n - F.pmod("t0", F.lit(n))))
    if not wrap:
        rolled = F.transform(rolled, lambda y, i: F.when((i - F.col("t0") >= 0) & (i - F.col("t0") < n), y).otherwise(0.0))
    rest = F.zip_with("v", rolled, lambda x, y: x - F.col("amp") * y)
    return rows.select("trace_id", F.round(F.sqrt(F.aggregate(rest, F.lit(0.0), lambda s, x: s + x * x) / n), 5).alias("rms"))


def bank(traces: DataFrame, filters: dict, key: str, allowed: tuple[int, int] | None = (0, 0), ddof: int = 3) -> DataFrame:
    """trace_id, event_id, channel, ``key``, amp, chisq, t0 of each trace with the filter of its key (a channel, a group of channels, a kind of noise).

    ``filters`` maps values of the key to filters: as many as the detector has of these, so they go to the tasks. Fits are as in
    ``fit_with_shift``; the default allows no shift. Traces of a key without a filter, or of another length than its filter, are left out.
    """
    made = {k: (f, f.norm, shifts(f.length, allowed)) for k, f in filters.items()}
    names = list(dict.fromkeys(["trace_id", "event_id", "channel", key]))

    def part(batches):
        for batch in batches:
            keys = batch.column("_key").to_pylist()
            for k in set(keys) & set(made):
                f, norm, tried = made[k]
                own_rows = batch.take(pa.array([i for i, x in enumerate(keys) if x == k]))
                for some, x in _blocks(own_rows, f.length):
                    series, own = f.overlap(x)
                    amps = series[:, tried] / norm
                    chi = own[:, None] - amps**2 * norm
                    at = chi.argmin(1)
                    line = np.arange(len(at))
                    yield pa.RecordBatch.from_arrays([*(own_rows.column(c).take(some) for c in names), pa.array(amps[line, at]), pa.array(chi[line, at] / (f.length - ddof)), pa.array(signed(tried[at], f.length).astype(np.int32))], [*names, "amp", "chisq", "t0"])

    kinds = ", ".join(f"{c} {traces.schema[c].dataType.simpleString()}" for c in names)
    rows = traces.select(*names, F.col(key).alias("_key"), F.col("samples").cast("array<double>").alias("samples"))
    out = rows.mapInArrow(part, f"{kinds}, amp double, chisq double, t0 int")
    return out.select(*names, F.round("amp", 6).alias("amp"), F.round("chisq", 6).alias("chisq"), "t0")


def two_templates(traces: DataFrame, f: Filter, second: np.ndarray, allowed: tuple[int, int], apart: tuple[int, int], ddof: int = 5) -> DataFrame:
    """trace_id, amp, amp2, chisq, t0, delta: two pulses at once, the first of ``f``'s shape at the shift t0, the other of the shape ``second`` at
    t0 + delta, with delta in ``apart`` (ends included).

    For every pair of shifts the two amplitudes solve 2 x 2 normal equations of inner products, which two correlations of the trace and
    one of the templates give. The first pair with the least chi2 counts, in order of delta and then of ``shifts``. Pairs at which
    the shapes are one and the same are left out. Traces of another length are left out.
    """
    n, g = f.length, Filter(np.asarray(second, float), f.psd, f.fs, f.one_sided)
    tried, n1, n2 = shifts(n, allowed), f.norm, g.norm
    mixed = g.overlap(f.template[None])[0][0]  # <first, second moved by d>

    def part(batches):
        for batch in batches:
            for some, x in _blocks(batch, n):
                one, own = f.overlap(x)
                two, _ = g.overlap(x)
                best = None
                for d in range(apart[0], apart[1] + 1):
                    c = mixed[d % n]
                    det = n1 * n2 - c * c
                    if det <= 1e-9 * n1 * n2:
                        continue
                    p, q = one[:, tried], two[:, (tried + d) % n]
                    a, b = (n2 * p - c * q) / det, (n1 * q - c * p) / det
                    chi = own[:, None] - a * p - b * q
                    at = chi.argmin(1)
                    line = np.arange(len(at))
                    new = np.stack([chi[line, at], a[line, at], b[line, at], signed(tried[at], n), np.full(len(at), d)])
                    best = new if best is None else np.where(new[0] < best[0], new, best)
                if best is not None:
                    yield pa.RecordBatch.from_arrays([batch.column("trace_id").take(some), pa.array(best[1]), pa.array(best[2]), pa.array(best[0] / (n - ddof)), pa.array(best[3].astype(np.int32)), pa.array(best[4].astype(np.int32))], ["trace_id", "amp", "amp2", "chisq", "t0", "delta"])

    out = _rows(traces).mapInArrow(part, "trace_id long, amp double, amp2 double, chisq double, t0 int, delta int")
    return out.select("trace_id", *(F.round(c, 6).alias(c) for c in ("amp", "amp2", "chisq")), "t0", "delta")


def matched(traces: DataFrame, f: Filter, floor: float = 0.0) -> DataFrame:
    """trace_id, samples: the amplitude at every (circular) shift, from 0 up. ``floor`` is added to the density, which may be 0 then."""
    f = Filter(f.template, np.nan_to_num(np.asarray(f.psd, float)) + floor, f.fs, f.one_sided) if floor else f
    n, norm = f.length, f.norm

    def part(batches):
        for batch in batches:
            for some, x in _blocks(batch, n):
                flat = (f.overlap(x)[0] / norm).ravel()
                yield pa.RecordBatch.from_arrays([batch.column("trace_id").take(some), pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * n), pa.array(flat))], ["trace_id", "samples"])

    return _rows(traces).mapInArrow(part, "trace_id long, samples array<double>")


def low_pass(traces: DataFrame, psd: np.ndarray, low: float, high: float, fs: float = 1.0) -> DataFrame:
    """trace_id, samples: the traces with each frequency weighted by 1 / density, falling to 0 from ``low`` to ``high`` along a line, and scaled so that a
    constant stays as it is. Frequencies without density are left out, but for 0, which has the next one's weight."""
    p = np.nan_to_num(np.asarray(psd, float))
    n = 2 * (len(p) - 1)
    w = np.divide(1.0, p, out=np.zeros(len(p)), where=p > 0) * np.clip((high - np.arange(len(p)) * fs / n) / (high - low), 0, 1)
    w[0] = w[0] or w[1]
    w = w / w[0]

    def part(batches):
        for batch in batches:
            for some, x in _blocks(batch, n):
                flat = np.fft.irfft(np.fft.rfft(x) * w, n).ravel()
                yield pa.RecordBatch.from_arrays([batch.column("trace_id").take(some), pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * n), pa.array(flat))], ["trace_id", "samples"])

    return _rows(traces).mapInArrow(part, "trace_id long, samples array<double>")


def sliding(series: DataFrame, f: Filter, hop: int = 1, chunk: int = 4096, ddof: int = 2) -> DataFrame:
    """channel, start, amp, chisq of every window of the template's length that starts at a multiple of ``hop``.

    ``series`` has channel, i (places from 0, without gaps) and v. A task gets a chunk of places with the head of the next
    one, so windows cross chunks and no channel is ever held whole. Null values count as 0; short channels give no row.
    The amplitudes of a chunk are one convolution; with a small hop the powers follow from window to window, else each window
    has a transform.
    """
    norm, n = f.norm, f.length

    def fits(v, first):
        starts = np.arange(-first % hop, len(v) - n + 1, hop)
        if hop <= 8:
            own = f.powers(v)[starts]
        else:
            windows = np.lib.stride_tricks.sliding_window_view(v, n)
            step = max(1, BLOCK // n)
            own = np.concatenate([np.abs(np.fft.rfft(windows[starts[at : at + step]])) ** 2 @ f.weight for at in range(0, len(starts), step)] or [np.zeros(0)])
        amp = f.correlated(v)[starts]
        return {"start": starts + first, "amp": amp, "chisq": (own - amp**2 * norm) / (n - ddof)}

    out = _chunked(series, n, chunk, fits, "start long, amp double, chisq double")
    return out.select("channel", "start", F.round("amp", 5).alias("amp"), F.round("chisq", 5).alias("chisq"))


def stepped(series: DataFrame, f: Filter, hop: int, allowed: tuple[int, int], chunk: int = 4096, ddof: int = 3) -> DataFrame:
    """channel, start, amp, chisq, t0, position of the best shift (as in ``fit_with_shift``) in each window that starts at a multiple of ``hop``; position is start + t0."""
    norm, n = f.norm, f.length
    tried = shifts(n, allowed)

    def fits(v, first):
        starts = np.arange(-first % hop, len(v) - n + 1, hop)
        windows, step, out = np.lib.stride_tricks.sliding_window_view(v, n), max(1, BLOCK // n), []
        for at in range(0, len(starts), step):
            series_, own = f.overlap(windows[starts[at : at + step]])
            amps = series_[:, tried] / norm
            chi = own[:, None] - amps**2 * norm
            best = chi.argmin(1)
            line = np.arange(len(best))
            out.append(np.stack([amps[line, best], chi[line, best] / (n - ddof), signed(tried[best], n)]))
        amp, chi, t0 = np.concatenate(out, 1) if out else np.zeros((3, 0))
        return {"start": starts + first, "amp": amp, "chisq": chi, "t0": t0.astype(np.int64), "position": starts + first + t0.astype(np.int64)}

    out = _chunked(series, n, chunk, fits, "start long, amp double, chisq double, t0 long, position long")
    return out.select("channel", "start", F.round("amp", 5).alias("amp"), F.round("chisq", 5).alias("chisq"), "t0", "position")


def convolved(series: DataFrame, f: Filter, chunk: int = 4096) -> DataFrame:
    """channel, start, amp, rest: the amplitude at every place by convolution alone, and what it leaves of the window's sum of squares (amp times the template taken away, in white noise)."""
    n, own = f.length, float(f.template @ f.template)

    def fits(v, first):
        amp = f.correlated(v)
        squares = np.concatenate([[0.0], np.cumsum(v * v)])
        return {"start": np.arange(len(amp)) + first, "amp": amp, "rest": squares[n:] - squares[:-n] - amp**2 * own}

    out = _chunked(series, n, chunk, fits, "start long, amp double, rest double")
    return out.select("channel", "start", F.round("amp", 5).alias("amp"), F.round("rest", 3).alias("rest"))


def _chunked(series: DataFrame, n: int, chunk: int, fits, kinds: str) -> DataFrame:
    """channel and what ``fits(values, first place)`` gives (a dict of arrays, columns ``kinds``) of each chunk with the head of the next one."""
    if chunk < n:
        raise ValueError("a chunk can't be shorter than the template")

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        i = table["i"].to_numpy()
        order = np.argsort(i)
        v = pc.fill_null(table["v"], 0.0).to_numpy()[order]
        if len(v) < n:
            return
        found = fits(v, int(i[order[0]]))
        many = len(found["start"])
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * many, table.schema.field("channel").type), *(pa.array(x) for x in found.values())], ["channel", *found])

    here = F.floor(F.col("i") / chunk).cast("long")
    # A window starts in one chunk only: the head that a chunk borrows has one sample less than a window.
    homes = F.explode(F.when((F.col("i") >= chunk) & (F.col("i") % chunk < n - 1), F.array(here, here - 1)).otherwise(F.array(here)))
    rows = series.select("channel", F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("v"), homes.alias("chunk"))
    kind = series.schema["channel"].dataType.simpleString()
    return rows.groupBy("channel", "chunk").applyInArrow(run, f"channel {kind}, {kinds}")
