"""Noise spectra of traces."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples that are transformed at once.
BLOCK = 1 << 20


def psd(traces: DataFrame, fs: float = 1.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """As ``density``, rounded."""
    out = density(traces, fs, keys)
    return out.withColumn("psd", F.round("psd", 8))


def density(traces: DataFrame, fs: float = 1.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, length, k, frequency, psd: the one-sided power density averaged over the traces of each length (and key); inner bins count twice.

    Each task sends one row of sums for each key, length and bin, whatever the number of its traces. Null and empty traces
    are left out; a null sample counts as 0.
    """
    names = [*keys, "length", "k", "s", "n"]

    def part(batches):
        sums: dict[tuple, list] = {}
        types = [pa.null()] * len(keys)
        for batch in batches:
            types = [batch.schema.field(j).type for j in range(len(keys))]
            column = batch.column(len(keys))
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            groups: dict[tuple, list] = {}
            marks = [batch.column(j).to_pylist() for j in range(len(keys))]
            for row, n in enumerate(sizes.tolist()):
                if n:
                    groups.setdefault((*(m[row] for m in marks), n), []).append(row)
            for key, rows in groups.items():
                n = key[-1]
                step = max(1, BLOCK // n)
                for at in range(0, len(rows), step):
                    some = column.take(pa.array(rows[at : at + step]))
                    x = pc.fill_null(some.flatten(), 0.0).to_numpy(zero_copy_only=False).reshape(-1, n)
                    power = (np.abs(np.fft.rfft(x)) ** 2).sum(0)
                    have = sums.setdefault(key, [np.zeros(len(power)), 0])
                    have[0] += power
                    have[1] += len(x)
        for key, (power, count) in sums.items():
            many = len(power)
            marks = [pa.array([value] * many, kind) for value, kind in zip(key, types)]
            yield pa.RecordBatch.from_arrays([*marks, pa.array(np.full(many, key[-1], np.int32)), pa.array(np.arange(many, dtype=np.int32)), pa.array(power), pa.array(np.full(many, count, np.int64))], names)

    kinds = "".join(f"{k} {traces.schema[k].dataType.simpleString()}, " for k in keys)
    rows = traces.select(*keys, F.col("samples").cast("array<double>")).mapInArrow(part, f"{kinds}length int, k int, s double, n long")
    once = (F.col("k") == 0) | (2 * F.col("k") == F.col("length"))
    mean = rows.groupBy(*keys, "length", "k").agg((F.sum("s") / F.sum("n")).alias("p"))
    return mean.select(*keys, "length", "k", (F.col("k") * fs / F.col("length")).alias("frequency"), (F.col("p") * F.when(once, 1.0).otherwise(2.0) / (fs * F.col("length"))).alias("psd"))


def unfolded(one_sided: DataFrame) -> DataFrame:
    """length, k, psd, weight: the two-sided density at every k below the length. Inner bins are halved and mirrored; the weight of a filter is
    1 / psd, 0 at frequency 0 (its density is infinite, given as null) and where the density is 0."""
    n, k = F.col("length"), F.col("k")
    mirror = (k > 0) & (2 * k < n)
    both = one_sided.select("length", F.explode(F.when(mirror, F.array(k, n - k)).otherwise(F.array(k))).alias("at"), F.when(k == 0, None).when(mirror, F.col("psd") / 2).otherwise(F.col("psd")).alias("psd"))
    return both.select("length", F.col("at").alias("k"), "psd", F.coalesce(F.try_divide(F.lit(1.0), "psd"), F.lit(0.0)).alias("weight"))


def welch(traces: DataFrame, segment: int, fs: float = 1.0) -> DataFrame:
    """k, frequency, psd after Welch: halves overlap, each segment loses its mean and has a periodic Hann window; traces of all lengths count together."""
    from .sequence import hop_windows

    bell = [float(x) for x in 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(segment) / segment)]
    scale = segment / sum(b * b for b in bell)
    parts = hop_windows(traces.select("trace_id", F.col("samples").cast("array<double>").alias("samples")), segment, segment // 2)
    mean = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x) / segment
    tapered = parts.withColumn("m", mean).select(F.zip_with("samples", F.array(*map(F.lit, bell)), lambda x, b: (x - F.col("m")) * b).alias("samples"))
    return density(tapered, fs).select("k", "frequency", (F.col("psd") * scale).alias("psd"))


def cross(traces: DataFrame, fs: float = 1.0) -> DataFrame:
    """a, b, k, re, im: the one-sided cross density of every two channels (a <= b), averaged over the events that have both.

    Rows are dealt by event and read event by event (as many traces as the detector has channels); a task sends one set of sums,
    so what leaves it doesn't grow with its events. Channels of another length than the event's first, null and empty traces and
    rows without an event are left out; a null sample counts as 0.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        now, held = None, []

        def close():
            n = len(held[0][1]) if held else 0
            some = [(c, np.fft.rfft(v)) for c, v in held if len(v) == n]
            for at, (a, x) in enumerate(some):
                for b, y in some[at:]:
                    have = sums.setdefault((a, b, n), [np.zeros(len(x), complex), 0])
                    have[0] += np.conj(x) * y
                    have[1] += 1

        for batch in batches:
            for event, channel, samples in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if event != now:
                    close()
                    now, held = event, []
                if channel is not None and samples.is_valid and len(samples):
                    held.append((channel, pc.fill_null(samples.values, 0.0).to_numpy(zero_copy_only=False)))
        close()
        for (a, b, n), (z, count) in sums.items():
            m = len(z)
            yield pa.RecordBatch.from_pydict({"a": np.full(m, a), "b": np.full(m, b), "length": np.full(m, n, np.int32), "k": np.arange(m, dtype=np.int32), "re": z.real.copy(), "im": z.imag.copy(), "n": np.full(m, count)})

    rows = traces.where("event_id is not null").select("event_id", F.col("channel").cast("long").alias("channel"), F.col("samples").cast("array<double>").alias("samples"))
    parts = rows.repartition("event_id").sortWithinPartitions("event_id", "channel").mapInArrow(part, "a long, b long, length int, k int, re double, im double, n long")
    sums = parts.groupBy("a", "b", "length", "k").agg((F.sum("re") / F.sum("n")).alias("re"), (F.sum("im") / F.sum("n")).alias("im"))
    twice = F.when((F.col("k") == 0) | (2 * F.col("k") == F.col("length")), 1.0).otherwise(2.0) / (fs * F.col("length"))
    return sums.select("a", "b", "k", (F.col("re") * twice + 0.0).alias("re"), (F.col("im") * twice + 0.0).alias("im"))


def of_sum(densities: DataFrame) -> DataFrame:
    """k, psd of the sum of all channels from their cross densities: the densities and twice the real cross densities. With channels that don't correlate it is the sum of their densities."""
    return densities.groupBy("k").agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("re")).otherwise(2 * F.col("re"))).alias("psd"))


def transforms(traces: DataFrame, fs: float = 1.0, window: str = "none") -> DataFrame:
    """trace_id, k, re, im: the transform of each trace at the frequencies from 0 up, divided by fs; with ``hann`` after a periodic Hann window.

    Null and empty traces are left out; a null sample counts as 0.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            for n in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == n)
                step = max(1, BLOCK // n)
                bell = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n) if window == "hann" else 1.0
                for at in range(0, len(rows), step):
                    some = pa.array(rows[at : at + step])
                    z = np.fft.rfft(pc.fill_null(column.take(some).flatten(), 0.0).to_numpy(zero_copy_only=False).reshape(-1, n) * bell) / fs
                    ids = batch.column(0).take(pa.array(np.repeat(rows[at : at + step], z.shape[1])))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(z.shape[1], dtype=np.int32), len(z))), pa.array(z.real.ravel()), pa.array(z.imag.ravel())], ["trace_id", "k", "re", "im"])

    return traces.select("trace_id", F.col("samples").cast("array<double>")).mapInArrow(part, f"trace_id {traces.schema['trace_id'].dataType.simpleString()}, k int, re double, im double")


def whitened(spectrum: DataFrame, density_: DataFrame) -> DataFrame:
    """The spectrum (k, re, im) divided by the root of the density (k, psd); null where the density is 0 or there is none."""
    root = F.sqrt(F.nullif("psd", F.lit(0.0)))
    names = [c for c in spectrum.columns if c not in ("re", "im")]
    return spectrum.join(density_.select("k", "psd"), "k", "left").select(*names, (F.col("re") / root).alias("re"), (F.col("im") / root).alias("im"))


def signal_to_noise(spectrum: DataFrame, density_: DataFrame) -> DataFrame:
    """The spectrum's columns with snr, its power over the density at each k; null where the density is 0 or there is none."""
    names = [c for c in spectrum.columns if c not in ("re", "im")]
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    return spectrum.join(density_.select("k", "psd"), "k", "left").select(*names, F.try_divide(power, F.col("psd")).alias("snr"))


def relative(density_: DataFrame, *keys: str) -> DataFrame:
    """The density divided by its largest value (of each key); one without a value above 0 gives nulls. A spectrum is one array long."""
    from pyspark.sql.window import Window

    top = F.max("psd").over(Window.partitionBy(*(keys or [F.lit(0)])))
    return density_.withColumn("psd", F.col("psd") / F.when(top > 0, top))


def detrended(traces: DataFrame) -> DataFrame:
    """The traces less their means."""
    v = F.col("samples").cast("array<double>")
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))) / F.size(v)
    return traces.withColumn("_mean", mean).withColumn("samples", F.transform(v, lambda x: x - F.col("_mean"))).drop("_mean")


#: The power of the frequency that the density of each noise colour is proportional to.
COLOURS = {"white": 0, "pink": -1, "brown": -2, "blue": 1, "violet": 2}


def coloured(frequencies: DataFrame, colour: str, total: float) -> DataFrame:
    """k, frequency, psd of a noise colour at the frequencies (k, frequency), scaled to a total power (the sum); frequency 0 has none."""
    raw = F.when(F.col("frequency") > 0, F.pow("frequency", F.lit(float(COLOURS[colour])))).otherwise(0.0)
    rows = frequencies.select("k", "frequency", raw.alias("psd"))
    return rows.join(F.broadcast(rows.agg(F.sum("psd").alias("_all")))).select("k", "frequency", (F.col("psd") * total / F.col("_all")).alias("psd"))
