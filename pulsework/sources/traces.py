"""Readers and writers of trace files. Files are spread over the tasks; a compressed file is one row of at most 2 GB, decoded in batches. Raw files are in ``raw``."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The raw file format (fixed values): file header, scope settings and the header before each record's samples, little endian.
FILE = np.dtype([
    ("version", "S22"), ("reserved", "S14"), ("reserved_2", "S4"), ("data_set_revision", "<u2"), ("size_file_header", "<u2"), ("size_data_header", "<u2"), ("size_scope_settings", "<u2"),
    ("samples_per_block", "<u4"), ("baseline_acq_ratio", "<u4"), ("bytes_per_sample", "<u2"), ("source", "<u2", 2), ("start_of_acquisition", "<u4"), ("max_pixel", "<i4"), ("min_pixel", "<i4"),
])
SCOPE = np.dtype([
    ("trigger_holdoff", "<f4"), ("trigger_source", "<u2", 2), ("trigger_level", "<f4", 2), ("trigger_slope", "<u2", 2), ("bits_per_sample", "<u2", 2), ("coupling", "<u2", 2), ("impedance", "<u2", 2),
    ("oversampling", "<u2"), ("xfac", "<f8"), ("xofs", "<f8"), ("yfac", "<f8", 2), ("yofs", "<f8", 2),
])
RECORD = [("text", "S6"), ("trace_no", "<u4"), ("time_stamp", "<u4"), ("sec100", "<u2"), ("temperature", "<f4"), ("xref", "<f8"), ("yref", "<f8")]


def energy_of(path: Column) -> Column:
    """The number before ``eV`` in a file name (``..._40eV...`` or ``..._40.zst``); -1 where there is none."""
    found = F.regexp_extract(path, r"_(\d+)(?:eV|\.)", 1)
    return F.when(found == "", F.lit(-1)).otherwise(found.try_cast("int"))


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def csv_traces(spark: SparkSession, path: str) -> DataFrame:
    """path, samples: a line of numbers with commas is a trace, .gz too. Empty lines are left out, what is no number is null."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.col("_metadata.file_path").alias("path"), F.transform(F.split("value", ","), lambda x: F.trim(x).try_cast("double")).alias("samples"))


def spectra(spark: SparkSession, path: str) -> DataFrame:
    """path, frequency, value: two columns of numbers with white space between them; lines of another form are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.get(parts, F.lit(0)).try_cast("double").alias("frequency"), F.get(parts, F.lit(1)).try_cast("double").alias("value"))
    return rows.where("frequency is not null and value is not null")


def packed_vectors(rows: DataFrame, column: str) -> DataFrame:
    """The rows with ``vector`` (the lines of a packed string) and ``last`` (its last line); null strings give null."""
    return rows.withColumn("vector", F.split(column, "\n")).withColumn("last", F.try_element_at("vector", F.lit(-1)))


def read_tensors(spark: SparkSession, path: str, shape: tuple[int, int], whole: bool = False) -> DataFrame:
    """path, energy, set, channel, samples of zstd files of float16 tensors with shuffled bytes: first all low bytes, then all high ones, of each
    set (of the whole file with ``whole``). ``shape`` is (channels, samples) of one set. Raises where the size isn't a multiple of a set."""
    channels, many = shape

    def part(batches):
        import zstandard

        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                raw = np.frombuffer(zstandard.ZstdDecompressor().decompressobj().decompress(content), np.uint8)
                size = channels * many * 2
                if len(raw) % size:
                    raise ValueError(f"{name}: {len(raw)} bytes are no multiple of {size}")
                sets = len(raw) // size
                planes = raw.reshape(2, -1) if whole else None
                for s in range(sets):
                    two = planes[:, s * size // 2 : (s + 1) * size // 2] if whole else raw[s * size : (s + 1) * size].reshape(2, -1)
                    values = np.ascontiguousarray(two.T).reshape(-1).view("<f2").astype(np.float32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(channels + 1, dtype=np.int32) * many), pa.array(values))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * channels), pa.array(np.full(channels, s)), pa.array(np.arange(channels)), lists], ["path", "set", "channel", "samples"])

    rows = _binary(spark, path).mapInArrow(part, "path string, set long, channel long, samples array<float>")
    return rows.select("path", energy_of(F.col("path")).alias("energy"), "set", "channel", "samples")


def write_tensors(traces: DataFrame, path: str, shape: tuple[int, int], sets_a_file: int = 256, level: int = 15) -> list[str]:
    """Writes rows (energy, set, channel, samples) as files of shuffled half-precision bytes, each of the sets of one energy, which ``read_tensors`` reads; returns their paths.

    ``shape`` is (channels, samples). A set without just these channels, numbered from 0, or with a trace of another length raises, as does a null
    sample; then files of other sets may be there already. A task holds the sets of one file; a file is moved into place when it is whole.
    Values outside half precision become infinite.
    """
    from .raw import _system, qualified  # which reads the formats above

    channels, many = shape
    root = qualified(traces.sparkSession, path)

    def write(key, table):
        import zstandard

        energy, block = key[0].as_py(), key[1].as_py()
        table = table.sort_by([("set", "ascending"), ("channel", "ascending")])
        sets = np.unique(table["set"].to_numpy())
        samples = table["samples"].combine_chunks()
        if len(table) != len(sets) * channels or (table["channel"].to_numpy().reshape(-1, channels) != np.arange(channels)).any():
            raise ValueError(f"a set of energy {energy} hasn't the channels 0 to {channels - 1}")
        if (pc.fill_null(pc.list_value_length(samples), -1).to_numpy() != many).any() or samples.flatten().null_count:
            raise ValueError(f"a trace of energy {energy} hasn't {many} samples")
        with np.errstate(over="ignore"):
            x = samples.flatten().to_numpy().astype(np.float16).reshape(len(sets), -1)
        raw = x.view(np.uint8).reshape(len(sets), -1, 2).transpose(0, 2, 1).tobytes()
        fs, inner = _system(root)
        fs.create_dir(inner)
        name = f"{inner.rstrip('/')}/traces_{block:06d}_energy_{energy}eV.zst"
        part = f"{inner.rstrip('/')}/_{uuid.uuid4().hex}"  # readers pass over such a name
        with fs.open_output_stream(part) as f:
            f.write(zstandard.ZstdCompressor(level=level).compress(raw))
        fs.move(part, name)
        return pa.table({"path": [name]})

    rows = traces.select(F.col("energy").cast("long").alias("energy"), F.floor(F.col("set") / sets_a_file).cast("long").alias("block"), F.col("set").cast("long").alias("set"), F.col("channel").cast("long").alias("channel"), F.col("samples").cast("array<double>").alias("samples"))
    return sorted(r.path for r in rows.groupBy("energy", "block").applyInArrow(write, "path string").collect())  # a name for each file


def write_traces(traces: DataFrame, path: str, *partitions: str) -> None:
    """Parquet with zstd, one folder for each value of the partition columns: the codec and layout take the place of shuffled byte files."""
    traces.write.mode("overwrite").option("compression", "zstd").partitionBy(*partitions).parquet(path)


def read_traces(spark: SparkSession, path: str, kind: str | None = None, shape: tuple[int, int] | None = None) -> DataFrame:
    """Traces of a path by its extension (or ``kind``): raw, csv (.csv, .csv.gz), zst (needs the ``shape`` of a set), else parquet. Pickles are refused: reading one runs it."""
    from . import raw

    kind = kind or next((k for k in ("raw", "csv", "csv.gz", "zst", "pkl") if path.endswith("." + k)), "parquet")
    if kind == "pkl":
        raise ValueError("pickles aren't read; write the traces as parquet")
    if kind == "zst" and shape is None:
        raise ValueError("tensors need a shape")
    readers = {"raw": raw.daq_traces, "csv": csv_traces, "csv.gz": csv_traces, "zst": lambda s, p: read_tensors(s, p, shape), "parquet": lambda s, p: s.read.parquet(p)}
    return readers[kind](spark, path)


def read_quantities(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of reduced quantities as CSV with a header; columns are taken by their names in the header, what doesn't fit the type is null."""
    names = spark.read.option("header", True).csv(path)
    wanted = spark.createDataFrame([], schema).schema
    return names.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in wanted))


def write_table(rows: DataFrame, path: str, *partitions: str, csv: bool = False) -> None:
    """Fits, quantities or amplitude series: parquet, one folder for each value of the partition columns; or CSV with a header."""
    writer = rows.write.mode("overwrite").partitionBy(*partitions)
    writer.option("header", True).csv(path) if csv else writer.option("compression", "zstd").parquet(path)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """path, i, x, value of arrays in .npy files: of one dimension (x is null), or two rows, frequencies and values. Other shapes and pickled objects raise."""

    def part(batches):
        import io

        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist()):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                if a.ndim != 1 and a.shape[:1] != (2,) or a.ndim > 2:
                    raise ValueError(f"{name}: an array of shape {a.shape} is no template or spectrum")
                y = a if a.ndim == 1 else a[1]
                x = pa.nulls(len(y), pa.float64()) if a.ndim == 1 else pa.array(a[0].astype(float))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(y)), pa.array(np.arange(len(y))), x, pa.array(y.astype(float))], ["path", "i", "x", "value"])

    return _binary(spark, path).mapInArrow(part, "path string, i long, x double, value double")


def last_vectors(rows: DataFrame, column: str, order: str, sensor: str) -> DataFrame:
    """``packed_vectors`` of the rows whose sensor number is 0 or more, in the order of the column ``order``."""
    return packed_vectors(rows.where(F.col(sensor) > -1), column).orderBy(order)
