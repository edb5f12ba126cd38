"""Raw trace files as a data source: records have one size, so a task reads a range of them and nothing else of the file.

``spark.dataSource.register(RawTraces)`` is done by the functions below. Options: ``path`` (a file or a folder, as a URI that Arrow's
file systems read; without a scheme, a local one), ``first`` and ``last`` (places, both inclusive), ``file`` (of a folder, the
files of this name), ``records`` (records of a partition), ``part`` (``records`` or ``header``) and ``pushdown``. Partitions are
planned from the options, so a point read opens one file at one place, in any session. Where the session has
``spark.sql.python.filterPushdown.enabled``, the functions also ask for ``pushdown``: filters on place and path then narrow the same plan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThanOrEqual, InputPartition, LessThanOrEqual

from .traces import FILE, RECORD, SCOPE

HEADER = "path string, version string, samples_per_block long, bytes_per_sample long, start_of_acquisition long, n_traces long, xfac double, xofs double"
ROWS = "path string, place long, text string, trace_no long, time_stamp long, sec100 long, temperature double, xref double, yref double, samples array<long>"
RECORDS = 4096


class Range(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    fs, inner = _system(path)
    info = fs.get_file_info(inner)
    found = fs.get_file_info(pafs.FileSelector(inner, recursive=True)) if info.type == pafs.FileType.Directory else [info]
    return sorted(f.path for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")))


def _open(root: str, path: str):
    return _system(root)[0].open_input_file(path)


def _head(f):
    """(header, scope settings, samples of a record, type of a record, where they start, how many there are). Raises on a file shorter than its headers."""
    raw = f.read_at(FILE.itemsize + SCOPE.itemsize, 0)
    if len(raw) < FILE.itemsize + SCOPE.itemsize:
        raise ValueError("the file is shorter than its headers")
    head, scope = np.frombuffer(raw, FILE, 1)[0], np.frombuffer(raw, SCOPE, 1, FILE.itemsize)[0]
    many = int(head["samples_per_block"])
    kind = np.dtype([*RECORD, ("samples", {2: "<u2", 4: "<u4"}[int(head["bytes_per_sample"])], (many,))])
    start = FILE.itemsize + int(head["size_scope_settings"])
    return head, scope, many, kind, start, (f.size() - start) // kind.itemsize


class RawReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.header = options["path"], options.get("part", "records") == "header"
        self.records, self.low, self.high, self.paths = int(options.get("records", RECORDS)), int(options.get("first", 0)), None, None
        if options.get("last") is not None:
            self.high = int(options["last"])
        if self.records < 1 or self.low < 0:
            raise ValueError("records has to be 1 at least, and first 0")
        self.file = options.get("file")

    def partitions(self):
        out = []
        for path in _files(self.root):
            if self.paths is not None and path not in self.paths or self.file is not None and path.rsplit("/", 1)[-1] != self.file:
                continue
            if self.header:
                out.append(Range(path, 0, 0))
                continue
            with _open(self.root, path) as f:
                n = _head(f)[-1]
            last = n if self.high is None else min(n, self.high + 1)
            out += [Range(path, at, min(at + self.records, last)) for at in range(self.low, last, self.records)]
        return out

    def read(self, part: Range | None):
        if part is None:  # what Spark makes of an empty plan
            return
        with _open(self.root, part.path) as f:
            head, scope, many, kind, start, n = _head(f)
            if self.header:
                yield pa.RecordBatch.from_pydict({
                    "path": [part.path], "version": [head["version"].decode("latin-1")], "samples_per_block": [many], "bytes_per_sample": [int(head["bytes_per_sample"])],
                    "start_of_acquisition": [int(head["start_of_acquisition"])], "n_traces": [n], "xfac": [float(scope["xfac"])], "xofs": [float(scope["xofs"])],
                })
                return
            step = max(1, (1 << 22) // kind.itemsize)
            for at in range(part.first, part.last, step):
                rows = np.frombuffer(f.read_at(min(step, part.last - at) * kind.itemsize, start + at * kind.itemsize), kind)
                fields = [pa.array([part.path] * len(rows)), pa.array(np.arange(at, at + len(rows))), pa.array([t.decode("latin-1") for t in rows["text"].tolist()])]
                fields += [pa.array(rows[c].astype(np.int64)) for c in ("trace_no", "time_stamp", "sec100")] + [pa.array(rows[c].astype(float)) for c in ("temperature", "xref", "yref")]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * many), pa.array(rows["samples"].astype(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([*fields, lists], ["path", "place", "text", "trace_no", "time_stamp", "sec100", "temperature", "xref", "yref", "samples"])


class PushedReader(RawReader):
    """The same with filters on place and path, which Spark refuses of any reader unless the session allows them."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThanOrEqual)) and f.attribute == ("place",):
                self.low = max(self.low, int(f.value))
            if isinstance(f, (EqualTo, LessThanOrEqual)) and f.attribute == ("place",):
                self.high = int(f.value) if self.high is None else min(self.high, int(f.value))
            if isinstance(f, EqualTo) and f.attribute == ("path",):
                self.paths = {f.value} & (self.paths or {f.value})
            yield f  # rows are tested again


class RawTraces(DataSource):
    @classmethod
    def name(cls):
        return "daq_raw"

    def schema(self):
        return HEADER if self.options.get("part") == "header" else ROWS

    def reader(self, schema):
        return (PushedReader if self.options.get("pushdown") == "true" else RawReader)(self.options)


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI; without a scheme it is one of the session's default file system, as in Spark's own readers."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return "file://" + whole.removeprefix("file:") if whole.startswith("file:/") and not whole.startswith("file://") else whole


def _reader(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(RawTraces)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("daq_raw").options(path=qualified(spark, path), pushdown=pushdown, **{k: v for k, v in options.items() if v is not None}).load()


def daq_traces(spark: SparkSession, path: str, records: int = RECORDS, first: int | None = None, last: int | None = None, file: str | None = None) -> DataFrame:
    """path, place (from 0), text, trace_no, time_stamp, sec100, temperature, xref, yref, samples of every complete record; an incomplete last one is left out.

    ``first`` and ``last`` bound the places that are read (both inclusive), ``file`` is the name of the only file of a folder to be read.
    """
    return _reader(spark, path, records=records, first=first, last=last, file=file)


def daq_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each raw file: path, its header, and xfac, xofs (seconds a sample and start); only the headers are read."""
    return _reader(spark, path, part="header")


def daq_record(spark: SparkSession, path: str, place: int, file: str | None = None) -> DataFrame:
    """The record at one place of a file (of each file of a folder, or of the named one); no other record is read. A place past the end gives no row."""
    return daq_traces(spark, path, first=int(place), last=int(place), file=file)
