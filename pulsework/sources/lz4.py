"""Compressed sample files (an LZ4 frame of 16-bit integers) as a data source that decodes a file in pieces.

A frame can't be entered in the middle, so a file is one partition; it is read as a stream, and no more than a few records of it are
held. Options: ``path`` (as for raw files) and ``length`` (samples of a record).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .raw import _files, _open, qualified

#: Samples of a record, and bytes that are decoded at a time.
LENGTH, PIECE = 1 << 16, 1 << 22
ROWS = "path string, record long, start long, samples array<short>"


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class Lz4Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.length = options["path"], int(options.get("length", LENGTH))
        if self.length < 1:
            raise ValueError("length has to be 1 at least")

    def partitions(self):
        return [File(p) for p in _files(self.root)]

    def read(self, part: File | None):
        if part is None:
            return
        record, held = 0, b""
        with _open(self.root, part.path) as f, pa.CompressedInputStream(f, "lz4") as stream:
            while piece := stream.read(PIECE):
                held += piece
                many = len(held) // (2 * self.length)
                if many:
                    yield self._rows(part.path, record, held[: 2 * self.length * many], many)
                    record, held = record + many, held[2 * self.length * many :]
        if len(held) > 1:
            yield self._rows(part.path, record, held[: len(held) // 2 * 2], 1)

    def _rows(self, path: str, record: int, raw: bytes, many: int) -> pa.RecordBatch:
        x = np.frombuffer(raw, "<i2")
        ends = np.minimum(np.arange(many + 1) * self.length, len(x)).astype(np.int32)
        records = np.arange(record, record + many)
        return pa.RecordBatch.from_arrays([pa.array([path] * many), pa.array(records), pa.array(records * self.length), pa.ListArray.from_arrays(pa.array(ends), pa.array(x))], ["path", "record", "start", "samples"])


class Lz4Records(DataSource):
    @classmethod
    def name(cls):
        return "lz4_records"

    def schema(self):
        return ROWS

    def reader(self, schema):
        return Lz4Reader(self.options)


def lz4_records(spark: SparkSession, path: str, length: int = LENGTH) -> DataFrame:
    """path, record (from 0), start (its first sample's place), samples: the records of ``length`` samples of each file; the last may be shorter, a single
    byte at the end is no sample. A file that isn't an LZ4 frame raises, one that is empty inside has no rows."""
    spark.dataSource.register(Lz4Records)
    return spark.read.format("lz4_records").options(path=qualified(spark, path), length=length).load()
