"""A live source of raw trace files in numbered chunks.

``chunk-000007.raw`` counts once ``chunk-000007.done`` stands beside it, so a file that is still being written is waited for, as is any
chunk after a missing one. ``_END`` says that no more will come: chunks without a marker are then left out for good, and ``finished`` holds.
Offsets are numbers of chunks: a query that starts again from its checkpoint reads each chunk once.
"""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from ..sources.raw import RECORDS, ROWS, Range, RawReader, _head, _open, _system, qualified


def _name(root: str, chunk: int, kind: str) -> str:
    return f"{_system(root)[1].rstrip('/')}/chunk-{chunk:06d}.{kind}"


def _is_file(root: str, path: str) -> bool:
    return _system(root)[0].get_file_info(path).type == pafs.FileType.File


class ChunkReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.records = options["path"], int(options.get("records", RECORDS))
        self.reader, self.next = RawReader(options), 0

    def initialOffset(self) -> dict:
        return {"chunk": 0}

    def ready(self, chunk: int) -> bool:
        return _is_file(self.root, _name(self.root, chunk, "done"))

    def latestOffset(self) -> dict:
        """The first chunk that isn't ready. Markers have to stay: a new run looks for them from the first chunk on."""
        while self.ready(self.next):
            self.next += 1
        return {"chunk": self.next}

    def partitions(self, start: dict, end: dict):
        self.next = max(self.next, end["chunk"])
        out = []
        for chunk in range(start["chunk"], end["chunk"]):
            path = _name(self.root, chunk, "raw")
            with _open(self.root, path) as f:
                n = _head(f)[-1]
            out += [Range(path, at, min(at + self.records, n)) for at in range(0, n, self.records)]
        return out

    def read(self, part: Range | None):
        return self.reader.read(part)


class LiveChunks(DataSource):
    @classmethod
    def name(cls):
        return "live_chunks"

    def schema(self):
        return ROWS

    def streamReader(self, schema):
        return ChunkReader(self.options)


def live(spark: SparkSession, path: str, records: int = RECORDS) -> DataFrame:
    """A stream of the records of ready chunks, with the columns of ``raw.daq_traces``; a batch has all chunks that have become ready. A chunk that is marked
    but shorter than its headers raises."""
    spark.dataSource.register(LiveChunks)
    return spark.readStream.format("live_chunks").options(path=qualified(spark, path), records=records).load()


def finished(spark: SparkSession, path: str) -> bool:
    """Whether the writer has said that no more chunks will come."""
    root = qualified(spark, path)
    return _is_file(root, f"{_system(root)[1].rstrip('/')}/_END")
