"""Compressed records and live chunks: round trips, half-written chunks, restarts."""

import numpy as np
import pyarrow as pa
import pytest

from pulsework.sources import lz4
from pulsework.streaming import chunks
from tests.test_files import write_raw


def compressed(path, raw):
    with pa.OSFile(str(path), "wb") as f, pa.CompressedOutputStream(f, "lz4") as out:
        out.write(raw)


@pytest.mark.parametrize("odd", [b"", b"x"])
def test_lz4_records(spark, tmp_path, monkeypatch, odd):
    monkeypatch.setattr(lz4, "PIECE", 1000)
    r = np.random.default_rng(2)
    data = {name: r.integers(-30000, 30000, n).astype("<i2") for name, n in (("a.lz4", 5003), ("b.lz4", 64), ("c.lz4", 0))}
    for name, x in data.items():
        compressed(tmp_path / name, x.tobytes() + odd)
    rows = lz4.lz4_records(spark, str(tmp_path), 64)
    assert rows.rdd.getNumPartitions() == 3
    found = {}
    for x in rows.orderBy("path", "record").collect():
        assert x.start == 64 * x.record and len(x.samples) == min(64, len(data[x.path[-5:]]) - x.start)
        found.setdefault(x.path[-5:], []).extend(x.samples)
    assert found == {k: v.tolist() for k, v in data.items() if len(v)}
    (tmp_path / "d.lz4").write_bytes(b"no frame at all")
    with pytest.raises(Exception, match="(?i)lz4"):
        lz4.lz4_records(spark, str(tmp_path / "d.lz4")).collect()


def test_chunks_that_become_ready(spark, tmp_path):
    data = np.random.default_rng(1).integers(0, 60000, (6, 12)).astype("<u2")
    live, mark = tmp_path / "live", str(tmp_path / "mark")
    live.mkdir()

    def chunk(k, done=True):
        write_raw(live / f"chunk-{k:06d}.raw", data + k)
        if done:
            (live / f"chunk-{k:06d}.done").touch()

    got = []

    def start():
        put = lambda batch, _: got.extend((r.path[-10:], r.place, r.samples) for r in batch.collect())
        return chunks.live(spark, str(live), 4).writeStream.foreachBatch(put).option("checkpointLocation", mark).start()

    chunk(0)
    chunk(1, done=False)  # still being written
    chunk(2)  # has to wait for the one before
    query = start()
    query.processAllAvailable()
    whole = lambda k: [(f"{k:06d}.raw", i, row) for i, row in enumerate((data + k).tolist())]
    assert sorted(got) == whole(0) and not chunks.finished(spark, str(live))
    (live / "chunk-000001.done").touch()
    query.processAllAvailable()
    query.stop()
    assert sorted(got) == whole(0) + whole(1) + whole(2)
    chunk(3)
    chunk(4, done=False)
    (live / "_END").touch()
    query = start()  # from the checkpoint: nothing comes twice
    query.processAllAvailable()
    query.stop()
    assert sorted(got) == whole(0) + whole(1) + whole(2) + whole(3) and chunks.finished(spark, str(live))
