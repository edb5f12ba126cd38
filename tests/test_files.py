import numpy as np
import pytest
import zstandard
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from pulsework.sources import raw, store, traces


def write_raw(path, data):
    n, many = data.shape
    head = np.zeros(1, traces.FILE)
    head["version"], head["size_data_header"], head["size_scope_settings"] = b"v7", 36, traces.SCOPE.itemsize
    head["samples_per_block"], head["bytes_per_sample"] = many, data.dtype.itemsize
    scope = np.zeros(1, traces.SCOPE)
    scope["xfac"] = 0.25
    rows = np.zeros(n, np.dtype([*traces.RECORD, ("samples", data.dtype, (many,))]))
    rows["trace_no"], rows["temperature"], rows["samples"] = np.arange(n) + 5, 1.5, data
    path.write_bytes(head.tobytes() + scope.tobytes() + rows.tobytes() + b"cut")


@pytest.mark.parametrize("kind", ["<u2", "<u4"])
def test_raw_files(spark, tmp_path, kind):
    data = np.random.default_rng(1).integers(0, 60000, (7, 12)).astype(kind)
    write_raw(tmp_path / "a.raw", data)
    head = raw.daq_files(spark, str(tmp_path)).first()
    assert (head.version, head.n_traces, head.samples_per_block, head.xfac) == ("v7", 7, 12, 0.25)
    rows = raw.daq_traces(spark, str(tmp_path)).orderBy("place").collect()
    assert [r.samples for r in rows] == data.tolist() and [r.trace_no for r in rows] == list(range(5, 12)) and rows[0].temperature == 1.5


@pytest.mark.parametrize("whole", [False, True])
def test_tensors(spark, tmp_path, whole):
    data = np.random.default_rng(2).normal(size=(3, 2, 8)).astype(np.float16)
    shuffled = lambda a: a.view(np.uint8).reshape(-1, 2).T.tobytes()
    raw = shuffled(data.reshape(-1)) if whole else b"".join(shuffled(s.reshape(-1)) for s in data)
    (tmp_path / "traces_energy_40.zst").write_bytes(zstandard.ZstdCompressor().compress(raw))
    rows = traces.read_tensors(spark, str(tmp_path), (2, 8), whole).orderBy("set", "channel").collect()
    assert np.array_equal(np.array([r.samples for r in rows], np.float16).reshape(3, 2, 8), data) and {r.energy for r in rows} == {40}
    with pytest.raises(PythonException):
        traces.read_tensors(spark, str(tmp_path), (2, 7)).collect()


def test_text_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("1,2.5,x\n\n4\n")
    assert sorted((r.samples for r in traces.csv_traces(spark, str(tmp_path / "t.csv")).collect()), key=len) == [[4.0], [1.0, 2.5, None]]
    (tmp_path / "s_20eV.txt").write_text("# f v\n 1.0  2e-3\n2\t3\n\n")
    rows = traces.spectra(spark, str(tmp_path / "s_20eV.txt"))
    assert sorted((r.frequency, r.value) for r in rows.collect()) == [(1.0, 0.002), (2.0, 3.0)]
    assert rows.select(traces.energy_of(F.col("path")).alias("e")).distinct().collect() == [(20,)]


def test_versions(spark, tmp_path):
    base = str(tmp_path)
    for run, value in ((12, 1), (12, 2), (3, 7)):
        store.write_versioned(spark.createDataFrame([(value,)], "v int"), base, "rqs", run, {"low": 0.1, "v": value})
    assert sorted((r.run_id, r.v) for r in store.read_latest(spark, base, "rqs").collect()) == [("000003", 7), ("000012", 2)]
    assert [r.v for r in store.read_latest(spark, base, "rqs", 12).collect()] == [2]
    assert store.config_key({"a": 1, "b": 2}) == store.config_key({"b": 2, "a": 1})
    work = spark.createDataFrame([(5,), (7,)], "v int")
    assert store.still_to_do(work, store.read_latest(spark, base, "rqs"), "v").collect() == [(5,)]


def test_written_traces_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, 20, [1.0, 2.0]), (2, 40, None)], "trace_id long, energy int, samples array<double>")
    traces.write_traces(df, str(tmp_path / "t"), "energy")
    assert spark.read.parquet(str(tmp_path / "t")).select(df.columns).orderBy("trace_id").collect() == df.collect()


def test_tensors_written_and_read(spark, tmp_path):
    r = np.random.default_rng(4)
    data = {(e, s, c): r.normal(size=8).astype(np.float16).astype(float).tolist() for e in (20, 40) for s in range(5) for c in range(3)}
    df = spark.createDataFrame([(*k, v) for k, v in data.items()], "energy int, set long, channel int, samples array<double>").repartition(3)
    names = traces.write_tensors(df, str(tmp_path / "t"), (3, 8), sets_a_file=2)
    assert len(names) == 6 and [n[-9:] for n in names] == ["_20eV.zst", "_40eV.zst"] * 3
    back = {(x.energy, int(x.path.split("_")[-3]) * 2 + x.set, x.channel): x.samples for x in traces.read_tensors(spark, str(tmp_path / "t"), (3, 8)).collect()}
    assert back == data
    series = df.where("energy = 20 and set = 0")  # one table of amplitudes of each channel
    assert len(traces.write_tensors(series, str(tmp_path / "a"), (3, 8))) == 1 and traces.read_tensors(spark, str(tmp_path / "a"), (3, 8)).count() == 3
    for odd in (df.where("set <> 1 or channel <> 2"), df.withColumn("samples", F.slice("samples", 1, 7)), df.withColumn("channel", F.col("channel") + 1)):
        with pytest.raises(PythonException, match="hasn't"):
            traces.write_tensors(odd, str(tmp_path / "odd"), (3, 8))
