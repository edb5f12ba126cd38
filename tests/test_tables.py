from graphlib import CycleError

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsework.functions import features, tables
from pulsework.sources import raw, traces
from tests.test_files import write_raw


def test_tables_on_demand(spark):
    src = spark.range(6).select("id", (F.col("id") % 2).alias("k"))
    made = []
    count = tables.Table("count", lambda t, o: made.append(1) or t["src"].where(F.col("id") >= o["low"]).groupBy("k").agg(F.count("*").alias("n")), ("src",), ("k", "n"), defaults={"low": 0})
    top = tables.Table("top", lambda t, o: t["count"].agg(F.max("n").alias("n")), ("count",))
    run = tables.Run({"src": src}, [count, top], {"count": {"low": 1}})
    run.views("top", "count")
    assert run.table("top").first().n == 3 and len(made) == 1 and spark.sql("SELECT sum(n) AS s FROM count").first().s == 5
    with pytest.raises(KeyError):
        run.table("none")
    with pytest.raises(TypeError):
        tables.Run({"src": src}, [count], {"count": {"low": "x"}}).table("count")
    with pytest.raises(ValueError, match="circle"):
        tables.Run({}, [tables.Table("a", None, ("b",)), tables.Table("b", None, ("a",))]).table("a")
    with pytest.raises(ValueError, match="lacks"):
        tables.Run({"src": src}, [tables.Table("c", lambda t, o: t["src"], ("src",), ("z",))]).table("c")


def test_features_of_each_other_are_a_circle(spark, monkeypatch):
    monkeypatch.setattr(features, "REGISTRY", {n: features.Feature(n, lambda o: F.lit(1), (m,)) for n, m in (("a", "b"), ("b", "a"))})
    with pytest.raises(CycleError):
        features.with_features(spark.range(1), {"a": {}})
    with pytest.raises(KeyError):
        features.with_features(spark.range(1), {"none": {}})


def test_mapped_traces_and_events(spark):
    df = spark.createDataFrame([(i, i // 2, float(i)) for i in range(6)], "trace_id long, event_id long, v double")
    assert tables.by_trace(df, lambda f: f[["trace_id"]].assign(w=f.v * 2), "trace_id long, w double").agg(F.sum("w")).first()[0] == 30
    assert tables.by_event(df, lambda f: f.groupby("event_id", as_index=False).v.sum(), "event_id long, v double").count() == 3


@pytest.mark.parametrize("pushdown", [None, "true"])
@pytest.mark.parametrize("kind", ["<u2", "<u4"])
def test_raw_source_by_ranges(spark, tmp_path, kind, pushdown, request):
    data = np.random.default_rng(1).integers(0, 60000, (23, 12)).astype(kind)
    write_raw(tmp_path / "a.raw", data)
    write_raw(tmp_path / "b.raw", data[:5])
    if pushdown:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", pushdown)
        request.addfinalizer(lambda: spark.conf.unset("spark.sql.python.filterPushdown.enabled"))
    assert {(x.version, x.n_traces, x.samples_per_block) for x in raw.daq_files(spark, str(tmp_path)).collect()} == {("v7", 23, 12), ("v7", 5, 12)}
    rows = raw.daq_traces(spark, str(tmp_path / "a.raw"), records=4)
    assert rows.rdd.getNumPartitions() == 6
    assert [x.samples for x in rows.orderBy("place").collect()] == data.tolist()
    one = raw.daq_record(spark, str(tmp_path), 7)
    assert [(x.place, x.samples) for x in one.collect()] == [(7, data[7].tolist())] and one.rdd.getNumPartitions() == 1
    assert traces.read_traces(spark, str(tmp_path / "b.raw")).where("place between 1 and 2").count() == 2
    two = raw.daq_record(spark, f"file://{tmp_path}", 3)
    assert [x.samples for x in two.collect()] == [data[3].tolist()] * 2 and two.rdd.getNumPartitions() == 2
    named = raw.daq_record(spark, str(tmp_path), 3, file="b.raw")
    assert [x.path.rsplit("/", 1)[-1] for x in named.collect()] == ["b.raw"] and named.rdd.getNumPartitions() == 1
    part = raw.daq_traces(spark, str(tmp_path), records=4, first=3, last=9)
    assert sorted(x.place for x in part.collect()) == [3, 3, 4, 4, 5, 6, 7, 8, 9] and part.rdd.getNumPartitions() == 3
    filtered = raw.daq_traces(spark, str(tmp_path), records=4).where("place >= 20")
    assert filtered.count() == 3 and filtered.rdd.getNumPartitions() == (1 if pushdown else 8)
    assert raw.daq_record(spark, str(tmp_path), 99).count() == 0
    (tmp_path / "c.raw").write_bytes(b"short")
    with pytest.raises(Exception, match="shorter"):
        raw.daq_files(spark, str(tmp_path / "c.raw")).collect()


def test_other_readers(spark, tmp_path):
    np.save(tmp_path / "t.npy", np.arange(3.0))
    np.save(tmp_path / "p.npy", np.array([[0.0, 1.0], [5.0, 6.0]]))
    rows = traces.read_npy(spark, str(tmp_path)).orderBy("path", "i").collect()
    assert [(x.i, x.x, x.value) for x in rows] == [(0, 0.0, 5.0), (1, 1.0, 6.0), (0, None, 0.0), (1, None, 1.0), (2, None, 2.0)]
    (tmp_path / "q.csv").write_text("b,a\n1.5,2\nx,3\n")
    assert sorted(map(tuple, traces.read_quantities(spark, str(tmp_path / "q.csv"), "a int, b double").collect())) == [(2, 1.5), (3, None)]
    with pytest.raises(ValueError):
        traces.read_traces(spark, "x.pkl")
    fits = spark.createDataFrame([(1, 20, 0.5)], "trace_id long, energy int, amp double")
    traces.write_table(fits, str(tmp_path / "fits"), csv=True)
    assert traces.read_quantities(spark, str(tmp_path / "fits"), "trace_id long, energy int, amp double").collect() == fits.collect()
    v = traces.last_vectors(spark.createDataFrame([(2, "a\nb", 1), (1, "c", 0), (3, "d", -1)], "id int, s string, sensor int"), "s", "id", "sensor")
    assert [x.last for x in v.collect()] == ["c", "b"]
