"""Streams out of order: the same rows as in order, late samples aside, and silent channels; the holdoff trigger in slices."""

import datetime

import numpy as np
import pytest

from pulsework.operators import filters, holdoff
from pulsework.streaming import buckets, ordered, run
from tests.test_streaming import by_hand

T0 = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def timed(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ordered.PROVIDER)
    return session


def chunks(spark, path, parts):
    for rows in parts:  # rows of (channel, i, v), one sample a second
        spark.createDataFrame([(T0 + datetime.timedelta(seconds=int(i)), c, int(i), float(v)) for c, i, v in rows], "ts timestamp, channel string, i long, v double").coalesce(1).write.mode("append").parquet(path)
    return run.source(spark, path, 1)


def shuffled(v, late, seed):
    """The samples in chunks, out of order by less than ``late`` seconds."""
    r = np.random.default_rng(seed)
    order = np.argsort(np.arange(len(v)) + r.uniform(0, late - 1, len(v)))
    return [[("a", i, v[i]) for i in part] for part in np.array_split(order, 6)]


@pytest.mark.parametrize("hold", [0, 5])
def test_trigger_out_of_order(timed, tmp_path, hold):
    v = np.random.default_rng(3).normal(size=300)
    parts = shuffled(v, 40, 1)
    parts[3] += [("b", 200, 5.0), ("b", 201, 0.0), ("b", 203, 5.0)]  # silent afterwards
    parts += [[("a", 1000, 0.0)], [("a", 7, 9.0), ("a", 1001, 9.0)]]  # 7 is late
    got = run.drained(ordered.hits(chunks(timed, str(tmp_path / "s"), parts), 1.0, 0.5, hold, "40 seconds")).collect()
    assert sorted(x.i for x in got if x.channel == "a" and not x.late) == by_hand(v, 1.0, 0.5, hold)
    assert sorted(x.i for x in got if x.channel == "b") == ([200, 203] if hold == 0 else [200])
    assert [(x.channel, x.i) for x in got if x.late] == [("a", 7)]


def test_filter_out_of_order(timed, tmp_path):
    r = np.random.default_rng(5)
    n = 16
    f = filters.Filter(np.exp(-np.arange(n) / 3.0), np.abs(r.normal(size=n // 2 + 1)) + 0.1)
    v = r.normal(size=200)
    parts = shuffled(v, 30, 2)
    parts += [[("a", 1000, 0.0)], [("a", 3, 1.0), ("a", 4, 1.0)]]
    got = run.drained(ordered.sliding(chunks(timed, str(tmp_path / "s"), parts), f, late="30 seconds")).collect()
    overlap, own = f.overlap(np.lib.stride_tricks.sliding_window_view(v, n))
    amp = overlap[:, 0] / f.norm
    rows = sorted((x.start, x.amp, x.chisq) for x in got if not x.late)
    assert [x[0] for x in rows] == list(range(len(v) - n + 1))
    assert np.allclose([x[1:] for x in rows], np.stack([amp, (own - amp**2 * f.norm) / (n - 2)], 1), atol=1e-5)
    assert sorted((x.start, x.amp) for x in got if x.late) == [(3, None), (4, None)]


def test_the_session_is_asked_for(spark, tmp_path):
    with pytest.raises(ValueError, match="providerClass"):
        ordered.hits(chunks(spark, str(tmp_path / "s"), [[("a", 1, 1.0)]]), 1.0, 0.5)


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
@pytest.mark.parametrize("hold", [0, 3, 150])
def test_slices_are_a_loop(spark, size, hold):
    v = np.random.default_rng(7).normal(size=400)
    rows = [(c, i - 50, float(x)) for c, s in (("a", 1), ("b", -1), (None, 0.9)) for i, x in enumerate(v * s) if c or i % 3] + [("c", 5, None), ("d", 0, 9.0)]
    df = spark.createDataFrame(rows, "channel string, i long, v double").repartition(3)
    got = {}
    for x in holdoff.held_off(df, 1.0, 0.5, hold, size).collect():
        got.setdefault(x.channel, []).append(x.i)
    loop = lambda u: [i - 50 for i in by_hand(u, 1.0, 0.5, hold)]
    assert sorted(got["a"]) == loop(v) and sorted(got["b"]) == loop(-v) and got["d"] == [0] and "c" not in got
    assert sorted(got[None]) == loop(np.where(np.arange(400) % 3 > 0, 0.9 * v, 0.7))


@pytest.mark.parametrize("width", [10, 60, 1000])
def test_events_in_buckets_of_time(timed, tmp_path, width):
    r = np.random.default_rng(8)
    t = np.sort(r.choice(2000, 220, replace=False))
    t = np.concatenate([t, np.arange(500, 700, 4)])  # one event over many buckets
    order = np.argsort(t + r.uniform(0, 29, len(t)))
    parts = [[(f"c{t[i] % 7}", t[i], 0.0) for i in part] for part in np.array_split(order, 5)] + [[("z", 4000, 0.0)], [("z", 4001, 0.0), ("y", 30, 0.0)], [("z", 8000, 0.0)]]
    found = run.drained(buckets.pieces(chunks(timed, str(tmp_path / "s"), parts), 10_000_000, width * 1_000_000, "30 seconds"))
    assert [x.channels for x in found.where("late").collect()] == [["y"]]
    line = np.sort(np.concatenate([t, [4000, 4001]]))
    want = []
    for run_ in np.split(line, np.flatnonzero(np.diff(line) >= 10) + 1):
        want.append((int(run_[0]), int(run_[-1]), len(run_), 1 if run_[0] >= 4000 else len({x % 7 for x in run_.tolist()})))
    base = int((T0 - datetime.datetime(1970, 1, 1)).total_seconds())
    got = sorted((x.start // 1_000_000 - base, x.stop // 1_000_000 - base, x.n, x.n_channels) for x in buckets.joined(found).collect())
    assert got == want
    if width == 10:
        assert found.where("not (opens and closes)").count() > 10 and found.where("not late").agg({"n": "max"}).first()[0] <= 10


def test_out_of_order_by_slots(timed, tmp_path):
    r = np.random.default_rng(12)
    v = {c: r.normal(size=30) for c in [*range(100, 140), None]}
    order = [(c, i) for c in v for i in range(30)]
    turn = np.argsort(np.array([i for _, i in order]) + r.uniform(0, 19, len(order)))
    parts = [[order[k] for k in part] for part in np.array_split(turn, 3)] + [[(100, 1000)], [(101, 1001)]]
    path = str(tmp_path / "s")
    for part in parts:
        rows = [(T0 + datetime.timedelta(seconds=int(i)), c, int(i), float(v[c][i]) if i < 30 else 0.0) for c, i in part]
        timed.createDataFrame(rows, "ts timestamp, channel long, i long, v double").coalesce(1).write.mode("append").parquet(path)
    got = run.drained(ordered.hits(run.source(timed, path, 1), 1.0, 0.5, 2, "20 seconds", slots=3)).collect()
    assert not any(x.late for x in got)
    assert {c: sorted(x.i for x in got if x.channel == c) for c in v} == {c: by_hand(x, 1.0, 0.5, 2) for c, x in v.items()}
