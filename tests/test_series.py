"""Sliced sorts, long-trace filters and triggers against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsework.operators import events, filters, holdoff as steps, joins, ranks, scores, selection, series, spectra


def test_running_totals_and_numbers(spark):
    r = np.random.default_rng(1)
    rows = [(None if k == 9 else int(k), float(x) if x > 3 else None, int(n)) for k, x, n in zip(r.integers(0, 10, 400), r.integers(0, 30, 400), range(400))]
    df = spark.createDataFrame(rows, "k int, x double, n int")
    for down in (False, True):
        got = ranks.running(df, ["k"], ["x", "n"], {"s": "n"}, slices=7, down=down).collect()
        for k in {x[0] for x in rows}:
            # nulls come first, or last going down
            mine = sorted((x for x in rows if x[0] == k), key=lambda x: ((x[1] is not None) if not down else (x[1] is None), (x[1] or 0) * (-1 if down else 1), x[2]))
            total = np.cumsum([x[2] for x in mine]).tolist()
            assert {g.n: (g.s, g.s_all) for g in got if g.k == k} == {x[2]: (t, total[-1]) for x, t in zip(mine, total)}
    places = ranks.numbered(df, [], ["x", "n"], "p").collect()
    assert sorted(g.p for g in places) == list(range(400)) and {g.p_all for g in places} == {400}


def test_exact_percentiles(spark):
    r = np.random.default_rng(2)
    values = {0: r.normal(size=1001), 1: np.round(r.normal(size=500), 1), 2: np.array([5.0]), 3: r.integers(0, 3, 77).astype(float)}
    df = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [(k, None) for k in range(5)], "k int, x double")
    got = {x.k: (x.a, x.b) for x in ranks.percentiles(df, "x", {"a": 0.01, "b": 0.5}, "k").collect()}
    assert set(got) == set(values) and all(np.allclose(got[k], np.percentile(v, [1, 50])) for k, v in values.items())


def test_roc_without_one_side_and_with_nulls(spark):
    df = spark.createDataFrame([("a", True, 1.0), ("a", False, None), ("b", True, 2.0), ("b", True, 2.0)], "k string, positive boolean, score double")
    got = {x.k: x for x in scores.curve(df, "k").collect()}
    assert (got["a"].tpr, got["a"].fpr, got["b"].tpr, got["b"].fpr) == (1.0, 0.0, 1.0, None)


@pytest.mark.parametrize("hop, chunk", [(1, 40), (3, 64), (16, 48)])
def test_three_ways_to_slide(spark, hop, chunk):
    """Recurrence, transform of each window and convolution agree, whatever the chunks."""
    r = np.random.default_rng(3)
    n = 32
    f = filters.Filter(np.exp(-np.arange(n) / 6.0), np.abs(r.normal(size=n // 2 + 1)) + 0.1)
    v = {"a": r.normal(size=300), "b": r.normal(size=33), "c": r.normal(size=20)}
    df = spark.createDataFrame([(c, i, float(x)) for c, s in v.items() for i, x in enumerate(s)], "channel string, i long, v double").repartition(5)
    got = {(x.channel, x.start): (x.amp, x.chisq) for x in filters.sliding(df, f, hop, chunk).collect()}
    windows = {(c, s): v[c][s : s + n] for c in v for s in range(0, len(v[c]) - n + 1, hop)}
    overlap, own = f.overlap(np.stack(list(windows.values())))
    amp = overlap[:, 0] / f.norm
    assert list(sorted(got)) == sorted(windows)
    assert np.allclose([got[k] for k in windows], np.stack([amp, (own - amp**2 * f.norm) / (n - 2)], 1), atol=1e-5)
    if hop == 1:
        conv = {(x.channel, x.start): x.amp for x in filters.convolved(df, f, chunk).collect()}
        assert np.allclose([conv[k] for k in windows], amp, atol=1e-5)


def test_padded_filter_finds_a_pulse_anywhere(spark):
    r = np.random.default_rng(4)
    f = filters.Filter(np.exp(-np.arange(16) / 4.0), np.ones(9))
    v = r.normal(size=256) * 0.01
    v[100:116] += 3 * f.template
    row = filters.fit_with_shift(spark.createDataFrame([(1, v.tolist())], "trace_id long, samples array<double>"), f.padded(256), wrap=False).first()
    assert row.t0 == 100 and abs(row.amp - 3) < 0.1


def test_two_pulses_are_told_apart(spark):
    n = 64
    one, two = np.exp(-np.arange(n) / 4.0), np.exp(-np.arange(n) / 15.0)
    v = 2 * np.roll(one, 5) + 0.7 * np.roll(two, 5 + 9)
    row = filters.two_templates(spark.createDataFrame([(1, v.tolist()), (2, None)], "trace_id long, samples array<double>"), filters.Filter(one, np.ones(33)), two, (-8, 8), (5, 12)).first()
    assert (row.t0, row.delta) == (5, 9) and abs(row.amp - 2) < 1e-6 and abs(row.amp2 - 0.7) < 1e-6 and abs(row.chisq) < 1e-6


def test_bank_leaves_out_what_has_no_filter(spark):
    rows = [(1, 1, 0, [1.0, 0.0, 0.0, 0.0]), (2, 1, 1, [1.0, 0.0, 0.0, 0.0]), (3, 1, 0, None), (4, 1, 0, [1.0]), (5, 1, None, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "trace_id long, event_id long, channel int, samples array<double>")
    assert [x.trace_id for x in filters.bank(df, {0: filters.Filter(np.array([1.0, 0, 0, 0]), np.ones(3))}, "channel").collect()] == [1]


def test_power_and_records_across_chunks(spark):
    r = np.random.default_rng(5)
    v = np.round(r.normal(size=200), 3)
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)] + [("b", 500 + i, 1.0) for i in range(5)], "channel string, event_id long, value double")
    df = df.withColumn("ts", F.timestamp_micros(F.col("event_id") * 1000))
    got = {x.event_id: x.power for x in series.moving_power(df, 7, chunk=16).collect()}
    assert got.keys() == set(range(6, 200)) and all(abs(got[i] - (v[i - 6 : i + 1] ** 2).sum()) < 1e-3 for i in got)
    recs = series.records(df, 64).collect()
    assert sorted((x.channel, x.block, x.n) for x in recs) == [("a", 0, 64), ("a", 1, 64), ("a", 2, 64), ("a", 3, 8), ("b", 0, 5)]
    hit = {x.event_id for x in series.hysteresis(df.where("channel = 'a'"), 1.0, 0.2).collect()}
    armed, want = True, set()
    for i, x in enumerate(v):
        if armed and x > 1.0:
            want.add(i)
            armed = False
        elif x < 0.2:
            armed = True
    assert hit == want


def test_lookup_raises_for_a_key_that_is_not_unique(spark):
    rows, table = spark.createDataFrame([(1,), (2,), (3,)], "k int"), spark.createDataFrame([(1, "x"), (2, "y")], "k int, name string")
    assert sorted(map(tuple, joins.looked_up(rows, table, ["k"]).collect())) == [(1, "x"), (2, "y"), (3, None)]
    with pytest.raises(Exception, match="unique"):
        joins.looked_up(rows, table.union(table), ["k"]).collect()


def test_resampling_a_long_key_is_linear(spark):
    known = spark.range(20_000).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("x"), (F.col("id") * 2).cast("double").alias("y"))
    wanted = spark.range(-2, 20_002).select(F.lit("a").alias("k"), (F.col("id") + 0.5).alias("x"))
    out = {x.x: x.y for x in joins.resampled(known, wanted, "k", "extrapolate").collect()}
    assert len(out) == 20_004 and all(abs(y - 2 * x) < 1e-6 for x, y in out.items())


def test_cross_densities_of_unsorted_events(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(12, 3, 16))
    rows = [(e, c, x[e, c].tolist()) for e in range(12) for c in range(3)] + [(50, 0, None), (51, None, [1.0]), (None, 1, [1.0])]
    df = spark.createDataFrame(rows, "event_id long, channel int, samples array<double>").repartition(4)
    z = np.fft.rfft(x)
    twice = np.r_[1, np.full(7, 2), 1] / 16
    got = {(g.a, g.b, g.k): complex(g.re, g.im) for g in spectra.cross(df).collect()}
    assert len(got) == 6 * 9 and all(abs(got[a, b, k] - (np.conj(z[:, a, k]) * z[:, b, k]).mean() * twice[k]) < 1e-9 for a, b, k in got)


def test_held_off_batch(spark):
    v = np.random.default_rng(7).normal(size=500)
    df = spark.createDataFrame([(c, i, float(x)) for c in "ab" for i, x in enumerate(v if c == "a" else -v)], "channel string, i long, v double").repartition(3)
    for holdoff in (0, 5):
        got = {c: sorted(x.i for x in steps.held_off(df, 1.0, 0.5, holdoff).collect() if x.channel == c) for c in "ab"}
        for c, s in (("a", v), ("b", -v)):
            found, fired, i = [], False, 0
            while i < len(s):
                if not fired and s[i] > 1.0:
                    found.append(i)
                    fired, i = True, i + holdoff
                elif fired and s[i] < 0.5:
                    fired = False
                i += 1
            assert got[c] == found


def test_filled_and_ranked(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (1, 2, 1.0), (1, 2, 3.0), (1, 9, 1.0), (2, None, 1.0), (3, 1, None)], "k int, p int, x double")
    assert {r.k: r.samples for r in selection.filled(df, "k", "p", "x", 3).collect()} == {1: [2.0, 0.0, 3.0], 3: [0.0, 0.0, 0.0]}


@pytest.mark.parametrize("mode", ["clamp", "zero", "extrapolate"])
def test_resampling_in_slices(spark, mode):
    r = np.random.default_rng(11)
    xs = np.sort(r.choice(1000, 60, replace=False)).astype(float)
    ys, at = r.normal(size=60), np.concatenate([r.uniform(-50, 1050, 80), xs[:5]])
    known = spark.createDataFrame([("a", float(x), float(y)) for x, y in zip(xs, ys)] + [("b", 500.0, 3.0), (None, 1.0, 2.0)], "k string, x double, y double").repartition(3)
    wanted = spark.createDataFrame([("a", float(x)) for x in at] + [("b", 1.0), ("c", 2.0), (None, 5.0), ("a", None)], "k string, x double")
    want = np.interp(at, xs, ys)
    if mode == "zero":
        want = np.where((at < xs[0]) | (at > xs[-1]), 0, want)
    if mode == "extrapolate":
        want = np.where(at < xs[0], ys[0] + (at - xs[0]) * (ys[1] - ys[0]) / (xs[1] - xs[0]), np.where(at > xs[-1], ys[-1] + (at - xs[-1]) * (ys[-1] - ys[-2]) / (xs[-1] - xs[-2]), want))
    for slices in (1, 7, 64):
        got = {(g.k, g.x): g.y for g in joins.resampled(known, wanted, "k", mode, slices).collect()}
        assert np.allclose([got["a", float(x)] for x in at], want, atol=1e-9) and len(got) == len({*at}) + 3
        assert got["b", 1.0] == (0 if mode == "zero" else 3) and got["c", 2.0] == (0 if mode == "zero" else None) and got[None, 5.0] == (0 if mode == "zero" else 2)


def test_channel_moments_of_odd_events(spark):
    r = np.random.default_rng(12)
    rows = [(e, c, [None if r.random() < 0.1 else float(x) for x in r.normal(size=int(r.choice([9, 12])))]) for e in range(15) for c in range(4) if r.random() < 0.9]
    rows += [(3, 1, [1.0, 2.0]), (None, 1, [1.0]), (4, None, [1.0]), (5, 2, None), (6, 3, [])]
    df = spark.createDataFrame(rows, "event_id long, channel int, samples array<double>").repartition(4)
    pairs = {}
    for e, a, x in rows:
        for f, b, y in rows:
            if e is not None and e == f and a is not None and b is not None and a <= b and x is not None and y is not None:
                pairs.setdefault((a, b), []).extend((p, q) for p, q in zip(x, y) if p is not None and q is not None)
    corr, cov = ({(g.a, g.b): g[2] for g in f(df).collect()} for f in (events.correlation, events.covariance))
    assert set(corr) == set(cov) == set(pairs)
    for k, v in pairs.items():
        x, y = np.array(v).T
        assert abs(corr[k] - np.corrcoef(x, y)[0, 1]) < 1e-6 and abs(cov[k] - np.cov(x, y)[0, 1]) < 1e-6


def test_slices_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ROWS_A_SLICE", 40)
    monkeypatch.setattr(ranks, "LEAF", 3)
    r = np.random.default_rng(13)
    x = r.choice(500, 2000).astype(float)
    rows = [("ab"[i % 3 == 0], float(v), i) for i, v in enumerate(x)] + [("a", None, 5000)]
    df = spark.createDataFrame(rows, "k string, x double, i long").repartition(3)
    sizes = [g["count"] for g in df.groupBy(ranks.slice_of(df, "x").alias("s")).count().collect()]
    assert len(sizes) > 40 and max(sizes) < 120  # 51 edges at most
    got = {(g.k, g.i): (g.place, g.place_all) for g in ranks.numbered(df, ["k"], ["x", "i"]).collect()}
    for k in "ab":
        own = sorted((v is not None, v or 0, i) for kk, v, i in rows if kk == k)
        assert [got[k, i] for *_, i in own] == [(n, len(own)) for n in range(len(own))]
