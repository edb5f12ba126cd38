import numpy as np
import pytest

from pulsework.functions import features
from pulsework.operators import filters, scores, spectra, templates

N = 32
T = np.exp(-np.arange(N) / 6.0)


def two_sided(f, x):
    """Amplitude series, norm and chi0 as sums over all frequencies."""
    n = f.length
    u = np.array([np.inf if k == 0 else f.psd[min(k, n - k)] / (1 if 2 * k == n else 2) for k in range(n)])
    t, x = np.fft.fft(f.template) / f.fs, np.fft.fft(x) / f.fs
    norm = (np.abs(t) ** 2 / u).sum() * f.fs / n
    return np.real(np.fft.ifft(t.conj() * x / u)) * f.fs / norm, norm, (np.abs(x) ** 2 / u).sum() * f.fs / n


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(7)


@pytest.mark.parametrize("n", [N, N + 1])
def test_overlap_is_the_two_sided_sum(noise, n):
    f = filters.Filter(noise.normal(size=n), noise.uniform(1, 2, n // 2 + 1), 3.0)
    x = noise.normal(size=(1, n))
    amps, norm, own = two_sided(f, x[0])
    series, mine = f.overlap(x)
    assert np.allclose(series[0] / f.norm, amps) and np.isclose(norm, f.norm) and np.isclose(own, mine[0])
    assert np.isclose((x @ f.kernel)[0], amps[0])


def frame(spark, rows):
    return spark.createDataFrame(rows, "trace_id long, event_id long, channel long, samples array<double>")


def test_fits_of_planted_pulses_and_odd_rows(spark, noise):
    f = filters.Filter(T, np.ones(N // 2 + 1))
    rows = [(0, 0, 0, (3 * T).tolist()), (1, 0, 1, (2 * np.roll(T, 5)).tolist()), (2, 1, 0, (4 * np.roll(T, -3)).tolist()), (3, 1, 1, []), (4, 1, 2, None), (5, 2, 0, [1.0, 2.0]), (6, 3, 0, [None] * N)]
    df = frame(spark, rows)
    assert {r.trace_id: (r.amp, r.t0) for r in filters.fit_with_shift(df, f, (-8, 8)).collect() if r.trace_id < 6} == {0: (3.0, 0), 1: (2.0, 5), 2: (4.0, -3)}
    assert filters.fit(df, f).where("trace_id = 0").first().amp == 3.0
    zero = filters.fit(df, f).where("trace_id = 6").first()
    assert zero.amp == 0 and zero.chisq == 0
    one = filters.fit_with_shift(df, f, None, wrap=False).where("trace_id = 2").first()
    assert one.t0 == N - 3
    assert filters.fit(df.limit(0), f).collect() == []
    both = filters.joint(frame(spark, [(0, 0, 0, np.roll(T, 2).tolist()), (1, 0, 1, (3 * np.roll(T, 2)).tolist()), (2, 1, 0, None)]), f, (-4, 4)).collect()
    assert [(r.event_id, r.n_channels, r.amp, r.t0) for r in both] == [(0, 2, 2.0, 2)]


def test_sliding_does_not_depend_on_chunks(spark, noise):
    f = filters.Filter(np.arange(8, 0, -1) / 8, np.ones(5))
    v = noise.normal(size=100)
    s = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)] + [("b", i, 1.0) for i in range(7)], "channel string, i long, v double")
    small, big = (sorted(map(tuple, filters.sliding(s, f, 3, c).collect())) for c in (8, 1000))
    assert small == big and [r[1] for r in big] == list(range(0, 93, 3)) and {r[0] for r in big} == {"a"}
    for _, start, amp, chisq in big:
        amps, norm, own = two_sided(f, v[start : start + 8])
        assert abs(amp - amps[0]) < 1e-5 and abs(chisq - (own - amps[0] ** 2 * norm) / 6) < 1e-5
    with pytest.raises(ValueError):
        filters.sliding(s, f, 1, 4)


def test_templates_and_spectra_of_odd_rows(spark):
    df = frame(spark, [(0, 0, 0, [1.0, None, 3.0]), (1, 0, 1, [3.0, 4.0]), (2, 0, 2, None), (3, 0, 3, [])])
    got = {r.i: (r.n, r.t) for r in templates.mean_trace(df).collect()}
    assert got == {0: (2, 2.0), 1: (1, 4.0), 2: (1, 3.0)}
    assert {r.i: r.t for r in templates.peak_normalised(templates.mean_trace(df)).collect()} == {0: 0.5, 1: 1.0, 2: 0.75}
    assert spectra.psd(df, keys=("channel",)).groupBy("channel").count().orderBy("channel").collect() == [(0, 2), (1, 2)]


def test_curve_with_ties_and_nulls(spark):
    rows = [(True, 3.0), (True, 2.0), (False, 2.0), (False, 1.0), (True, None)]
    c = scores.curve(spark.createDataFrame(rows, "positive boolean, score double"))
    assert [(r.score, r.tp, r.fp) for r in c.orderBy("score").collect()] == [(1.0, 2, 2), (2.0, 2, 1), (3.0, 1, 0)]
    assert scores.auc(c).first().auc == round(0.5 * (1 / 3 + 2 / 3) / 2 + 0.5 * 2 / 3, 6)


def test_features_follow_their_inputs(spark):
    df = frame(spark, [(0, 0, 0, [1.0, 1.0, 5.0, 0.0])])
    got = features.with_features(df, {"amplitude": {}, "mean_baseline": {"samples": 2}, "peak_time": {"time_per_sample": 0.5}}).first()
    assert (got.amplitude, got.mean_baseline, got.peak_arg, got.peak_time) == (4.0, 1.0, 2, 1.0)
    with pytest.raises(KeyError):
        features.with_features(df, {"unknown": {}})
