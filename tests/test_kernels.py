"""Sample kernels against plain loops, with nulls and odd lengths, and their growth with the length of a trace."""

import statistics
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsework.operators import kernels, sequence, templates

@pytest.fixture(scope="module")
def some(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=n).round(3).tolist()) for i, n in enumerate([1, 2, 3, 5, 9, 9, 40, 700])] + [(90, None), (91, [])]
    return rows, spark.createDataFrame(rows, "trace_id long, samples array<double>").repartition(2)


def got(df, column):
    return {r.trace_id: r.x for r in df.select("trace_id", column.alias("x")).collect()}


def same(a, b):
    return a == b if a is None or b is None else len(a) == len(b) and all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-9) for x, y in zip(a, b, strict=True))


def plain(name, v):
    n = len(v)
    if name == "gradient":
        return [None] if n == 1 else [v[1] - v[0] if i == 0 else v[i] - v[i - 1] if i == n - 1 else (v[i + 1] - v[i - 1]) / 2 for i in range(n)]
    if name == "median":
        return [statistics.median(([0] * 2 + v + [0] * 2)[i : i + 5]) for i in range(n)]
    if name == "smooth":
        return None if n < 5 else [float(np.polyval(np.polyfit(range(5), v[s : s + 5], 2), i - s)) for i in range(n) for s in [max(0, min(i - 2, n - 5))]]
    taps = [1.0, -2.0, 0.5, 4.0] if name != "long" else (np.arange(300) % 7 - 3.0).tolist()
    full = np.convolve(v, taps) if n else np.zeros(len(taps) - 1)
    if name in ("valid", "long"):
        return full[len(taps) - 1 : n].tolist() if n >= len(taps) else []
    return full.tolist() if name == "full" else full[1 : 1 + n].tolist()


CASES = {
    "gradient": lambda: kernels.gradient(F.col("samples")), "median": lambda: kernels.median_filter(F.col("samples"), 5), "smooth": lambda: kernels.polynomial_smoothed(F.col("samples"), 5, 2),
    "valid": lambda: kernels.weights([1.0, -2.0, 0.5, 4.0], F.col("samples")), "full": lambda: kernels.convolution([1.0, -2.0, 0.5, 4.0], F.col("samples")), "same": lambda: kernels.convolution([1.0, -2.0, 0.5, 4.0], F.col("samples"), "same"),
    "long": lambda: kernels.weights((np.arange(300) % 7 - 3.0).tolist(), F.col("samples")),
}


@pytest.mark.parametrize("name", CASES)
def test_against_plain_loops(some, name, monkeypatch):
    rows, df = some
    found = got(df, CASES[name]())
    for i, v in rows:
        assert same(found[i], None if v is None else plain(name, v)), (name, i)


def test_null_samples(spark):
    df = spark.createDataFrame([(1, [1.0, None, 3.0, 4.0, 8.0, 9.0]), (2, [float("nan"), 1.0, 2.0])], "trace_id long, samples array<double>")
    assert got(df, kernels.gradient(F.col("samples")))[1] == [None, 1.0, None, 2.5, 2.5, 1.0]
    assert got(df, kernels.median_filter(F.col("samples"), 3))[1] == [None, None, None, 4.0, 8.0, 8.0]
    assert got(df, kernels.weights([1.0, 1.0], F.col("samples")))[1] == [None, None, 7.0, 12.0, 17.0]
    assert np.isnan(got(df, kernels.gradient(F.col("samples")))[2][0])
    assert sequence.edges(df).where("trace_id = 1").first().height is None


def test_edges_by_hand(spark):
    v = [0.0] * 30 + [10.0, 20.0, 18.0] + [1.0] * 30
    r = sequence.edges(spark.createDataFrame([(1, v), (2, [5.0, 1.0, 0.0]), (3, [1.0, 2.0])], "trace_id long, samples array<double>")).orderBy("trace_id").collect()
    assert (r[0].edge, r[0].base, r[0].rise, r[0].peak) == (32, 30 / 32, -30, round(31 + (10 - 18) / (2 * (10 - 40 + 18)), 5))
    assert (r[1].edge, r[1].rise, r[1].peak) == (0, None, 0) and len(r) == 2


@pytest.mark.parametrize("name, kernel", [("median", lambda x: kernels.medians(x, 51)), ("smooth", lambda x: kernels.convolved(x, kernels.polynomial_weights(51, 3)[25])), ("long", lambda x: kernels.convolved(x, np.ones(2000)))])
def test_time_grows_with_the_length(name, kernel):
    """At most 2.5 times the time for twice the samples, up to the length of real traces."""

    def seconds(n):
        x, best = np.random.default_rng(1).normal(size=(8, n)), np.inf
        for _ in range(5):
            t = time.perf_counter()
            kernels.mapped(pa.array(list(x), pa.list_(pa.float64())), kernel)
            best = min(best, time.perf_counter() - t)
        return best

    assert seconds(32768) < 2.5 * seconds(16384) + 0.05


@pytest.mark.parametrize("n, to", [(1, 5), (2, 5), (3, 7), (4, 9), (5, 1), (64, 96), (300, 601)])
def test_spline_against_a_dense_solve(spark, n, to):
    y = np.random.default_rng(n).normal(size=n)
    x = np.arange(to) * ((n - 1) / (to - 1)) if to > 1 else np.zeros(1)
    if n < 4:
        want = np.polyval(np.polyfit(range(n), y, n - 1), x)
    else:
        a, b = np.zeros((n, n)), np.zeros(n)
        for i in range(1, n - 1):
            a[i, i - 1 : i + 2], b[i] = (1, 4, 1), 6 * (y[i - 1] - 2 * y[i] + y[i + 1])
        a[0, :3], a[-1, -3:] = (1, -2, 1), (1, -2, 1)
        m = np.linalg.solve(a, b)
        at = np.minimum(x.astype(int), n - 2)
        u = x - at
        want = m[at] / 6 * (1 - u) ** 3 + m[at + 1] / 6 * u**3 + (y[at] - m[at] / 6) * (1 - u) + (y[at + 1] - m[at + 1] / 6) * u
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)] + [("b", i, 2.0) for i in range(6)], "k string, i int, t double")
    got = {(r.k, r.i): r.t for r in templates.resampled(df, to, "k").collect()}
    assert np.allclose([got["a", i] for i in range(to)], want, atol=1e-9) and len(got) == 2 * to and abs(got["b", to - 1] - 2) < 1e-12


def test_pooled_moments(spark):
    r = np.random.default_rng(9)
    rows = [(i % 3, [None if r.random() < 0.1 else float(x) for x in 1000 + r.normal(size=r.integers(1, 30))]) for i in range(40)] + [(0, None), (1, []), (7, [None])]
    got = {g.k: g for g in kernels.pooled(spark.createDataFrame(rows, "k int, samples array<double>").repartition(3), "k", v=F.col("samples")).collect()}
    for k in range(3):
        x = np.array([y for kk, v in rows if kk == k and v for y in v if y is not None])
        assert got[k].n == len(x) and abs(got[k].mean - x.mean()) < 1e-9 and abs(got[k].m2 - ((x - x.mean()) ** 2).sum()) < 1e-5
    assert (got[7].n, got[7].mean, got[7].m2) == (0, None, 0)
