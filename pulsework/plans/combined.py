"""Queries of events, joins and spectra, with their SQL."""

from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators import joins, spectra
from .tables import LONG, P, T, events, places, traces

_HOUR = 3_600_000_000


def _triggers(s, d):
    return events(s, d).where("value > 80").select(F.col("user_id").alias("channel"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))


def _cut(s, d):
    """16 samples around every value above 95."""
    windows = places(s, d).where("v > 95").select(F.col("event_id").alias("window"), "channel", (F.col("i") - 4).alias("start"), F.lit(16).alias("length"))
    return joins.cut_out(places(s, d).select("channel", "i", "v"), windows)


def _resampled(mode):
    def query(s, d):
        known = places(s, d).select("channel", F.col("i").cast("double").alias("x"), F.col("v").alias("y"))
        wanted = places(s, d).select("channel", (0.75 * F.col("i") - 1.25).alias("x")).union(places(s, d).where("i < 5").select("channel", (F.col("i") + 1e6).alias("x")))
        return joins.resampled(known, wanted, "channel", mode).select("channel", "x", F.round("y", 6).alias("y"))

    return query


def _truth(s, d):
    fits = traces(s, d).select("trace_id", (F.array_position("samples", F.array_max("samples")) - 1).alias("position"))
    truth = traces(s, d).select("trace_id", (F.array_position("samples", F.array_min("samples")) - 1).alias("inject"))
    return joins.with_truth(fits, truth, "trace_id", 20)


def _methods(s, d):
    """The maximum of the first and of the second half of the traces, of traces that have one above 0.2."""
    top = lambda at: traces(s, d).select("trace_id", F.array_max(F.slice("samples", at, 32)).cast("double").alias("v")).where("v > 0.2")
    return joins.side_by_side(top(1), top(33), ["trace_id"], "v")


def _weights(s, d):
    return s.createDataFrame([(c, 0.5 + c / 8) for c in range(7)], "channel long, weight double")


QUERIES = {
    "spike_search": lambda s, d: ev.spike(traces(s, d)),
    "dark_counts": lambda s, d: ev.dark_counts(traces(s, d).where("energy = 0"), [0.1, 0.2, 0.25, 0.3, 0.35]),
    "leading_spread": lambda s, d: ev.leading_spread(traces(s, d)),
    "weighted_sum_channel": lambda s, d: ev.weighted_sum(traces(s, d), _weights(s, d)),
    "merged_triggers": lambda s, d: ev.merged_triggers(_triggers(s, d), _HOUR // 4),
    "event_cut_out": _cut,
    "resampled_clamp": _resampled("clamp"),
    "resampled_zero": _resampled("zero"),
    "resampled_extrapolate": _resampled("extrapolate"),
    "fit_truth": _truth,
    "side_by_side": lambda s, d: _methods(s, d).select("trace_id", F.round("first", 6).alias("first"), F.round("second", 6).alias("second")),
    "agreement": lambda s, d: joins.agreement(_methods(s, d)),
    "also_significant": lambda s, d: joins.also_significant(places(s, d).select("channel", "event_id", "v"), "channel", "v", 95.0),
    "channel_psd": lambda s, d: spectra.psd(traces(s, d), keys=("channel",)).select("channel", "k", "psd"),
    "two_sided_psd": lambda s, d: spectra.unfolded(spectra.density(traces(s, d).where("energy = 0"))).select("k", F.round("psd", 8).alias("psd"), F.round("weight", 4).alias("weight")),
    "welch_psd": lambda s, d: spectra.welch(traces(s, d), 32).select("k", "frequency", F.round("psd", 8).alias("psd")),
    "cross_density": lambda s, d: spectra.cross(traces(s, d)).select("a", "b", "k", F.round("re", 7).alias("re"), (F.round("im", 7) + 0.0).alias("im")),
}
_DFT = f"(SELECT trace_id, event_id, channel, energy, k, sum(x * cos(2 * pi() * k * i / 64)) AS re, -sum(x * sin(2 * pi() * k * i / 64)) AS im FROM {LONG}, range(0, 33) t(k) GROUP BY ALL)"
_PEAK = f"(SELECT *, list_max(v) AS top, list_position(v, list_max(v)) - 1 AS t FROM {T})"
_RESAMPLED = f"""WITH s AS (SELECT channel, CAST(i AS DOUBLE) AS x, v AS y, lag(v) OVER w AS py, lead(v) OVER w AS ny, max(i) OVER (PARTITION BY channel) AS m FROM {P} WINDOW w AS (PARTITION BY channel ORDER BY i)),
 w AS (SELECT channel, 0.75::DOUBLE * i - 1.25::DOUBLE AS x FROM {P} UNION ALL SELECT channel, i + 1e6 FROM {P} WHERE i < 5),
 b AS (SELECT w.channel, w.x, p.y AS py, n.y AS ny, p.x AS px, p.py AS before, n.ny AS after FROM w LEFT JOIN s p ON p.channel = w.channel AND p.x = least(floor(w.x), (SELECT max(m) FROM s q WHERE q.channel = w.channel))
  LEFT JOIN s n ON n.channel = w.channel AND n.x = greatest(floor(w.x) + 1, 0))
 SELECT channel, x, round(coalesce(CASE WHEN px = x THEN py END, py + (ny - py) * (x - px), {{0}}), 6) AS y FROM b"""
_HALVES = f"(SELECT trace_id, CASE WHEN list_max(v[1:32]) > 0.2 THEN list_max(v[1:32]) END AS a, CASE WHEN list_max(v[33:64]) > 0.2 THEN list_max(v[33:64]) END AS b FROM {T})"
ORACLE = {
    "spike_search": f"SELECT event_id, channel, trace_id, round(top, 6) AS top FROM {_PEAK} QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY top DESC, channel) = 1",
    "dark_counts": f"""SELECT threshold, count(*) AS n, count(*) FILTER (top > threshold) AS n_fired, round(avg((top > threshold)::INT), 6) AS rate FROM (SELECT event_id, max(top) AS top FROM {_PEAK} WHERE energy = 0 GROUP BY 1),
 (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.25::DOUBLE), (0.3::DOUBLE), (0.35::DOUBLE)) g(threshold) GROUP BY 1""",
    "leading_spread": f"SELECT event_id, CASE WHEN count(*) > 1 THEN max(t) - min(t) END AS spread FROM (SELECT event_id, CAST(t AS BIGINT) AS t FROM {_PEAK} QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY top DESC, channel) <= 2) GROUP BY 1",
    "weighted_sum_channel": f"SELECT event_id, CAST(-1 AS BIGINT) AS channel, i, round(sum((0.5::DOUBLE + channel / 8) * x), 5) AS v FROM {LONG} WHERE channel < 7 GROUP BY event_id, i",
    "merged_triggers": f"""WITH t AS (SELECT user_id AS channel, epoch_us(ts) AS t FROM events WHERE value > 80), n AS (SELECT *, CASE WHEN t - lag(t) OVER (ORDER BY t, channel) <= {_HOUR // 4} THEN 0 ELSE 1 END AS f FROM t)
 SELECT min(t) AS start, max(t) AS stop, count(*) AS n, count(DISTINCT channel) AS n_channels FROM (SELECT *, sum(f) OVER (ORDER BY t, channel) AS e FROM n) GROUP BY e""",
    "event_cut_out": f"SELECT w.event_id AS \"window\", s.channel, s.i, s.v FROM {P} w JOIN {P} s ON w.channel = s.channel AND s.i >= w.i - 4 AND s.i < w.i + 12 WHERE w.v > 95",
    "resampled_clamp": _RESAMPLED.format("py, ny"),
    "resampled_zero": _RESAMPLED.format("0"),
    "resampled_extrapolate": _RESAMPLED.format("py + coalesce(py - before, 0) * (x - px), ny + coalesce(after - ny, 0) * x"),
    "fit_truth": f"SELECT trace_id, position, d AS delta, abs(d) AS distance, abs(d) > 20 AS implausible FROM (SELECT trace_id, CAST(list_position(v, list_max(v)) - 1 AS BIGINT) AS position, CAST(list_position(v, list_max(v)) - list_position(v, list_min(v)) AS BIGINT) AS d FROM {T})",
    "side_by_side": f'SELECT trace_id, round(a, 6) AS "first", round(b, 6) AS "second" FROM {_HALVES} WHERE a IS NOT NULL OR b IS NOT NULL',
    "agreement": f"""SELECT count(*) FILTER (a - b IS NOT NULL) AS n, count(*) FILTER (a - b IS NULL) AS n_missing, round(max(abs(a - b)), 6) AS max_abs, round(sqrt(avg((a - b) ** 2)), 6) AS rms, round(sqrt(sum((a - b) ** 2) / sum(b * b) FILTER (a IS NOT NULL)), 6) AS relative,
 round(corr(a, b), 6) AS corr, bool_and(abs(a - b) <= 1e-12 + 1e-8 * abs(b)) AS "close" FROM {_HALVES} WHERE a IS NOT NULL OR b IS NOT NULL""",
    "also_significant": f"SELECT channel, event_id, v, n_significant FROM (SELECT channel, event_id, v, count(*) OVER (PARTITION BY channel) AS n_significant FROM {P} WHERE v > 95) WHERE n_significant > 1",
    "channel_psd": f"SELECT channel, CAST(k AS INTEGER) AS k, round(avg(re * re + im * im) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END / 64, 8) AS psd FROM {_DFT} GROUP BY channel, k",
    "two_sided_psd": f"""WITH p AS (SELECT CAST(k AS INTEGER) AS k, CASE WHEN k > 0 THEN avg(re * re + im * im) / 64 END AS p FROM {_DFT} WHERE energy = 0 GROUP BY k)
 SELECT k, round(p, 8) AS psd, round(coalesce(1 / p, 0), 4) AS weight FROM (SELECT k, p FROM p UNION ALL SELECT 64 - k, p FROM p WHERE k BETWEEN 1 AND 31)""",
    "welch_psd": f"""WITH s AS (SELECT trace_id, a * 16 AS a, i - a * 16 AS i, x - avg(x) OVER (PARTITION BY trace_id, a) AS x FROM {LONG}, range(0, 3) r(a) WHERE i >= a * 16 AND i < a * 16 + 32),
 f AS (SELECT trace_id, a, k, sum((0.5 - 0.5 * cos(2 * pi() * i / 32)) * x * cos(2 * pi() * k * i / 32)) AS re, sum((0.5 - 0.5 * cos(2 * pi() * i / 32)) * x * sin(2 * pi() * k * i / 32)) AS im FROM s, range(0, 17) t(k) GROUP BY ALL)
 SELECT CAST(k AS INTEGER) AS k, k / 32 AS frequency, round(avg(re * re + im * im) * CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END / (SELECT sum((0.5 - 0.5 * cos(2 * pi() * i / 32)) ** 2) FROM range(0, 32) h(i)), 8) AS psd FROM f GROUP BY k""",
    "cross_density": f"""WITH f AS (SELECT * FROM {_DFT}) SELECT x.channel AS a, y.channel AS b, CAST(x.k AS INTEGER) AS k, round(avg(x.re * y.re + x.im * y.im) * CASE WHEN x.k IN (0, 32) THEN 1 ELSE 2 END / 64, 7) AS re,
 round(avg(x.re * y.im - x.im * y.re) * CASE WHEN x.k IN (0, 32) THEN 1 ELSE 2 END / 64, 7) + 0.0 AS im FROM f x JOIN f y ON x.event_id = y.event_id AND x.k = y.k AND x.channel <= y.channel GROUP BY x.channel, y.channel, x.k""",
}
