"""Queries of cuts, joins, sets and scalars, with their SQL."""

from pyspark.sql import functions as F

from ..operators import calibration, combined, events, holdoff, joins, kernels, models, reduced, selection, sequence, series
from .calibrated import _HIST, _scan
from .tables import LONG, P, T, items, places, traces
from .tables import events as stream

_RANGES = {"l_quantity": (10, 40), "l_discount": (0.02, 0.06)}
_LIMITS = [2.0, 2.5, 3.0]


def _quantities(s, d):
    return traces(s, d).select("trace_id", "event_id", "channel", F.round(F.array_max("samples").cast("double"), 6).alias("top"), F.round(F.array_min("samples").cast("double"), 6).alias("low"))


def _range_traces(s, d):
    some = calibration.within(_quantities(s, d), top=(0.3, 0.4), low=(-0.4, -0.25))
    return joins.with_traces(some, traces(s, d), ["trace_id"]).select("trace_id", "top", "low", F.size("samples").alias("n"), F.round(F.element_at("samples", 1).cast("double"), 6).alias("first"))


def _series(s, d):
    return stream(s, d).select(F.col("event_type").alias("channel"), "ts", "event_id", "value")


def _lookup(s, d):
    names = traces(s, d).groupBy("channel").agg(F.count("*").alias("n_traces"), F.round(F.max(F.array_max("samples").cast("double")), 6).alias("best"))
    return joins.looked_up(_quantities(s, d).select("trace_id", "channel"), names, ["channel"])


def _triggers(s, d):
    t = series.placed(_series(s, d)).where("value > 95").select("channel", F.floor(F.col("i") / 64).cast("long").alias("block"), "event_id", (F.col("i") % 64).alias("offset"))
    return joins.triggers_with_records(t, series.records(_series(s, d), 64))


def _described(s, d):
    """The users' first event as their run's start; two kinds of users are unknown."""
    e = stream(s, d).select(F.col("user_id").alias("channel"), "ts", "event_id", "value")
    starts = stream(s, d).where("user_id % 3 > 0").groupBy(F.col("user_id").alias("channel")).agg(F.unix_seconds(F.min(F.col("ts").cast("timestamp"))).alias("start"))
    kinds = stream(s, d).where("user_id < 100").select(F.col("user_id").alias("channel"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("kind")).distinct()
    return series.described(series.records(e, 16).drop("samples"), starts, 4000, kinds)


def _thresholds(s, d):
    return traces(s, d).select("trace_id", "channel", F.array_max(reduced.doubles()).alias("top")).join(events.sigma_thresholds(traces(s, d), [2.5]), "channel").select("trace_id", "channel", "threshold", (F.col("top") > F.col("threshold")).alias("fired"))


def _grid(s, d):
    """Every pair of sigma and threshold met by every channel's count."""
    tops = traces(s, d).select("channel", F.array_max("samples").cast("double").alias("top"))
    both = tops.join(F.broadcast(joins.grid(s, sigma=[0.05, 0.1], n=[2.0, 3.0, 4.0])))
    return both.groupBy("channel", "sigma", "n").agg(F.count_if(F.col("top") > F.col("sigma") * F.col("n")).cast("int").alias("hits"))


def _finite(s, d):
    """Maxima with all that isn't finite among them: by channel, a null, not a number, an infinity."""
    top = F.round(F.array_max("samples").cast("double"), 6)
    odd = F.when(F.col("channel") == 1, F.lit(None)).when(F.col("channel") == 2, F.lit(float("nan"))).when(F.col("channel") == 3, F.lit(float("inf"))).otherwise(top)
    rows = traces(s, d).select("energy", "trace_id", odd.alias("x")).withColumn("x", selection.finite("x"))
    return selection.ranked(rows, "energy", "x", "trace_id").select("energy", "trace_id", "rank", (F.col("x") == float("-inf")).alias("none"))


def _hits(s, d):
    return holdoff.held_off(places(s, d), 80.0, 0.5, 4)


def _scalars(s, d):
    e, x = series.placed(_series(s, d)), F.col("value")
    position = F.col("i") + F.floor(x).cast("long")
    return e.select(
        "event_id", F.round(models.fwhm(x), 6).alias("fwhm"), F.round(models.centre(F.floor(x / 5), 0.0, 100.0, 20), 4).alias("centre"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ns"),
        position.alias("position"), (position - F.col("event_id")).alias("delta"), F.concat(F.round(x / 10, 1).cast("string"), F.lit(" sigma")).alias("label"), F.round(x * 0.7674, 6).alias("threshold"),
    )


def _significant(s, d):
    fits = places(s, d).where("v > 75").select("channel", (F.col("i") + 3).alias("position"), "v", "event_id")
    truth = places(s, d).groupBy("channel").agg(F.max_by("i", F.struct("v", -F.col("i"))).alias("inject"))
    return joins.with_truth(fits, truth, "channel", 5).select("event_id", "position", "delta", "implausible")


QUERIES = {
    "default_mask": lambda s, d: selection.cut_share(selection.masked(items(s, d), _RANGES), "mask", "l_returnflag"),
    "range_traces": _range_traces,
    "two_stage": lambda s, d: calibration.within(calibration.within(items(s, d), l_quantity=(10, 30)), l_tax=(0.02, 0.04)).select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"),
    "either_window": lambda s, d: selection.in_any(items(s, d), "l_quantity", [(1, 3), (20, 22), (48, 50)]).groupBy("l_quantity").agg(F.count("*").alias("n")),
    "listed_dropped": lambda s, d: selection.without(_quantities(s, d), traces(s, d).where(F.exists("samples", lambda x: x > 0.4)), "trace_id").select("trace_id", "top"),
    "parted_by_limit": lambda s, d: selection.parted(items(s, d), "l_discount", 0.05).groupBy("good").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean")),
    "finite_ranks": _finite,
    "first_traces": lambda s, d: selection.first(traces(s, d).select("energy", "trace_id"), "energy", "trace_id", 7),
    "baseline_added": lambda s, d: combined.less_baseline(traces(s, d), 16).join(traces(s, d).select("trace_id", F.col("channel").alias("c")), "trace_id").select("trace_id", F.posexplode(F.transform("samples", lambda x: x + F.col("c") / 8)).alias("i", "v")).select("trace_id", "i", F.round("v", 6).alias("v")),
    "amplitude_listing": lambda s, d: selection.ranked(_quantities(s, d), "channel", "top", "trace_id").select("channel", "rank", "trace_id", "top"),
    "complete_rows": lambda s, d: selection.complete(_quantities(s, d).withColumn("low", F.when(F.col("low") > -0.3, F.col("low"))), "event_id", "channel"),
    "channel_thresholds": _thresholds,
    "unique_lookup": _lookup,
    "triggers_with_records": _triggers,
    "parameter_grid": _grid,
    "channel_covariance": lambda s, d: events.covariance(traces(s, d)),
    "share_pivot": lambda s, d: models.share_pivot(stream(s, d).withColumn("hour", F.hour("ts")), "hour", "event_type", ["click", "error", "purchase"]),
    "distinct_blocks": lambda s, d: series.placed(_series(s, d)).select("channel", F.floor(F.col("i") / 64).cast("long").alias("block")).distinct(),
    "best_chi2": lambda s, d: models.best(_scan(s, d), "chi2", "slope", "level"),
    "rise_time": lambda s, d: sequence.edges(traces(s, d)).select("trace_id", F.round(F.col("rise") * 0.128, 6).alias("rise_ms")),
    "time_axis": lambda s, d: sequence.edges(traces(s, d)).select("trace_id", F.posexplode(sequence.time_axis(F.col("edge"), F.lit(64), 0.128)).alias("i", "t")).select("trace_id", "i", F.round("t", 6).alias("t")),
    "pretrigger_rms": lambda s, d: combined.channel_statistics(combined.less_baseline(traces(s, d), 16).withColumn("samples", F.slice("samples", 1, 16))).select("channel", F.round("std", 6).alias("rms")),
    "near_peak": lambda s, d: traces(s, d).select("trace_id", F.explode(sequence.near_peak(reduced.doubles())).alias("z")).select("trace_id", F.col("z.k").alias("k"), F.round("z.x", 6).alias("x")),
    "triggered_sum": lambda s, d: events.triggered_sum(traces(s, d), 0.3).select("event_id", "n", F.posexplode("samples").alias("i", "v")).withColumn("v", F.round("v", 5)),
    "top_two": lambda s, d: events.top_two(traces(s, d)),
    "unit_area": lambda s, d: sequence.exploded(traces(s, d), sequence.unit_area(F.transform(reduced.doubles(), lambda x: x + 1)), "v").select("trace_id", "i", F.round("v", 8).alias("v")),
    "polynomial_smoothed": lambda s, d: sequence.exploded(traces(s, d), kernels.polynomial_smoothed(reduced.doubles(), 5, 2), "v").select("trace_id", "i", F.round("v", 6).alias("v")),
    "full_convolution": lambda s, d: sequence.exploded(traces(s, d), kernels.convolution([1.0, -2.0, 0.5], reduced.doubles()), "v").select("trace_id", "i", F.round("v", 6).alias("v")),
    "same_convolution": lambda s, d: sequence.exploded(traces(s, d), kernels.convolution([1.0, -2.0, 0.5], reduced.doubles(), "same"), "v").select("trace_id", "i", F.round("v", 6).alias("v")),
    "series_records": lambda s, d: series.records(_series(s, d), 64).select("channel", "block", "n", F.round(sequence.total(F.col("samples")), 4).alias("total")),
    "record_times": _described,
    "holdoff_trigger": _hits,
    "hits_per_record": lambda s, d: events.hits_per_record(_hits(s, d), series.records(places(s, d).select("channel", "ts", "event_id", F.col("v").alias("value")), 16), 16),
    "significant_fits": _significant,
    "smoothed_spectrum": lambda s, d: models.smoothed(calibration.histogram(items(s, d), "l_quantity", 0, 50, 50), 50, 1.5),
    "scalar_functions": _scalars,
    "gap_free": lambda s, d: selection.filled(series.placed(_series(s, d)).where("value > 50").withColumn("block", F.floor(F.col("i") / 64).cast("long")).withColumn("place", F.col("i") % 64), "block", "place", "value", 64).select("block", F.posexplode("samples").alias("i", "v")),
    "concatenated": lambda s, d: traces(s, d).where("energy = 1").unionByName(traces(s, d).where("energy = 3")).unionByName(traces(s, d).where("energy = 5")).groupBy("energy").agg(F.count("*").alias("n")),
    "labelled_union": lambda s, d: combined.labelled(_quantities(s, d).where("channel < 5"), _quantities(s, d).where("channel >= 5")).select("trace_id", "top", "positive"),
    "channel_difference": lambda s, d: traces(s, d).select("channel").distinct().exceptAll(traces(s, d).where(F.array_max("samples") > 0.42).select("channel").distinct()),
    "mask_intersection": lambda s, d: selection.in_all(*(items(s, d).where(c).select("l_orderkey") for c in ("l_quantity > 40", "l_discount < 0.03", "l_tax > 0.04"))),
}
_M = f"(SELECT trace_id, event_id, channel, energy, v, round(list_max(v), 6) AS top, round(list_min(v), 6) AS low FROM {T})"
_E = "(SELECT event_type AS channel, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, event_id, ts, value FROM events)"
_U = "(SELECT user_id AS channel, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, ts, value FROM events)"
_EDGE = f"""WITH d AS (SELECT trace_id, i, x, lead(x, 2) OVER w - 2 * lead(x) OVER w + x AS d FROM {LONG} WINDOW w AS (PARTITION BY trace_id ORDER BY i)),
 s AS (SELECT trace_id, stddev_pop(d) AS s, avg(x) FILTER (i < 16) AS start FROM d GROUP BY 1), t AS (SELECT trace_id, list_position(v, list_max(v)) - 1 AS top, list_max(v) AS high FROM {T}),
 e AS (SELECT trace_id, any_value(top) AS top, CASE WHEN coalesce(min(i) FILTER (d > 5 * s), 0) > 0 THEN min(i) FILTER (d > 5 * s) ELSE coalesce(min(i) FILTER (d > 4 * s), 0) END AS edge,
  coalesce(min(i) FILTER (i < top AND x - start > 0.8 * (high - start)), 0) - coalesce(min(i) FILTER (i < top AND x - start > 0.2 * (high - start)), 0) AS rise FROM d JOIN s USING (trace_id) JOIN t USING (trace_id) GROUP BY 1)"""
_FIR = "SELECT trace_id, i, round(coalesce(lag(x, {0}) OVER w, 0) + -2 * coalesce(lag(x, {1}) OVER w, 0) + 0.5 * coalesce(lag(x, {2}) OVER w, 0), 6) AS v FROM (SELECT trace_id, i, x FROM {3} UNION ALL SELECT trace_id, CAST(j AS INTEGER), 0 FROM {4}, range(64, 66) r(j)) WINDOW w AS (PARTITION BY trace_id ORDER BY i)"
_KEPT = "[[31, 9, -3, -5, 3], [9, 13, 12, 6, -5], [-3, 12, 17, 12, -3], [-5, 6, 12, 13, 9], [3, -5, -3, 9, 31]]"
_HELD = f"""WITH RECURSIVE s AS (SELECT channel, i, v, row_number() OVER (PARTITION BY channel ORDER BY i) AS r FROM {P} WHERE v > 80 OR v < 40),
 h(channel, r, i, hit, fired, free) AS (SELECT channel, r, i, v > 80, v > 80, CASE WHEN v > 80 THEN i + 5 ELSE i + 1 END FROM s WHERE r = 1
 UNION ALL SELECT s.channel, s.r, s.i, s.i >= h.free AND NOT h.fired AND s.v > 80, CASE WHEN s.i < h.free THEN h.fired WHEN NOT h.fired THEN s.v > 80 ELSE NOT s.v < 40 END,
  CASE WHEN s.i >= h.free AND NOT h.fired AND s.v > 80 THEN s.i + 5 ELSE h.free END FROM h JOIN s ON s.channel = h.channel AND s.r = h.r + 1)"""
ORACLE = {
    "default_mask": """SELECT l_returnflag, count(*) AS n, count(*) FILTER (m) AS n_pass, round(avg(m::INT), 6) AS share, round(100 * (1 - avg(m::INT)), 4) AS removed_percent
 FROM (SELECT l_returnflag, l_quantity BETWEEN 10 AND 40 AND l_discount BETWEEN 0.02::DOUBLE AND 0.06::DOUBLE AS m FROM lineitem) GROUP BY 1""",
    "range_traces": f"SELECT trace_id, top, low, CAST(len(v) AS INTEGER) AS n, round(v[1], 6) AS first FROM {_M} WHERE top BETWEEN 0.3::DOUBLE AND 0.4::DOUBLE AND low BETWEEN -0.4::DOUBLE AND -0.25::DOUBLE",
    "two_stage": "SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem WHERE l_quantity BETWEEN 10 AND 30 AND l_tax BETWEEN 0.02::DOUBLE AND 0.04::DOUBLE",
    "either_window": "SELECT l_quantity, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 1 AND 3 OR l_quantity BETWEEN 20 AND 22 OR l_quantity BETWEEN 48 AND 50 GROUP BY 1",
    "listed_dropped": f"SELECT trace_id, top FROM {_M} WHERE NOT list_max(v) > 0.4::FLOAT",
    "parted_by_limit": "SELECT l_discount < 0.05::DOUBLE AS good, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1",
    "finite_ranks": f"""SELECT energy, trace_id, row_number() OVER (PARTITION BY energy ORDER BY x DESC NULLS LAST, trace_id) AS rank, x IS NULL AS "none" FROM (SELECT energy, trace_id, CASE WHEN channel NOT IN (1, 2, 3) THEN top END AS x FROM {_M})""",
    "first_traces": f"SELECT energy, trace_id FROM {T} QUALIFY row_number() OVER (PARTITION BY energy ORDER BY trace_id) <= 7",
    "baseline_added": f"SELECT trace_id, i, round(x - avg(x) FILTER (i < 16) OVER (PARTITION BY trace_id) + channel / 8, 6) AS v FROM {LONG}",
    "amplitude_listing": f"SELECT channel, row_number() OVER (PARTITION BY channel ORDER BY top DESC, trace_id) AS rank, trace_id, top FROM {_M}",
    "complete_rows": f"SELECT trace_id, top, low FROM {_M} WHERE low > -0.3::DOUBLE",
    "channel_thresholds": f"""WITH s AS (SELECT channel, round(2.5 * stddev_samp(x), 6) AS threshold FROM {LONG} GROUP BY 1) SELECT trace_id, channel, threshold, list_max(v) > threshold AS fired FROM {T} JOIN s USING (channel)""",
    "unique_lookup": f"SELECT trace_id, channel, count(*) OVER (PARTITION BY channel) AS n_traces, max(top) OVER (PARTITION BY channel) AS best FROM {_M}",
    "triggers_with_records": f"SELECT channel, i // 64 AS block, event_id, value AS sample FROM {_E} WHERE value > 95",
    "parameter_grid": f"""SELECT channel, sigma, n, CAST(count(*) FILTER (list_max(v) > sigma * n) AS INTEGER) AS hits FROM {T}, (VALUES (0.05::DOUBLE), (0.1::DOUBLE)) a(sigma), (VALUES (2.0::DOUBLE), (3.0::DOUBLE), (4.0::DOUBLE)) b(n) GROUP BY 1, 2, 3""",
    "channel_covariance": f"SELECT x.channel AS a, y.channel AS b, round(covar_samp(x.x, y.x), 7) AS cov FROM {LONG} x JOIN {LONG} y ON x.event_id = y.event_id AND x.i = y.i AND x.channel <= y.channel GROUP BY 1, 2",
    "share_pivot": "SELECT CAST(hour(ts) AS INTEGER) AS hour, " + ", ".join(f"round(avg((event_type = '{e}')::INT), 6) AS {e}" for e in ("click", "error", "purchase")) + " FROM events WHERE event_type IN ('click', 'error', 'purchase') GROUP BY 1",
    "distinct_blocks": f"SELECT DISTINCT channel, i // 64 AS block FROM {_E}",
    "best_chi2": f"""SELECT slope, level, round(c, 3) AS chi2, ndof, round(c / ndof, 4) AS reduced FROM (SELECT slope, level, sum((n - level * (1 + slope * x / 100000)) ** 2 / n) AS c, count(*) - 2 AS ndof
 FROM {_HIST}, (SELECT a * 0.25::DOUBLE - 0.5::DOUBLE AS slope, b * 100.0::DOUBLE + 100 AS level FROM range(0, 5) p(a), range(0, 5) q(b)) GROUP BY 1, 2) ORDER BY chi2, slope, level LIMIT 1""",
    "rise_time": f"{_EDGE} SELECT trace_id, CASE WHEN top > 0 THEN round(CAST(rise AS INTEGER) * 0.128::DOUBLE, 6) END AS rise_ms FROM e",
    "time_axis": f"{_EDGE} SELECT trace_id, CAST(i AS INTEGER) AS i, round((i - edge) * 0.128::DOUBLE, 6) AS t FROM e, range(0, 64) r(i)",
    "pretrigger_rms": f"SELECT channel, round(round(stddev_pop(x), 7), 6) AS rms FROM (SELECT channel, x - avg(x) OVER (PARTITION BY trace_id) AS x FROM {LONG} WHERE i < 16) GROUP BY 1",
    "near_peak": f"SELECT l.trace_id, CAST(l.i - t AS INTEGER) AS k, round(x, 6) AS x FROM {LONG} l JOIN (SELECT trace_id, list_position(v, list_max(v)) - 1 AS t FROM {T}) p ON p.trace_id = l.trace_id AND abs(l.i - t) <= 2",
    "triggered_sum": f"SELECT event_id, CAST(count(*) AS INTEGER) AS n, i, round(sum(x), 5) AS v FROM {LONG} JOIN (SELECT trace_id FROM {T} WHERE list_max(v) > 0.3::DOUBLE) USING (trace_id) GROUP BY event_id, i",
    "top_two": f"SELECT event_id, CAST(r AS INTEGER) AS rank, channel, round(a, 6) AS amp, CAST(t AS BIGINT) AS place FROM (SELECT event_id, channel, list_max(v) AS a, list_position(v, list_max(v)) - 1 AS t, row_number() OVER (PARTITION BY event_id ORDER BY list_max(v) DESC, channel) AS r FROM {T}) WHERE r <= 2",
    "unit_area": f"WITH a AS (SELECT trace_id, sum(x + 1) - (arg_min(x, i) + arg_max(x, i) + 2) / 2 AS a FROM {LONG} GROUP BY 1) SELECT trace_id, i, round((x + 1) / a, 8) AS v FROM {LONG} JOIN a USING (trace_id)",
    "polynomial_smoothed": f"""SELECT trace_id, CAST(i AS INTEGER) AS i, round(list_sum(list_transform(range(1, 6), lambda j: v[s + j] * k[j])) / 35, 6) AS v FROM (SELECT trace_id, v, i, s, ({_KEPT})[i - s + 1] AS k FROM {T}, (SELECT i, greatest(0, least(i - 2, 59)) AS s FROM range(0, 64) r(i)))""",
    "full_convolution": _FIR.format(0, 1, 2, LONG, T),
    "same_convolution": f"SELECT trace_id, CAST(i - 1 AS INTEGER) AS i, v FROM ({_FIR.format(0, 1, 2, LONG, T)}) WHERE i BETWEEN 1 AND 64",
    "series_records": f"SELECT channel, i // 64 AS block, CAST(count(*) AS INTEGER) AS n, round(sum(value), 4) AS total FROM {_E} GROUP BY 1, 2",
    "record_times": f"""WITH r AS (SELECT channel, i // 16 AS block, count(*) AS n, min(epoch_us(min(ts))) OVER (PARTITION BY channel) AS t0, max(count(*)) OVER (PARTITION BY channel) AS l FROM {_U} GROUP BY 1, 2)
 SELECT channel, block, CAST(n AS INTEGER) AS n, CASE WHEN channel < 100 THEN CASE WHEN channel % 2 = 0 THEN 'even' ELSE 'odd' END END AS kind, CAST(4000 AS INTEGER) AS dt,
 CAST(CASE WHEN channel % 3 > 0 THEN t0 // 1000000 ELSE 0 END * 1000000000 + block * l * 4000 AS BIGINT) AS time, CAST(CASE WHEN channel % 3 > 0 THEN t0 // 1000000 ELSE 0 END * 1000000000 + block * l * 4000 + n * 4000 AS BIGINT) AS endtime FROM r""",
    "holdoff_trigger": f"{_HELD} SELECT channel, i FROM h WHERE hit",
    "hits_per_record": f"{_HELD} SELECT b.channel, block, count(h.i) AS hits FROM (SELECT DISTINCT channel, i // 16 AS block FROM {P}) b LEFT JOIN h ON h.channel = b.channel AND h.hit AND h.i // 16 = block GROUP BY 1, 2",
    "significant_fits": f"""WITH t AS (SELECT channel, arg_max(i, struct_pack(v := v, i := -i)) AS inject FROM {P} GROUP BY 1) SELECT event_id, i + 3 AS "position", i + 3 - inject AS delta, abs(i + 3 - inject) > 5 AS implausible FROM {P} JOIN t USING (channel) WHERE v > 75""",
    "smoothed_spectrum": """WITH h AS (SELECT CAST(least(floor(l_quantity), 49) AS BIGINT) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1), k AS (SELECT j, exp(-0.5 * (j / 1.5) ** 2) AS w FROM range(-6, 7) r(j)),
 m AS (SELECT b AS bin, b + j AS place, w / (SELECT sum(w) FROM k) AS w FROM range(0, 50) r(b), k) SELECT m.bin, round(sum(w * coalesce(n, 0)), 6) AS n FROM m LEFT JOIN h ON h.bin = CASE WHEN place < 0 THEN -1 - place WHEN place > 49 THEN 99 - place ELSE place END GROUP BY 1""",
    "scalar_functions": f"""SELECT event_id, round(2 * sqrt(2 * ln(2)) * value, 6) AS fwhm, round((floor(value / 5) + 0.5) * 5, 4) AS centre, epoch_us(ts) * 1000 AS ns, i + CAST(floor(value) AS BIGINT) AS "position", i + CAST(floor(value) AS BIGINT) - event_id AS delta,
 CAST(round(value / 10, 1) AS VARCHAR) || ' sigma' AS label, round(value * 0.7674::DOUBLE, 6) AS threshold FROM {_E}""",
    "gap_free": f"""WITH e AS (SELECT i // 64 AS block, i % 64 AS i, max(value) AS v FROM {_E} WHERE value > 50 GROUP BY 1, 2) SELECT b.block, CAST(r.i AS INTEGER) AS i, coalesce(v, 0) AS v FROM (SELECT DISTINCT block FROM e) b CROSS JOIN range(0, 64) r(i) LEFT JOIN e ON e.block = b.block AND e.i = r.i""",
    "concatenated": f"SELECT energy, count(*) AS n FROM {T} WHERE energy IN (1, 3, 5) GROUP BY 1",
    "labelled_union": f"SELECT trace_id, top, channel >= 5 AS positive FROM {_M}",
    "channel_difference": f"SELECT channel FROM {T} GROUP BY 1 HAVING NOT max(list_max(v)) > 0.42::FLOAT",
    "mask_intersection": "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_or(l_quantity > 40) AND bool_or(l_discount < 0.03::DOUBLE) AND bool_or(l_tax > 0.04::DOUBLE)",
}
