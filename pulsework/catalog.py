"""The registered queries of the trace operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import calibration, events, joins, reduced, series, shape, spectra
from .plans import banks, calibrated, combined, cuts, matched, sequences, shapes, streams, triggers


def _traces(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("trace_id"), F.col("embedding").alias("samples"), F.col("label").alias("energy"), F.floor(F.col("vec_id") / 9).cast("long").alias("event_id"), (F.col("vec_id") % 9).alias("channel"))


def _series(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("channel"), "ts", "event_id", "value")


def _items(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet")


def _scores(spark, d):
    return _traces(spark, d).select((F.col("energy") >= 5).alias("positive"), F.array_max("samples").cast("double").alias("score"))


def _quiet(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("user_id").alias("channel"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value")
    return joins.quiet(rows, rows.where("value > 50"), _DAY, _DAY // 2).select("event_id")


def _bank(spark, d):
    bank = spark.createDataFrame([(0, 4, "low"), (5, 5, "middle"), (6, 8, "high")], "lo long, hi long, template string")
    return joins.by_channel_range(_traces(spark, d), bank).select("trace_id", "channel", "template")


_DAY = 86_400_000_000
GRID = [0.1, 0.2, 0.3]
QUERIES = {
    "reduced_quantities": lambda s, d: reduced.reduced(_traces(s, d)),
    "trigger_efficiency": lambda s, d: reduced.efficiency(_traces(s, d), GRID),
    "fold_maximum": lambda s, d: reduced.fold_maximum(_traces(s, d)),
    "sum_channel": lambda s, d: reduced.pooled_sum(_traces(s, d)),
    "range_query": lambda s, d: calibration.within(_items(s, d), l_quantity=(10, 20), l_discount=(0.02, 0.05)).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"),
    "histogram": lambda s, d: calibration.histogram(_items(s, d), "l_quantity", 0, 50, 20),
    "group_summary": lambda s, d: calibration.summary(_items(s, d), "l_returnflag", "l_extendedprice"),
    "tumbling_windows": lambda s, d: series.tumbling(_series(s, d), 64),
    "hysteresis_trigger": lambda s, d: series.hysteresis(_series(s, d), 80.0, 0.5),
    "trace_shape": lambda s, d: shape.shape(_traces(s, d)),
    "exceeding_events": lambda s, d: shape.exceeding(_traces(s, d), 0.35),
    "coincidence_score": lambda s, d: events.coincidence(_traces(s, d), 10),
    "fold_multiplicity": lambda s, d: events.multiplicity(_traces(s, d), 0.3),
    "sigma_thresholds": lambda s, d: events.sigma_thresholds(_traces(s, d), [2, 2.5, 3]),
    "any_channel_efficiency": lambda s, d: events.any_channel(_traces(s, d), events.sigma_thresholds(_traces(s, d), [2, 2.5, 3])),
    "roc_grid": lambda s, d: events.roc(_scores(s, d), [0.1, 0.2, 0.25, 0.3, 0.4]),
    "channel_correlation": lambda s, d: events.correlation(_traces(s, d)),
    "channel_bank": _bank,
    "quiet_windows": _quiet,
    "noise_psd": lambda s, d: spectra.psd(_traces(s, d).where("energy = 0")),
    "moving_power": lambda s, d: series.moving_power(_series(s, d), 32),
    "binned_mean": lambda s, d: calibration.binned_mean(_items(s, d), "l_quantity", "l_extendedprice", 0, 50, 10),
    "histogram_2d": lambda s, d: calibration.histogram_2d(_items(s, d), ("l_quantity", 0, 50, 10), ("l_discount", 0, 0.1, 5)),
    "cut_flow": lambda s, d: calibration.cut_flow(_items(s, d), {"quantity": "l_quantity between 10 and 40", "discount": "l_discount < 0.06", "tax": "l_tax > 0.02"}),
}
_V = "(SELECT event_type AS channel, ts, event_id, value FROM events)"
ORACLE = {
    "reduced_quantities": """SELECT vec_id AS trace_id, round(list_sum(v) / len(v), 6) AS mean, round(list_sum(v[1:16]) / 16, 6) AS mean_baseline, round(list_max(v) - list_sum(v[1:16]) / 16, 6) AS amplitude,
 CAST(list_position(v, list_max(v)) - 1 AS BIGINT) AS peak_arg, round(list_max(v) - list_min(v), 6) AS height FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)""",
    "trigger_efficiency": """SELECT energy, threshold, n, n_pass, round(n_pass / n, 6) AS eff, round(sqrt(n_pass / n * (1 - n_pass / n) / n), 6) AS err FROM (
 SELECT label AS energy, threshold, count(*) AS n, CAST(sum(CASE WHEN list_max(CAST(embedding AS DOUBLE[])) > threshold THEN 1 ELSE 0 END) AS BIGINT) AS n_pass FROM embeddings, (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE)) t(threshold) GROUP BY ALL)""",
    "fold_maximum": """SELECT event_id, round(coalesce(t[2], t[1]), 6) AS score FROM (SELECT vec_id // 9 AS event_id, list_reverse_sort(list(list_max(CAST(embedding AS DOUBLE[])))) AS t FROM embeddings GROUP BY 1)""",
    "sum_channel": """SELECT event_id, i, round(sum(v), 5) AS v FROM (SELECT vec_id // 9 AS event_id, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS i, unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings) GROUP BY ALL""",
    "range_query": "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount BETWEEN 0.02 AND 0.05",
    "histogram": "SELECT CAST(least(floor(l_quantity / 2.5), 19) AS BIGINT) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1",
    "group_summary": "SELECT l_returnflag, count(l_extendedprice) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std, round(quantile_cont(l_extendedprice, 0.01), 4) AS p1, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem GROUP BY 1",
    "tumbling_windows": f"""SELECT channel, "window", round(avg(value), 8) AS mean, max(value) AS top FROM (SELECT *, (row_number() OVER (PARTITION BY channel ORDER BY ts, event_id) - 1) // 64 AS "window" FROM {_V}) GROUP BY 1, 2 HAVING count(*) = 64""",
    "hysteresis_trigger": f"""SELECT channel, event_id FROM (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY channel ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM (
 SELECT *, CASE WHEN value > 80 THEN 1 WHEN value < 40 THEN 0 END AS mark FROM {_V})) WHERE mark = 1 AND coalesce(was, 0) = 0""",
}
_T = "(SELECT vec_id, vec_id // 9 AS event_id, vec_id % 9 AS channel, label, CAST(embedding AS DOUBLE[]) AS v, list_max(CAST(embedding AS DOUBLE[])) AS top FROM embeddings)"
_LONG = f"(SELECT vec_id, event_id, channel, label, top, unnest(range(0, len(v))) AS i, unnest(v) AS x FROM {_T})"
_SIGMA = f"(SELECT channel, n_sigma, round(n_sigma * s, 6) AS threshold FROM (SELECT channel, stddev_samp(x) AS s FROM {_LONG} GROUP BY 1), (VALUES (2.0::DOUBLE), (2.5::DOUBLE), (3.0::DOUBLE)) t(n_sigma))"
ORACLE |= {
    "trace_shape": f"""SELECT vec_id AS trace_id, round(stddev_pop(x), 6) AS std, round(regr_slope(x, i) FILTER (i < 16), 6) AS slope, round(sum(i * abs(x)) / sum(abs(x)), 5) AS centre,
 CAST(max(i) FILTER (x >= top / 2) - min(i) FILTER (x >= top / 2) AS BIGINT) AS width, round(sum(x * x), 6) AS energy FROM {_LONG} GROUP BY 1""",
    "exceeding_events": f"SELECT event_id, max(top) > 0.35 AS fired, NOT max(top) > 0.35 AS empty FROM {_T} GROUP BY 1",
    "coincidence_score": f"""SELECT event_id, round(max(CASE WHEN r = 1 THEN top END) + CASE WHEN abs(max(CASE WHEN r = 1 THEN t END) - max(CASE WHEN r = 2 THEN t END)) < 10 THEN max(CASE WHEN r = 2 THEN top END) ELSE 0 END, 6) AS score
 FROM (SELECT event_id, top, list_position(v, top) AS t, row_number() OVER (PARTITION BY event_id ORDER BY top DESC, channel) AS r FROM {_T}) GROUP BY 1""",
    "fold_multiplicity": f"""SELECT count(*) AS n, round(avg((f >= 1)::INT), 6) AS ge1, round(avg((f >= 2)::INT), 6) AS ge2, round(avg((f >= 3)::INT), 6) AS ge3 FROM (SELECT event_id, sum((top > 0.3)::INT) AS f FROM {_T} GROUP BY 1)""",
    "sigma_thresholds": f"SELECT * FROM {_SIGMA}",
    "any_channel_efficiency": f"""SELECT n_sigma, count(*) AS n, CAST(sum(fired::INT) AS BIGINT) AS n_fired, round(sum(fired::INT) / count(*), 6) AS eff
 FROM (SELECT n_sigma, event_id, bool_or(top > threshold) AS fired FROM {_T} JOIN {_SIGMA} USING (channel) GROUP BY 1, 2) GROUP BY 1""",
    "roc_grid": f"""SELECT threshold, round(avg((top > threshold)::INT) FILTER (label >= 5), 6) AS tpr, round(avg((top > threshold)::INT) FILTER (label < 5), 6) AS fpr
 FROM {_T}, (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.25::DOUBLE), (0.3::DOUBLE), (0.4::DOUBLE)) t(threshold) GROUP BY 1""",
    "channel_correlation": f"SELECT x.channel AS a, y.channel AS b, round(corr(x.x, y.x), 6) AS corr FROM {_LONG} x JOIN {_LONG} y ON x.event_id = y.event_id AND x.i = y.i AND x.channel <= y.channel GROUP BY 1, 2",
    "channel_bank": "SELECT vec_id AS trace_id, vec_id % 9 AS channel, CASE WHEN vec_id % 9 <= 4 THEN 'low' WHEN vec_id % 9 = 5 THEN 'middle' ELSE 'high' END AS template FROM embeddings",
    "quiet_windows": f"""SELECT event_id FROM events w WHERE NOT EXISTS (SELECT 1 FROM events t WHERE t.user_id = w.user_id AND t.value > 50 AND epoch_us(t.ts) BETWEEN epoch_us(w.ts) - {_DAY} AND epoch_us(w.ts) + {_DAY // 2})""",
    "noise_psd": f"""SELECT CAST(64 AS INTEGER) AS length, CAST(k AS INTEGER) AS k, k / 64 AS frequency, round(avg(re * re + im * im) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END / 64, 8) AS psd FROM (
 SELECT vec_id, k, sum(x * cos(2 * pi() * k * i / 64)) AS re, sum(x * sin(2 * pi() * k * i / 64)) AS im FROM {_LONG}, range(0, 33) t(k) WHERE label = 0 GROUP BY 1, 2) GROUP BY k""",
    "moving_power": f"""SELECT channel, event_id, round(p, 4) AS power FROM (SELECT channel, event_id, sum(value * value) OVER w AS p, count(*) OVER w AS n FROM {_V} WINDOW w AS (PARTITION BY channel ORDER BY ts, event_id ROWS BETWEEN 31 PRECEDING AND CURRENT ROW)) WHERE n = 32""",
    "binned_mean": "SELECT CAST(least(floor(l_quantity / 5), 9) AS BIGINT) AS bin, count(l_extendedprice) AS n, round(avg(l_extendedprice), 4) AS mean FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1",
    "histogram_2d": """SELECT CAST(least(floor((l_quantity - 0) / 5.0::DOUBLE), 9) AS BIGINT) AS x, CAST(least(floor((l_discount - 0) / (0.1::DOUBLE / 5)), 4) AS BIGINT) AS y, count(*) AS n
 FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 AND l_discount BETWEEN 0::DOUBLE AND 0.1::DOUBLE GROUP BY 1, 2""",
    "cut_flow": """SELECT count(*) AS n, count(*) FILTER (l_quantity BETWEEN 10 AND 40) AS quantity, count(*) FILTER (l_quantity BETWEEN 10 AND 40 AND l_discount < 0.06::DOUBLE) AS discount,
 count(*) FILTER (l_quantity BETWEEN 10 AND 40 AND l_discount < 0.06::DOUBLE AND l_tax > 0.02::DOUBLE) AS tax FROM lineitem""",
}


for _more in (matched, sequences, calibrated, combined, streams, triggers, banks, cuts, shapes):
    QUERIES |= _more.QUERIES
    ORACLE |= _more.ORACLE


def flagship(spark, sf_dir):
    return QUERIES["trigger_efficiency"](spark, sf_dir)
