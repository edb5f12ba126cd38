"""Queries of sample sequences, with their SQL."""

from pyspark.sql import functions as F

from ..operators import kernels, reduced, selection, sequence
from .tables import LONG, P, T, places, traces

def _exploded(values, name):
    return lambda s, d: sequence.exploded(traces(s, d), values(reduced.doubles()), "x").select("trace_id", "i", F.round("x", 6).alias(name))


def _second(v):
    return sequence.first_difference(sequence.first_difference(v))


def _area(s, d):
    return traces(s, d).select("trace_id", F.round(sequence.area(reduced.doubles()), 6).alias("area"))


def _edge_response(s, d):
    return sequence.exploded(traces(s, d), kernels.weights(sequence.gauss_step(2), reduced.doubles()), "x").select("trace_id", "i", F.round("x", 6).alias("v"))


def _segments(s, d):
    """Windows that touch, put together again: the traces themselves."""
    back = sequence.joined_segments(sequence.hop_windows(traces(s, d), 16, 16))
    return back.select("trace_id", F.size("samples").alias("n"), F.round(F.element_at("samples", -1).cast("double"), 6).alias("last"))


QUERIES = {
    "first_difference": _exploded(sequence.first_difference, "d"),
    "second_difference": _exploded(_second, "d"),
    "gradient": _exploded(kernels.gradient, "g"),
    "trapezoid_area": _area,
    "median_filter": _exploded(lambda v: kernels.median_filter(v, 5), "m"),
    "rolled_traces": _exploded(lambda v: sequence.roll(v, 7), "v"),
    "shifted_traces": _exploded(lambda v: sequence.shifted(v, -5), "v"),
    "padded_traces": lambda s, d: traces(s, d).select("trace_id", F.size(sequence.padded(reduced.doubles(), 100)).alias("n"), F.round(sequence.total(sequence.padded(reduced.doubles(), 100)), 6).alias("total")),
    "clipped_traces": _exploded(lambda v: sequence.clipped(v, 0.1), "v"),
    "quantised_traces": lambda s, d: sequence.exploded(traces(s, d), sequence.quantised(reduced.doubles(), 1000.0), "q").select("trace_id", "i", F.col("q").cast("int").alias("q")),
    "edge_response": _edge_response,
    "rising_edges": lambda s, d: sequence.edges(traces(s, d)),
    "hop_windows": lambda s, d: sequence.hop_windows(traces(s, d), 16, 8).select("trace_id", "start", F.round(F.array_max("samples").cast("double"), 6).alias("top")),
    "segments_joined": _segments,
    "trace_halves": lambda s, d: selection.halves(traces(s, d).select("trace_id", "energy"), "energy", "trace_id"),
    "channel_range": lambda s, d: traces(s, d).where(F.col("channel").between(5, 8)).select("trace_id", "channel", F.round(sequence.total(F.slice(reduced.doubles(), 17, 16)), 6).alias("total")),
    "not_unique_keys": lambda s, d: selection.not_unique(places(s, d).select("channel", F.date_trunc("hour", "ts").alias("hour")), "channel", "hour").select("channel", F.unix_timestamp("hour").alias("hour"), "n"),
}

_SHIFT = "SELECT trace_id, CAST(i + {0} AS INTEGER) AS i, v"
_K = "[" + ", ".join(repr(x) for x in reversed(sequence.gauss_step(2))) + "]::DOUBLE[]"
ORACLE = {
    "first_difference": f"SELECT trace_id, i, round(d, 6) AS d FROM (SELECT trace_id, i, lead(x) OVER (PARTITION BY trace_id ORDER BY i) - x AS d FROM {LONG}) WHERE d IS NOT NULL",
    "second_difference": f"SELECT trace_id, i, round(d, 6) AS d FROM (SELECT trace_id, i, lead(x, 2) OVER w - 2 * lead(x) OVER w + x AS d FROM {LONG} WINDOW w AS (PARTITION BY trace_id ORDER BY i)) WHERE d IS NOT NULL",
    "gradient": f"SELECT trace_id, i, round(coalesce((lead(x) OVER w - lag(x) OVER w) / 2, lead(x) OVER w - x, x - lag(x) OVER w), 6) AS g FROM {LONG} WINDOW w AS (PARTITION BY trace_id ORDER BY i)",
    "trapezoid_area": f"SELECT trace_id, round(sum((x + y) / 2), 6) AS area FROM (SELECT trace_id, x, lead(x) OVER (PARTITION BY trace_id ORDER BY i) AS y FROM {LONG}) GROUP BY 1",
    "median_filter": f"SELECT trace_id, i, round(quantile_cont(x, 0.5) OVER (PARTITION BY trace_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS m FROM (SELECT trace_id, i, x FROM {LONG} UNION ALL SELECT vec_id, CAST(j AS INTEGER), 0 FROM embeddings, (VALUES (-2), (-1), (64), (65)) z(j)) QUALIFY i BETWEEN 0 AND 63",
    "rolled_traces": f"SELECT trace_id, CAST((i + 7) % 64 AS INTEGER) AS i, round(x, 6) AS v FROM {LONG}",
    "shifted_traces": f"SELECT trace_id, i, round(lead(x, 5) OVER (PARTITION BY trace_id ORDER BY i), 6) AS v FROM {LONG}",
    "padded_traces": f"SELECT trace_id, CAST(100 AS INTEGER) AS n, round(sum(x), 6) AS total FROM {LONG} GROUP BY 1",
    "clipped_traces": f"SELECT trace_id, i, round(greatest(-0.1::DOUBLE, least(0.1::DOUBLE, x)), 6) AS v FROM {LONG}",
    "quantised_traces": f"SELECT trace_id, i, CAST(trunc(x * 1000) AS INTEGER) AS q FROM {LONG}",
    "edge_response": f"SELECT trace_id, CAST(j AS INTEGER) AS i, round(list_sum(list_transform(range(1, 13), lambda m: v[j + m] * ({_K})[m])), 6) AS v FROM {T}, range(0, 53) r(j)",
    "rising_edges": f"""WITH d AS (SELECT trace_id, i, x, lead(x, 2) OVER w - 2 * lead(x) OVER w + x AS d FROM {LONG} WINDOW w AS (PARTITION BY trace_id ORDER BY i)),
 s AS (SELECT trace_id, stddev_pop(d) AS s, avg(x) FILTER (i < 16) AS start FROM d GROUP BY 1), t AS (SELECT trace_id, v, list_position(v, list_max(v)) - 1 AS top, list_max(v) AS high FROM {T}),
 e AS (SELECT trace_id, CASE WHEN coalesce(min(i) FILTER (d > 5 * s), 0) > 0 THEN min(i) FILTER (d > 5 * s) ELSE coalesce(min(i) FILTER (d > 4 * s), 0) END AS edge,
  coalesce(min(i) FILTER (i < top AND x - start > 0.8 * (high - start)), 0) - coalesce(min(i) FILTER (i < top AND x - start > 0.2 * (high - start)), 0) AS rise FROM d JOIN s USING (trace_id) JOIN t USING (trace_id) GROUP BY 1)
 SELECT trace_id, CAST(edge AS INTEGER) AS edge, CASE WHEN edge > 0 THEN round(list_avg(v[1:edge]), 6) END AS base, round(list_avg(v[top + 1:top + 10]) - start, 6) AS height, CASE WHEN top > 0 THEN CAST(rise AS INTEGER) END AS rise,
 round(top + CASE WHEN top > 0 AND top < 63 THEN (v[top] - v[top + 2]) / (2 * (v[top] - 2 * v[top + 1] + v[top + 2])) ELSE 0 END, 5) AS peak FROM e JOIN s USING (trace_id) JOIN t USING (trace_id)""",
    "hop_windows": f"SELECT trace_id, CAST(j * 8 AS INTEGER) AS start, round(list_max(v[j * 8 + 1:j * 8 + 16]), 6) AS top FROM {T}, range(0, 7) r(j)",
    "segments_joined": f"SELECT trace_id, CAST(len(v) AS INTEGER) AS n, round(v[-1], 6) AS last FROM {T}",
    "trace_halves": f"SELECT trace_id, energy, CASE WHEN row_number() OVER (PARTITION BY energy ORDER BY trace_id) > count(*) OVER (PARTITION BY energy) // 2 THEN 1 ELSE 0 END AS half FROM {T}",
    "channel_range": f"SELECT trace_id, channel, round(list_sum(v[17:32]), 6) AS total FROM {T} WHERE channel BETWEEN 5 AND 8",
    "not_unique_keys": f"SELECT channel, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, count(*) AS n FROM {P} GROUP BY 1, 2 HAVING count(*) > 1",
}
