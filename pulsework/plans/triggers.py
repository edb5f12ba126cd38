"""Queries of triggers over events, with their SQL."""

from pyspark.sql import functions as F

from ..operators import combined, filters, reduced
from .matched import _BASE, _SHIFTS, _filter
from .tables import LONG, T, traces


def _single(s, d):
    t = traces(s, d).where("channel < 5")
    return filters.fit_with_shift(t, _filter(s, d), (-8, 8)).join(t.select("trace_id", "event_id"), "trace_id")


def _mixed(s, d):
    return combined.mixed_score(_single(s, d), filters.joint(traces(s, d).where("channel >= 5"), _filter(s, d), (-8, 8)))


def _acceptance(s, d):
    """The raw maximum against the filter's amplitude."""
    raw = traces(s, d).select("trace_id", (F.array_max("samples") > 0.3).alias("fired"))
    of = filters.amplitude(traces(s, d), _filter(s, d)).select("trace_id", (F.col("amp") > 0.2).alias("fired"))
    return combined.acceptance(raw, of, "trace_id")


def _difference(s, d):
    at = lambda t: reduced.efficiency(traces(s, d), [t])
    return combined.efficiency_difference(at(0.25), at(0.3), "energy")


QUERIES = {
    "mixed_trigger": _mixed,
    "trigger_acceptance": _acceptance,
    "efficiency_difference": _difference,
    "count_score": lambda s, d: combined.count_score(traces(s, d), 0.3),
    "channel_statistics": lambda s, d: combined.channel_statistics(traces(s, d)),
    "empty_rate": lambda s, d: combined.empty_rate(traces(s, d), 0.3),
    "group_traces": lambda s, d: combined.group_traces(traces(s, d), {"submerged": (0, 4), "vacuum": (5, 8), "all": (0, 8)}),
    "baseline_removed": lambda s, d: combined.less_baseline(traces(s, d), 16).select("trace_id", F.round(F.array_max("samples"), 6).alias("top")),
    "missing_channels": lambda s, d: combined.missing(traces(s, d), traces(s, d).where(F.array_max("samples") > 0.3), "event_id", "channel"),
}
_TOP = f"(SELECT *, list_max(v) AS top FROM {T})"
ORACLE = {
    "mixed_trigger": f"""{_BASE}{_SHIFTS}, l AS (SELECT trace_id, channel FROM {T}),
 one AS (SELECT event_id, max(amp) AS x FROM (SELECT event_id, trace_id, round(arg_max(hit, hit * hit) / any_value(norm), 6) AS amp FROM a JOIN tried USING (shift) JOIN l USING (trace_id), z WHERE channel < 5 GROUP BY 1, 2) GROUP BY 1),
 j AS (SELECT event_id, shift, sum(hit) / any_value(norm) / count(*) AS amp FROM a JOIN tried USING (shift) JOIN l USING (trace_id), z WHERE channel >= 5 GROUP BY 1, 2), two AS (SELECT event_id, round(arg_max(amp, amp * amp), 6) AS y FROM j GROUP BY 1)
 SELECT event_id, round(greatest(x, y), 6) AS score FROM one FULL JOIN two USING (event_id)""",
    "trigger_acceptance": f"""{_BASE} SELECT list_max(v) > 0.3::FLOAT AS "first", round(amp, 6) > 0.2::DOUBLE AS "second", count(*) AS n FROM fit JOIN {T} t USING (trace_id) GROUP BY 1, 2""",
    "efficiency_difference": f"""SELECT round(avg(x - y), 6) AS mean, round(max(abs(x - y)), 6) AS largest FROM (SELECT energy, round(avg((top > 0.25)::INT), 6) AS x, round(avg((top > 0.3)::INT), 6) AS y FROM {_TOP} GROUP BY 1)""",
    "count_score": f"SELECT event_id, count(*) FILTER (top > 0.3) AS n_above FROM {_TOP} GROUP BY 1",
    "channel_statistics": f"SELECT channel, round(avg(x), 7) AS mean, round(stddev_pop(x), 7) AS std FROM {LONG} GROUP BY 1",
    "empty_rate": f"SELECT energy, count(*) AS n, round(avg((NOT top > 0.3)::INT), 6) AS rate FROM {_TOP} GROUP BY 1",
    "group_traces": f"""SELECT event_id, g AS "group", i, round(sum(x), 5) AS v FROM {LONG} JOIN (VALUES ('submerged', 0, 4), ('vacuum', 5, 8), ('all', 0, 8)) b(g, lo, hi) ON channel BETWEEN lo AND hi GROUP BY 1, 2, 3""",
    "baseline_removed": f"SELECT trace_id, round(list_max(v) - list_avg(v[1:16]), 6) AS top FROM {T}",
    "missing_channels": f"SELECT event_id, channel FROM {T} GROUP BY 1, 2 HAVING NOT max(list_max(v)) > 0.3",
}
