"""Queries of optimum filters, templates and scores, with their SQL."""

import numpy as np
from pyspark.sql import functions as F

from ..operators import filters, scores, spectra, templates
from .tables import LONG, P, T, places, traces

SHORT = 16


def _filter(spark, d):
    """The template is the mean trace of label 1, the noise that of label 0."""
    t = traces(spark, d)
    shape = templates.peak_normalised(templates.mean_trace(t.where("energy = 1")))
    return filters.Filter(filters.array_of(shape, "i", "t"), filters.array_of(spectra.density(t.where("energy = 0")), "k", "psd"))


def _windows(spark, d):
    """Tumbling windows of a user's events as short traces; an incomplete last one is left out."""
    seg = F.floor(F.col("i") / SHORT).cast("long")
    w = places(spark, d).groupBy("channel", seg.alias("seg")).agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("s"))
    return w.where(F.size("s") == SHORT).select("channel", "seg", F.col("s.v").alias("samples"))


def _short(spark, d):
    """A straight fall from 1 in the noise of the windows."""
    return filters.Filter(np.arange(SHORT, 0, -1) / SHORT, filters.array_of(spectra.density(_windows(spark, d)), "k", "psd"))


def _fits(spark, d):
    return filters.fit_with_shift(traces(spark, d), _filter(spark, d), (-8, 8))


def _roc(spark, d):
    """Whether the amplitude of the best fit tells the labels from 5 up."""
    t = traces(spark, d).select("trace_id", (F.col("energy") >= 5).alias("positive"), (F.col("channel") >= 5).alias("vacuum"))
    return t.join(filters.amplitude(traces(spark, d), _filter(spark, d)), "trace_id").withColumnRenamed("amp", "score")


def _curve(spark, d):
    c = scores.curve(_roc(spark, d), "vacuum")
    return c.select("vacuum", "score", "tp", "fp", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


QUERIES = {
    "template_mean": lambda s, d: templates.mean_trace(traces(s, d), "energy").select("energy", "i", "n", F.round("t", 6).alias("t")),
    "template_peak_normalised": lambda s, d: templates.peak_normalised(templates.mean_trace(traces(s, d), "channel"), "channel").select("channel", "i", F.round("t", 5).alias("t")),
    "template_min_max": lambda s, d: templates.min_max(templates.mean_trace(traces(s, d), "energy"), "energy").select("energy", "i", F.round("t", 5).alias("t")),
    "template_self_cleaned": lambda s, d: templates.self_cleaned(traces(s, d), 50, 1.02).select("trace_id", "energy"),
    "of_amplitude": lambda s, d: filters.amplitude(traces(s, d), _filter(s, d)),
    "of_fit": lambda s, d: filters.fit(traces(s, d), _filter(s, d)),
    "of_fit_with_shift": _fits,
    "of_fit_any_shift": lambda s, d: filters.fit_with_shift(traces(s, d), _filter(s, d), wrap=False),
    "of_joint": lambda s, d: filters.joint(traces(s, d), _filter(s, d), (-8, 8)),
    "of_sum_channel": lambda s, d: filters.summed(traces(s, d), 9, _filter(s, d)),
    "of_residual": lambda s, d: filters.residual(traces(s, d), _fits(s, d), _filter(s, d).template),
    "of_sliding": lambda s, d: filters.sliding(places(s, d), _short(s, d), hop=1, chunk=32),
    "of_stepped": lambda s, d: filters.sliding(places(s, d), _short(s, d), hop=SHORT, chunk=4096),
    "template_line_fit": lambda s, d: filters.line_fit(traces(s, d), _filter(s, d).template),
    "roc_curve": _curve,
    "auc_by_group": lambda s, d: scores.auc(scores.curve(_roc(s, d), "vacuum"), "vacuum", at=0.2),
    "threshold_at_tpr": lambda s, d: scores.nearest(scores.curve(_roc(s, d), "vacuum"), 0.8, "vacuum"),
    "hit_confusion": lambda s, d: scores.hit_counts(places(s, d).groupBy("channel").agg(F.count_if(F.col("v") > 95).alias("hits"))),
}

_D = "d AS (SELECT CAST(k AS INTEGER) AS k, CAST(i AS INTEGER) AS i, cos(2 * pi() * k * i / {n}) AS c, sin(2 * pi() * k * i / {n}) AS s FROM range(0, {h} + 1) a(k), range(0, {n}) b(i))"
_BASE = f"""WITH s AS (SELECT * FROM {LONG}), t AS (SELECT i, x / max(x) OVER () AS x FROM (SELECT i, avg(x) AS x FROM s WHERE energy = 1 GROUP BY i)),
 {_D.format(n=64, h=32)},
 f AS (SELECT trace_id, event_id, energy, k, sum(x * c) AS re, -sum(x * s) AS im FROM s JOIN d USING (i) GROUP BY ALL),
 p AS (SELECT k, CASE k WHEN 0 THEN 0 WHEN 32 THEN 1 ELSE 4 END / (avg(re * re + im * im) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END / 64) / 64 AS w FROM f WHERE energy = 0 GROUP BY k),
 g AS (SELECT k, w, sum(x * c) AS re, -sum(x * s) AS im FROM t JOIN d USING (i) JOIN p USING (k) GROUP BY k, w),
 z AS (SELECT sum(w * (re * re + im * im)) AS norm FROM g),
 own AS (SELECT trace_id, event_id, sum(w * (f.re * f.re + f.im * f.im)) AS own, sum(w * (f.re * g.re + f.im * g.im)) AS hit FROM f JOIN g USING (k) GROUP BY 1, 2),
 fit AS (SELECT trace_id, hit / norm AS amp, (own - hit * hit / norm) / 62 AS chisq FROM own, z)"""
_SHIFTS = """, a AS (SELECT trace_id, event_id, i AS shift, sum(w * ((g.re * f.re + g.im * f.im) * c - (g.re * f.im - g.im * f.re) * s)) AS hit FROM f JOIN g USING (k) JOIN d USING (k) GROUP BY ALL),
 tried AS (SELECT i AS shift, CASE WHEN i >= 32 THEN i - 64 ELSE i END AS t0 FROM range(0, 64) r(i) WHERE i <= 8 OR i >= 56)"""
_BEST = """, best AS (SELECT trace_id, hit / norm AS amp, (own - hit * hit / norm) / 61 AS chisq, CAST(t0 AS INTEGER) AS t0 FROM (
 SELECT a.trace_id, a.hit, t0, own, row_number() OVER (PARTITION BY a.trace_id ORDER BY a.hit * a.hit DESC, t0) AS r FROM a JOIN tried USING (shift) JOIN own ON a.trace_id = own.trace_id), z WHERE r = 1)"""
_SLIDE = f"""WITH s AS (SELECT * FROM {P}), {_D.format(n=16, h=8)},
 full_ AS (SELECT channel, i // 16 AS seg FROM s GROUP BY 1, 2 HAVING count(*) = 16),
 wf AS (SELECT channel, seg, k, sum(v * c) AS re, -sum(v * d.s) AS im FROM (SELECT channel, i // 16 AS seg, i % 16 AS i, v FROM s) JOIN full_ USING (channel, seg) JOIN d USING (i) GROUP BY ALL),
 p AS (SELECT k, CASE k WHEN 0 THEN 0 WHEN 8 THEN 1 ELSE 4 END / (avg(re * re + im * im) * CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END / 16) / 16 AS w FROM wf GROUP BY k),
 g AS (SELECT k, w, sum((16 - i) / 16 * c) AS re, -sum((16 - i) / 16 * s) AS im FROM d JOIN p USING (k) GROUP BY k, w),
 z AS (SELECT sum(w * (re * re + im * im)) AS norm FROM g),
 f AS (SELECT a.channel, a.i AS start, k, sum(b.v * c) AS re, -sum(b.v * d.s) AS im FROM s a JOIN s b ON a.channel = b.channel AND b.i >= a.i AND b.i < a.i + 16 JOIN d ON d.i = b.i - a.i GROUP BY ALL HAVING count(*) = 16),
 own AS (SELECT channel, start, sum(w * (f.re * f.re + f.im * f.im)) AS own, sum(w * (f.re * g.re + f.im * g.im)) AS hit FROM f JOIN g USING (k) GROUP BY 1, 2)
 SELECT channel, start, round(hit / norm, 5) AS amp, round((own - hit * hit / norm) / 14, 5) AS chisq FROM own, z"""
_SIDES = f"{_BASE}, sc AS (SELECT o.trace_id, round(amp, 6) AS score, energy >= 5 AS positive, channel >= 5 AS vacuum FROM fit o JOIN {T} t ON o.trace_id = t.trace_id)"
_CURVE = f"""{_SIDES}, cv AS (SELECT vacuum, score, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp, sum(p) OVER w / sum(p) OVER (PARTITION BY vacuum) AS tpr, sum(n) OVER w / sum(n) OVER (PARTITION BY vacuum) AS fpr
 FROM (SELECT vacuum, score, sum(positive::INT) AS p, sum((NOT positive)::INT) AS n FROM sc GROUP BY 1, 2) WINDOW w AS (PARTITION BY vacuum ORDER BY score DESC))"""
_MEAN = f"(SELECT {{0}}, i, count(x) AS n, avg(x) AS t FROM {LONG} GROUP BY 1, 2)"
ORACLE = {
    "template_mean": f"SELECT energy, i, n, round(t, 6) AS t FROM {_MEAN.format('energy')}",
    "template_peak_normalised": f"SELECT channel, i, round(t / max(t) OVER (PARTITION BY channel), 5) AS t FROM {_MEAN.format('channel')}",
    "template_min_max": f"SELECT energy, i, round((t - min(t) OVER w) / (max(t) OVER w - min(t) OVER w), 5) AS t FROM {_MEAN.format('energy')} WINDOW w AS (PARTITION BY energy)",
    "template_self_cleaned": f"""WITH n AS (SELECT trace_id, energy, v, trace_id // 50 AS batch, coalesce(lead(v) OVER w, first_value(v) OVER w) AS u FROM {T} WINDOW w AS (PARTITION BY trace_id // 50 ORDER BY trace_id)),
 f AS (SELECT trace_id, energy, batch, list_sum(list_transform(range(1, len(v) + 1), lambda j: (v[j] - u[j]) ** 2)) AS far FROM n)
 SELECT trace_id, energy FROM (SELECT *, quantile_cont(far, 0.5) OVER (PARTITION BY batch) AS median FROM f) WHERE far < 1.02::DOUBLE * median""",
    "of_amplitude": f"{_BASE} SELECT trace_id, round(amp, 6) AS amp FROM fit",
    "of_fit": f"{_BASE} SELECT trace_id, round(amp, 6) AS amp, round(chisq, 6) AS chisq FROM fit",
    "of_fit_with_shift": f"{_BASE}{_SHIFTS}{_BEST} SELECT trace_id, round(amp, 6) AS amp, round(chisq, 6) AS chisq, t0 FROM best",
    "of_fit_any_shift": f"""{_BASE}{_SHIFTS} SELECT trace_id, round(hit / norm, 6) AS amp, round((own - hit * hit / norm) / 61, 6) AS chisq, CAST(shift AS INTEGER) AS t0 FROM (
 SELECT a.trace_id, a.hit, shift, own, row_number() OVER (PARTITION BY a.trace_id ORDER BY a.hit * a.hit DESC, shift) AS r FROM a JOIN own ON a.trace_id = own.trace_id), z WHERE r = 1""",
    "of_joint": f"""{_BASE}{_SHIFTS}, e AS (SELECT event_id, count(*) AS n_channels, sum(own) AS own FROM own GROUP BY 1), h AS (SELECT event_id, shift, sum(hit) AS hit FROM a GROUP BY 1, 2)
 SELECT event_id, n_channels, round(hit / n_channels / norm, 6) AS amp, round((own - hit * hit / n_channels / norm) / (n_channels * 64 - 3), 6) AS chisq, CAST(t0 AS INTEGER) AS t0
 FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY hit * hit DESC, t0) AS r FROM h JOIN tried USING (shift)) JOIN e USING (event_id), z WHERE r = 1""",
    "of_sum_channel": f"""{_BASE}, q AS (SELECT event_id, k, sum(re) AS re, sum(im) AS im FROM f GROUP BY 1, 2),
 o AS (SELECT event_id, sum(w / 9 * (q.re * q.re + q.im * q.im)) AS own, sum(w / 9 * (q.re * g.re + q.im * g.im)) AS hit FROM q JOIN g USING (k) GROUP BY 1)
 SELECT event_id, round(hit / (norm / 9), 6) AS amp, round((own - hit * hit / (norm / 9)) / 62, 6) AS chisq FROM o, z""",
    "of_residual": f"""{_BASE}{_SHIFTS}{_BEST} SELECT s.trace_id, round(sqrt(sum((s.x - round(amp, 6) * t.x) ** 2) / 64), 5) AS rms FROM s JOIN best USING (trace_id) JOIN t ON t.i = (s.i - t0 + 64) % 64 GROUP BY 1""",
    "of_sliding": _SLIDE,
    "of_stepped": f"{_SLIDE} WHERE start % 16 = 0",
    "template_line_fit": f"""WITH t AS (SELECT i, x / max(x) OVER () AS y FROM (SELECT i, avg(x) AS x FROM {LONG} WHERE energy = 1 GROUP BY i))
 SELECT trace_id, round(regr_slope(x, y), 6) AS amp, round(regr_intercept(x, y), 6) AS "offset", round((regr_syy(x, y) - regr_sxy(x, y) ** 2 / regr_sxx(x, y)) / (var_pop(x) FILTER (i < 16)) / 62, 5) AS chisq FROM {LONG} JOIN t USING (i) GROUP BY 1""",
    "roc_curve": f"{_CURVE} SELECT vacuum, score, tp, fp, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM cv",
    "auc_by_group": f"""{_CURVE} SELECT vacuum, round(sum((fpr - x) * (tpr + y) / 2), 6) AS auc, round(coalesce(max(tpr) FILTER (fpr <= 0.2), 0), 6) AS tpr_at
 FROM (SELECT *, lag(fpr, 1, 0) OVER w AS x, lag(tpr, 1, 0) OVER w AS y FROM cv WINDOW w AS (PARTITION BY vacuum ORDER BY score DESC)) GROUP BY 1""",
    "threshold_at_tpr": f"{_CURVE} SELECT vacuum, score, round(tpr, 6) AS tpr FROM (SELECT *, row_number() OVER (PARTITION BY vacuum ORDER BY abs(tpr - 0.8), score DESC) AS r FROM cv) WHERE r = 1",
    "hit_confusion": """SELECT *, round((tp + tn) / (tp + tn + fp), 6) AS accuracy, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0 END AS "precision" FROM (
 SELECT count(*) FILTER (h >= 1) AS tp, count(*) FILTER (h = 0) AS tn, CAST(sum(greatest(h - 1, 0)) AS BIGINT) AS fp FROM (SELECT user_id, count(*) FILTER (value > 95) AS h FROM events GROUP BY 1))""",
}
