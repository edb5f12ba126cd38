"""Queries of banks of filters, long-trace filters and triggers that compare filters, with their SQL."""

import numpy as np
from pyspark.sql import functions as F

from ..operators import combined, filters, reduced, scores, sequence, spectra, templates
from .matched import _BASE, _BEST, _D, _SHIFTS, _SLIDE, SHORT, _filter, _fits, _short
from .tables import LONG, P, T, places, traces


def _mean_shape(spark, d, energy):
    return filters.array_of(templates.peak_normalised(templates.mean_trace(traces(spark, d).where(F.col("energy") == energy))), "i", "t")


def _noise(spark, d, condition="true"):
    return filters.array_of(spectra.density(traces(spark, d).where("energy = 0").where(condition)), "k", "psd")


def _by_part(spark, d):
    """Channels below 5 and the others, each with a template and a noise density of its own."""
    t = traces(spark, d).withColumn("part", (F.col("channel") >= 5).cast("int"))
    return t, {p: filters.Filter(_mean_shape(spark, d, p + 1), _noise(spark, d, f"int(channel >= 5) = {p}")) for p in (0, 1)}


def _channel_bank(spark, d):
    t, bank = _by_part(spark, d)
    return filters.bank(t, bank, "part", (-8, 8)).select("trace_id", "part", "amp", "chisq", "t0")


def _noise_bank(spark, d):
    """Even and odd channels as two kinds of noise."""
    t = traces(spark, d).withColumn("noise", F.col("channel") % 2)
    shape = _mean_shape(spark, d, 1)
    return filters.bank(t, {p: filters.Filter(shape, _noise(spark, d, f"channel % 2 = {p}")) for p in (0, 1)}, "noise")


def _best_by_noise(spark, d):
    """Where the largest amplitude of each kind of noise stands."""
    best = _noise_bank(spark, d).groupBy("noise").agg(F.max_by(F.struct("event_id", "channel", "amp", "chisq"), F.struct("amp", -F.col("trace_id"))).alias("b"))
    return best.select("noise", "b.event_id", "b.channel", "b.amp", "b.chisq")


def _conservative(spark, d):
    """Any channel above one threshold, the larger of the parts' own multiples of sigma."""
    t, bank = _by_part(spark, d)
    amps = filters.bank(t, bank, "part").select("event_id", "part", "trace_id", "amp").join(t.select("trace_id", "energy"), "trace_id")
    return combined.conservative(amps, amps.where("energy = 0"), "part", [1.0, 2.0, 3.0])


def _individual_or_joint(spark, d):
    t = traces(spark, d).where("channel >= 5")
    one = filters.amplitude(t, _filter(spark, d)).join(t.select("trace_id", "event_id"), "trace_id")
    return combined.union_of_curves(one, filters.joint(t, _filter(spark, d), (0, 0)), 0.05, 0.03, [1.0, 2.0, 3.0, 4.0])


def _long(spark, d):
    """A filter of 16 samples, made of windows of the noise, put to whole traces."""
    windows = sequence.hop_windows(traces(spark, d).where("energy = 0"), SHORT, SHORT)
    f = filters.Filter(np.arange(SHORT, 0, -1) / SHORT, filters.array_of(spectra.density(windows), "k", "psd"))
    return filters.fit_with_shift(traces(spark, d), f.padded(64), wrap=False)


def _two(spark, d):
    f = _filter(spark, d)
    return filters.two_templates(traces(spark, d), f, np.roll(f.template, 1)[::-1].copy(), (-4, 4), (3, 6))


def _series(make):
    return lambda s, d: make(s, d).select("trace_id", F.posexplode("samples").alias("i", "v")).select("trace_id", "i", F.round("v", 5).alias("v"))


def _edge_cube(spark, d):
    return combined.edge_cube(traces(spark, d), [1, 2, 3], [2.0, 3.0, 4.0], 16)


def _auc_by_fold(spark, d):
    """Sets of one event and energy; noise sets count for every energy. By energy, part of the detector and fold."""
    t = traces(spark, d).withColumn("vacuum", F.col("channel") >= 5).groupBy("event_id", "energy", "vacuum").agg(F.sort_array(F.collect_list(F.array_max("samples").cast("double")), asc=False).alias("t"))
    folds = t.select("energy", "vacuum", F.posexplode(F.array(F.get("t", F.lit(0)), F.coalesce(F.get("t", F.lit(1)), F.get("t", F.lit(0))))).alias("fold", "score"))
    folds = folds.withColumns({"fold": F.col("fold") + 1, "score": F.round("score", 5)})
    energies = F.explode(F.sequence(F.lit(1), F.lit(9)).cast("array<int>"))
    noise = folds.where("energy = 0").withColumn("energy", energies)
    both = combined.labelled(noise, folds.where("energy > 0"))
    return scores.auc(scores.curve(both, "energy", "vacuum", "fold"), "energy", "vacuum", "fold", at=0.2)


QUERIES = {
    "of_channel_bank": _channel_bank,
    "of_noise_bank": lambda s, d: _noise_bank(s, d).select("trace_id", "noise", "amp", "chisq"),
    "best_by_noise": _best_by_noise,
    "conservative_trigger": _conservative,
    "individual_or_joint": _individual_or_joint,
    "of_one_sided": lambda s, d: filters.fit(traces(s, d), filters.Filter(_filter(s, d).template, _filter(s, d).psd, one_sided=True)),
    "of_padded": _long,
    "of_convolved": lambda s, d: filters.convolved(places(s, d), _short(s, d), chunk=64),
    "of_stepped_shift": lambda s, d: filters.stepped(places(s, d), _short(s, d), SHORT, (-2, 2)),
    "of_two_templates": _two,
    "matched_series": _series(lambda s, d: filters.matched(traces(s, d), _filter(s, d))),
    "matched_floor": _series(lambda s, d: filters.matched(traces(s, d), _filter(s, d), 0.001)),
    "low_passed": _series(lambda s, d: filters.low_pass(traces(s, d), _filter(s, d).psd, 0.125, 0.25)),
    "of_residual_cut": lambda s, d: filters.residual(traces(s, d), _fits(s, d), _filter(s, d).template, wrap=False),
    "template_line_sigma": lambda s, d: filters.line_fit(traces(s, d), _filter(s, d).template, sigma_power=1).select("trace_id", "chisq"),
    "weighted_amplitude": lambda s, d: filters.weighted_amplitude(traces(s, d), _filter(s, d).template),
    "edge_cube": _edge_cube,
    "nearest_threshold": lambda s, d: scores.nearest_threshold(scores.curve(traces(s, d).select((F.col("energy") >= 5).alias("positive"), F.round(F.array_max("samples").cast("double"), 5).alias("score"))), 0.3),
    "auc_by_fold": _auc_by_fold,
    "best_accuracy": lambda s, d: scores.best_accuracy(combined.configurations(places(s, d), [80.0, 90.0, 95.0], "channel"), "threshold"),
}


def _bank(part, energies, ddof=61):
    """f, g, z and own with a template (of an energy) and a noise density for each value of the expression ``part``."""
    named = ", ".join(f"({p}, {e})" for p, e in enumerate(energies))
    return f"""WITH s AS (SELECT *, {part} AS part FROM {LONG}), {_D.format(n=64, h=32)},
 t AS (SELECT part, i, x / max(x) OVER (PARTITION BY part) AS x FROM (SELECT e.part, i, avg(x) AS x FROM (SELECT energy, i, x FROM s) q JOIN (VALUES {named}) e(part, energy) USING (energy) GROUP BY 1, 2)),
 f AS (SELECT trace_id, event_id, channel, energy, part, k, sum(x * c) AS re, -sum(x * s) AS im FROM s JOIN d USING (i) GROUP BY ALL),
 p AS (SELECT part, k, CASE k WHEN 0 THEN 0 WHEN 32 THEN 1 ELSE 4 END / (avg(re * re + im * im) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END / 64) / 64 AS w FROM f WHERE energy = 0 GROUP BY 1, 2),
 g AS (SELECT part, k, w, sum(x * c) AS re, -sum(x * s) AS im FROM t JOIN d USING (i) JOIN p USING (part, k) GROUP BY 1, 2, 3),
 z AS (SELECT part, sum(w * (re * re + im * im)) AS norm FROM g GROUP BY 1),
 own AS (SELECT trace_id, event_id, channel, energy, part, sum(w * (f.re * f.re + f.im * f.im)) AS own, sum(w * (f.re * g.re + f.im * g.im)) AS hit FROM f JOIN g USING (part, k) GROUP BY ALL),
 fit AS (SELECT trace_id, event_id, channel, energy, part, round(hit / norm, 6) AS amp, round((own - hit * hit / norm) / {ddof}, 6) AS chisq FROM own JOIN z USING (part))"""


_PART, _ODD = _bank("CAST(channel >= 5 AS INTEGER)", (1, 2)), _bank("channel % 2", (1, 1))
_GRID = "(VALUES (1.0::DOUBLE), (2.0::DOUBLE), (3.0::DOUBLE){}) n(n_sigma)"
_EVENTS = f"""{_BASE}, l AS (SELECT trace_id, channel FROM {T}), one AS (SELECT event_id, max(round(hit / norm, 6)) AS a FROM own JOIN l USING (trace_id), z WHERE channel >= 5 GROUP BY 1),
 two AS (SELECT event_id, round(sum(hit) / count(*) / any_value(norm), 6) AS b FROM own JOIN l USING (trace_id), z WHERE channel >= 5 GROUP BY 1)"""
_KERNEL = "(SELECT s, j, (exp(-0.5 * (((j + 1) - 3 * s) / s) ** 2) - exp(-0.5 * ((j - 3 * s) / s) ** 2)) AS k FROM range(1, 4) a(s), range(0, 18) b(j) WHERE j < 6 * s)"
ORACLE = {
    "of_channel_bank": f"""{_PART}, a AS (SELECT trace_id, part, i AS shift, sum(w * ((g.re * f.re + g.im * f.im) * c - (g.re * f.im - g.im * f.re) * s)) AS hit FROM f JOIN g USING (part, k) JOIN d USING (k) GROUP BY ALL),
 tried AS (SELECT i AS shift, CASE WHEN i >= 32 THEN i - 64 ELSE i END AS t0 FROM range(0, 64) r(i) WHERE i <= 8 OR i >= 56)
 SELECT trace_id, part, round(hit / norm, 6) AS amp, round((own - hit * hit / norm) / 61, 6) AS chisq, CAST(t0 AS INTEGER) AS t0 FROM (
 SELECT a.trace_id, a.part, a.hit, t0, own, norm, row_number() OVER (PARTITION BY a.trace_id ORDER BY a.hit * a.hit DESC, t0) AS r FROM a JOIN tried USING (shift) JOIN own USING (trace_id) JOIN z ON z.part = a.part) WHERE r = 1""",
    "of_noise_bank": f"{_ODD} SELECT trace_id, part AS noise, amp, chisq FROM fit",
    "best_by_noise": f"{_ODD} SELECT part AS noise, event_id, channel, amp, chisq FROM fit QUALIFY row_number() OVER (PARTITION BY part ORDER BY amp DESC, trace_id) = 1",
    "conservative_trigger": f"""{_PART}, h AS (SELECT n_sigma, max(n_sigma * s) AS threshold FROM (SELECT part, stddev_samp(amp) AS s FROM fit WHERE energy = 0 GROUP BY 1), {_GRID.format('')} GROUP BY 1)
 SELECT n_sigma, round(threshold, 6) AS threshold, count(*) AS n, count(*) FILTER (top > threshold) AS n_fired, round(avg((top > threshold)::INT), 6) AS eff FROM (SELECT event_id, max(amp) AS top FROM fit GROUP BY 1), h GROUP BY 1, 2""",
    "individual_or_joint": f"""{_EVENTS} SELECT n_sigma, count(*) AS n, round(avg((a > n_sigma * 0.05::DOUBLE)::INT), 6) AS individual, round(avg((b > n_sigma * 0.03::DOUBLE)::INT), 6) AS joint, round(avg((a > n_sigma * 0.05::DOUBLE OR b > n_sigma * 0.03::DOUBLE)::INT), 6) AS either
 FROM one JOIN two USING (event_id), {_GRID.format(', (4.0::DOUBLE)')} GROUP BY 1""",
    "of_one_sided": f"{_BASE.replace('WHEN 32 THEN 1 ELSE 4 END / (avg', 'ELSE 1 END / (avg')} SELECT trace_id, round(amp, 6) AS amp, round(chisq, 6) AS chisq FROM fit",
    "of_padded": f"""WITH s AS (SELECT * FROM {LONG}), w16 AS (SELECT trace_id, i // 16 AS seg, k, sum(x * cos(2 * pi() * k * (i % 16) / 16)) AS re, sum(x * sin(2 * pi() * k * (i % 16) / 16)) AS im FROM s, range(0, 9) r(k) WHERE energy = 0 GROUP BY ALL),
 q AS (SELECT k, avg(re * re + im * im) * CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END / 16 AS p FROM w16 GROUP BY 1), {_D.format(n=64, h=32)},
 p AS (SELECT r.k, CASE r.k WHEN 0 THEN 0 WHEN 32 THEN 1 ELSE 4 END / (a.p + coalesce((b.p - a.p) * (r.k / 4 - r.k // 4), 0)) / 64 AS w FROM range(0, 33) r(k) JOIN q a ON a.k = r.k // 4 LEFT JOIN q b ON b.k = r.k // 4 + 1),
 f AS (SELECT trace_id, k, sum(x * c) AS re, -sum(x * d.s) AS im FROM s JOIN d USING (i) GROUP BY ALL),
 g AS (SELECT k, w, sum((16 - i) / 16 * c) AS re, -sum((16 - i) / 16 * s) AS im FROM d JOIN p USING (k) WHERE i < 16 GROUP BY 1, 2), z AS (SELECT sum(w * (re * re + im * im)) AS norm FROM g),
 own AS (SELECT trace_id, sum(w * (f.re * f.re + f.im * f.im)) AS own FROM f JOIN g USING (k) GROUP BY 1),
 a AS (SELECT trace_id, i AS shift, sum(w * ((g.re * f.re + g.im * f.im) * c - (g.re * f.im - g.im * f.re) * s)) AS hit FROM f JOIN g USING (k) JOIN d USING (k) GROUP BY ALL)
 SELECT trace_id, round(hit / norm, 6) AS amp, round((own - hit * hit / norm) / 61, 6) AS chisq, CAST(shift AS INTEGER) AS t0 FROM a JOIN own USING (trace_id), z QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY hit * hit DESC, shift) = 1""",
    "of_convolved": f"""WITH o AS ({_SLIDE.replace('SELECT channel, start, round(hit / norm, 5) AS amp, round((own - hit * hit / norm) / 14, 5) AS chisq FROM own, z', 'SELECT channel, start, hit / norm AS amp FROM own, z')}),
 q AS (SELECT a.channel, a.i AS start, sum(b.v * b.v) AS power FROM {P} a JOIN {P} b ON a.channel = b.channel AND b.i >= a.i AND b.i < a.i + 16 GROUP BY 1, 2)
 SELECT channel, start, round(amp, 5) AS amp, round(power - amp * amp * (SELECT sum(((16 - i) / 16) ** 2) FROM range(0, 16) r(i)), 3) AS rest FROM o JOIN q USING (channel, start)""",
    "of_stepped_shift": f"""{_SLIDE[: _SLIDE.index(' own AS (')]} own AS (SELECT channel, start, sum(w * (f.re * f.re + f.im * f.im)) AS own FROM f JOIN g USING (k) WHERE start % 16 = 0 GROUP BY 1, 2),
 a AS (SELECT channel, start, i AS shift, sum(w * ((g.re * f.re + g.im * f.im) * c - (g.re * f.im - g.im * f.re) * s)) AS hit FROM f JOIN g USING (k) JOIN d USING (k) WHERE start % 16 = 0 AND (i <= 2 OR i >= 14) GROUP BY ALL),
 b AS (SELECT *, CASE WHEN shift >= 8 THEN shift - 16 ELSE shift END AS t0 FROM a)
 SELECT channel, start, round(hit / norm, 5) AS amp, round((own - hit * hit / norm) / 13, 5) AS chisq, CAST(t0 AS BIGINT) AS t0, start + t0 AS "position" FROM b JOIN own USING (channel, start), z
 QUALIFY row_number() OVER (PARTITION BY channel, start ORDER BY own - hit * hit / norm, t0) = 1""",
    "of_two_templates": f"""{_BASE}, u AS (SELECT i, (SELECT x FROM t q WHERE q.i = (62 - r.i + 64) % 64) AS x FROM range(0, 64) r(i)),
 h AS (SELECT k, w, sum(u.x * c) AS re, -sum(u.x * s) AS im FROM u JOIN d USING (i) JOIN p USING (k) GROUP BY 1, 2), y AS (SELECT sum(w * (re * re + im * im)) AS n2 FROM h),
 one AS (SELECT trace_id, i AS shift, sum(w * ((g.re * f.re + g.im * f.im) * c - (g.re * f.im - g.im * f.re) * s)) AS p FROM f JOIN g USING (k) JOIN d USING (k) GROUP BY ALL),
 two AS (SELECT trace_id, i AS shift, sum(w * ((h.re * f.re + h.im * f.im) * c - (h.re * f.im - h.im * f.re) * s)) AS q FROM f JOIN h USING (k) JOIN d USING (k) GROUP BY ALL),
 mixed AS (SELECT i AS delta, sum(g.w * ((h.re * g.re + h.im * g.im) * c - (h.re * g.im - h.im * g.re) * s)) AS m FROM g JOIN h USING (k) JOIN d USING (k) GROUP BY 1),
 both_ AS (SELECT one.trace_id, CASE WHEN one.shift >= 32 THEN one.shift - 64 ELSE one.shift END AS t0, delta, own, (n2 * p - m * q) / (norm * n2 - m * m) AS a, (norm * q - m * p) / (norm * n2 - m * m) AS b, p, q
  FROM one JOIN mixed ON delta BETWEEN 3 AND 6 JOIN two ON two.trace_id = one.trace_id AND two.shift = (one.shift + delta + 64) % 64 JOIN own ON own.trace_id = one.trace_id, z, y WHERE one.shift <= 4 OR one.shift >= 60)
 SELECT trace_id, round(a, 6) AS amp, round(b, 6) AS amp2, round((own - a * p - b * q) / 59, 6) AS chisq, CAST(t0 AS INTEGER) AS t0, CAST(delta AS INTEGER) AS delta FROM both_ QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY own - a * p - b * q, delta, t0) = 1""",
    "matched_series": f"{_BASE}{_SHIFTS} SELECT trace_id, CAST(shift AS INTEGER) AS i, round(hit / norm, 5) AS v FROM a, z",
    "matched_floor": f"{_BASE.replace('THEN 1 ELSE 2 END / 64) / 64', 'THEN 1 ELSE 2 END / 64 + 0.001::DOUBLE) / 64')}{_SHIFTS} SELECT trace_id, CAST(shift AS INTEGER) AS i, round(hit / norm, 5) AS v FROM a, z",
    "low_passed": f"""{_BASE}, e AS (SELECT k, greatest(least((0.25::DOUBLE - k / 64) / 0.125::DOUBLE, 1), 0) / (avg(re * re + im * im) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END / 64) AS e FROM f WHERE energy = 0 GROUP BY k),
 n AS (SELECT k, e / (SELECT e FROM e WHERE k = 0) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END / 64 AS e FROM e)
 SELECT trace_id, i, round(sum(n.e * (re * c - im * s)), 5) AS v FROM f JOIN n USING (k) JOIN d USING (k) GROUP BY 1, 2""",
    "of_residual_cut": f"""{_BASE}{_SHIFTS}{_BEST} SELECT s.trace_id, round(sqrt(sum((s.x - round(amp, 6) * coalesce(t.x, 0)) ** 2) / 64), 5) AS rms FROM s JOIN best USING (trace_id) LEFT JOIN t ON t.i = s.i - t0 GROUP BY 1""",
    "template_line_sigma": f"""WITH t AS (SELECT i, x / max(x) OVER () AS y FROM (SELECT i, avg(x) AS x FROM {LONG} WHERE energy = 1 GROUP BY i))
 SELECT trace_id, round((regr_syy(x, y) - regr_sxy(x, y) ** 2 / regr_sxx(x, y)) / (stddev_pop(x) FILTER (i < 16)) / 62, 5) AS chisq FROM {LONG} JOIN t USING (i) GROUP BY 1""",
    "weighted_amplitude": f"""WITH t AS (SELECT i, x / max(x) OVER () AS y FROM (SELECT i, avg(x) AS x FROM {LONG} WHERE energy = 1 GROUP BY i))
 SELECT trace_id, round(sum(x * y / (0.001::DOUBLE + abs(x))) / sum(y * y / (0.001::DOUBLE + abs(x))), 6) AS amp FROM {LONG} JOIN t USING (i) GROUP BY 1""",
    "edge_cube": f"""WITH k AS {_KERNEL}, n AS (SELECT s, j, k / -sum(CASE WHEN j >= 3 * s THEN k END) OVER (PARTITION BY s) AS k FROM k), x AS (SELECT * FROM {LONG}),
 r AS (SELECT s AS width, trace_id, channel, energy, x.i + n.j - 6 * s + 1 AS i, sum(x * k) AS v FROM x, n GROUP BY ALL HAVING count(*) = 6 * s),
 e AS (SELECT width, stddev_pop(v) AS sigma FROM r WHERE channel = 0 AND i < 16 GROUP BY 1), m AS (SELECT width, trace_id, energy, max(v) AS top FROM r GROUP BY ALL)
 SELECT width, n_sigma, energy, count(*) AS n, count(*) FILTER (top > n_sigma * sigma) AS n_fired, round(avg((top > n_sigma * sigma)::INT), 6) AS eff FROM m JOIN e USING (width), (VALUES (2.0::DOUBLE), (3.0::DOUBLE), (4.0::DOUBLE)) g(n_sigma) GROUP BY 1, 2, 3""",
    "nearest_threshold": f"""WITH c AS (SELECT score, sum(sum(p)) OVER w / sum(sum(p)) OVER () AS tpr, sum(sum(n)) OVER w / sum(sum(n)) OVER () AS fpr FROM (SELECT round(list_max(v), 5) AS score, (energy >= 5)::INT AS p, (energy < 5)::INT AS n FROM {T}) GROUP BY score WINDOW w AS (ORDER BY score DESC))
 SELECT round(score, 6) AS score, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM c ORDER BY abs(score - 0.3::DOUBLE), score DESC LIMIT 1""",
    "auc_by_fold": f"""WITH t AS (SELECT event_id, energy, channel >= 5 AS vacuum, list_reverse_sort(list(list_max(v))) AS t FROM {T} GROUP BY 1, 2, 3),
 f AS (SELECT energy, vacuum, 1 AS fold, round(t[1], 5) AS score FROM t UNION ALL SELECT energy, vacuum, 2, round(coalesce(t[2], t[1]), 5) FROM t),
 b AS (SELECT energy, vacuum, fold, score, 1 AS p FROM f WHERE energy > 0 UNION ALL SELECT e.energy, vacuum, fold, score, 0 FROM f, range(1, 10) e(energy) WHERE f.energy = 0),
 c AS (SELECT energy, vacuum, fold, score, sum(sum(p)) OVER w / nullif(sum(sum(p)) OVER a, 0) AS tpr, sum(sum(1 - p)) OVER w / nullif(sum(sum(1 - p)) OVER a, 0) AS fpr FROM b GROUP BY 1, 2, 3, 4 WINDOW w AS (PARTITION BY energy, vacuum, fold ORDER BY score DESC), a AS (PARTITION BY energy, vacuum, fold))
 SELECT energy, vacuum, CAST(fold AS INTEGER) AS fold, round(sum((fpr - x) * (tpr + y) / 2), 6) AS auc, round(coalesce(max(tpr) FILTER (fpr <= 0.2), 0), 6) AS tpr_at FROM (SELECT *, lag(fpr, 1, 0) OVER w AS x, lag(tpr, 1, 0) OVER w AS y FROM c WINDOW w AS (PARTITION BY energy, vacuum, fold ORDER BY score DESC)) GROUP BY 1, 2, 3""",
    "best_accuracy": f"""WITH h AS (SELECT threshold, channel, count(*) FILTER (v > threshold) AS h FROM {P}, (VALUES (80.0::DOUBLE), (90.0::DOUBLE), (95.0::DOUBLE)) g(threshold) GROUP BY 1, 2),
 c AS (SELECT threshold, (count(*) FILTER (h >= 1) + count(*) FILTER (h = 0)) / (count(*) + sum(greatest(h - 1, 0))) AS accuracy FROM h GROUP BY 1) SELECT threshold, round(accuracy, 6) AS accuracy FROM c ORDER BY accuracy DESC, threshold LIMIT 1""",
}
