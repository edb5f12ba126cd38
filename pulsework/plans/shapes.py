"""Queries of spectra and templates, with their SQL."""

import numpy as np
from pyspark.sql import functions as F

from ..operators import filters, joins, kernels, models, reduced, selection, sequence, spectra, templates
from .banks import _mean_shape, _noise
from .tables import LONG, T, traces


def _density(s, d):
    return spectra.density(traces(s, d).where("energy = 0"))


def _spectrum(s, d):
    """The transform of the template of energy 1."""
    one = templates.peak_normalised(templates.mean_trace(traces(s, d).where("energy = 1")))
    row = one.agg(F.sort_array(F.collect_list(F.struct("i", "t"))).alias("s")).select(F.lit(0).cast("long").alias("trace_id"), F.col("s.t").alias("samples"))
    return spectra.transforms(row)


def _hann(s, d):
    return spectra.signal_to_noise(spectra.transforms(traces(s, d).where("energy = 1"), window="hann"), _density(s, d)).select("trace_id", "k", F.round("snr", 4).alias("snr"))


def _regridded(s, d):
    """The power of the samples from 60 to 85 %, on a grid twice as fine."""
    part = traces(s, d).where("energy = 0").withColumn("samples", F.slice("samples", 39, 16))
    known = spectra.density(part).select(F.lit(0).alias("g"), F.col("k").cast("double").alias("x"), F.col("psd").alias("y"))
    wanted = s.range(17).select(F.lit(0).alias("g"), (F.col("id") / 2).alias("x"))
    return joins.resampled(known, wanted, "g").select("x", F.round("y", 8).alias("psd"))


def _kernel_phase(s, d):
    f = filters.Filter(_mean_shape(s, d, 1), _noise(s, d))
    z = np.fft.rfft(f.kernel)
    rows = s.createDataFrame([(k, float(x.real), float(x.imag)) for k, x in enumerate(z)], "k int, re double, im double").where("k between 1 and 31")
    return rows.select("k", F.round(F.atan2("im", "re"), 5).alias("phase"))


def _coloured(s, d):
    """Each colour with the total power of the noise."""
    f = _density(s, d).select("k", "frequency")
    total = _density(s, d).where("k > 0").agg(F.sum("psd").alias("p")).first().p
    out = None
    for colour in spectra.COLOURS:
        one = spectra.coloured(f, colour, total).select(F.lit(colour).alias("colour"), "k", F.round("psd", 7).alias("psd"))
        out = one if out is None else out.unionByName(one)
    return out


def _means(s, d, *keys):
    return templates.mean_trace(traces(s, d), *keys)


def _smooth_template(s, d):
    """Less the baseline, smoothed, averaged, and filtered by medians."""
    v = kernels.polynomial_smoothed(F.transform("samples", lambda x: x - F.col("b")), 5, 2)
    rows = traces(s, d).where("energy = 1").withColumn("b", reduced.mean(F.slice(reduced.doubles(), 1, 16))).withColumn("samples", reduced.doubles()).withColumn("samples", v)
    mean = templates.mean_trace(rows).agg(F.sort_array(F.collect_list(F.struct("i", "t"))).alias("s")).select(F.lit(0).alias("trace_id"), F.col("s.t").alias("v"))
    return sequence.exploded(mean, kernels.median_filter(F.col("v"), 3), "t").select("i", F.round("t", 6).alias("t"))


def _line_template(s, d):
    """Traces whose maximum is within 5 % of the fullest bin, cleaned of those unlike their neighbours, averaged."""
    tops = traces(s, d).withColumn("top", F.round(F.array_max("samples").cast("double"), 6))
    line = models.find_line(tops, "top", 0.2, 0.4, 10, 0.05)
    some = tops.join(F.broadcast(line)).where("top between lo and hi").drop("top", "centre", "lo", "hi")
    return templates.mean_trace(templates.self_cleaned(some, 50, 1.1)).select("i", "n", F.round("t", 6).alias("t"))


QUERIES = {
    "regridded_psd": _regridded,
    "relative_psd": lambda s, d: spectra.relative(spectra.density(traces(s, d), keys=("channel",)), "channel").select("channel", "k", F.round("psd", 6).alias("psd")),
    "uncorrelated_psd": lambda s, d: spectra.density(traces(s, d)).select("k", F.round(F.col("psd") * 9, 8).alias("psd")),
    "sum_density": lambda s, d: spectra.of_sum(spectra.cross(traces(s, d))).select("k", F.round("psd", 7).alias("psd")),
    "amplitude_density": lambda s, d: spectra.transforms(traces(s, d).where("energy = 0")).select("trace_id", "k", F.round(F.sqrt((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / 64), 6).alias("asd")),
    "whitened_template": lambda s, d: spectra.whitened(_spectrum(s, d), _density(s, d)).select("k", (F.round("re", 5) + 0.0).alias("re"), (F.round("im", 5) + 0.0).alias("im")),
    "snr_spectrum": _hann,
    "density_units": lambda s, d: _density(s, d).select("k", F.round(F.pow(F.sqrt("psd") * 2e-6, 2) * 1e12, 8).alias("psd")),
    "coloured_noise": _coloured,
    "kernel_phase": _kernel_phase,
    "periodogram": lambda s, d: spectra.density(spectra.detrended(traces(s, d).where("energy = 0"))).where("k > 0").select("k", F.round("psd", 8).alias("psd")),
    "pooled_template": lambda s, d: templates.pooled(_means(s, d, "channel").where("channel >= 5"), "channel").select("i", F.round("t", 5).alias("t")),
    "absolute_template": lambda s, d: templates.absolute_normalised(_means(s, d, "channel"), "channel").select("channel", "i", F.round("t", 5).alias("t")),
    "smooth_template": _smooth_template,
    "line_template": _line_template,
    "position_templates": lambda s, d: templates.mean_trace(traces(s, d).withColumns({"x": F.col("event_id") % 3, "y": F.col("event_id") % 2}), "x", "y", "channel").select("x", "y", "channel", "i", "n", F.round("t", 6).alias("t")),
    "template_residuals": lambda s, d: templates.residuals(traces(s, d), _means(s, d, "channel"), "channel").select("trace_id", "i", F.round("r", 6).alias("r")),
    "template_stack": lambda s, d: templates.stacked(raw=_means(s, d), peak=templates.peak_normalised(_means(s, d))).select("template_id", "i", F.round("t", 5).alias("t")),
    "stretched_template": lambda s, d: templates.stretched(_means(s, d), 64, 96).select("i", F.round("t", 6).alias("t")),
    "cubic_template": lambda s, d: templates.resampled(_means(s, d, "energy"), 96, "energy").select("energy", "i", F.round("t", 6).alias("t")),
    "offset_template": lambda s, d: templates.offset_removed(_means(s, d, "energy"), 16, "energy").select("energy", "i", F.round("t", 4).alias("t")),
    "sum_template": lambda s, d: templates.peak_normalised(templates.mean_trace(reduced.summed(traces(s, d), "event_id"))).select("i", F.round("t", 4).alias("t")),
}
_DFT = f"(SELECT trace_id, event_id, channel, energy, k, sum(x * cos(2 * pi() * k * i / 64)) AS re, -sum(x * sin(2 * pi() * k * i / 64)) AS im FROM {LONG}, range(0, 33) t(k) GROUP BY ALL)"
_PSD = f"(SELECT CAST(k AS INTEGER) AS k, avg(re * re + im * im) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END / 64 AS psd FROM {_DFT} WHERE energy = 0 GROUP BY k)"
_MEAN = f"(SELECT {{0}}, i, count(x) AS n, avg(x) AS t FROM {LONG} GROUP BY ALL)"
_ONE = f"(SELECT i, x / max(x) OVER () AS x FROM (SELECT i, avg(x) AS x FROM {LONG} WHERE energy = 1 GROUP BY i))"
_KEPT = "[[31, 9, -3, -5, 3], [9, 13, 12, 6, -5], [-3, 12, 17, 12, -3], [-5, 6, 12, 13, 9], [3, -5, -3, 9, 31]]"
ORACLE = {
    "regridded_psd": f"""WITH f AS (SELECT trace_id, k, sum(x * cos(2 * pi() * k * (i - 38) / 16)) AS re, sum(x * sin(2 * pi() * k * (i - 38) / 16)) AS im FROM {LONG}, range(0, 9) r(k) WHERE energy = 0 AND i BETWEEN 38 AND 53 GROUP BY ALL),
 p AS (SELECT k, avg(re * re + im * im) * CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END / 16 AS p FROM f GROUP BY k)
 SELECT j / 2 AS x, round(a.p + coalesce((b.p - a.p) * (j % 2) / 2, 0), 8) AS psd FROM range(0, 17) r(j) JOIN p a ON a.k = j // 2 LEFT JOIN p b ON b.k = j // 2 + 1""",
    "relative_psd": f"SELECT channel, CAST(k AS INTEGER) AS k, round(p / max(p) OVER (PARTITION BY channel), 6) AS psd FROM (SELECT channel, k, avg(re * re + im * im) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS p FROM {_DFT} GROUP BY channel, k)",
    "uncorrelated_psd": f"SELECT CAST(k AS INTEGER) AS k, round(9 * (avg(re * re + im * im) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END / 64), 8) AS psd FROM {_DFT} GROUP BY k",
    "sum_density": f"""WITH f AS (SELECT * FROM {_DFT}), c AS (SELECT x.channel AS a, y.channel AS b, x.k, avg(x.re * y.re + x.im * y.im) * CASE WHEN x.k IN (0, 32) THEN 1 ELSE 2 END / 64 AS re FROM f x JOIN f y ON x.event_id = y.event_id AND x.k = y.k AND x.channel <= y.channel GROUP BY 1, 2, 3)
 SELECT CAST(k AS INTEGER) AS k, round(sum(CASE WHEN a = b THEN re ELSE 2 * re END), 7) AS psd FROM c GROUP BY k""",
    "amplitude_density": f"SELECT trace_id, CAST(k AS INTEGER) AS k, round(sqrt((re * re + im * im) / 64), 6) AS asd FROM {_DFT} WHERE energy = 0",
    "whitened_template": f"WITH g AS (SELECT CAST(k AS INTEGER) AS k, sum(x * cos(2 * pi() * k * i / 64)) AS re, -sum(x * sin(2 * pi() * k * i / 64)) AS im FROM {_ONE}, range(0, 33) r(k) GROUP BY k) SELECT k, round(re / sqrt(psd), 5) + 0.0 AS re, round(im / sqrt(psd), 5) + 0.0 AS im FROM g JOIN {_PSD} USING (k)",
    "snr_spectrum": f"""WITH f AS (SELECT trace_id, CAST(k AS INTEGER) AS k, sum(h * x * cos(2 * pi() * k * i / 64)) AS re, sum(h * x * sin(2 * pi() * k * i / 64)) AS im FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * i / 64) AS h FROM {LONG} WHERE energy = 1), range(0, 33) r(k) GROUP BY 1, 2)
 SELECT trace_id, k, round((re * re + im * im) / psd, 4) AS snr FROM f JOIN {_PSD} USING (k)""",
    "density_units": f"SELECT k, round((sqrt(psd) * 2e-6) ** 2 * 1e12, 8) AS psd FROM {_PSD}",
    "coloured_noise": f"""WITH p AS (SELECT * FROM {_PSD}), c AS (SELECT colour, k, CASE WHEN k > 0 THEN (k / 64) ** e ELSE 0 END AS r FROM p, (VALUES ('white', 0), ('pink', -1), ('brown', -2), ('blue', 1), ('violet', 2)) c(colour, e))
 SELECT colour, k, round(r * (SELECT sum(psd) FROM p WHERE k > 0) / sum(r) OVER (PARTITION BY colour), 7) AS psd FROM c""",
    "kernel_phase": f"WITH g AS (SELECT CAST(k AS INTEGER) AS k, sum(x * cos(2 * pi() * k * i / 64)) AS re, -sum(x * sin(2 * pi() * k * i / 64)) AS im FROM {_ONE}, range(0, 33) r(k) GROUP BY k) SELECT k, round(atan2(im, re), 5) AS phase FROM g WHERE k BETWEEN 1 AND 31",
    "periodogram": f"SELECT k, round(psd, 8) AS psd FROM {_PSD} WHERE k > 0",
    "pooled_template": f"SELECT i, round(t / max(abs(t)) OVER (), 5) AS t FROM (SELECT i, avg(t) AS t FROM (SELECT channel, i, t / max(abs(t)) OVER (PARTITION BY channel) AS t FROM {_MEAN.format('channel')} WHERE channel >= 5) GROUP BY i)",
    "absolute_template": f"SELECT channel, i, round(t / max(abs(t)) OVER (PARTITION BY channel), 5) AS t FROM {_MEAN.format('channel')}",
    "smooth_template": f"""WITH b AS (SELECT trace_id, list_transform(v, lambda x: x - list_avg(v[1:16])) AS v FROM {T} WHERE energy = 1),
 m AS (SELECT i, avg(list_sum(list_transform(range(1, 6), lambda j: v[s + j] * k[j])) / 35) AS t FROM (SELECT v, i, s, ({_KEPT})[i - s + 1] AS k FROM b, (SELECT i, greatest(0, least(i - 2, 59)) AS s FROM range(0, 64) r(i))) GROUP BY i)
 SELECT CAST(i AS INTEGER) AS i, round(quantile_cont(t, 0.5) OVER (ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS t FROM (SELECT i, t FROM m UNION ALL SELECT -1, 0 UNION ALL SELECT 64, 0) QUALIFY i BETWEEN 0 AND 63""",
    "line_template": f"""WITH q AS (SELECT *, round(list_max(v), 6) AS top FROM {T}), h AS (SELECT least(floor((top - 0.2::DOUBLE) / (0.2::DOUBLE / 10)), 9) AS bin, count(*) AS n FROM q WHERE top BETWEEN 0.2::DOUBLE AND 0.4::DOUBLE GROUP BY 1),
 l AS (SELECT 0.2::DOUBLE + (bin + 0.5) * 0.2::DOUBLE / 10 AS c FROM h ORDER BY n DESC, bin LIMIT 1), s AS (SELECT q.* FROM q, l WHERE top BETWEEN round(c * (1 - 0.05::DOUBLE), 6) AND round(c * (1 + 0.05::DOUBLE), 6)),
 n AS (SELECT *, trace_id // 50 AS batch, coalesce(lead(v) OVER w, first_value(v) OVER w) AS u FROM s WINDOW w AS (PARTITION BY trace_id // 50 ORDER BY trace_id)),
 f AS (SELECT v, batch, list_sum(list_transform(range(1, len(v) + 1), lambda j: (v[j] - u[j]) ** 2)) AS far FROM n), k AS (SELECT v FROM (SELECT *, quantile_cont(far, 0.5) OVER (PARTITION BY batch) AS median FROM f) WHERE far < 1.1::DOUBLE * median)
 SELECT CAST(i AS INTEGER) AS i, count(*) AS n, round(avg(v[i + 1]), 6) AS t FROM k, range(0, 64) r(i) GROUP BY i""",
    "position_templates": f"SELECT event_id % 3 AS x, event_id % 2 AS y, channel, i, count(x) AS n, round(avg(x), 6) AS t FROM {LONG} l GROUP BY event_id % 3, event_id % 2, channel, i",
    "template_residuals": f"SELECT trace_id, i, round(x - avg(x) OVER (PARTITION BY channel, i), 6) AS r FROM {LONG}",
    "template_stack": f"WITH m AS (SELECT i, avg(x) AS t FROM {LONG} GROUP BY i) SELECT 'raw' AS template_id, i, round(t, 5) AS t FROM m UNION ALL SELECT 'peak', i, round(t / max(t) OVER (), 5) FROM m",
    "stretched_template": f"WITH m AS (SELECT i, avg(x) AS t FROM {LONG} GROUP BY i) SELECT CAST(j AS INTEGER) AS i, round(a.t + coalesce((b.t - a.t) * (j * 2 / 3 - a.i), 0), 6) AS t FROM range(0, 96) r(j) JOIN m a ON a.i = j * 2 // 3 LEFT JOIN m b ON b.i = a.i + 1",
    "cubic_template": f"""WITH RECURSIVE m AS MATERIALIZED (SELECT energy, i, avg(x) AS t FROM {LONG} GROUP BY ALL),
 d AS MATERIALIZED (SELECT energy, i, lag(t) OVER w - 2 * t + lead(t) OVER w AS d FROM m WINDOW w AS (PARTITION BY energy ORDER BY i)),
 fwd AS (SELECT energy, i, 0::DOUBLE AS c, d AS g FROM d WHERE i = 1 UNION ALL SELECT f.energy, d.i, 1 / (4 - f.c), (6 * d.d - f.g) / (4 - f.c) FROM fwd f JOIN d ON d.energy = f.energy AND d.i = f.i + 1 WHERE d.i <= 61),
 bwd AS (SELECT energy, i, d AS b FROM d WHERE i = 62 UNION ALL SELECT f.energy, f.i, CASE WHEN f.i = 1 THEN f.g ELSE f.g - f.c * b.b END FROM bwd b JOIN fwd f ON f.energy = b.energy AND f.i = b.i - 1),
 b AS (SELECT energy, i, b FROM bwd UNION ALL SELECT energy, 0, 2 * max(b) FILTER (i = 1) - max(b) FILTER (i = 2) FROM bwd GROUP BY energy UNION ALL SELECT energy, 63, 2 * max(b) FILTER (i = 62) - max(b) FILTER (i = 61) FROM bwd GROUP BY energy),
 p AS (SELECT CAST(j AS INTEGER) AS j, least(j * 63 // 95, 62) AS k, j * 63 / 95 - least(j * 63 // 95, 62) AS u FROM range(0, 96) r(j))
 SELECT x.energy, j AS i, round(bx.b / 6 * (1 - u) ** 3 + b_y.b / 6 * u ** 3 + (x.t - bx.b / 6) * (1 - u) + (y.t - b_y.b / 6) * u, 6) AS t
 FROM p JOIN m x ON x.i = k JOIN m y ON y.i = k + 1 AND y.energy = x.energy JOIN b bx ON bx.i = k AND bx.energy = x.energy JOIN b b_y ON b_y.i = k + 1 AND b_y.energy = x.energy""",
    "offset_template": f"SELECT energy, i, round(t / max(t) OVER (PARTITION BY energy), 4) AS t FROM (SELECT energy, i, t - avg(t) FILTER (i < 16) OVER (PARTITION BY energy) AS t FROM {_MEAN.format('energy')})",
    "sum_template": f"SELECT i, round(t / max(t) OVER (), 4) AS t FROM (SELECT i, avg(x) AS t FROM (SELECT event_id, i, sum(x) AS x FROM {LONG} GROUP BY 1, 2) GROUP BY i)",
}
