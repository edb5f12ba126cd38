"""Queries of cuts and calibration over the table of items, with their SQL."""

from pyspark.sql import functions as F

from ..operators import calibration, models, selection
from .tables import events, items, traces

_BANDS = {"low": (0.0, 20000.0), "line": (30000.0, 50000.0), "high": (60000.0, 80000.0)}
_CUTS = {"quantity": "l_quantity between 5 and 45", "discount": "l_discount <= 0.08", "tax": "l_tax > 0.01"}
_LINES = [(1.0, 20000.0, 3000.0), (0.5, 45000.0, 2000.0)]


def _classes(s, d):
    return items(s, d).groupBy(selection.classes("l_extendedprice", _BANDS).alias("class")).agg(F.count("*").alias("n"))


def _region(s, d):
    e = selection.by_region(F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), (10, 20), (30, 40))
    return items(s, d).groupBy("l_returnflag").agg(F.round(F.sum(e), 4).alias("total"))


def _days(s, d):
    return items(s, d).withColumn("day", F.datediff("l_shipdate", F.lit("1992-01-01")).cast("double"))


def _line(s, d):
    return models.drift_line(_days(s, d), "day", "l_extendedprice", 0, 2800, 28, 1000)


def _energy(s, d):
    e = models.quadratic(F.col("l_extendedprice"), 3.26315e-06, 0.532509)
    return items(s, d).groupBy("l_linestatus").agg(F.round(F.avg(e), 4).alias("quadratic"), F.round(F.avg((F.col("l_extendedprice") - 100) / 3), 4).alias("linear"))


def _spectrum(s, d):
    return calibration.histogram(items(s, d), "l_extendedprice", 0, 100000, 20).select((F.col("bin") * 5000 + 2500.0).alias("x"), F.col("n").cast("double").alias("n"))


def _model(s, d):
    return _spectrum(s, d).select("x", F.round(models.lorentz(F.col("x"), _LINES, 10.0, 0.5), 6).alias("model"))


def _scan(s, d):
    grid = s.range(0, 5).select((F.col("id") * 0.25 - 0.5).alias("slope")).join(s.range(0, 5).select((F.col("id") * 100.0 + 100).alias("level")))
    return models.chi2_scan(_spectrum(s, d), grid, F.col("level") * (1 + F.col("slope") * F.col("x") / 100000), 2)


QUERIES = {
    "amplitude_classes": _classes,
    "reject_reasons": lambda s, d: selection.reasons(items(s, d), _CUTS),
    "window_cut_share": lambda s, d: selection.cut_share(items(s, d), "l_quantity > 10 and l_quantity < 40", "l_returnflag"),
    "masked_mean": lambda s, d: selection.masked_mean(items(s, d), "l_quantity", 20, 40, "l_shipdate").select(F.datediff("l_shipdate", F.lit("1992-01-01")).alias("day"), "mean"),
    "region_choice": _region,
    "describe": lambda s, d: models.describe(items(s, d), "l_extendedprice", "l_returnflag", "l_linestatus"),
    "ranged_histogram": lambda s, d: models.ranged_histogram(items(s, d), "l_extendedprice", 25, "l_returnflag"),
    "edge_histogram": lambda s, d: models.edge_histogram(items(s, d), "l_extendedprice", [900, 1000, 2000, 5000, 10000, 30000, 90000]),
    "drift_line": lambda s, d: _line(s, d).select(F.round("slope", 6).alias("slope"), F.round("offset", 4).alias("offset"), F.round("level", 4).alias("level")),
    "drift_corrected": lambda s, d: models.drift_corrected(_days(s, d), _line(s, d), "day", "l_extendedprice").select("l_orderkey", "l_linenumber", F.round("corrected", 3).alias("corrected")),
    "energy_scale": _energy,
    "line_model": _model,
    "find_line": lambda s, d: models.find_line(items(s, d), "l_extendedprice", 10000, 60000, 25),
    "chi2_scan": _scan,
    "class_shares": lambda s, d: models.shares(items(s, d), "l_extendedprice", "l_returnflag", "l_linestatus"),
    "variation_envelope": lambda s, d: models.envelope(items(s, d).withColumn("root", F.sqrt("l_extendedprice")), "l_quantity", "l_returnflag", "root"),
    "finite_ranks": lambda s, d: traces(s, d).groupBy("energy").agg(F.round(F.max(selection.finite("trace_id")), 1).alias("top")),
    "daily_pivot": lambda s, d: events(s, d).groupBy(F.hour("ts").alias("hour")).pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.count("event_id")).na.fill(0),
}
_DAY = "(SELECT *, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS day FROM lineitem)"
_LINE = f"SELECT regr_slope(mu, t) AS slope, regr_intercept(mu, t) AS \"offset\", avg(mu) AS level FROM (SELECT (least(floor(day / 100), 27) + 0.5) * 100 AS t, avg(l_extendedprice) AS mu FROM {_DAY} WHERE day BETWEEN 0 AND 2800 GROUP BY 1 HAVING avg(l_extendedprice) > 1000)"
_HIST = "(SELECT least(floor(l_extendedprice / 5000), 19) * 5000 + 2500 AS x, CAST(count(*) AS DOUBLE) AS n FROM lineitem WHERE l_extendedprice BETWEEN 0 AND 100000 GROUP BY 1)"
ORACLE = {
    "amplitude_classes": """SELECT CASE WHEN l_extendedprice > 0 AND l_extendedprice < 20000 THEN 'low' WHEN l_extendedprice > 30000 AND l_extendedprice < 50000 THEN 'line' WHEN l_extendedprice > 60000 AND l_extendedprice < 80000 THEN 'high' ELSE 'bad' END AS "class", count(*) AS n FROM lineitem GROUP BY 1""",
    "reject_reasons": "SELECT CASE WHEN NOT l_quantity BETWEEN 5 AND 45 THEN 'quantity' WHEN NOT l_discount <= 0.08::DOUBLE THEN 'discount' WHEN NOT l_tax > 0.01::DOUBLE THEN 'tax' ELSE 'passed' END AS reason, count(*) AS n FROM lineitem GROUP BY 1",
    "window_cut_share": "SELECT l_returnflag, n, n_pass, round(n_pass / n, 6) AS share, round(100 * (1 - n_pass / n), 4) AS removed_percent FROM (SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_quantity > 10 AND l_quantity < 40) AS n_pass FROM lineitem GROUP BY 1)",
    "masked_mean": f"SELECT CAST(day AS INTEGER) AS day, round(avg(l_quantity) FILTER (l_quantity BETWEEN 20 AND 40), 6) AS mean FROM {_DAY} GROUP BY l_shipdate, day",
    "region_choice": "SELECT l_returnflag, round(sum(CASE WHEN l_quantity BETWEEN 10 AND 20 THEN l_discount WHEN l_quantity BETWEEN 30 AND 40 THEN l_tax ELSE 0 END), 4) AS total FROM lineitem GROUP BY 1",
    "describe": """SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, min(l_extendedprice) AS low, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1,
 round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3, max(l_extendedprice) AS high FROM lineitem GROUP BY 1, 2""",
    "ranged_histogram": """WITH e AS (SELECT min(l_extendedprice) AS low, (max(l_extendedprice) - min(l_extendedprice)) / 25 AS w FROM lineitem), c AS (SELECT l_returnflag, CAST(least(floor((l_extendedprice - low) / w), 24) AS BIGINT) AS bin, count(*) AS n, any_value(w) AS w FROM lineitem, e GROUP BY 1, 2)
 SELECT l_returnflag, bin, n, round(n / (sum(n) OVER (PARTITION BY l_returnflag) * w), 8) AS density FROM c""",
    "edge_histogram": """SELECT lo AS bin, count(*) AS n FROM lineitem JOIN (VALUES (0::BIGINT, 900, 1000), (1, 1000, 2000), (2, 2000, 5000), (3, 5000, 10000), (4, 10000, 30000), (5, 30000, 90000)) b(lo, a, z)
 ON l_extendedprice >= a AND (l_extendedprice < z OR (z = 90000 AND l_extendedprice = z)) GROUP BY 1""",
    "drift_line": f'SELECT round(slope, 6) AS slope, round("offset", 4) AS "offset", round(level, 4) AS level FROM ({_LINE})',
    "drift_corrected": f'SELECT l_orderkey, l_linenumber, round(l_extendedprice * level / (slope * day + "offset"), 3) AS corrected FROM {_DAY}, ({_LINE})',
    "energy_scale": "SELECT l_linestatus, round(avg(3.26315e-06::DOUBLE * l_extendedprice * l_extendedprice + 0.532509::DOUBLE * l_extendedprice), 4) AS quadratic, round(avg((l_extendedprice - 100) / 3), 4) AS linear FROM lineitem GROUP BY 1",
    "line_model": f"SELECT x, round(0.5 + 10 * (1 / (1 + ((x - 20000) / 3000) ** 2) + 0.5 / (1 + ((x - 45000) / 2000) ** 2)), 6) AS model FROM {_HIST}",
    "find_line": """SELECT round(c, 6) AS centre, round(c * 0.98, 6) AS lo, round(c * 1.02, 6) AS hi FROM (SELECT 10000 + (bin + 0.5) * 2000 AS c FROM (
 SELECT least(floor((l_extendedprice - 10000) / 2000), 24) AS bin, count(*) AS n FROM lineitem WHERE l_extendedprice BETWEEN 10000 AND 60000 GROUP BY 1 ORDER BY n DESC, bin LIMIT 1))""",
    "chi2_scan": f"""SELECT slope, level, round(c, 3) AS chi2, ndof, round(c / ndof, 4) AS reduced FROM (SELECT slope, level, sum((n - level * (1 + slope * x / 100000)) ** 2 / n) AS c, count(*) - 2 AS ndof
 FROM {_HIST}, (SELECT a * 0.25::DOUBLE - 0.5::DOUBLE AS slope, b * 100.0::DOUBLE + 100 AS level FROM range(0, 5) p(a), range(0, 5) q(b)) GROUP BY 1, 2)""",
    "class_shares": "SELECT l_returnflag, l_linestatus, round(t, 2) AS total, round(100 * t / sum(t) OVER (), 6) AS percent FROM (SELECT l_returnflag, l_linestatus, sum(l_extendedprice) AS t FROM lineitem GROUP BY 1, 2)",
    "variation_envelope": "SELECT l_quantity, round(min(m), 4) AS lower, round(max(m), 4) AS upper FROM (SELECT l_quantity, l_returnflag, avg(sqrt(l_extendedprice)) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1",
    "finite_ranks": "SELECT label AS energy, CAST(max(vec_id) AS DOUBLE) AS top FROM embeddings GROUP BY 1",
    "daily_pivot": "SELECT CAST(hour(ts) AS INTEGER) AS hour, " + ", ".join(f"count(*) FILTER (event_type = '{e}') AS {e}" for e in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1",
}
