"""Queries of streams and files, with their SQL."""

from pyspark.sql import functions as F

from ..operators import joins
from ..sources import traces as files
from ..streaming import buckets, ordered, periods, run, sliding, trigger
from .matched import _SLIDE, _short
from .tables import P, events, places


def _stream(s, d):
    e = run.source(s, f"{d}/events.parquet")
    return e.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("channel"), F.col("value").alias("v"))


def _placed(s, d):
    """A stream of (channel, i, v) in three chunks: the event's time is its place."""
    e = events(s, d).select(F.col("user_id").alias("channel"), F.unix_micros(F.col("ts").cast("timestamp")).alias("i"), F.col("value").alias("v"))
    return run.chunked(e, "i", "channel")


def _filtered(s, d):
    return run.drained(sliding.sliding(run.chunked(places(s, d).select("channel", "i", "v"), "i", "channel"), _short(s, d)))


def _merged(s, d):
    """Late triggers only end what is open; the last event stays open until the stream goes on."""
    stream = run.chunked(events(s, d).where("value > 80").select(F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("user_id").alias("channel")), "t", "channel")
    return run.drained(periods.merged(stream, "15 minutes", "1 hour"))


def _spectra(s, d):
    """Windows of 16 values of a user as traces, by the day of their first value."""
    w = places(s, d).groupBy("channel", F.floor(F.col("i") / 16).alias("seg")).agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("s"), F.min(F.col("ts").cast("timestamp")).alias("ts"))
    rows = w.select("channel", "ts", F.unix_micros("ts").alias("t"), F.col("s.v").alias("samples"))
    return run.drained(periods.noise_spectra(run.chunked(rows, "t", "channel"), "1 day", "1 hour", 16), "update", ("start", "k"))


def _noise_windows(s, d):
    """Two windows of 4 samples of each record of 16, without a value above 95 from one sample before to one after them, in an order that a seed decides."""
    p = places(s, d)
    windows = p.where("i % 4 = 0").select("channel", F.floor(F.col("i") / 16).cast("long").alias("block"), F.col("i").alias("t"))
    quiet = joins.quiet(windows, p.where("v > 95").select("channel", F.col("i").alias("t")), 1, 4)
    turn = F.md5(F.concat_ws("-", F.lit(7), "channel", "block", "t"))
    return quiet.groupBy("channel", "block").agg(F.slice(F.sort_array(F.collect_list(F.struct(turn.alias("h"), "t"))), 1, 2).alias("w")).select("channel", "block", F.explode("w.t").alias("start"))


def _vectors(s, d):
    v = files.packed_vectors(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), "text")
    return v.select("doc_id", F.size("vector").alias("n"), F.md5("last").alias("last"))


def _unordered(s, d):
    """The trigger over samples that come up to 50 minutes out of order, behind a watermark of an hour; the samples of the last hour are still waited for."""
    session = s.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ordered.PROVIDER)
    e = events(session, d).select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("channel"), F.unix_micros(F.col("ts").cast("timestamp")).alias("i"), F.col("value").alias("v"))
    mixed = e.withColumn("turn", F.col("i") + F.pmod(F.xxhash64("i", "channel"), F.lit(3_000_000_000)))
    stream = run.chunked(mixed, "turn")
    return run.drained(ordered.hits(stream, 80.0, 0.5, late="1 hour")).where("not late").select("channel", "i")


def _bucketed(s, d):
    """Events in buckets of two hours; of the last ones, those whose buckets the watermark hasn't passed are still open."""
    session = s.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ordered.PROVIDER)
    e = events(session, d).where("value > 80").select(F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("user_id").alias("channel"))
    return buckets.joined(run.drained(buckets.pieces(run.chunked(e, "t"), 900_000_000, 7_200_000_000, "1 hour")))


QUERIES = {
    "stream_rates": lambda s, d: run.drained(periods.rates(_stream(s, d), "30 minutes", "1 hour", 80.0), "update", ("start", "channel")),
    "stream_sliding_tops": lambda s, d: run.drained(periods.sliding_tops(_stream(s, d), "2 hours", "1 hour", "1 hour"), "update", ("start",)),
    "stream_trigger": lambda s, d: run.drained(trigger.hits(_placed(s, d), 80.0, 0.5)),
    "stream_unordered_trigger": _unordered,
    "stream_bucketed_events": _bucketed,
    "stream_filter": _filtered,
    "stream_spectra": _spectra,
    "stream_events": _merged,
    "noise_windows": _noise_windows,
    "packed_vectors": _vectors,
}
ORACLE = {
    "stream_filter": _SLIDE,
    "stream_spectra": f"""WITH w AS (SELECT channel, i // 16 AS seg, min(epoch_us(ts)) // 86400000000 * 86400000000 AS start FROM {P} GROUP BY 1, 2 HAVING count(*) = 16),
 f AS (SELECT w.channel, seg, start, k, sum(v * cos(2 * pi() * k * (i % 16) / 16)) AS re, sum(v * sin(2 * pi() * k * (i % 16) / 16)) AS im FROM {P} p JOIN w ON w.channel = p.channel AND w.seg = p.i // 16, range(0, 9) r(k) GROUP BY w.channel, seg, start, k)
 SELECT CAST(start AS BIGINT) AS start, CAST(k AS INTEGER) AS k, count(*) AS n, round(avg(re * re + im * im) * CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END / 16, 4) AS psd FROM f GROUP BY start, k""",
    "stream_events": """WITH t AS (SELECT user_id AS channel, epoch_us(ts) AS t FROM events WHERE value > 80), n AS (SELECT *, CASE WHEN t - lag(t) OVER (ORDER BY t, channel) < 900000000 THEN 0 ELSE 1 END AS f FROM t)
 SELECT min(t) AS start, max(t) AS stop, count(*) AS n, CAST(count(DISTINCT channel) AS INTEGER) AS n_channels FROM (SELECT *, sum(f) OVER (ORDER BY t, channel) AS e FROM n) GROUP BY e HAVING max(t) + 900000000 <= (SELECT max(t) FROM t) - 3600000000""",
    "stream_bucketed_events": """WITH t AS (SELECT user_id AS channel, epoch_us(ts) AS t FROM events WHERE value > 80), n AS (SELECT *, CASE WHEN t - lag(t) OVER (ORDER BY t, channel) < 900000000 THEN 0 ELSE 1 END AS f FROM t)
 SELECT min(t) AS start, max(t) AS stop, count(*) AS n, CAST(count(DISTINCT channel) AS INTEGER) AS n_channels FROM (SELECT *, sum(f) OVER (ORDER BY t, channel) AS e FROM n) GROUP BY e HAVING (max(t) // 7200000000 + 1) * 7200000000 + 900000000 <= (SELECT max(t) // 1000 * 1000 FROM t) - 3600000000""",
    "noise_windows": f"""WITH w AS (SELECT channel, i // 16 AS block, i AS start, md5('7-' || channel || '-' || (i // 16) || '-' || i) AS h FROM {P} a WHERE i % 4 = 0 AND NOT EXISTS (SELECT 1 FROM {P} b WHERE b.channel = a.channel AND b.v > 95 AND b.i BETWEEN a.i - 1 AND a.i + 4))
 SELECT channel, block, start FROM w QUALIFY row_number() OVER (PARTITION BY channel, block ORDER BY h) <= 2""",
    "stream_rates": """SELECT CAST(epoch_us(ts) // 1800000000 * 1800000000 AS BIGINT) AS start, event_type AS channel, count(value) AS n, count(*) FILTER (value > 80) AS n_pass, round(avg(value), 5) AS mean FROM events GROUP BY 1, 2""",
    "stream_sliding_tops": "SELECT CAST((epoch_us(ts) // 3600000000 - k) * 3600000000 AS BIGINT) AS start, count(value) AS n, max(value) AS top FROM events, (VALUES (0), (1)) h(k) GROUP BY 1",
    "stream_trigger": """SELECT user_id AS channel, epoch_us(ts) AS i FROM (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM (
 SELECT *, CASE WHEN value > 80 THEN 1 WHEN value < 40 THEN 0 END AS mark FROM events)) WHERE mark = 1 AND coalesce(was, 0) = 0""",
    "stream_unordered_trigger": """SELECT user_id AS channel, epoch_us(ts) AS i FROM (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM (
 SELECT *, CASE WHEN value > 80 THEN 1 WHEN value < 40 THEN 0 END AS mark FROM events)) WHERE mark = 1 AND coalesce(was, 0) = 0 AND epoch_us(ts) <= (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events WHERE value > 80 OR value < 40) - 3600000000""",
    "packed_vectors": "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n, md5(string_split(text, chr(10))[-1]) AS last FROM documents",
}
