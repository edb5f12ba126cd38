"""Joins by ranges, written as joins by equal keys."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import slice_of


def by_channel_range(traces: DataFrame, bank: DataFrame) -> DataFrame:
    """Rows with the columns of the range (lo, hi, both included) that holds their channel; rows outside all ranges are left out."""
    keyed = bank.select(F.explode(F.sequence("lo", "hi")).alias("channel"), *(c for c in bank.columns if c not in ("lo", "hi")))
    return traces.join(keyed, "channel")


def quiet(windows: DataFrame, triggers: DataFrame, before: int, after: int, key: str = "channel") -> DataFrame:
    """Windows (key, t) without a trigger (key, t) of the same key from t - ``before`` to t + ``after``, ends included.

    Time falls into buckets as long as the interval, so a window meets the triggers of two buckets at most and the
    anti join is one by equal keys. Windows with a null key or time stay, as no trigger is near them.
    """
    width = before + after + 1
    bucket = lambda t: F.floor(t / width).cast("long")
    near = triggers.select(F.col(key).alias("k"), F.col("t").alias("u"), F.explode(F.array_distinct(F.array(bucket(F.col("t") - after), bucket(F.col("t") + before)))).alias("b"))
    hit = (F.col(key) == F.col("k")) & (bucket(F.col("t")) == F.col("b")) & F.col("u").between(F.col("t") - before, F.col("t") + after)
    return windows.join(near, hit, "left_anti")


def cut_out(records: DataFrame, windows: DataFrame, key: str = "channel", width: int = 4096) -> DataFrame:
    """window, key, i, v: the samples of records (key, i, v) inside each window (key, window, start, length), across record borders.

    Places fall into buckets of ``width``, and a window is named in each bucket that it touches, so the join is one by equal
    keys. Windows without samples give no row.
    """
    bucket = lambda i: F.floor(i / width).cast("long")
    touched = F.sequence(bucket(F.col("start")), bucket(F.col("start") + F.col("length") - 1))
    spread = windows.where("length > 0").select(F.col(key).alias("k"), "window", "start", "length", F.explode(touched).alias("b"))
    inside = (F.col(key) == F.col("k")) & (bucket(F.col("i")) == F.col("b")) & (F.col("i") >= F.col("start")) & (F.col("i") < F.col("start") + F.col("length"))
    return records.join(spread, inside).select("window", key, "i", "v")


def resampled(known: DataFrame, wanted: DataFrame, key: str, mode: str = "clamp", slices: int | None = None) -> DataFrame:
    """key, x, y: ``known`` (key, x, y) interpolated linearly at the places of ``wanted`` (key, x).

    Places are cut into slices by x, which are sorted by themselves; the nearest known places before and after a slice are carried
    to it from the others, so a key may be in many tasks. Outside the known range: ``clamp`` has the nearest known value, ``zero`` has 0,
    ``extrapolate`` the line through the two nearest known ones (with one, its value). A key without known places gives null (0 with
    ``zero``); a place that is known twice has one of its values. Null places are left out.
    """
    if mode not in ("clamp", "zero", "extrapolate"):
        raise ValueError(mode)
    a = known.where("x is not null").select(F.col(key).alias("k"), F.col("x").cast("double").alias("at"), "x", "y", F.lit(0).alias("side"))
    b = wanted.where("x is not null").select(F.col(key).alias("k"), F.col("x").cast("double").alias("at"), "x", F.lit(None).cast("double").alias("y"), F.lit(1).alias("side"))
    rows = a.unionByName(b)
    rows = rows.withColumn("slice", slice_of(rows, "at", slices))
    value = F.struct("x", "y")
    if mode == "extrapolate":
        # known places bring the known ones next to them, for the line through both
        steps = _beside(rows, F.when(F.col("side") == 0, value), strict=True)
        rows = steps.select("k", "at", "x", "y", "side", "slice", F.col("p.x").alias("bx"), F.col("p.y").alias("by"), F.col("n.x").alias("ax"), F.col("n.y").alias("ay"))
        value = F.struct("x", "y", "bx", "by", "ax", "ay")
    rows = _beside(rows, F.when(F.col("side") == 0, value)).where("side = 1")
    between = F.col("p.y") + (F.col("n.y") - F.col("p.y")) * F.coalesce(F.try_divide(F.col("x") - F.col("p.x"), F.col("n.x") - F.col("p.x")), F.lit(0.0))
    on_known = F.when(F.col("p.x") == F.col("x"), F.col("p.y"))
    if mode == "extrapolate":
        above = F.col("p.y") + F.coalesce(F.try_divide(F.col("p.y") - F.col("p.by"), F.col("p.x") - F.col("p.bx")), F.lit(0.0)) * (F.col("x") - F.col("p.x"))
        below = F.col("n.y") + F.coalesce(F.try_divide(F.col("n.ay") - F.col("n.y"), F.col("n.ax") - F.col("n.x")), F.lit(0.0)) * (F.col("x") - F.col("n.x"))
        return rows.select(F.col("k").alias(key), "x", F.coalesce(on_known, between, above, below).alias("y"))
    out = F.coalesce(on_known, between, F.lit(0.0)) if mode == "zero" else F.coalesce(on_known, between, F.col("p.y"), F.col("n.y"))
    return rows.select(F.col("k").alias(key), "x", out.alias("y"))


def _beside(rows: DataFrame, value, strict: bool = False) -> DataFrame:
    """``rows`` (k, slice, x, side) with p and n, the last ``value`` that isn't null up to each row and the first one from it on, in the order of (x, side); with ``strict``, before and after it."""
    rows = rows.withColumn("value", value)
    order = F.struct("x", "side")
    per = rows.groupBy("k", "slice").agg(F.max_by("value", F.when(F.col("value").isNotNull(), order)).alias("last"), F.min_by("value", F.when(F.col("value").isNotNull(), order)).alias("first"))
    above, below = (Window.partitionBy("k").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("slice"), F.desc("slice")))
    per = per.select(F.col("k").alias("sk"), F.col("slice").alias("ss"), F.last("last", ignorenulls=True).over(above).alias("before"), F.last("first", ignorenulls=True).over(below).alias("after"))
    end = -1 if strict else 0
    on, back = (Window.partitionBy("k", "slice").orderBy(*o).rowsBetween(Window.unboundedPreceding, end) for o in (("x", "side"), (F.desc("x"), F.desc("side"))))
    rows = rows.withColumns({"p": F.last("value", ignorenulls=True).over(on), "n": F.last("value", ignorenulls=True).over(back)})
    rows = rows.join(per, F.col("k").eqNullSafe(F.col("sk")) & (F.col("slice") == F.col("ss")))
    return rows.withColumns({"p": F.coalesce("p", "before"), "n": F.coalesce("n", "after")}).drop("sk", "ss", "before", "after", "value")


def with_truth(fits: DataFrame, truth: DataFrame, key: str, limit: int) -> DataFrame:
    """The fits (key, position) with truth (key, inject): delta, distance, and whether the distance is above ``limit``; fits without truth are left out."""
    delta = F.col("position") - F.col("inject")
    return fits.join(truth.select(key, "inject"), key).select(*fits.columns, delta.alias("delta"), F.abs(delta).alias("distance"), (F.abs(delta) > limit).alias("implausible"))


def side_by_side(first: DataFrame, second: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, first, second: two methods' values at the same keys; null where one has none."""
    return first.select(*keys, F.col(value).alias("first")).join(second.select(*keys, F.col(value).alias("second")), keys, "full")


def agreement(both: DataFrame, rtol: float = 1e-8, atol: float = 1e-12) -> DataFrame:
    """One row on columns first, second: n (both present), n_missing, max_abs, rms, relative (norm of the difference by that of second), corr, close."""
    d, y = F.col("first") - F.col("second"), F.col("second")
    full = d.isNotNull()
    return both.agg(
        F.count_if(full).alias("n"), F.count_if(~full).alias("n_missing"), F.round(F.max(F.abs(d)), 6).alias("max_abs"), F.round(F.sqrt(F.avg(d * d)), 6).alias("rms"),
        F.round(F.sqrt(F.try_divide(F.sum(d * d), F.sum(F.when(full, y * y)))), 6).alias("relative"), F.round(F.corr("first", "second"), 6).alias("corr"),
        F.bool_and(F.abs(d) <= atol + rtol * F.abs(y)).alias("close"),
    )


def also_significant(fits: DataFrame, key: str, value: str, threshold: float) -> DataFrame:
    """The significant fits (above the threshold) whose key has another one: counts by key meet the rows again, so a hot key is no window of its own."""
    some = fits.where(F.col(value) > threshold)
    many = some.groupBy(key).agg(F.count("*").alias("n_significant")).where("n_significant > 1")
    return some.join(many, key)


def with_traces(quantities: DataFrame, traces: DataFrame, keys: list[str]) -> DataFrame:
    """The selected quantities with their traces, by equal keys; rows without a trace are left out. Other columns of the traces that the quantities have too are left out."""
    return quantities.join(traces.select(*keys, *(c for c in traces.columns if c not in quantities.columns)), keys)


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of the table's row of the same keys (null if there is none); raises where the table has more than one."""
    rest = [c for c in table.columns if c not in keys]
    one = table.groupBy(*keys).agg(F.count("*").alias("_n"), F.any_value(F.struct(*rest)).alias("_r"))
    checked = one.select(*keys, F.when(F.col("_n") == 1, F.col("_r")).otherwise(F.raise_error(F.lit("a key of the table isn't unique"))).alias("_r"))
    return rows.join(checked, keys, "left").select(*rows.columns, *(F.col(f"_r.{c}").alias(c) for c in rest))


def triggers_with_records(triggers: DataFrame, records: DataFrame) -> DataFrame:
    """channel, block, event_id, sample: the triggers (channel, block, event_id, offset) with the sample of their record (channel, block, samples) at the offset; null outside it."""
    both = triggers.join(records.select("channel", "block", "samples"), ["channel", "block"])
    return both.select("channel", "block", "event_id", F.get("samples", F.col("offset").cast("int")).alias("sample"))


def grid(spark, **axes: list[float]) -> DataFrame:
    """A row for every combination of the values of the axes: as many as the caller names."""
    out = spark.range(1).select()
    for name, values in axes.items():
        out = out.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    return out
