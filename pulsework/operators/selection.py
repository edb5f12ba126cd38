"""Cuts and classes of rows: predicates that reach the scan, or counts in one pass."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import numbered


def classes(column: str, bands: dict[str, tuple[float, float]], rest: str = "bad") -> Column:
    """The name of the first band (low < value < high) that holds the value; ``rest`` for others and nulls."""
    out = F
    for name, (low, high) in bands.items():
        out = out.when((F.col(column) > low) & (F.col(column) < high), name)
    return out.otherwise(rest)


def reasons(rows: DataFrame, cuts: dict[str, str]) -> DataFrame:
    """reason, n: rows by the first cut that they fail (a null condition fails), ``passed`` for the others."""
    out = F
    for name, condition in cuts.items():
        out = out.when(~F.coalesce(F.expr(condition), F.lit(False)), name)
    return rows.groupBy(out.otherwise("passed").alias("reason")).agg(F.count("*").alias("n"))


def cut_share(rows: DataFrame, condition: str, *keys: str) -> DataFrame:
    """keys, n, n_pass, share, removed_percent; a null condition doesn't pass."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.expr(condition)).alias("n_pass"))
    share = F.try_divide("n_pass", "n")
    return out.withColumn("share", F.round(share, 6)).withColumn("removed_percent", F.round(100 * (1 - share), 4))


def masked_mean(rows: DataFrame, column: str, low: float, high: float, *keys: str) -> DataFrame:
    """keys, mean of the values inside [low, high]; null without any."""
    return rows.groupBy(*keys).agg(F.round(F.avg(F.when(F.col(column).between(low, high), F.col(column))), 6).alias("mean"))


def by_region(region: Column, first: Column, second: Column, near: tuple[float, float], far: tuple[float, float]) -> Column:
    """``first`` where the region value is inside ``near``, ``second`` inside ``far``, 0 elsewhere."""
    return F.when(region.between(*near), first).when(region.between(*far), second).otherwise(F.lit(0.0))


def halves(rows: DataFrame, group: str, order: str) -> DataFrame:
    """The rows with ``half`` (0 or 1): the first floor(n / 2) rows of each group by ``order`` are half 0."""
    return numbered(rows, [group], [order], "_at").withColumn("half", (F.col("_at") >= F.floor(F.col("_at_all") / 2)).cast("int")).drop("_at", "_at_all")


def first(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each group by ``order``."""
    return numbered(rows, [group], [order], "_at").where(F.col("_at") < n).drop("_at", "_at_all")


def finite(column: str) -> Column:
    """The value, minus infinity where it is null or not finite, for rankings."""
    c = F.col(column).cast("double")
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(float("-inf"))).otherwise(c)


def not_unique(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys that occur more than once, with their number; empty for a table whose key is unique."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def masked(rows: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """The rows with ``mask``: every named column is inside its range, ends included; a null is outside. Its report is ``cut_share``."""
    test = F.lit(True)
    for name, (low, high) in ranges.items():
        test = test & F.coalesce(F.col(name).between(low, high), F.lit(False))
    return rows.withColumn("mask", test)


def in_any(rows: DataFrame, column: str, ranges: list[tuple[float, float]]) -> DataFrame:
    """The rows whose value is inside any of the ranges, ends included."""
    test = F.lit(False)
    for low, high in ranges:
        test = test | F.col(column).between(low, high)
    return rows.where(test)


def without(rows: DataFrame, listed: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys aren't listed; the list may be of any size."""
    return rows.join(listed.select(*keys).distinct(), list(keys), "left_anti")


def parted(rows: DataFrame, column: str, limit: float) -> DataFrame:
    """The rows with ``good``: the value is below the limit; null for a null."""
    return rows.withColumn("good", F.col(column) < limit)


def ranked(rows: DataFrame, group: str, by: str, tie: str) -> DataFrame:
    """The rows with their ``rank`` in the group, from 1 for the largest value; ties go by the column ``tie``."""
    out = numbered(rows.withColumn("_down", -F.col(by).cast("double")), [group], ["_down", tie], "rank")
    return out.withColumn("rank", F.col("rank") + 1).drop("_down", "rank_all")


def complete(rows: DataFrame, *drop: str) -> DataFrame:
    """The rows that have no null, without the named columns."""
    return rows.drop(*drop).dropna()


def in_all(*tables: DataFrame) -> DataFrame:
    """The keys that every table has, each once."""
    out = tables[0]
    for t in tables[1:]:
        out = out.intersect(t)
    return out


def filled(rows: DataFrame, key: str, place: str, value: str, length: int) -> DataFrame:
    """key, samples: an array of ``length`` places, with 0 where a key has no row for a place; places outside are left out, of two rows for one place the larger value counts."""
    best = rows.where(F.col(place).between(0, length - 1)).groupBy(key, place).agg(F.max(value).alias("v"))
    by = best.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col(place).cast("int"), "v"))).alias("m"))
    return by.select(key, F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("samples"))
