"""Running totals, numbers and exact percentiles of sorted rows, without one task that sorts them all.

Rows are cut into slices by value, with edges from one approximate pass; the totals of the slices, a few rows for each key, are
summed first, and each slice is sorted by itself. The edges decide how even the slices are, not the result.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a slice, about; a table of fewer has one slice and isn't read for edges. Equal values share a slice.
ROWS_A_SLICE = 500_000
#: Edges that a leaf of the search for a slice compares with.
LEAF = 32


def slice_of(rows: DataFrame, order: str, slices: int | None = None) -> Column:
    """The number of the slice of the column ``order``, a number; nulls are in slice 0. Without ``slices`` there are as many as the rows need."""
    slices = slices or rows.count() // ROWS_A_SLICE + 1
    edges = sorted(set(rows.approxQuantile(order, [i / slices for i in range(1, slices)], 0.25 / slices))) if slices > 1 else []

    def halved(low: int, high: int) -> Column:  # the slice is between low and high edges passed
        if high - low <= LEAF:
            return F.lit(low) + sum((F.when(F.col(order) >= e, 1).otherwise(0) for e in edges[low:high]), F.lit(0))
        middle = (low + high) // 2
        return F.when(F.col(order) >= edges[middle], halved(middle + 1, high)).otherwise(halved(low, middle))

    return F.coalesce(F.when(F.col(order).isNull(), 0), halved(0, len(edges)))


def running(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], slices: int | None = None, down: bool = False) -> DataFrame:
    """``rows`` with a running total (of all rows up to this one) and a grand total for each entry name -> column of ``sums``, as
    ``name`` and ``name_all``, in each value of ``keys``, in the order of the columns ``order``, of which the first is a number.

    ``down`` turns the order of the first column round. Rows that tie in all of ``order`` have any order among themselves.
    """
    keyed = rows.withColumn("_slice", slice_of(rows, order[0], slices) * (-1 if down else 1))
    per = keyed.groupBy(*keys, "_slice").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    part = Window.partitionBy(*(keys or [F.lit(0)]))
    before = part.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "_slice", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums), *(F.sum(f"_{n}").over(part).alias(f"{n}_all") for n in sums))
    per = per.select(*(F.col(k).alias(f"_slice_k{i}") for i, k in enumerate(keys)), F.col("_slice").alias("_slice_at"), *(f"_{n}" for n in sums), *(f"{n}_all" for n in sums))
    first = F.col(order[0]).desc_nulls_last() if down else F.col(order[0]).asc_nulls_first()
    inner = Window.partitionBy(*keys, "_slice").orderBy(first, *order[1:]).rowsBetween(Window.unboundedPreceding, 0)
    inside = keyed.select("*", *(F.sum(c).over(inner).alias(n) for n, c in sums.items()))
    same = F.col("_slice") == F.col("_slice_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_slice_k{i}"))
    both = inside.join(per, same)
    return both.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_slice", "_slice_at", *(f"_{n}" for n in sums), *(f"_slice_k{i}" for i in range(len(keys))))


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "place", slices: int | None = None) -> DataFrame:
    """``rows`` with their number from 0 in each value of ``keys``, as ``name``, and the number of all, as ``name_all``."""
    out = running(rows.withColumn("_one", F.lit(1)), keys, order, {name: "_one"}, slices).drop("_one")
    return out.withColumn(name, F.col(name) - 1)


def percentiles(rows: DataFrame, column: str, shares: dict[str, float], *keys: str) -> DataFrame:
    """keys and each percentile by its name: exact, linear between the neighbours. Nulls don't count; a key without values has no row.

    Equal values are counted before they are sorted.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    line = running(counts, list(keys), ["_v"], {"_n": "_c"})
    at = {name: F.lit(float(q)) * (F.col("_n_all") - 1) for name, q in shares.items()}
    low = lambda h: F.min(F.when(F.col("_n") > F.floor(h), F.col("_v")))
    high = lambda h: F.min(F.when(F.col("_n") > F.floor(h) + 1, F.col("_v")))
    found = line.groupBy(*keys).agg(F.first("_n_all").alias("_n_all"), *(low(h).alias(f"_{n}_low") for n, h in at.items()), *(F.coalesce(high(h), low(h)).alias(f"_{n}_high") for n, h in at.items()))
    return found.select(*keys, *((F.col(f"_{n}_low") + (h - F.floor(h)) * (F.col(f"_{n}_high") - F.col(f"_{n}_low"))).alias(n) for n, h in at.items()))
