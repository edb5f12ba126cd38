"""Long series: rows (channel, order columns, value). A channel may be as long as it likes: it is cut into slices of time."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import numbered, slice_of


def placed(series: DataFrame) -> DataFrame:
    """``series`` with i, the place of each row in its channel in time order, from 0."""
    timed = series.withColumn("_t", F.unix_micros(F.col("ts").cast("timestamp")))
    return numbered(timed, ["channel"], ["_t", "event_id"], "i").drop("_t", "i_all")


def tumbling(series: DataFrame, length: int) -> DataFrame:
    """channel, window, mean, top of each run of ``length`` samples; the remainder is dropped."""
    rows = placed(series).withColumn("window", F.floor(F.col("i") / length).cast("long"))
    out = rows.groupBy("channel", "window").agg(F.count("*").alias("n"), F.round(F.avg("value"), 8).alias("mean"), F.max("value").alias("top"))
    return out.where(F.col("n") == length).drop("n")


def hysteresis(series: DataFrame, threshold: float, rearm: float) -> DataFrame:
    """channel, event_id of hits: a value above ``threshold`` while armed; a value below rearm * threshold arms again.

    Only the last sample that was above or below matters, so a hit is a sample above whose last such sample before was
    below, or that has none before it: no state. The last such sample of the slices before is carried into each slice.
    """
    mark = F.when(F.col("value") > threshold, 1).when(F.col("value") < rearm * threshold, 0)
    rows = series.select("channel", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), mark.alias("mark")).where("mark is not null")
    rows = rows.withColumn("s", slice_of(rows, "t"))
    ends = rows.groupBy("channel", "s").agg(F.max_by("mark", F.struct("t", "event_id")).alias("end"))
    carried = ends.select(F.col("channel").alias("c"), F.col("s").alias("q"), F.lag("end").over(Window.partitionBy("channel").orderBy("s")).alias("carried"))
    inner = F.lag("mark").over(Window.partitionBy("channel", "s").orderBy("t", "event_id"))
    both = rows.withColumn("last", inner).join(carried, F.col("channel").eqNullSafe(F.col("c")) & (F.col("s") == F.col("q")))
    return both.where("mark = 1 and coalesce(last, carried, 0) = 0").select("channel", "event_id")


def moving_power(series: DataFrame, length: int, chunk: int = 1 << 16) -> DataFrame:
    """channel, event_id, power: the sum of squares of the last ``length`` samples, where there are as many. Chunks borrow the tail of the one before."""
    here = F.floor(F.col("i") / chunk).cast("long")
    homes = F.when(F.col("i") % chunk > chunk - length, F.array(here, here + 1)).otherwise(F.array(here))
    rows = placed(series).select("channel", "event_id", "i", "value", here.alias("own"), F.explode(homes).alias("chunk"))
    order = Window.partitionBy("channel", "chunk").orderBy("i").rowsBetween(1 - length, 0)
    out = rows.select("channel", "event_id", "own", "chunk", F.sum(F.col("value") * F.col("value")).over(order).alias("power"), F.count("*").over(order).alias("n"))
    return out.where((F.col("n") == length) & (F.col("own") == F.col("chunk"))).select("channel", "event_id", F.round("power", 4).alias("power"))


def records(series: DataFrame, length: int) -> DataFrame:
    """channel, block, n, samples: a series cut into records of ``length`` samples; the last one of a channel may be shorter, so nothing is lost at the end."""
    rows = placed(series).withColumn("block", F.floor(F.col("i") / length).cast("long"))
    out = rows.groupBy("channel", "block").agg(F.sort_array(F.collect_list(F.struct("i", "value"))).alias("s"))
    return out.select("channel", "block", F.size("s").alias("n"), F.col("s.value").alias("samples"))


def described(records_: DataFrame, starts: DataFrame, dt: int, kinds: DataFrame) -> DataFrame:
    """``records_`` (channel, block, n) with time and endtime (ns), dt and kind: the run's start (starts: channel, start in seconds; 0 if
    absent) and the records before it. ``kinds`` (channel, kind) names the kind of channel; unknown ones are null."""
    # the lengths are reduced before they are shuffled; the samples of a channel never meet
    lengths = records_.groupBy("channel").agg(F.max("n").alias("_length"))
    rows = records_.join(lengths, "channel").join(starts, "channel", "left").join(kinds, "channel", "left")
    time = (F.coalesce("start", F.lit(0)) * 1_000_000_000 + F.col("block") * F.col("_length") * dt).cast("long")
    return rows.withColumns({"time": time, "dt": F.lit(dt)}).withColumn("endtime", F.col("time") + F.col("n") * dt).drop("_length", "start")
