"""The given tables, seen as tables of traces, series and reduced quantities."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window


def traces(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("trace_id"), F.col("embedding").alias("samples"), F.col("label").alias("energy"), F.floor(F.col("vec_id") / 9).cast("long").alias("event_id"), (F.col("vec_id") % 9).alias("channel"))


def places(spark, d):
    """channel (user), i (place in time order, from 0), event_id, ts, v of the event stream."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("user_id").alias("channel"), (F.row_number().over(order) - 1).cast("long").alias("i"), "event_id", "ts", F.col("value").alias("v"))


def items(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet")


def events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


#: The same tables in SQL.
T = "(SELECT vec_id AS trace_id, vec_id // 9 AS event_id, vec_id % 9 AS channel, label AS energy, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
LONG = f"(SELECT trace_id, event_id, channel, energy, CAST(unnest(range(0, len(v))) AS INTEGER) AS i, unnest(v) AS x FROM {T})"
P = "(SELECT user_id AS channel, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, event_id, ts, value AS v FROM events)"
