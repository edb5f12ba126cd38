"""Tables of runs, by version of their configuration."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def config_key(config: dict, length: int = 10) -> str:
    """A short key of a configuration; the order of its entries doesn't matter."""
    digest = hashlib.sha1(json.dumps(config, sort_keys=True, default=str).encode()).digest()
    return base64.b32encode(digest).decode().lower()[:length]


def run_name(run: int | str) -> str:
    return f"{run:06d}" if isinstance(run, int) else run


def write_versioned(rows: DataFrame, base: str, kind: str, run: int | str, config: dict) -> None:
    """Adds a version to base/kind, in folders by run, configuration and time of writing; older versions stay."""
    stamped = rows.withColumn("run_id", F.lit(run_name(run))).withColumn("config", F.lit(config_key(config))).withColumn("written", F.unix_micros(F.current_timestamp()))
    stamped.write.mode("append").partitionBy("run_id", "config", "written").parquet(f"{base}/{kind}")


def versions(spark: SparkSession, base: str, kind: str) -> DataFrame:
    """run_id, config, written of every version that is there, from the folders alone."""
    return spark.read.option("recursiveFileLookup", "false").schema(_with_text(spark, f"{base}/{kind}")).parquet(f"{base}/{kind}").select("run_id", "config", "written").distinct()


def read_latest(spark: SparkSession, base: str, kind: str, *runs: int | str, config: dict | None = None, written: int | None = None) -> DataFrame:
    """The newest version of each of the runs (of all, if none is named); of a configuration, the newest that was written with it, and with ``written`` the version
    of that time (microseconds, as ``versions`` has it) and no other. Folders give run, configuration and time, so only theirs are read."""
    rows = spark.read.option("recursiveFileLookup", "false").schema(_with_text(spark, f"{base}/{kind}")).parquet(f"{base}/{kind}")
    if runs:
        rows = rows.where(F.col("run_id").isin([run_name(r) for r in runs]))
    if config is not None:
        rows = rows.where(F.col("config") == config_key(config))
    if written is not None:
        return rows.where(F.col("written") == written)
    newest = rows.groupBy("run_id").agg(F.max("written").alias("written"))
    return rows.join(F.broadcast(newest), ["run_id", "written"], "left_semi")


def _with_text(spark: SparkSession, path: str):
    """The table's schema with run ids as text: 000012 is no number."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    kinds = {"run_id": StringType(), "config": StringType(), "written": LongType()}
    return StructType([StructField(f.name, kinds.get(f.name, f.dataType)) for f in spark.read.parquet(path).schema])


def still_to_do(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The work whose key has no output yet."""
    return work.join(done.select(key).distinct(), key, "left_anti")
