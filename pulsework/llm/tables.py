"""Reading inputs, cutting lineage, and what is left of it afterwards."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it. Where it is unset, a temporary folder, on a local master only."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="pulsework-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes a table in the shared folder and reads it again: later jobs need nothing of what made it, and lost executors cost no more than their own tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of the table has."""
    while name in df.columns:
        name = "_" + name
    return name


#: Bytes of rows that a Python task gets at once: what it and its JVM hold of them, workers that wait for their next task too.
BATCH = 1 << 21
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, size: int | None = None):
    """What runs meanwhile hands its rows to Python ``size`` bytes at a time (``BATCH``), or one longer row; the setting is put back after it."""
    was = spark.conf.get(_BYTES)
    spark.conf.set(_BYTES, size or BATCH)
    try:
        yield
    finally:
        spark.conf.set(_BYTES, was)


_written: list[str] = []


def mark() -> int:
    """The state of ``cut`` for ``forget``."""
    return len(_written)


def forget(spark: SparkSession, since: int = 0, keep: DataFrame | list[DataFrame] | None = None) -> None:
    """Deletes the tables that ``cut`` has written since the mark, but for those that ``keep`` (a table or several) reads: nothing that is still to be computed may need the others."""
    kept = {f.rsplit("/", 2)[-2] for df in (keep if isinstance(keep, list) else [keep] if keep is not None else []) for f in df.inputFiles()}
    for path in _written[since:]:
        if path.rsplit("/", 1)[-1] not in kept:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _written[since:] = [p for p in _written[since:] if p.rsplit("/", 1)[-1] in kept]


#: The parts that the rows of a hot key are dealt into.
SALT = 32


def met(rows: DataFrame, index: DataFrame, on: list[str], by: str, broadcast_rows: int, how: str = "inner") -> DataFrame:
    """``rows`` joined (``how``: inner, left or left_semi) with ``index``, a table that ``cut`` has written, by equal columns.

    An index of at most ``broadcast_rows`` rows is broadcast. Beyond it, as any key may have a large part of all rows, the rows
    are dealt into ``SALT`` parts by a hash of the column ``by``, and each part meets a copy of the index. The result is the same.
    """
    if index.count() <= broadcast_rows:
        return rows.join(F.broadcast(index), on, how)
    parts = index.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int")).join(parts, [*on, "_part"], how).drop("_part")


#: Keys with more than one in so many of all rows are few enough to be broadcast. A table of ``SMALL`` rows or fewer is no burden to any task.
HOT, SMALL = 4096, 100_000


def spread(rows: DataFrame, index: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` (a table, as it is read several times) joined with ``index``, which has one row for each key.

    Keys with more than one in ``HOT`` of all rows are at most ``HOT``: their rows of the index are broadcast, and their rows aren't shuffled.
    """
    total = rows.count()
    if total <= SMALL:
        return rows.join(index, on)
    found = rows.groupBy(on).agg(F.count("*").alias("_n")).where(F.col("_n") * HOT > total).select(on).toArrow()
    if not found.num_rows:
        return rows.join(index, on)
    # as an Arrow table: rows of Python would start Python workers of another kind in each executor, which stay
    hot = F.broadcast(rows.sparkSession.createDataFrame(found, rows.select(on).schema))
    return rows.join(F.broadcast(index.join(hot, on, "left_semi")), on).unionByName(rows.join(hot, on, "left_anti").join(index, on))
