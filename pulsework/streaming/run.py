"""Running a stream over what is there, into a table."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """A new folder in the one that all executors share, as the cluster names it; where that is unset, a temporary one, on a local master only."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(where or tempfile.mkdtemp(prefix='pulsework-')).rstrip('/')}/{uuid.uuid4().hex}"


def chunked(rows: DataFrame, order: str, key: str | None = None, chunks: int = 3, files: int = 8) -> DataFrame:
    """A stream of a table's rows in ``chunks`` parts by the column ``order``, each written after the one before; a value of ``key`` has one file in a part, so its
    rows come in order. Without a key each part has just ``files`` files (if it has as many rows), and so is a batch of its own."""
    spark = rows.sparkSession
    edges = rows.approxQuantile(order, [i / chunks for i in range(1, chunks)], 0.01)
    path, spans = folder(spark), list(zip([None, *edges], [*edges, None]))
    for low, high in spans:
        part = rows.where(F.lit(True) if low is None else F.col(order) >= low).where(F.lit(True) if high is None else F.col(order) < high)
        part.repartition(files, *([key] if key else [])).write.mode("append").parquet(path)
    return source(spark, path, files)


def source(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A stream of the parquet files of a table, at most ``files`` of them in a chunk. The schema is the table's own."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    # A pattern, because a table may be a single file.
    return reader.parquet(path[:-1] + f"[{path[-1]}]")


def drained(stream: DataFrame, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """All rows of the stream, once it has read what is there. With ``update``, the last row of each key counts."""
    spark = stream.sparkSession
    where = folder(spark)

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_number", F.lit(number)).write.mode("overwrite").parquet(f"{where}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    schema = spark.createDataFrame([], stream.schema).withColumn("batch_number", F.lit(0)).schema
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{where}/rows") if query.lastProgress else spark.createDataFrame([], schema)
    if not keys:
        return rows.drop("batch_number")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_number").alias("last")).select(*keys, *(f"last.{c}" for c in rest))
