"""A corpus pipeline: toxic documents go, one document of each group of near copies stays, leaked benchmark text goes, languages are mixed to target weights, and what is left is dealt into shards.

Every stage works on all that its predecessor kept and is written as Parquet before the next one reads it.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsework.llm import op1_sharding, op4_decontamination, op5_mixing, op8_jaccard, op9_toxicity
from pulsework.llm.tables import cut, forget, mark, read


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of toxicity below 0.3 stay, with the columns that they have; null and empty texts and repeated rows too."""
    model = op9_toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return op9_toxicity.tagged(docs, model, score="_toxicity", spans="_spans").where(F.col("_toxicity") < 0.3).select(docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id stays (a null one comes last); ties go to the least hash of the text, and one row of equal ones stays."""
    return op8_jaccard.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item of the benchmark stay, also those with a null text or doc_id."""
    return op4_decontamination.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays (a rate is at least 1), with the columns that it has; those of rarer languages are repeated, and so are null texts at a rate of their own."""
    mix, _ = op5_mixing.fit(docs, read(spark, sf_dir, "labels"), least=1.0)
    return op5_mixing.dealt(docs, mix)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its columns, its text too, and its shard and place in it; equal texts share a shard, null and empty ones too."""
    return op1_sharding.shard(docs)


STAGES = [("toxicity", toxicity), ("jaccard_join", jaccard_join), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]
#: A learned classifier, a similarity join and a heap: not to be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that are left, with their texts and shards, as a table in the shared folder. What a stage wrote on its way is deleted once the stage is done."""
    docs = read(spark, sf_dir, "documents")
    since = mark()
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
        forget(spark, since, keep=docs)
    return docs
