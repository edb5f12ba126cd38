"""Bounded samples of labelled rows, and what both classifiers share."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(doc_id="doc_id"):
    """Rows that are never learnt from: crc32 of the doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, label: str, each: int, chars: int) -> tuple[DataFrame, float]:
    """(doc_id, y, text) and the log-odds of label 1 among all labelled rows that may be learnt from.

    At most ``each`` rows of either label, chosen by a hash of their doc_id, and of those only texts of at most ``chars``
    characters: so the sample is bounded at any size of input. Labels other than 0 and 1, and null doc_ids, don't count. Of
    several rows under one doc_id, the largest label and the least text count.
    """
    own = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("y"))
    n = {r.y: r.n for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    few = [own.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each) for y in (0, 1)]
    few = F.broadcast(few[0].union(few[1]))  # 2 * each rows at most
    rows = docs.select("doc_id", "text").where(F.length("text") <= chars).join(few, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return rows, float(np.log((n.get(1, 0) + 1) / (n.get(0, 0) + 1)))


def sample(docs: DataFrame, labels: DataFrame, label: str, each: int, chars: int) -> tuple[list[str], np.ndarray, float]:
    """Texts, labels and log-odds of ``sampled``, on the driver."""
    rows, odds = sampled(docs, labels, label, each, chars)
    rows = sorted((r.doc_id, r.y, r.text) for r in rows.collect())
    return [r[2] for r in rows], np.array([r[1] for r in rows], np.int64), odds


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]]."""
    return np.diff(np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])[first])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
