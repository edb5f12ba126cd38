"""Statistics of scores: rows (positive boolean, score) and optional keys."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import running


def curve(scores: DataFrame, *keys: str) -> DataFrame:
    """keys, score, p, n, tp, fp, tpr, fpr: the ROC at every score that occurs; a row passes where its score is at least that high.

    Rows are first counted by score (p positive, n negative ones), and running sums go over slices of the scores. Null scores
    never pass but count in the totals; without positives (negatives) tpr (fpr) is null.
    """
    side = scores.select(*keys, "score", F.col("positive").cast("long").alias("p"), (~F.col("positive")).cast("long").alias("n"))
    steps = side.groupBy(*keys, "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    run = running(steps, list(keys), ["score"], {"tp": "p", "fp": "n"}, down=True)
    some = run.where(F.col("score").isNotNull())
    return some.select(*keys, "score", "p", "n", "tp", "fp", (F.col("tp") / F.nullif("tp_all", F.lit(0))).alias("tpr"), (F.col("fp") / F.nullif("fp_all", F.lit(0))).alias("fpr"))


def auc(roc: DataFrame, *keys: str, at: float = 0.1) -> DataFrame:
    """keys, auc (trapezoids from the origin), tpr_at (the largest tpr with fpr <= ``at``, 0 if there is none).

    The point before this one is this one less its own rows, so no second sort is needed.
    """
    before = lambda rate, all_, own: F.coalesce(F.col(rate) * F.try_divide(F.col(all_) - F.col(own), F.col(all_)), F.lit(0.0))
    x, y = before("fpr", "fp", "n"), before("tpr", "tp", "p")
    rows = roc.withColumn("area", (F.col("fpr") - x) * (F.col("tpr") + y) / 2)
    best = F.coalesce(F.max(F.when(F.col("fpr") <= at, F.col("tpr"))), F.lit(0.0))
    return rows.groupBy(*keys).agg(F.round(F.sum("area"), 6).alias("auc"), F.round(best, 6).alias("tpr_at"))


def nearest(roc: DataFrame, tpr: float, *keys: str) -> DataFrame:
    """keys, score, tpr: the point of the curve whose tpr is nearest the target; of several, the one with the highest score."""
    way = F.struct(F.abs(F.col("tpr") - tpr), -F.col("score"))
    return roc.groupBy(*keys).agg(F.min_by(F.struct("score", "tpr"), way).alias("b")).select(*keys, F.round("b.score", 6).alias("score"), F.round("b.tpr", 6).alias("tpr"))


def nearest_threshold(roc: DataFrame, threshold: float, *keys: str) -> DataFrame:
    """keys, score, tpr, fpr: the point of the curve whose score is nearest the target; of two, the higher one."""
    way = F.struct(F.abs(F.col("score") - threshold), -F.col("score"))
    return roc.groupBy(*keys).agg(F.min_by(F.struct("score", "tpr", "fpr"), way).alias("b")).select(*keys, *(F.round(f"b.{c}", 6).alias(c) for c in ("score", "tpr", "fpr")))


def best_accuracy(hits: DataFrame, *keys: str) -> DataFrame:
    """One row: the configuration (keys) with the largest accuracy of its ``hit_counts`` (columns tp, tn, fp); of several, the least by its keys."""
    right = F.coalesce(F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp")), F.lit(0.0))
    order = F.struct(-right, *keys)
    return hits.agg(F.min_by(F.struct(*keys, right.alias("accuracy")), order).alias("b")).select(*(f"b.{k}" for k in keys), F.round("b.accuracy", 6).alias("accuracy"))


def hit_counts(hits: DataFrame) -> DataFrame:
    """One row: tp, tn, fp, accuracy, precision of rows (hits): one hit is right, none a true negative, every further one false."""
    n = F.col("hits")
    one = hits.agg(F.count_if(n >= 1).alias("tp"), F.count_if(n == 0).alias("tn"), F.coalesce(F.sum(F.greatest(n - 1, F.lit(0))), F.lit(0)).cast("long").alias("fp"))
    right, all_ = F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp")
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return one.select("tp", "tn", "fp", share(right, all_).alias("accuracy"), share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))
