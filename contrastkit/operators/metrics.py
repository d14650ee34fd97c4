"""Metrics of scored rows, for each value of the columns `by`. Undefined metrics are null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrastkit.functions.numeric import clamped
from contrastkit.operators.ordered import running


def confusion(label: Column, predicted: Column) -> dict[str, Column]:
    """Aggregates tp, tn, fp, fn."""
    count = lambda y, p: F.count_if((label == y) & (predicted == p))
    return {"tp": count(1, 1), "tn": count(0, 0), "fp": count(0, 1), "fn": count(1, 0)}


def balanced_accuracy(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    """Null if a class is absent."""
    return (F.try_divide(tp.cast("double"), tp + fn) + F.try_divide(tn.cast("double"), tn + fp)) / 2


def matthews(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    """Null if a margin is empty."""
    a, b, c, d = (x.cast("double") for x in (tp, tn, fp, fn))
    return F.try_divide(a * b - c * d, F.sqrt((a + c) * (a + d) * (b + c) * (b + d)))


def roc_auc(rows: DataFrame, by: Sequence[str], label: str, score: str) -> DataFrame:
    """(by, roc_auc): the share of pairs of a positive and a negative that the score orders right, ties counting half.

    That is what mid-ranks give. Rows are counted by score before they are ordered. Null with one class only.
    """
    own = rows.groupBy(*by, score).agg(F.sum(label).cast("double").alias("_p"), (F.count(F.lit(1)) - F.sum(label)).cast("double").alias("_n"))
    own = running(own, by, [score], {"_upto": "_n"})
    right = F.sum(F.col("_p") * (F.col("_upto") - F.col("_n") / 2))
    return own.groupBy(*by).agg(F.try_divide(right, F.sum("_p") * F.sum("_n")).alias("roc_auc"))


def average_precision(rows: DataFrame, by: Sequence[str], label: str, score: str, order: Sequence[str], ties: str = "input") -> DataFrame:
    """(by, average_precision): the mean precision at each positive; null without positives.

    ties: "input" ranks equal scores by `order`, "grouped" gives all of them the precision behind the last.
    """
    if ties == "grouped":
        own = rows.groupBy(*by, score).agg(F.sum(label).alias("_p"), F.count(F.lit(1)).alias("_n"))
        placed = running(own, by, [F.desc(score)], {"_hits": "_p", "_place": "_n"})
        return placed.groupBy(*by).agg(F.try_divide(F.sum(F.col("_p") * F.col("_hits") / F.col("_place")), F.sum("_p").cast("double")).alias("average_precision"))
    placed = running(rows.select(*by, label, score, *order), by, [F.desc(score), *order], {"_hits": label, "_place": F.lit(1)})
    return placed.groupBy(*by).agg(F.avg(F.when(F.col(label) == 1, F.col("_hits") / F.col("_place"))).alias("average_precision"))


def log_loss(label: Column, score: Column) -> Column:
    p = clamped(score)
    return F.avg(-F.when(label == 1, F.log(p)).otherwise(F.log(1 - p)))


def brier(label: Column, score: Column) -> Column:
    return F.avg((score - label) * (score - label))


def evaluated(rows: DataFrame, by: Sequence[str], label: str, score: str, predicted: str, order: Sequence[str]) -> DataFrame:
    """For each value of `by`: sizes, all metrics and the confusion counts.

    Rows are put in order once, by falling score and then by `order`. Running positives and places give the precision at
    each positive; where they stand at the end of equal scores gives the negatives above, and so the area under the curve.
    """
    y = F.col(label)
    placed = running(rows.select(*by, label, score, predicted, *order), by, [F.desc(score), *order], {"_hits": label, "_place": F.lit(1)})
    four = confusion(y, F.col(predicted))
    at = placed.groupBy(*by, score).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(label).cast("long").alias("_p"),
        (F.max("_place") - F.max("_hits")).alias("_negatives"),
        F.sum(F.when(y == 1, F.col("_hits") / F.col("_place"))).alias("_precision"),
        *[c.alias(name) for name, c in four.items()],
    )
    return of_counted(at, by, score)


def of_counted(at: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """evaluated of (by, score, _n, _p, _negatives, _precision, tp, tn, fp, fn): at each score the rows, positives, negatives
    down to its end, and the sum of the precision at its positives, which may also come in rows of its own that count none."""
    n, p, s = F.col("_n"), F.col("_p"), F.col(score)
    sure, four = clamped(s), ("tp", "tn", "fp", "fn")
    whole, positives = F.sum("_n"), F.sum("_p")
    pairs = positives.cast("double") * (whole - positives)
    above = F.sum(p * (F.col("_negatives") - (n - p) / 2.0))
    out = at.groupBy(*by).agg(
        whole.alias("n"),
        positives.alias("positives"),
        (positives / whole).alias("prevalence"),
        (-F.sum(p * F.log(sure) + (n - p) * F.log(1 - sure)) / whole).alias("log_loss"),
        (F.sum(p * (s - 1) * (s - 1) + (n - p) * s * s) / whole).alias("brier"),
        *[F.sum(name).alias(name) for name in four],
        F.try_divide(pairs - above, pairs).alias("roc_auc"),
        F.try_divide(F.sum("_precision"), positives.cast("double")).alias("average_precision"),
    )
    counts = [F.col(c) for c in four]
    out = out.withColumn("balanced_accuracy", balanced_accuracy(*counts)).withColumn("mcc", matthews(*counts))
    return out.select(*by, "n", "positives", "prevalence", "log_loss", "brier", *four, "balanced_accuracy", "mcc", "roc_auc", "average_precision")


def best_thresholds(rows: DataFrame, by: Sequence[str], label: str, score: str) -> DataFrame:
    """(by, threshold): the score that, taken as the least of a positive, gives the best (MCC, balanced accuracy).

    Ties keep the lowest; an undefined metric counts as -999. One running sum over the distinct scores tries them all.
    """
    own = rows.groupBy(*by, F.col(score).alias("threshold")).agg(F.sum(label).cast("long").alias("p"), F.count(F.lit(1)).alias("n"))
    return best_of_counted(own, by)


def best_of_counted(counted: DataFrame, by: Sequence[str]) -> DataFrame:
    """best_thresholds of (by, threshold, p, n): positives and rows at each distinct score."""
    whole = counted.groupBy(*by).agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    tried = running(counted, by, [F.desc("threshold")], {"tp": "p", "_above": "n"}).join(whole, list(by))
    tried = tried.withColumn("fp", F.col("_above") - F.col("tp")).withColumn("fn", F.col("_p") - F.col("tp")).withColumn("tn", F.col("_n") - F.col("_p") - F.col("fp"))
    four = [F.col(c) for c in ("tp", "tn", "fp", "fn")]
    worst = F.lit(-999.0)
    key = F.struct(F.coalesce(matthews(*four), worst).alias("mcc"), F.coalesce(balanced_accuracy(*four), worst).alias("ba"), (-F.col("threshold")).alias("low"))
    return tried.groupBy(*by).agg(F.max_by("threshold", key).alias("threshold"))


def fold_means(rows: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Means of the metrics over folds; undefined ones are left out."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("folds"), *[F.avg(m).alias(f"mean_{m}") for m in metrics])


def wrong_predictions(rows: DataFrame, label: str, predicted: str, score: str, threshold: str, order: Sequence[str], limit: int = 50) -> DataFrame:
    """The most confident errors: FP or FN, and how far the rounded score is from the threshold."""
    out = rows.where(F.col(label) != F.col(predicted)).withColumn("error_type", F.when(F.col(predicted) == 1, "FP").otherwise("FN"))
    out = out.withColumn("confidence", F.abs(F.round(score, 8) - F.round(threshold, 8)))
    return out.orderBy(F.desc("confidence"), *order).limit(limit)
