"""Metrics over a prediction table ``(keys…, y, yhat)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(pred: DataFrame, keys: Sequence[str] = (), y: str = "y", yhat: str = "yhat") -> DataFrame:
    return pred.groupBy(*keys, F.col(y).alias("y"), F.col(yhat).alias("yhat")).agg(F.count("*").alias("n"))


def accuracy(pred: DataFrame, keys: Sequence[str] = (), y: str = "y", yhat: str = "yhat") -> DataFrame:
    return pred.groupBy(*keys).agg(F.avg((F.col(y) == F.col(yhat)).cast("double")).alias("accuracy"))


def class_scores(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every class in truth or prediction.

    Works on confusion counts: each cell adds to its true and its predicted class.
    """
    cells = counts.select(*keys, "n", F.explode(F.array(
        F.struct(F.col("y").alias("class"), F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0).alias("tp"),
                 F.col("n").alias("real"), F.lit(0).cast("long").alias("said")),
        F.struct(F.col("yhat").alias("class"), F.lit(0).cast("long").alias("tp"),
                 F.lit(0).cast("long").alias("real"), F.col("n").alias("said")),
    )).alias("c")).select(*keys, "c.*")
    sums = cells.groupBy(*keys, "class").agg(
        F.sum("tp").alias("tp"), F.sum("real").alias("support"), F.sum("said").alias("predicted"))

    def ratio(a, b):
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))

    f1 = F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("predicted"))
    return sums.select(*keys, "class", ratio("tp", "predicted").alias("precision"),
                       ratio("tp", "support").alias("recall"),
                       F.coalesce(f1, F.lit(0.0)).alias("f1"), "support", "tp")


def macro_f1(pred: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    scores = class_scores(confusion(pred, keys), keys)
    return scores.groupBy(*keys).agg(F.avg("f1").alias("macro_f1"))


def class_f1(pred: DataFrame, cls, keys: Sequence[str] = ()) -> DataFrame:
    """F1 of one class per group; zero where the class is not in the truth."""
    scores = class_scores(confusion(pred, keys), keys)
    hit = F.max(F.when((F.col("class") == F.lit(cls)) & (F.col("support") > 0), F.col("f1")))
    return scores.groupBy(*keys).agg(F.coalesce(hit, F.lit(0.0)).alias("class_f1"))


def fold_scores(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Macro F1 and accuracy per group from one confusion table."""
    scores = class_scores(confusion(pred, keys), keys)
    return scores.groupBy(*keys).agg(
        F.avg("f1").alias("MacroF1"), (F.sum("tp") / F.sum("support")).alias("Accuracy"))


def summarize(results: DataFrame, keys: Sequence[str] = ("Setting", "Model")) -> DataFrame:
    return results.groupBy(*keys).agg(
        F.avg("MacroF1").alias("MacroF1_mean"), F.stddev_samp("MacroF1").alias("MacroF1_std"),
        F.avg("Accuracy").alias("Accuracy_mean"), F.stddev_samp("Accuracy").alias("Accuracy_std"))


def classification_report(pred: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per class, then accuracy, macro and weighted averages, per group."""
    keys = list(keys)
    scores = class_scores(confusion(pred, keys), keys)
    name = F.col("class").cast("string").alias("class")
    per_class = scores.select(*keys, name, "precision", "recall", "f1", "support")
    weigh = lambda c: F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    averages = scores.groupBy(*keys).agg(
        F.array(
            F.struct(F.lit("accuracy").alias("class"), *[
                (F.sum("tp") / F.sum("support")).alias(c) for c in ("precision", "recall", "f1")],
                F.sum("support").alias("support")),
            F.struct(F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")],
                     F.sum("support").alias("support")),
            F.struct(F.lit("weighted avg").alias("class"), *[weigh(c).alias(c) for c in ("precision", "recall", "f1")],
                     F.sum("support").alias("support")),
        ).alias("rows"))
    summary = averages.select(*keys, F.explode("rows").alias("r")).select(*keys, "r.*")
    return per_class.unionByName(summary)


def report_pooled(pred: DataFrame) -> DataFrame:
    return classification_report(pred)


def report_mean(pred: DataFrame, fold: str) -> DataFrame:
    """Report per fold, averaged over the folds."""
    return classification_report(pred, [fold]).groupBy("class").agg(*[
        F.avg(c).alias(c) for c in ("precision", "recall", "f1", "support")])
