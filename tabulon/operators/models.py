"""Classifier registry, ridge classifier, and fitting over folds."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LogisticRegression,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.operators.boosting import Settings, SoftmaxBoosting
from tabulon.operators.encode import add_class_weight, assemble
from tabulon.operators.forest import Settings as ForestSettings
from tabulon.operators.forest import fit_forest
from tabulon.operators.gram import gram
from tabulon.operators.linear import LinearScores, class_counts, fit_squared_hinge
from tabulon.operators.resample import smotenc
from tabulon.session import discard, materialize, side_by_side

SEED = 42
MAX_DEPTH = 30  # the library's limit; leaves end most trees before
TOLERANCE = 1e-4  # of linear models, the original library's default
MAX_BINS = 256  # cut points tried per column; more than any code column has levels here
FIT_PARTITION_ROWS = 20_000  # training rows of a partition: an iteration is one task per partition


def compact(df: DataFrame) -> DataFrame:
    """Training rows in as many partitions as their number asks for.

    Every pass of a fit sends the statistics of all open nodes per partition,
    so many small partitions cost more than they share out.  Draws go by a row's
    place in its partition: with row ids, rows that fit one partition are put in
    the order of these and always give the same model.
    """
    parts = df.count() // FIT_PARTITION_ROWS + 1
    rows = df.coalesce(parts)
    return rows.sortWithinPartitions("rid", "label") if parts == 1 and "rid" in df.columns else rows


def decision_tree(max_depth: int = MAX_DEPTH, seed: int = SEED, max_bins: int = MAX_BINS):
    return lambda df: DecisionTreeClassifier(
        impurity="gini", maxDepth=max_depth, maxBins=max_bins, seed=seed, cacheNodeIds=True).fit(compact(df))


def random_forest(n: int = 200, min_leaf: int = 2, weights: bool = True, max_depth: int = MAX_DEPTH,
                  seed: int = SEED, max_bins: int = MAX_BINS):
    """Gini trees on Poisson(1) draws of the rows and a root of the columns at each node."""
    return lambda df: fit_forest(df, ForestSettings(n, min_leaf, max_depth, max_bins, seed, weights))


def _balanced(df: DataFrame, weights: bool) -> tuple[DataFrame, float]:
    """Weighted rows and the sum of weights (with balance, the row count)."""
    rows = df.count()
    df = df.coalesce(rows // FIT_PARTITION_ROWS + 1)
    return add_class_weight(df, "label") if weights else df.withColumn("weight", F.lit(1.0)), float(rows)


def logistic(weights: bool = True, max_iter: int = 1000, c: float = 1.0):
    """Multinomial, penalty 1/(2C) on unscaled columns: regParam is 1/(C sum w)."""
    def fit(df: DataFrame):
        df, total = _balanced(df, weights)
        return LogisticRegression(regParam=1.0 / (c * total), standardization=False, maxIter=max_iter,
                                  tol=TOLERANCE, weightCol="weight", family="multinomial").fit(df)

    return fit


def linear_svc(weights: bool = True, max_iter: int = 1000, c: float = 1.0):
    """One squared-hinge machine per class."""
    return lambda df: fit_squared_hinge(compact(df), c, weights, max_iter=max_iter)


def boosted_trees(n: int = 300, depth: int = 6, lr: float = 0.08, subsample: float = 0.8, colsample: float = 0.8,
                  seed: int = SEED, max_bins: int = MAX_BINS):
    """One softmax ensemble over all classes; folds are fitted together."""
    return SoftmaxBoosting(Settings(n, depth, lr, subsample, colsample, max_bins=max_bins, seed=seed))


def ridge_classifier(alpha: float = 1.0, weights: bool = True):
    """Least squares on +1/-1 targets with a penalty, solved from one moment
    matrix; the intercept is not penalised."""
    def fit(df: DataFrame):
        df, _ = _balanced(df, weights)
        classes = tuple(class_counts(df))
        p = len(df.select(vector_to_array("features").alias("x")).first()["x"])
        xs = [f"__x{i}" for i in range(p)]
        ys = [f"__y{c}" for c in range(len(classes))]
        arr = df.withColumn("__a", vector_to_array("features"))
        cols = arr.select(*[F.col("__a")[i].alias(x) for i, x in enumerate(xs)],
                          *[F.when(F.col("label") == v, 1.0).otherwise(-1.0).alias(y) for v, y in zip(classes, ys)],
                          "weight")
        g = gram(cols, [*xs, *ys], "weight")
        total = g[0, 0]
        mean = g[0, 1:] / total
        centred = g[1:, 1:] - total * np.outer(mean, mean)
        w = np.linalg.solve(centred[:p, :p] + alpha * np.eye(p), centred[:p, p:]).T
        return LinearScores(w, mean[p:] - w @ mean[:p], classes)

    return fit


Fit = Callable[[DataFrame], object]


def model_registry() -> dict[str, Fit]:
    """The six classifiers with the settings of the original study."""
    return {
        "DecisionTree": decision_tree(),
        "RandomForest": random_forest(),
        "LogisticRegression": logistic(),
        "RidgeClassifier": ridge_classifier(),
        "LinearSVC": linear_svc(),
        "GradientBoosting": boosted_trees(),
    }


@dataclass(frozen=True)
class Resampler:
    """SMOTENC settings for the training part of each fold."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    k: int = 5
    seed: int = SEED
    few: str = "raise"


def training_rows(train: DataFrame, key: str, features: Sequence[str], resample: Resampler | None) -> DataFrame:
    """Training vectors, over-sampled when asked; ``rid`` tells the rows apart."""
    rows = train.select(key, "label", *features)
    name = F.col(key).cast("string")
    if resample is not None:
        num = [c for c in features if c in resample.numeric]
        cat = [c for c in features if c in resample.categorical]
        rows = smotenc(rows, key, "label", num, cat, resample.k, resample.seed, few=resample.few, digest="__digest")
        name = F.coalesce(name, "__digest")
    return assemble(rows, features).select("label", "features", F.xxhash64(name).alias("rid"))


def fold_columns(folds: DataFrame, key: str) -> tuple[DataFrame, int, int]:
    """One row per key with an array of its fold in each repeat."""
    long = folds if "repeat" in folds.columns else folds.withColumn("repeat", F.lit(0))
    ends = long.agg(F.max("repeat").alias("r"), F.max("fold").alias("k")).first()
    pairs = F.array_sort(F.collect_list(F.struct("repeat", "fold")))
    wide = long.groupBy(key).agg(F.transform(pairs, lambda p: p["fold"]).alias("__folds"))
    return wide, ends["r"] + 1, ends["k"] + 1


def map_folds(df: DataFrame, key: str, features: Sequence[str], folds: DataFrame, models: Mapping[str, Fit],
              work: Callable[[int, str, object, DataFrame], DataFrame], resample: Resampler | None = None,
              workers: int = 4, fit_rows: int | None = None) -> DataFrame:
    """Fit every model outside each fold and unite ``work(fold, name, model, held)``.

    ``df`` needs a numeric ``label``; ``folds`` holds one row per key and
    repeat.  The table is written once, whatever the number of repeats; a
    fold's training vectors are kept while its models are fitted, and up to
    ``workers`` folds are in work at a time.  A fit that has ``fit_sets`` gets
    the training vectors of all folds in one table instead.  With ``fit_rows``, a model is
    fitted to at most so many training rows of its fold, in hash order of the
    key; held-out rows are never left out.
    """
    wide, repeats, k = fold_columns(folds, key)
    joined = materialize(df.select(key, "label", *features).join(wide, key), "folded")

    joint = {name: fit for name, fit in models.items() if hasattr(fit, "fit_sets")}
    alone = {name: fit for name, fit in models.items() if name not in joint}

    def held(number: int) -> DataFrame:
        return joined.filter(F.col("__folds")[number // k] == number % k).drop("__folds")

    def one(number: int) -> tuple[list[DataFrame], DataFrame | None]:
        seen = joined.filter(F.col("__folds")[number // k] != number % k)
        if fit_rows is not None:
            seen = seen.orderBy(F.xxhash64(key), key).limit(fit_rows)
        train = training_rows(seen, key, features, resample).persist(StorageLevel.MEMORY_AND_DISK)
        parts = [work(number, name, fit(train), held(number)) for name, fit in alone.items()]
        kept = materialize(train.select(F.lit(number).alias("set"), "rid", "label", "features"), "training") if joint else None
        train.unpersist()
        return parts, kept

    done = side_by_side([partial(one, n) for n in range(repeats * k)], workers)
    parts = [part for some, _ in done for part in some]
    if joint:
        every = reduce(DataFrame.unionByName, [kept for _, kept in done])
        for name, fit in joint.items():
            parts += [work(n, name, model, held(n)) for n, model in fit.fit_sets(every).items()]
        discard(*[kept for _, kept in done])
    return reduce(DataFrame.unionByName, parts)


def predict(model, df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    scored = model.transform(assemble(df, features))
    return scored.select(*keep, F.col("label").alias("y"), F.col("prediction").alias("yhat"))


def fit_predict(df: DataFrame, key: str, features: Sequence[str], folds: DataFrame, models: Mapping[str, Fit],
                resample: Resampler | None = None, setting: str = "default", fit_rows: int | None = None) -> DataFrame:
    """Predictions of every model on the fold it did not see."""
    def work(fold: int, name: str, model, held: DataFrame) -> DataFrame:
        return predict(model, held, features, [key]).select(
            F.lit(setting).alias("Setting"), F.lit(name).alias("Model"), F.lit(fold).alias("Fold"), key, "y", "yhat")

    return map_folds(df, key, features, folds, models, work, resample, fit_rows=fit_rows)
