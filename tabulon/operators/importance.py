"""Permutation importance, guardrails, elimination and rank comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial, reduce

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.operators.encode import assemble
from tabulon.operators.evaluate import fold_scores
from tabulon.operators.folds import stratified_folds, with_partner
from tabulon.operators.models import Fit, Resampler, map_folds
from tabulon.operators.ordering import list_rank, top_k
from tabulon.operators.resample import smotenc
from tabulon.session import materialize, side_by_side


def permutation_scores(model, held: DataFrame, key: str, features: Sequence[str], metric: str = "accuracy",
                       seed: int = 42) -> DataFrame:
    """Score lost per feature when its column is shuffled: ``(Feature, Decrease)``.

    Every feature has a permutation of its own.  A scored copy of a row takes
    a single feature from that feature's partner row, so all features (and the
    untouched baseline) go through the model in one job.
    """
    names = list(features)
    rows = held.select(key, "label", F.array(*[F.col(f).cast("double") for f in names]).alias("x"))
    cells = rows.select(key, F.posexplode("x").alias("swap", "v"))
    partners = with_partner(cells, key, ["v"], ["swap"], seed, own=True).groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("swap", "v_perm"))).alias("p"))
    mixed = rows.join(partners, key).withColumn("x_perm", F.col("p.v_perm"))
    copies = mixed.withColumn("swap", F.explode(F.sequence(F.lit(-1), F.lit(len(names) - 1))))
    swapped = F.transform("x", lambda v, i: F.when(i == F.col("swap"), F.col("x_perm")[i]).otherwise(v))
    scored = model.transform(copies.withColumn("features", array_to_vector(swapped)))
    pred = scored.select("swap", F.col("label").alias("y"), F.col("prediction").alias("yhat"))
    if metric == "accuracy":
        scores = pred.groupBy("swap").agg(F.avg((F.col("y") == F.col("yhat")).cast("double")).alias("s"))
    elif metric == "macro_f1":
        scores = fold_scores(pred, ["swap"]).select("swap", F.col("MacroF1").alias("s"))
    else:
        raise ValueError(f"unknown metric {metric!r}")
    # One row per feature from here on.
    wide = scores.agg(F.map_from_entries(F.collect_list(F.struct("swap", "s"))).alias("m"))
    rows = F.array(*[F.struct(F.lit(f).alias("Feature"), (F.col("m")[-1] - F.col("m")[i]).alias("Decrease"))
                     for i, f in enumerate(names)])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def permutation_importance(df: DataFrame, key: str, features: Sequence[str], folds: DataFrame,
                           models: Mapping[str, Fit], resample: Resampler | None = None, setting: str = "default",
                           metric: str = "accuracy", seed: int = 42) -> DataFrame:
    def work(fold: int, name: str, model, held: DataFrame) -> DataFrame:
        return permutation_scores(model, held, key, features, metric, seed + fold).select(
            F.lit(setting).alias("Setting"), F.lit(name).alias("Model"), "Feature", F.lit(fold).alias("Fold"),
            F.col("Decrease").alias("Decrease_in_Accuracy"))

    return map_folds(df, key, features, folds, models, work, resample)


def mean_importance(importance: DataFrame, value: str = "Decrease_in_Accuracy",
                    keys: Sequence[str] = ()) -> DataFrame:
    return importance.groupBy(*keys, "Feature").agg(F.avg(value).alias("Mean"))


def keep_equivalent(importance: DataFrame, stats: DataFrame, level: float = 0.05, p: str = "p_value") -> DataFrame:
    """Rows of the best model of each setting and of those it does not beat."""
    best = stats.select("Setting", F.col("Best_Model").alias("Model"))
    equal = stats.filter(F.col(p) > level).select("Setting", "Model")
    return importance.join(best.unionByName(equal), ["Setting", "Model"], "left_semi")


def above_noise(importance: DataFrame, noise: str = "random_noise", value: str = "Decrease_in_Accuracy") -> DataFrame:
    """Rows of features that beat the noise probe and zero in some model."""
    means = mean_importance(importance, value, ["Setting", "Model"])
    probe = means.filter(F.col("Feature") == noise).select("Setting", "Model", F.col("Mean").alias("noise_mean"))
    good = means.join(probe, ["Setting", "Model"]).filter(
        (F.col("Mean") > F.col("noise_mean")) & (F.col("Mean") > 0) & (F.col("Feature") != noise))
    return importance.join(good.select("Setting", "Feature"), ["Setting", "Feature"], "left_semi")


def _eliminate(train: DataFrame, features: Sequence[str], fit: Fit, step: int, down_to: int = 1):
    """Yield ``(kept features, model)`` while the weakest ones are dropped."""
    kept = list(features)
    while True:
        model = fit(assemble(train, kept).select("label", "features"))
        yield list(kept), model
        if len(kept) <= down_to:
            return
        weights = model.featureImportances.toArray()
        order = sorted(range(len(kept)), key=lambda i: (weights[i], kept[i]))
        gone = {kept[i] for i in order[: min(step, len(kept) - down_to)]}
        kept = [f for f in kept if f not in gone]


def rfecv(df: DataFrame, key: str, features: Sequence[str], fit: Fit, cv: int = 3, step: int = 1,
          seed: int = 42, resample: Resampler | None = None) -> DataFrame:
    """Recursive elimination; the number of features is chosen by macro F1.

    Returns ``(Feature, Ranking, Support, Best_Score)``; rank 1 is kept.  With
    ``resample`` the rows are over-sampled first, as the original study does
    with the training part of one split; synthetic rows get keys of their own.
    """
    if resample is not None:
        num, cat = ([c for c in features if c in part] for part in (resample.numeric, resample.categorical))
        more = smotenc(df.select(key, "label", *features), key, "label", num, cat, resample.k, resample.seed,
                       few=resample.few, digest="__digest")
        df = more.withColumn(key, F.coalesce(F.col(key).cast("string"), F.concat(F.lit("synthetic-"), "__digest")))
    folds = stratified_folds(df, key, "label", cv, seed)
    joined = materialize(df.select(key, "label", *features).join(folds, key), "rfe")

    def one(f: int) -> list[DataFrame]:
        train, held = joined.filter(F.col("fold") != f), joined.filter(F.col("fold") == f)
        return [model.transform(assemble(held, kept)).select(
            F.lit(len(kept)).alias("size"), F.lit(f).alias("fold"), F.col("label").alias("y"),
            F.col("prediction").alias("yhat")) for kept, model in _eliminate(train, features, fit, step)]

    parts = side_by_side([partial(one, f) for f in range(cv)])
    pred = reduce(DataFrame.unionByName, [p for some in parts for p in some])
    sizes = fold_scores(pred, ["size", "fold"]).groupBy("size").agg(F.avg("MacroF1").alias("score")).collect()
    best = min(sizes, key=lambda r: (-round(r["score"], 12), r["size"]))
    ranking = {}
    last = None
    for kept, _ in _eliminate(joined, features, fit, step, best["size"]):
        if last is not None:
            ranking = {f: r + 1 for f, r in ranking.items()}
            ranking.update({f: 2 for f in last if f not in kept})
        last = kept
    ranking.update({f: 1 for f in last})
    rows = [(f, ranking[f], ranking[f] == 1, float(best["score"])) for f in features]
    return df.sparkSession.createDataFrame(rows, "Feature string, Ranking int, Support boolean, Best_Score double")


def align(series: Mapping[str, DataFrame], key: str, value: str) -> DataFrame:
    """Full outer alignment of named series on a key; gaps stay null."""
    out = None
    for name, df in series.items():
        part = df.select(key, F.col(value).alias(name))
        out = part if out is None else out.join(part, key, "full_outer")
    return out


def compare_ranks(series: Mapping[str, DataFrame], key: str = "Feature", value: str = "Mean") -> DataFrame:
    """Scores of several runs side by side, with average descending ranks.

    One row per feature: as many as a table has columns.
    """
    out = align({f"{n}_score": d for n, d in series.items()}, key, value)
    for n in series:
        out = out.withColumn(f"{n}_rank", list_rank(f"{n}_score"))
    return out


def lookup(df: DataFrame, ref: DataFrame, key: str, value: str, default) -> DataFrame:
    """Left join with a default for keys the reference table lacks."""
    return df.join(ref.select(key, value), key, "left").na.fill({value: default})


def common_features(a: DataFrame, b: DataFrame, key: str = "Feature", exclude: Sequence[str] = ()) -> DataFrame:
    both = a.select(key).intersect(b.select(key))
    return both.filter(~F.col(key).isin(*exclude)) if exclude else both


def distinct_features(df: DataFrame, key: str = "Feature", without: DataFrame | None = None) -> DataFrame:
    """Names that occur, minus those of another table."""
    names = df.select(key).distinct()
    return names if without is None else names.exceptAll(without.select(key).distinct())


def compare_rankings(mean_perm: DataFrame, rfe: DataFrame, k: int = 10) -> DataFrame:
    """Features in the permutation top ``k`` that elimination kept."""
    best = top_k(mean_perm, [F.desc("Mean"), F.asc("Feature")], k).select("Feature")
    return best.intersect(rfe.filter("Support").select("Feature"))


def feature_pairs(features: DataFrame, col: str = "Feature", limit: int = 5_000) -> DataFrame:
    """Unordered pairs of the names in a column, without a join.

    Names are columns of a table, so their number is checked, not assumed.
    """
    names = features.select(col).distinct()
    n = names.count()
    if n > limit:
        raise ValueError(f"{n} names are no feature list")
    every = names.agg(F.array_sort(F.collect_list(col)).alias("all"))
    first = every.select("all", F.posexplode("all").alias("i", "feature_1"))
    return first.select("feature_1", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("feature_2"))
