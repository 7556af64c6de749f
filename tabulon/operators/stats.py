"""Rank tests, rank correlation, multiple testing, tiers."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from tabulon.operators.ordering import prefix_sums, value_places

EXACT_SIGNED_RANK = 50
EXACT_RANK_SUM = 8


# ---- p-values: one call per tested group, never per row ----

def _signed_rank_counts(n: int) -> np.ndarray:
    """Number of sign patterns of 1..n for each possible rank sum."""
    counts = np.zeros(n * (n + 1) // 2 + 1)
    counts[0] = 1
    for r in range(1, n + 1):
        counts[r:] = counts[r:] + counts[:-r].copy()
    return counts


def signed_rank_p(n: int, plus: float, ties: float, zeros: int) -> float:
    """Two-sided p of the signed-rank sum; exact for few, untied differences."""
    if n == 0:
        return 1.0
    total = n * (n + 1) / 2
    w = min(plus, total - plus)
    if n <= EXACT_SIGNED_RANK and ties == 0 and zeros == 0:
        counts = _signed_rank_counts(n)
        return float(min(1.0, 2 * counts[: int(round(w)) + 1].sum() / counts.sum()))
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    if var <= 0:
        return 1.0
    return math.erfc(abs(w - total / 2) / math.sqrt(2 * var))


def _rank_sum_counts(n1: int, n2: int) -> np.ndarray:
    """Ways to reach each U value: choose n1 of n1 + n2 places."""
    ways = np.zeros(n1 * n2 + 1)
    ways[0] = 1
    for i in range(1, n1 + 1):  # times (1 - q^(n2 + i)), over (1 - q^i): a polynomial in q again
        ways[n2 + i:] -= ways[:-(n2 + i)].copy()
        for first in range(i):
            np.cumsum(ways[first::i], out=ways[first::i])
    return ways


def rank_sum_p(n1: int, n2: int, u1: float, ties: float) -> float:
    """Two-sided p of U; exact when one side is small and nothing is tied."""
    if not n1 or not n2:
        return float("nan")
    u = max(u1, n1 * n2 - u1)
    if min(n1, n2) <= EXACT_RANK_SUM and ties == 0:
        small, large = min(n1, n2), max(n1, n2)
        counts = _rank_sum_counts(small, large)
        return float(min(1.0, 2 * counts[int(math.ceil(u)):].sum() / counts.sum()))
    n = n1 + n2
    var = n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))
    if var <= 0:
        return 1.0
    return min(1.0, math.erfc((u - n1 * n2 / 2 - 0.5) / math.sqrt(2 * var)))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            c = 1.0 + step / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def correlation_p(r: float, n: int) -> float:
    """Two-sided p of a correlation from Student's t with n - 2 degrees."""
    if n < 3 or r is None or math.isnan(r):
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    t2 = r * r * df / (1 - r * r)
    return incomplete_beta(df / 2, 0.5, df / (df + t2))


@pandas_udf(DoubleType())
def _signed_rank_p(n: pd.Series, plus: pd.Series, ties: pd.Series, zeros: pd.Series) -> pd.Series:
    return pd.Series([signed_rank_p(int(a), float(b), float(c), int(d)) for a, b, c, d in zip(n, plus, ties, zeros)])


@pandas_udf(DoubleType())
def _rank_sum_p(n1: pd.Series, n2: pd.Series, u: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([rank_sum_p(int(a), int(b), float(c), float(d)) for a, b, c, d in zip(n1, n2, u, ties)])


@pandas_udf(DoubleType())
def _correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([correlation_p(a, int(b)) for a, b in zip(r, n)])


# ---- statistics ----

def signed_rank(df: DataFrame, keys: Sequence[str], a: str, b: str, short: bool = False) -> DataFrame:
    """Signed-rank statistic of paired columns per group.

    Equal absolute differences are counted together before they are ranked,
    so the ranking works on distinct values.  Zero differences are dropped.
    ``short`` says that a group is a short list, such as one score per fold;
    other groups may have any size.
    """
    keys = list(keys)
    d = df.withColumn("__d", F.col(a) - F.col(b)).filter(F.col("__d").isNotNull())
    sizes = d.groupBy(*keys, F.abs("__d").alias("__abs")).agg(
        F.count("*").alias("__all"), F.count_if(F.col("__d") > 0).alias("__plus")).withColumn(
        "__n", F.when(F.col("__abs") == 0, F.lit(0)).otherwise(F.col("__all")))
    if short:
        smaller = Window.partitionBy(*keys).orderBy("__abs").rowsBetween(Window.unboundedPreceding, -1)
        placed = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(smaller), F.lit(0)))
    else:
        placed = prefix_sums(sizes, keys, [F.col("__abs")], {"__before": "__n"})
    rank, n = F.col("__before") + (F.col("__n") + 1) / 2.0, F.col("__n").cast("double")
    sums = placed.groupBy(*keys).agg(
        F.sum("__n").alias("n"), (F.sum("__all") - F.sum("__n")).alias("zeros"),
        F.sum(rank * F.col("__plus")).alias("w_plus"),
        F.sum(rank * (F.col("__n") - F.col("__plus"))).alias("w_minus"), F.sum(n * n * n - n).alias("ties"))
    return sums.withColumn("w", F.least("w_plus", "w_minus"))


def wilcoxon(df: DataFrame, keys: Sequence[str], a: str, b: str, short: bool = False) -> DataFrame:
    stats = signed_rank(df, keys, a, b, short)
    return stats.withColumn("p_value", _signed_rank_p("n", "w_plus", "ties", "zeros")).select(
        *keys, "n", "w", "p_value")


def holm(df: DataFrame, p: str, by: Sequence[str] = (), out: str = "p_holm") -> DataFrame:
    """Step-down adjustment; the tests of a family are few rows."""
    family = Window.partitionBy(*by)
    order = family.orderBy(p)
    m = F.count(p).over(family)
    scaled = F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("__s", F.when(F.col(p).isNotNull(), scaled)).withColumn(
        out, F.max("__s").over(running)).drop("__s")


def model_equivalence(results: DataFrame, score: str = "MacroF1") -> DataFrame:
    """Test every model against the best one of its setting, paired by fold."""
    means = results.groupBy("Setting", "Model").agg(F.avg(score).alias("mean"))
    w = Window.partitionBy("Setting").orderBy(F.desc("mean"), F.asc("Model"))
    best = means.withColumn("r", F.row_number().over(w)).filter("r = 1").select(
        "Setting", F.col("Model").alias("Best_Model"), F.col("mean").alias("best_mean"))
    best_scores = results.join(best, "Setting").filter(F.col("Model") == F.col("Best_Model")).select(
        "Setting", "Fold", "Best_Model", F.col(score).alias("best_score"))
    others = results.select("Setting", "Model", "Fold", F.col(score).alias("score"))
    pairs = others.join(best_scores, ["Setting", "Fold"]).filter(F.col("Model") != F.col("Best_Model"))
    tested = wilcoxon(pairs, ["Setting", "Model", "Best_Model"], "best_score", "score", short=True)
    diff = means.join(best, "Setting").select("Setting", "Model", (F.col("best_mean") - F.col("mean")).alias("Diff_Mean"))
    joined = tested.join(diff, ["Setting", "Model"]).select("Setting", "Model", "Best_Model", "p_value", "Diff_Mean")
    return holm(joined, "p_value", ["Setting"])


def significant(p: str = "p_value", level: float = 0.05):
    return F.col(p) < level


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with p, over rows where both values are present.

    Equal pairs are counted first; each column's ranks are read from its rows in
    range order, and centred before they are multiplied, which keeps the sums
    exact enough.
    """
    pairs = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).groupBy("x", "y").agg(
        F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("n")).filter("n > 0")
    rank = F.col("before") + (F.col("equal") + 1) / 2.0
    ranked = value_places(pairs, "x", weight="n").select("x", "y", "n", rank.alias("r_x"))
    ranked = value_places(ranked, "y", weight="n").select("n", "r_x", rank.alias("r_y"), "total")
    middle = (F.col("total") + 1) / 2.0
    rx, ry, n = F.col("r_x") - middle, F.col("r_y") - middle, F.col("n")
    sums = ranked.agg(F.sum(n).alias("n"), F.sum(n * rx * ry).alias("xy"),
                      F.sum(n * rx * rx).alias("xx"), F.sum(n * ry * ry).alias("yy"))
    rho = F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy")))
    return sums.select("n", rho.alias("rho")).withColumn("p_value", _correlation_p("rho", "n"))


def rank_sum(df: DataFrame, group: str, value: str, first: str, second: str) -> DataFrame:
    """U statistic of two named groups from counted values."""
    sizes = df.filter(F.col(group).isin(first, second)).groupBy(value).agg(
        F.count(value).alias("__n"), F.count_if(F.col(group) == first).alias("__a")).filter("__n > 0")
    placed = prefix_sums(sizes, [], [F.col(value)], {"__before": "__n"})
    rank = F.col("__before") + (F.col("__n") + 1) / 2.0
    n = F.col("__n").cast("double")
    sums = placed.agg(F.sum("__a").alias("n1"), (F.sum("__n") - F.sum("__a")).alias("n2"),
                      F.sum(rank * F.col("__a")).alias("r1"), F.sum(n * n * n - n).alias("ties"))
    u1 = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0
    return sums.withColumn("u1", u1).withColumn("u2", F.col("n1") * F.col("n2") - F.col("u1"))


def mann_whitney(df: DataFrame, group: str, value: str, first: str, second: str) -> DataFrame:
    stats = rank_sum(df, group, value, first, second)
    return stats.select("n1", "n2", "u1", _rank_sum_p("n1", "n2", "u1", "ties").alias("p_value"))


def feature_tiers(importance: DataFrame, value: str = "Decrease_in_Accuracy", by: Sequence[str] = ("Setting", "Model"),
                  max_pairs: int = 20, level: float = 0.05) -> DataFrame:
    """Features in order of mean importance, cut into tiers where a feature
    differs from the next one over the folds.

    Windows run over one row per feature.
    """
    by = list(by)
    means = importance.groupBy(*by, "Feature").agg(F.avg(value).alias("Mean"))
    order = Window.partitionBy(*by).orderBy(F.desc("Mean"), F.asc("Feature"))
    listed = means.withColumn("Position", F.row_number().over(order)).filter(F.col("Position") <= max_pairs + 1)
    here = importance.join(listed, [*by, "Feature"]).select(*by, "Fold", "Position", F.col(value).alias("here"))
    above = here.select(*by, "Fold", (F.col("Position") + 1).alias("Position"), F.col("here").alias("above"))
    tested = wilcoxon(here.join(above, [*by, "Fold", "Position"]), [*by, "Position"], "above", "here", short=True)
    tiers = listed.join(tested.select(*by, "Position", "p_value"), [*by, "Position"], "left")
    running = Window.partitionBy(*by).orderBy("Position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = F.coalesce((F.col("p_value") < level).cast("int"), F.lit(0))
    return tiers.withColumn("Tier", F.sum(cut).over(running) + 1).select(
        *by, "Position", "Feature", "Mean", "p_value", "Tier")
