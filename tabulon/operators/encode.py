"""Encoders, imputers, class weights and the feature vector."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.operators.gram import masked_grams, pattern_grams
from tabulon.operators.ordering import prefix_sums
from tabulon.session import discard, materialize

NULL_LEVEL = "nan"
MAX_LEVELS = 10_000
MAX_ONE_HOT = 1_000
MAX_PATTERNS = 4_096  # patterns of gaps whose moments fit the driver and a task


def check_levels(df: DataFrame, cols: Sequence[str], limit: int = MAX_LEVELS) -> None:
    """Levels end up in plans and on the driver, so their number is checked first."""
    if not cols:
        return
    sizes = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).first()
    wide = {c: sizes[c] for c in cols if sizes[c] > limit}
    if wide:
        raise ValueError(f"too many levels to encode: {wide}")


def fit_levels(df: DataFrame, cols: Sequence[str], keep_null: bool = False) -> dict[str, list[str]]:
    """Alphabetical levels per column; null is the level ``nan`` unless kept."""
    cols = list(cols)
    if not cols:
        return {}
    check_levels(df, cols)
    text = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    if not keep_null:
        text = text.na.fill(NULL_LEVEL)
    model: StringIndexerModel = StringIndexer(
        inputCols=cols, outputCols=[f"__{c}" for c in cols],
        stringOrderType="alphabetAsc", handleInvalid="skip").fit(text)
    return {c: list(labels) for c, labels in zip(cols, model.labelsArray)}


def with_codes(df: DataFrame, texts: Mapping[str, Column], levels: Mapping[str, Sequence[str]],
               unseen: float | None = -1.0) -> DataFrame:
    """Add code columns for text columns; a level the fit did not see, or null,
    gets ``unseen``.

    The indexer looks a level up in a hash table.  Its output carries nominal
    metadata, which would make trees split on category sets, so the codes are
    copied to plain doubles.
    """
    known = {c: list(levels[c]) for c in texts if len(levels[c])}
    out = df.withColumns({f"__t_{c}": t for c, t in texts.items()})
    if known:
        model = StringIndexerModel.from_arrays_of_labels(
            list(known.values()), inputCols=[f"__t_{c}" for c in known], outputCols=[f"__k_{c}" for c in known],
            handleInvalid="keep")
        out = model.transform(out)
    missing = F.lit(unseen).cast("double")
    codes = {c: F.when(F.col(f"__k_{c}") < len(known[c]), F.col(f"__k_{c}") + 0.0).otherwise(missing)
             if c in known else missing for c in texts}
    return out.withColumns(codes).drop(*[f"__t_{c}" for c in texts], *[f"__k_{c}" for c in known])


def encode_label(df: DataFrame, label: str, out: str = "label",
                 levels: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    levels = list(levels) if levels is not None else fit_levels(df, [label], keep_null=True)[label]
    return with_codes(df, {out: F.col(label)}, {out: levels}, None), levels


def ordinal_encode(df: DataFrame, cols: Sequence[str], levels: Mapping[str, Sequence[str]] | None = None,
                   keep_null: bool = False) -> tuple[DataFrame, dict[str, list[str]]]:
    """Alphabetical codes as plain doubles; null is a level unless kept."""
    levels = dict(levels) if levels is not None else fit_levels(df, cols, keep_null)
    if not cols:
        return df, levels
    empty = {c: F.col(c).isNull() for c in cols}
    texts = {c: F.coalesce(F.col(c).cast("string"), F.lit(NULL_LEVEL)) for c in cols}
    if keep_null:
        df = df.withColumns({f"__null_{c}": e for c, e in empty.items()})
    out = with_codes(df, texts, levels)
    if keep_null:
        out = out.withColumns({c: F.when(~F.col(f"__null_{c}"), F.col(c)) for c in cols}).drop(
            *[f"__null_{c}" for c in cols])
    return out, levels


@dataclass(frozen=True)
class OneHot:
    """Columns made by ``one_hot`` and the feature each one comes from."""

    levels: dict[str, list[str]]

    @property
    def parents(self) -> dict[str, str]:
        return {f"{c}_{v}": c for c, vs in self.levels.items() for v in vs[1:]}

    @property
    def columns(self) -> list[str]:
        return list(self.parents)


def one_hot(df: DataFrame, cols: Sequence[str], levels: Mapping[str, Sequence[str]] | None = None
            ) -> tuple[DataFrame, OneHot]:
    """0/1 column ``<feature>_<level>`` per level but the first."""
    if levels is None:
        check_levels(df, cols, MAX_ONE_HOT)
        levels = fit_levels(df, cols)
    levels = dict(levels)
    hot = OneHot({c: list(levels[c]) for c in cols})
    made = {}
    for c in cols:
        text = F.coalesce(F.col(c).cast("string"), F.lit(NULL_LEVEL))
        for v in hot.levels[c][1:]:
            made[f"{c}_{v}"] = (text == v).cast("double")
    return (df.withColumns(made) if made else df).drop(*cols), hot


def medians(df: DataFrame, cols: Sequence[str], stored: bool = False, accuracy: int = 10_000) -> DataFrame:
    """Exact medians of many columns at once; columns without values are left out.

    As in ``exact_quantiles``, a sketch brackets each median, the rows below
    are counted, and only values inside a bracket are unfolded and ordered.
    Brackets are two numbers per column.
    """
    cols = list(cols)
    wide = (df if stored else materialize(df.select(*cols), "columns")).select(
        *[F.col(c).cast("double").alias(c) for c in cols])
    reach = 4.0 / accuracy
    sketch = wide.agg(*[e for i, c in enumerate(cols) for e in (
        F.count(c).alias(f"n{i}"), F.percentile_approx(c, [0.5 - reach, 0.5 + reach], accuracy).alias(f"q{i}"))]).first()
    total = {c: sketch[f"n{i}"] for i, c in enumerate(cols) if sketch[f"n{i}"]}
    bracket = {c: tuple(sketch[f"q{i}"]) if total[c] > accuracy else (float("-inf"), float("inf"))
               for i, c in enumerate(cols) if c in total}
    if not total:
        return df.sparkSession.createDataFrame([], "column string, median double")
    below = wide.agg(*[F.count_if(F.col(c) < lo).alias(f"b{i}") for i, (c, (lo, _)) in enumerate(bracket.items())]).first()
    inside = F.array(*[F.struct(F.lit(c).alias("column"), F.when(F.col(c).between(lo, hi), F.col(c)).alias("value"))
                       for c, (lo, hi) in bracket.items()])
    values = wide.select(F.explode(F.filter(inside, lambda v: v["value"].isNotNull())).alias("v")).select("v.*")
    cells = values.groupBy("column", "value").agg(F.count("*").alias("n"))
    placed = prefix_sums(cells, ["column"], [F.col("value")], {"before": "n"})
    known = F.create_map(*[F.lit(x) for i, c in enumerate(bracket) for x in (
        c, F.struct(F.lit(total[c]).alias("rows"), F.lit(below[f"b{i}"]).alias("below")))])[F.col("column")]
    start, last = F.col("before") + known["below"], known["rows"] - 1
    picks = [F.max(F.when((start <= at) & (at < start + F.col("n")), F.col("value")))
             for at in (F.floor(last / 2), F.ceil(last / 2))]
    return placed.groupBy("column").agg(((picks[0] + picks[1]) / 2).alias("median"))


def impute_median(df: DataFrame, cols: Sequence[str], fitted: Mapping[str, float] | None = None,
                  stored: bool = False) -> tuple[DataFrame, dict[str, float]]:
    """Fill nulls by the column's median, one number per column."""
    if fitted is None:
        fitted = {r["column"]: r["median"] for r in medians(df, cols, stored).collect()}
    empty = [c for c in cols if c not in fitted]
    if empty:
        raise ValueError(f"columns without any value: {empty}; drop them first")
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(fitted[c])) for c in cols}), dict(fitted)


def impute_const(df: DataFrame, cols: Sequence[str], value: str = "missing") -> DataFrame:
    return df.na.fill(value, list(cols))


def _evidence_ridge(gram: np.ndarray, target: int, others: list[int], rounds: int = 300, tol: float = 1e-3):
    """Bayesian ridge from second moments: weights and intercept.

    ``gram`` holds sums of products of (1, columns) over the rows where the
    target is known.  Precisions are set by evidence maximisation.
    """
    n = gram[0, 0]
    idx = np.array(others) + 1
    y = target + 1
    mx, my = gram[0, idx] / n, gram[0, y] / n
    xx = gram[np.ix_(idx, idx)] - n * np.outer(mx, mx)
    xy = gram[idx, y] - n * mx * my
    yy = gram[y, y] - n * my * my
    eig, vec = np.linalg.eigh(xx)
    eig = np.clip(eig, 0, None)
    proj = vec.T @ xy
    hyper = 1e-6
    alpha, lam = 1.0 / (yy / n + np.finfo(float).eps), 1.0
    weights = np.zeros(len(idx))
    for _ in range(rounds):
        before = weights
        weights = vec @ (proj * alpha / (lam + alpha * eig))
        rss = max(yy - 2 * weights @ xy + weights @ xx @ weights, 0.0)
        used = np.sum(alpha * eig / (lam + alpha * eig))
        lam = (used + 2 * hyper) / (weights @ weights + 2 * hyper)
        alpha = (n - used + 2 * hyper) / (rss + 2 * hyper)
        if np.sum(np.abs(before - weights)) < tol:
            break
    weights = vec @ (proj * alpha / (lam + alpha * eig))
    return weights, my - mx @ weights


def gap_pattern(cols: Sequence[str]) -> Column:
    """One character per column, 1 for a null."""
    return F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in cols])


def chained_maps(grams: Mapping[str, np.ndarray], todo: Sequence[int], rounds: int) -> dict[str, np.ndarray]:
    """Per pattern of gaps the linear map from (1, known columns) to the filled row.

    A filled row is linear in its known values, so the moments of the filled
    table follow from the moments of each pattern: filling column j replaces
    row and column j of the moments of the patterns that lack it.  All rounds
    run on these matrices.  ``todo`` lists columns in the order they are filled.
    """
    names = list(grams)
    moments = np.array([grams[n] for n in names])
    gaps = np.array([[c == "1" for c in n] for n in names])
    size = moments.shape[1]
    maps = np.tile(np.eye(size), (len(names), 1, 1))
    maps[:, 1:][gaps] = 0.0  # gaps start at the column mean, which is the centre
    before = None
    for _ in range(rounds):
        equations = np.zeros((len(todo), size))
        for at, j in enumerate(todo):
            others = [i for i in range(size - 1) if i != j]
            weights, shift = _evidence_ridge(moments[~gaps[:, j]].sum(axis=0), j, others)
            equation = equations[at]
            equation[0], equation[np.array(others, int) + 1] = shift, weights
            lacking = np.flatnonzero(gaps[:, j])
            row = moments[lacking] @ equation
            moments[lacking, j + 1, :] = row
            moments[lacking, :, j + 1] = row
            moments[lacking, j + 1, j + 1] = row @ equation
            maps[lacking, j + 1] = equation @ maps[lacking]
        if before is not None and np.allclose(equations, before, rtol=1e-6, atol=1e-12):
            break
        before = equations
    return dict(zip(names, maps))


def _fill_by_pattern(df: DataFrame, cols: list[str], patterns: Mapping[str, int], centre: list[float], todo: list[str],
                     rounds: int) -> DataFrame:
    """Both passes of ``refit="pattern"``: moments per pattern, then one map per row."""
    maps = chained_maps(pattern_grams(df, cols, centre), [cols.index(c) for c in todo], rounds)
    rows = [(p, [maps[p][cols.index(c) + 1].tolist() for c in todo]) for p in patterns if "1" in p]
    table = df.sparkSession.createDataFrame(rows, "__pattern string, __maps array<array<double>>")
    known = F.array(F.lit(1.0), *[F.coalesce(F.col(c).cast("double") - F.lit(m), F.lit(0.0)) for c, m in zip(cols, centre)])
    joined = df.withColumn("__pattern", gap_pattern(cols)).join(F.broadcast(table), "__pattern", "left").withColumn("__known", known)

    def filled(at: int, c: str) -> Column:
        products = F.zip_with("__known", F.col("__maps")[at], lambda a, b: a * b)
        guess = F.aggregate(products, F.lit(0.0), lambda a, b: a + b) + F.lit(centre[cols.index(c)])
        return F.when(F.col(c).isNull(), guess).otherwise(F.col(c).cast("double"))

    made = {c: F.col(c).cast("double") for c in cols} | {c: filled(i, c) for i, c in enumerate(todo)}
    return joined.select(*[made.get(c, F.col(c)).alias(c) for c in df.columns])


def impute_iterative(df: DataFrame, cols: Sequence[str], rounds: int = 10, codes: Sequence[str] = (),
                     refit: str = "pattern") -> DataFrame:
    """Chained-equation imputation of a numeric matrix.

    Nulls start at the column mean.  In a round the columns are filled one after
    the other, fewest nulls first, each from the newest values of the others, by
    an equation that is fitted to those newest values.  The table is read three
    times, whatever the rounds: rows per pattern of gaps, moments per pattern,
    and the final map of each row.  Beyond ``MAX_PATTERNS`` patterns, or with
    ``refit="column"``, every equation takes a pass and a write of its own; the
    numbers are the same.  With ``"round"`` all equations of a round are fitted
    in one pass, to the values at its start, and settle at the same ones.  The
    matrices are solved on the driver (columns by columns in size, whatever the
    number of rows).  Rounds end early when no equation moves any more.
    ``codes`` are rounded half to even at the end.
    """
    if refit not in ("pattern", "column", "round"):
        raise ValueError("refit is pattern, column or round")
    cols = list(cols)
    counted = df.groupBy(gap_pattern(cols).alias("p")).agg(F.count("*").alias("n"), *[
        F.sum(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]).limit(MAX_PATTERNS + 1).collect()
    if len(counted) <= MAX_PATTERNS:
        gaps = {c: sum(r["n"] for r in counted if r["p"][i] == "1") for i, c in enumerate(cols)}
        known = {c: sum(r["n"] for r in counted) - gaps[c] for c in cols}
        means = {c: math.fsum(r[f"s{i}"] or 0.0 for r in counted) / known[c] if known[c] else None for i, c in enumerate(cols)}
    else:
        first = df.agg(*[F.avg(c).alias(c) for c in cols], *[F.count_if(F.col(c).isNull()).alias(f"n__{c}") for c in cols]).first()
        means, gaps = {c: first[c] for c in cols}, {c: first[f"n__{c}"] for c in cols}
        refit = "column" if refit == "pattern" else refit
    todo = sorted((c for c in cols if gaps[c] > 0), key=lambda c: (gaps[c], cols.index(c)))
    if not todo:
        return df
    if any(means[c] is None for c in cols):
        raise ValueError("a column without any value cannot be imputed")
    centre = [float(means[c]) for c in cols]
    if refit == "pattern":
        out = _fill_by_pattern(df, cols, {r["p"]: r["n"] for r in counted}, centre, todo, rounds)
        return out.withColumns({c: F.bround(F.col(c), 0) for c in codes}) if codes else out
    work = df.withColumns({f"__m_{c}": F.col(c).isNull() for c in todo})
    work = work.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in zip(cols, centre)})
    work = materialize(work, "impute")
    before = None
    for _ in range(rounds):
        grams = masked_grams(work, cols, {c: f"__m_{c}" for c in todo}, centre) if refit == "round" else {}
        old = work
        equations = np.zeros((len(todo), len(cols) + 1))
        for at, c in enumerate(todo):
            j = cols.index(c)
            others = [i for i in range(len(cols)) if i != j]
            if refit == "column":
                grams = masked_grams(work, cols, {c: f"__m_{c}"}, centre)
            weights, shift = _evidence_ridge(grams[c], j, others)
            equations[at, others], equations[at, -1] = weights, shift
            guess = sum((F.lit(float(w)) * (F.col(cols[i]) - F.lit(centre[i])) for w, i in zip(weights, others)),
                        F.lit(float(centre[j] + shift)))
            work = work.withColumn(c, F.when(F.col(f"__m_{c}"), guess).otherwise(F.col(c)))
            if refit == "column":
                work = materialize(work, "impute")
                discard(old)
                old = work
        if refit == "round":
            work = materialize(work, "impute")
            discard(old)
        if before is not None and np.allclose(equations, before, rtol=1e-6, atol=1e-12):
            break
        before = equations
    work = work.drop(*[f"__m_{c}" for c in todo])
    if codes:
        work = work.withColumns({c: F.bround(F.col(c), 0) for c in codes})
    return work


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (classes x class size), from class counts only."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("rows"), F.count("*").alias("classes"))
    rows, classes = totals.select("rows").scalar(), totals.select("classes").scalar()
    return counts.withColumn("weight", rows / (classes * F.col("n")))


def add_class_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Weight column as an expression: one short query for the class counts."""
    sizes = df.groupBy(label).agg(F.count("*").alias("n")).limit(MAX_LEVELS + 1).collect()
    if len(sizes) > MAX_LEVELS:
        raise ValueError("too many classes")
    counts = {r[label]: r["n"] for r in sizes}
    rows = sum(counts.values())
    weight = F.lit(None).cast("double")
    for value, n in counts.items():
        weight = F.when(F.col(label).eqNullSafe(F.lit(value)), rows / (len(counts) * n)).otherwise(weight)
    return df.withColumn(out, weight)


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """Feature vector in the given order, from fresh doubles."""
    return df.withColumn(out, array_to_vector(F.array(*[F.col(c).cast("double") for c in features])))
