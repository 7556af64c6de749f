"""End-to-end plans: survey to features, features to results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.clean import (
    canonical_category,
    clean_reader_nulls,
    clean_unknowns,
    damage_label,
    finite,
    parse_ef,
    status_label,
    string_columns,
    to_numeric,
)
from tabulon.functions.geo import segment_distance_km
from tabulon.functions.hashing import add_noise
from tabulon.functions.ratios import geometric_ratios
from tabulon.operators.columns import FeatureSet, add_missing_flag, all_null_columns, existing
from tabulon.operators.encode import (
    encode_label,
    impute_iterative,
    impute_median,
    ordinal_encode,
)
from tabulon.operators.evaluate import class_f1, fold_scores
from tabulon.operators.folds import repeated_folds
from tabulon.operators.importance import compare_ranks, mean_importance, permutation_importance
from tabulon.operators.models import Fit, Resampler, fit_predict, random_forest
from tabulon.session import materialize
from tabulon.sources import normalize_columns, union_sources, with_source

TRACK = ("tornado_start_lat", "tornado_start_long", "tornado_end_lat", "tornado_end_long")


def load_survey(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Unite raw text tables: plain names, source tag, unknown words as null."""
    tagged = [with_source(normalize_columns(df), name) for name, df in sources.items()]
    return clean_unknowns(clean_reader_nulls(union_sources(*tagged)))


def engineer(df: DataFrame, key: str, numeric: Sequence[str], categorical: Sequence[str], method: str = "haversine",
             ratios: bool = True) -> DataFrame:
    """Typed columns, labels, rating, distance, noise probe and ratios.

    Everything is a column expression, so the plan up to here is one scan.
    """
    place = existing(("latitude", "longitude", *TRACK), df)
    numbers = existing([c for c in numeric if c not in ("distance_km", "random_noise")], df)
    text = set(string_columns(df))
    typed = {c: to_numeric(c) if c in text else finite(F.col(c).cast("double"))
             for c in dict.fromkeys([*numbers, *place, *existing(["degree_of_damage_u"], df)])}
    typed |= {c: canonical_category(c) for c in existing(categorical, df)}
    out = df.withColumns(typed)
    made = {}
    if "degree_of_damage_u" in df.columns:
        made["target"] = damage_label("degree_of_damage_u")
    if "status_u" in df.columns:
        made["status_target"] = status_label("status_u")
    if "tornado_ef" in df.columns:
        made["ef_numeric"] = parse_ef("tornado_ef").cast("double")
    if len(place) == 6:
        made["distance_km"] = segment_distance_km("latitude", "longitude", *TRACK, method=method)
    out = add_noise(out.withColumns(made), key)
    shape = {"buidling_height_m", "wall_length_front", "wall_length_side", "building_area_m2", "wall_thickness",
             "parapet_height_m"}
    return geometric_ratios(out) if ratios and shape <= set(df.columns) else out


@dataclass(frozen=True)
class Prepared:
    """Numeric matrix with a coded label, ready for folds and models."""

    table: DataFrame
    features: list[str]
    numeric: list[str]
    categorical: list[str]
    classes: list[str]

    @property
    def resampler(self) -> Resampler:
        return Resampler(tuple(self.numeric), tuple(self.categorical))


def prepare(df: DataFrame, key: str, features: FeatureSet, strategy: str = "median",
            flags: Sequence[str] = ()) -> Prepared:
    """Drop unlabelled rows and empty columns, impute, encode, write once.

    ``strategy``: ``median`` (exact median, null as a level), ``iterative``
    (chained equations over numbers and codes) or ``indicator`` (median plus
    missing flags for ``flags``).
    """
    fs = features.on(df)
    rows = materialize(df.na.drop(subset=[fs.label]).select(key, fs.label, *fs.all), "labelled")
    empty = set(all_null_columns(rows, list(fs.numbers))) if fs.numbers else set()
    numbers = [c for c in fs.numbers if c not in empty]
    cats = list(fs.categorical)
    rows = rows.drop(*empty)
    if strategy == "indicator":
        rows = add_missing_flag(rows, list(flags))
    rows, classes = encode_label(rows, fs.label)
    if strategy == "iterative":
        rows, _ = ordinal_encode(rows, cats, keep_null=True)
        rows = impute_iterative(rows, numbers + cats, codes=cats)
    else:
        rows, _ = impute_median(rows, numbers, stored=True)
        rows, _ = ordinal_encode(rows, cats)
    if strategy == "indicator":
        made = [f"{c}_is_missing" for c in flags]
        rows = rows.withColumns({c: F.col(c).cast("double") for c in made})
        cats = cats + made
    table = materialize(rows.select(key, "label", *numbers, *cats), "prepared")
    return Prepared(table, numbers + cats, numbers, cats, classes)


def cross_validate(prep: Prepared, key: str, models: Mapping[str, Fit], k: int = 5, repeats: int = 5,
                   setting: str = "Distance", resample: bool = True, seed: int = 42,
                   fit_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Fold scores and predictions of every model on the same folds; ``fit_rows`` bounds the rows of a fit only."""
    folds = materialize(repeated_folds(prep.table, key, "label", k, repeats, seed), "folds")
    pred = fit_predict(prep.table, key, prep.features, folds, models, prep.resampler if resample else None, setting, fit_rows)
    pred = materialize(pred, "predictions")
    return fold_scores(pred, ["Setting", "Model", "Fold"]), pred


def smote_ablation(prep: Prepared, key: str, cls: str, fit: Fit | None = None, k: int = 5, repeats: int = 5,
                   neighbors: int = 3, seed: int = 42) -> DataFrame:
    """Macro F1 and the F1 of one class, with and without over-sampling."""
    fit = fit or random_forest(100, 1)
    folds = materialize(repeated_folds(prep.table, key, "label", k, repeats, seed), "folds")
    code = float(prep.classes.index(cls))
    with_ = Resampler(tuple(prep.numeric), tuple(prep.categorical), neighbors)
    parts = [fit_predict(prep.table, key, prep.features, folds, {"RandomForest": fit}, r, name)
             for name, r in (("with", with_), ("without", None))]
    pred = materialize(parts[0].unionByName(parts[1]), "ablation")
    macro = fold_scores(pred, ["Setting", "Fold"])
    one = class_f1(pred, code, ["Setting", "Fold"])
    return macro.join(one, ["Setting", "Fold"]).groupBy("Setting").agg(
        F.avg("MacroF1").alias("macro_f1"), F.avg("class_f1").alias("class_f1"))


def missingness_sensitivity(df: DataFrame, key: str, features: FeatureSet, flags: Sequence[str],
                            fit: Fit | None = None, k: int = 5, seed: int = 42) -> DataFrame:
    """Importance scores and ranks under three ways to treat missing values."""
    fit = fit or random_forest(100, 2)
    series = {}
    for name, strategy in (("baseline", "median"), ("iterative", "iterative"), ("indicator", "indicator")):
        prep = prepare(df, key, features, strategy, flags)
        folds = materialize(repeated_folds(prep.table, key, "label", k, 1, seed), "folds")
        imp = permutation_importance(prep.table, key, prep.features, folds, {"RandomForest": fit}, prep.resampler)
        series[name] = materialize(mean_importance(imp), f"importance-{name}")
    return compare_ranks(series)
