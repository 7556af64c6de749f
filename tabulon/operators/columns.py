"""Column lists, feature sets, null columns and indicators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.ratios import RATIOS, FENESTRATION

# Survey columns by role, spelled as in the survey.
NUMERIC = (
    "number_stories", "year_built_u", "building_area_m2", "buidling_height_m", "wall_length_side",
    "wall_length_front", "wall_thickness", "parapet_height_m", "overhang_length_u", "random_noise",
    "distance_km", *FENESTRATION,
)
CATEGORICAL = (
    "archetype", "occupany_u", "building_urban_setting", "building_position_on_street", "roof_shape_u",
    "roof_slope_u", "construction_type_u", "mwfrs_u_wall", "mwfrs_u_roof", "structural_wall_system_u",
    "foundation_type_u", "wall_substrate_u", "wall_cladding_u", "roof_system_u", "roof_substrate_type_u",
    "roof_cover_u", "retrofit_present_u", "retrofit_type_u",
)
HAZARD = ("ef_numeric",)


@dataclass(frozen=True)
class FeatureSet:
    name: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    hazard: tuple[str, ...] = ()
    label: str = "target"
    extra: dict = field(default_factory=dict, compare=False)

    @property
    def numbers(self) -> tuple[str, ...]:
        return self.numeric + self.hazard

    @property
    def all(self) -> tuple[str, ...]:
        return self.numbers + self.categorical

    def on(self, df: DataFrame) -> "FeatureSet":
        """The part of the set that the table has."""
        return replace(self, numeric=tuple(existing(self.numeric, df)),
                       categorical=tuple(existing(self.categorical, df)),
                       hazard=tuple(existing(self.hazard, df)))


def feature_set(name: str) -> FeatureSet:
    """Named settings; the name says what they hold."""
    numeric, categorical, hazard = drop_leaky(NUMERIC), drop_leaky(CATEGORICAL), drop_leaky(HAZARD)
    without_distance = tuple(c for c in numeric if c != "distance_km")
    sets = {
        "Hazard-Neutral": FeatureSet("Hazard-Neutral", without_distance, categorical),
        "Distance": FeatureSet("Distance", numeric, categorical),
        "Hazard-Inclusive": FeatureSet("Hazard-Inclusive", numeric, categorical, hazard),
        "Engineered": FeatureSet("Engineered", numeric + RATIOS, categorical),
        "Status-Target": FeatureSet("Status-Target", numeric + RATIOS, categorical, label="status_target"),
    }
    if name not in sets:
        raise ValueError(f"unknown feature set {name!r}; known: {sorted(sets)}")
    return sets[name]


def existing(cols: Sequence[str], df: DataFrame, strict: bool = False) -> list[str]:
    have = set(df.columns)
    missing = [c for c in cols if c not in have]
    if strict and missing:
        raise ValueError(f"missing columns: {missing}")
    return [c for c in cols if c in have]


def drop_leaky(cols: Sequence[str], word: str = "damage") -> tuple[str, ...]:
    return tuple(c for c in cols if word not in c.lower())


def column_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Non-null count, least and greatest value of each column, in one pass."""
    one = df.agg(*[e for c in cols for e in (
        F.count(c).alias(f"{c}__n"), F.min(c).alias(f"{c}__lo"), F.max(c).alias(f"{c}__hi"))])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"{c}__n").alias("non_null"),
                 F.col(f"{c}__lo").cast("double").alias("min"), F.col(f"{c}__hi").cast("double").alias("max"))
        for c in cols])).alias("s")).select("s.*")


def all_null_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    counts = df.agg(*[F.count(c).alias(c) for c in cols]).first()
    return [c for c in cols if counts[c] == 0]


def drop_all_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*all_null_columns(df, cols))


def add_missing_flag(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_is_missing": F.col(c).isNull().cast("int") for c in cols})


def missingness_report(df: DataFrame, cols: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """Missing count and percent per column, worst first, in one pass."""
    kinds = set(categorical)
    one = df.agg(F.count("*").alias("__rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    rows = F.explode(F.array(*[
        F.struct(F.lit(c).alias("Feature"), F.col(c).alias("Missing_Count"),
                 F.try_divide(F.col(c) * 100.0, F.col("__rows")).alias("Missing_Percent"),
                 F.lit("Categorical" if c in kinds else "Numeric").alias("Type"))
        for c in cols]))
    return one.select(rows.alias("r")).select("r.*").orderBy(F.desc("Missing_Count"), "Feature")
