"""Fold tables and permuted columns, numbered by hash instead of a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.hashing import key_hash
from tabulon.operators.ordering import hash_position, null_safe_join


def repeated_folds(df: DataFrame, key: str, label: str, k: int = 5, repeats: int = 5, seed: int = 42) -> DataFrame:
    """``(key, repeat, fold)`` with every class spread evenly over the folds.

    Rows are numbered in hash order inside their class, the numbering goes on
    from class to class, and the number modulo ``k`` is the fold.
    """
    rows = df.filter(F.col(label).isNotNull()).select(key, label)
    rows = rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    rows = rows.withColumn("__h", key_hash(key, F.col("repeat"), F.lit(seed)))
    placed = hash_position(rows, "__h", "__pos", ["repeat", label], [key])
    # Classes are few: the offsets of the classes are a handful of rows.
    sizes = rows.groupBy("repeat", label).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("repeat").orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("repeat", label, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__class_off"))
    joined = null_safe_join(placed, offsets, ["repeat", label], "inner")
    fold = ((F.col("__pos") + F.col("__class_off")) % k).cast("int")
    return joined.select(key, "repeat", fold.alias("fold"))


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    return repeated_folds(df, key, label, k, 1, seed).drop("repeat")


def first_split(folds: DataFrame) -> DataFrame:
    return folds.filter(F.col("fold") == 0)


def with_partner(df: DataFrame, key: str, cols: Sequence[str], by: Sequence[str], seed: int = 42,
                 suffix: str = "_perm", own: bool = False) -> DataFrame:
    """Give each row the columns of another row of its group, by a permutation.

    The place in plain hash order meets the place in seeded hash order.  With
    ``own`` the group is part of the seed, so groups that hold the same keys
    are permuted independently.
    """
    by = list(by)
    here = hash_position(df.withColumn("__h", key_hash(key)), "__h", "__pos", by, [key]).drop("__h")
    there = df.select(*by, key, *cols).withColumn("__h", key_hash(key, *(by if own else []), F.lit(seed)))
    there = hash_position(there, "__h", "__pos", by, [key]).select(
        *by, "__pos", *[F.col(c).alias(f"{c}{suffix}") for c in cols])
    return null_safe_join(here, there, [*by, "__pos"], "inner").drop("__pos")


def permute_column(df: DataFrame, key: str, col: str, by: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """Shuffle one column inside each group; all other columns stay."""
    mixed = with_partner(df, key, [col], by, seed)
    return mixed.withColumn(col, F.col(f"{col}_perm")).drop(f"{col}_perm")
