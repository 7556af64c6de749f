"""Minority over-sampling on mixed numeric and categorical columns."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.hashing import key_hash, uniform_of
from tabulon.operators.neighbors import class_profile, neighbors
from tabulon.operators.ordering import hash_position

log = logging.getLogger(__name__)


def _mode(values: Column) -> Column:
    """Most frequent code of a short array; a tie goes to the least code."""
    counted = F.transform(F.array_distinct(values), lambda v: F.struct(
        F.size(F.filter(values, lambda x: x == v)).alias("n"), (-v).alias("neg")))
    return -F.array_max(counted)["neg"]


def _coordinate(near: str, place: int) -> Column:
    return F.transform(near, lambda n: F.element_at(n["v"], place + 1))


def smotenc(df: DataFrame, key: str, label: str, num: Sequence[str], cat: Sequence[str] = (), k: int = 5,
            seed: int = 42, few: str = "raise", digest: str | None = None, **sizes) -> DataFrame:
    """Raise every class to the size of the largest by synthetic rows.

    A synthetic row lies between a real row and one of its ``k`` nearest rows
    of the class; its categories are the most frequent ones among the ``k``.
    The real rows of a class take turns in hash order, so the new rows are
    spread evenly.  Categories must be numeric codes.  A class to be raised that
    has at most ``k`` rows is an error, or with ``few="keep"`` leaves all rows
    as they are.  ``digest`` names a column that tells synthetic rows apart.
    """
    if few not in ("raise", "keep"):
        raise ValueError("few is raise or keep")
    num, cat = list(num), list(cat)
    known = class_profile(df, label, num)
    counts = {c: n for c, (n, _) in known.items()}
    most = max(counts.values())
    need = {c: most - n for c, n in counts.items() if n < most}
    small = {c: counts[c] for c in need if counts[c] <= k}
    real = df.select(key, label, *num, *cat).withColumn("synthetic", F.lit(False))
    if digest is not None:
        real = real.withColumn(digest, F.lit(None).cast("string"))
    if small and few == "raise":
        raise ValueError(f"classes {sorted(small)} have at most {k} rows")
    if small:
        log.warning("classes %s have at most %d rows; rows are used as they are", small, k)
        return real
    if not need:
        return real
    name = F.col(label).cast("string")
    minority = df.filter(name.isin(list(need))).select(key, label, *num, *cat)
    known = {c: known[c] for c in need}
    near = neighbors(minority, key, label, num, cat, k, known=known, **sizes)
    near = hash_position(near.withColumn("__h", key_hash(key, F.lit(seed))), "__h", "__pos", [label], [key])
    turns = F.lit(0).cast("long")
    for c, n in need.items():
        each, rest = divmod(n, counts[c])
        turns = F.when(name == c, F.lit(each) + (F.col("__pos") < rest).cast("int")).otherwise(turns)
    many = near.withColumn("__t", turns).filter("__t > 0").withColumn(
        "__s", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__t"))))
    many = many.withColumn("__d", key_hash(key, "__s", F.lit(seed))).withColumn(
        "__gap", uniform_of(F.col("__d"), 0)).withColumn(
        "__to", F.element_at("near", (F.floor(uniform_of(F.col("__d"), 1) * F.size("near")) + 1).cast("int"))["v"])
    made = {}
    for i, c in enumerate(num):
        x = F.col(c).cast("double")
        made[c] = x + F.col("__gap") * (F.element_at("__to", i + 1) - x)
    for j, c in enumerate(cat):
        made[c] = _mode(_coordinate("near", len(num) + j))
    new = many.select(F.lit(None).cast(df.schema[key].dataType).alias(key), label,
                      *[made[c].alias(c) for c in [*num, *cat]], F.lit(True).alias("synthetic"),
                      *([F.col("__d").alias(digest)] if digest is not None else []))
    return real.unionByName(new)


def smote(df: DataFrame, key: str, label: str, num: Sequence[str], k: int = 5, seed: int = 42, **sizes) -> DataFrame:
    return smotenc(df, key, label, num, (), k, seed, **sizes)
