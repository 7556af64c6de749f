"""Codes and one-hot vectors for columns with any number of levels.

The levels of a column are a table of their own, numbered by range without a
single-task sort.  A frequent level reaches the rows by broadcast, all others by
a join on the level, so no task gets more than its share of a level that many
rows have.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.operators.encode import NULL_LEVEL
from tabulon.operators.ordering import position
from tabulon.session import materialize

HEAVY = 1_000  # a level with more than one row in so many is frequent; there are fewer than this


def _text(c: str, keep_null: bool) -> Column:
    text = F.col(c).cast("string")
    return text if keep_null else F.coalesce(text, F.lit(NULL_LEVEL))


def fit_dictionary(df: DataFrame, col: str, keep_null: bool = False) -> DataFrame:
    """(level, n, code): the levels of a column, numbered from 0 in alphabetical order, with their rows.

    Null is the level ``nan``, or with ``keep_null`` none.  Written once.
    """
    counted = df.groupBy(_text(col, keep_null).alias("level")).agg(F.count("*").alias("n")).filter(F.col("level").isNotNull())
    placed = position(counted, [F.col("level").asc()], "code")
    return materialize(placed.select("level", "n", (F.col("code") - 1).cast("double").alias("code")), "dictionary")


def dictionary_encode(df: DataFrame, dictionaries: Mapping[str, DataFrame], keep_null: bool = False, unseen: float = -1.0) -> DataFrame:
    """``df`` with each column replaced by its code; a level that the dictionary lacks gets ``unseen``.

    With ``keep_null`` nulls stay null.
    """
    for c, levels in dictionaries.items():
        total = levels.agg(F.sum("n")).first()[0] or 0
        often = levels.filter(F.col("n") > total / HEAVY).select(F.col("level").alias("__often"), F.col("code").alias("__often_code"))
        named = df.withColumn("__level", _text(c, keep_null))
        named = named.join(F.broadcast(often), F.col("__level") == F.col("__often"), "left")
        # Rows that have their code, or no level, are spread by a number that no level of the dictionary has.
        done = F.col("__often").isNotNull() | F.col("__level").isNull()
        spread = F.when(done, F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)) + 1).otherwise(0)
        named = named.withColumns({"__salt": spread, "__rest": F.when(~done, F.col("__level"))})
        rest = levels.select(F.lit(0).cast("long").alias("__zero"), F.col("level").alias("__name"), F.col("code").alias("__rest_code"))
        joined = named.join(rest, (F.col("__salt") == F.col("__zero")) & (F.coalesce("__rest", F.lit("")) == F.col("__name")), "left")
        code = F.coalesce("__often_code", "__rest_code", F.when(F.col("__level").isNotNull(), F.lit(unseen)))
        df = joined.select(*[code.alias(k) if k == c else F.col(k) for k in df.columns])
    return df


def sparse_one_hot(df: DataFrame, cols: Sequence[str], dictionaries: Mapping[str, DataFrame] | None = None,
                   suffix: str = "_hot") -> tuple[DataFrame, dict[str, DataFrame]]:
    """Add per column a sparse vector ``<column>_hot`` with a place for every level but the first.

    The first level, and one that the dictionary lacks, is a vector of zeros.  A
    column needs two levels.
    """
    dictionaries = dict(dictionaries) if dictionaries is not None else {c: fit_dictionary(df, c) for c in cols}
    coded = dictionary_encode(df.withColumns({f"__keep_{c}": F.col(c) for c in cols}), {c: dictionaries[c] for c in cols})
    for c in cols:
        size = dictionaries[c].count()
        if size < 2:
            raise ValueError(f"{c} has a single level")
        # The last code is the one that the encoder leaves out: here the first level and unknown ones.
        shifted = F.when(F.col(c) <= 0, F.lit(float(size - 1))).otherwise(F.col(c) - 1)
        attributes = {"ml_attr": {"type": "nominal", "num_vals": size, "name": "__code"}}
        coded = coded.withColumn("__code", shifted.alias("__code", metadata=attributes))
        encoder = OneHotEncoder(inputCols=["__code"], outputCols=[f"{c}{suffix}"], dropLast=True)
        coded = encoder.fit(coded.limit(0)).transform(coded).drop("__code")
    plain = [F.col(f"__keep_{k}").alias(k) if k in cols else F.col(k) for k in df.columns]
    return coded.select(*plain, *[f"{c}{suffix}" for c in cols]), dictionaries
