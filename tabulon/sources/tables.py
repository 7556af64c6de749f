"""Reading, naming, uniting, profiling and writing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCORE_SCHEMA = T.StructType([
    T.StructField("Setting", T.StringType()),
    T.StructField("Model", T.StringType()),
    T.StructField("Fold", T.IntegerType()),
    T.StructField("MacroF1", T.DoubleType()),
    T.StructField("Accuracy", T.DoubleType()),
])
IMPORTANCE_SCHEMA = T.StructType([
    T.StructField("Setting", T.StringType()),
    T.StructField("Model", T.StringType()),
    T.StructField("Feature", T.StringType()),
    T.StructField("Fold", T.IntegerType()),
    T.StructField("Decrease_in_Accuracy", T.DoubleType()),
])
EQUIVALENCE_SCHEMA = T.StructType([
    T.StructField("Setting", T.StringType()),
    T.StructField("Model", T.StringType()),
    T.StructField("Best_Model", T.StringType()),
    T.StructField("p_value", T.DoubleType()),
    T.StructField("Diff_Mean", T.DoubleType()),
])


def read_survey(spark: SparkSession, path: str, encoding: str = "UTF-8", quoted_breaks: bool = False) -> DataFrame:
    """Header CSV with every column as string; types are cast later by role.

    The header line gives the schema, so no inference pass runs over the data.
    ``quoted_breaks`` reads values that hold line breaks inside quotes; a file is
    then one task, so it is off by default.
    """
    return (
        spark.read.option("header", True)
        .option("encoding", encoding)
        .option("multiLine", quoted_breaks)
        .option("escape", '"')
        .option("inferSchema", False)
        .csv(path)
    )


def normalized_name(name: str) -> str:
    return name.strip().lower().replace(" ", "_").replace(".", "")


def normalize_columns(df: DataFrame) -> DataFrame:
    names = [normalized_name(c) for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"column names collide after normalisation: {twice}")
    return df.toDF(*names)


def with_source(df: DataFrame, name: str, column: str = "dataset_source") -> DataFrame:
    return df.withColumn(column, F.lit(name))


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    other = set(b.columns)
    return [c for c in a.columns if c in other]


def union_sources(*dfs: DataFrame) -> DataFrame:
    """Outer union by name; a column missing in one source is null there."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def columns_like(df: DataFrame, part: str) -> list[str]:
    return [c for c in df.columns if part.lower() in c.lower()]


def drop_unnamed(df: DataFrame) -> DataFrame:
    """Drop index leftovers: ``unnamed*`` headers and Spark's ``_c<N>``."""
    def artifact(c: str) -> bool:
        return c.lower().startswith("unnamed") or (c.startswith("_c") and c[2:].isdigit())

    return df.drop(*[c for c in df.columns if artifact(c)])


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def export_features(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write a cleaned and engineered table without index leftovers."""
    write_table(drop_unnamed(df), path, fmt)


def read_results(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path)


def profile(df: DataFrame, distinct: bool = True) -> DataFrame:
    """One row per column: type, non-null count, distinct count, least value.

    All counts come from a single pass.  Distinct counts are exact: the table
    is turned into (column, value) pairs, which are grouped map-side first.
    """
    types = dict(df.dtypes)
    cols = df.columns
    if not distinct:
        one = df.agg(F.count("*").alias("rows"), *[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)],
                     *[F.min(F.col(c).cast("string")).alias(f"m{i}") for i, c in enumerate(cols)])
        return one.select("rows", F.explode(F.array(*[F.struct(
            F.lit(c).alias("column"), F.lit(types[c]).alias("type"), F.col(f"n{i}").alias("non_null"),
            F.col(f"m{i}").alias("min_value")) for i, c in enumerate(cols)])).alias("p")).select(
            "p.column", "p.type", "rows", "p.non_null", "p.min_value")
    pairs = df.select(
        F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols
        ])).alias("p")
    ).select("p.*")
    counts = pairs.groupBy("column", "value").agg(F.count("*").alias("n"))
    type_of = F.create_map(*[F.lit(x) for c in cols for x in (c, types[c])])
    out = counts.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"),
        F.count("value").alias("distinct"),
        F.min("value").alias("min_value"),
    )
    return out.select("column", type_of[F.col("column")].alias("type"), "rows", "non_null", "distinct", "min_value")


def first_row(df: DataFrame, order: Sequence[Column] = ()) -> DataFrame:
    """(position, column, value): the first row as text, a row per column.

    Without ``order`` that is the first row read, which is the first line of a
    single file; with it, the least row, of which each task keeps one.
    """
    one = df.orderBy(*order).limit(1) if order else df.limit(1)
    cells = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                      for i, c in enumerate(df.columns)])
    return one.select(F.explode(cells).alias("c")).select("c.*")


def header_is_data(df: DataFrame, expected: Sequence[str]) -> bool:
    """True when the first row repeats the expected column names.

    ``first`` reads one row of one partition, never the table.
    """
    row = df.first()
    if row is None:
        return False
    values = {str(v).strip().lower() for v in row if v is not None}
    return len(values & {e.lower() for e in expected}) * 2 >= len(expected)
