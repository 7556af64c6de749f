"""Moment matrices (sums of products) in one pass over the rows."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MERGERS = 64


def sum_vectors(parts: DataFrame, key: str | None) -> list:
    """Add up one vector per partition in two steps, so no task sees them all."""
    keys = [key] if key else []
    vec = parts.withColumn("v", array_to_vector("v")).withColumn("__g", F.col("part") % _MERGERS)
    some = vec.groupBy(*keys, "__g").agg(Summarizer.sum(F.col("v")).alias("v"))
    return some.groupBy(*keys).agg(Summarizer.sum(F.col("v")).alias("v")).collect()


def gram(df: DataFrame, cols: Sequence[str], weight: str | None = None) -> np.ndarray:
    """Sum of w * (1, x)(1, x)' over all rows; size depends on columns only."""
    cols = list(cols)
    size = len(cols) + 1
    picked = df.select(*[F.col(c).cast("double").alias(c) for c in cols],
                       (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("__w"),
                       F.spark_partition_id().alias("__p"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, part = np.zeros((size, size)), 0
        for pdf in batches:
            if not len(pdf):
                continue
            part = int(pdf["__p"].iloc[0])
            x = np.column_stack([np.ones(len(pdf)), pdf[cols].to_numpy(float)])
            total += x.T @ (x * pdf["__w"].to_numpy(float)[:, None])
        yield pd.DataFrame({"part": [part], "v": [total.ravel().tolist()]})

    parts = picked.mapInPandas(partial, "part int, v array<double>")
    return sum_vectors(parts, None)[0]["v"].toArray().reshape(size, size)


def masked_grams(df: DataFrame, cols: Sequence[str], masks: Mapping[str, str],
                 centre: Sequence[float]) -> dict[str, np.ndarray]:
    """For each masked column, the moments over the rows outside its mask.

    Columns are taken relative to ``centre``, which keeps the sums accurate.
    """
    cols, targets = list(cols), list(masks)
    centre = np.asarray(centre, dtype=float)
    size = len(cols) + 1
    picked = df.select(*[F.col(c).cast("double").alias(c) for c in cols], *masks.values(),
                       F.spark_partition_id().alias("__p"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, part = np.zeros((len(targets), size, size)), 0
        for pdf in batches:
            if not len(pdf):
                continue
            part = int(pdf["__p"].iloc[0])
            x = np.column_stack([np.ones(len(pdf)), pdf[cols].to_numpy(float) - centre])
            every = x.T @ x
            for i, t in enumerate(targets):
                hidden = x[pdf[masks[t]].to_numpy(bool)]
                total[i] += every - hidden.T @ hidden
        yield pd.DataFrame({"part": [part] * len(targets), "target": targets,
                            "v": [m.ravel().tolist() for m in total]})

    parts = picked.mapInPandas(partial, "part int, target string, v array<double>")
    return {r["target"]: r["v"].toArray().reshape(size, size) for r in sum_vectors(parts, "target")}


def pattern_grams(df: DataFrame, cols: Sequence[str], centre: Sequence[float]) -> dict[str, np.ndarray]:
    """Moments of (1, columns) over the rows of each pattern of gaps, gaps counting as zero.

    A pattern is a string of 0 and 1 (gap), one per column.  Columns are taken
    relative to ``centre``.  A task holds one matrix per pattern it meets, so
    the caller counts the patterns first.
    """
    cols = list(cols)
    centre = np.asarray(centre, dtype=float)
    size = len(cols) + 1
    picked = df.select(F.array(*[F.col(c).cast("double") for c in cols]).alias("x"), F.spark_partition_id().alias("part"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = {}, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(1)[0].as_py()
            flat = batch.column(0).flatten()
            gaps = flat.is_null().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            x = np.where(gaps, 0.0, flat.fill_null(0.0).to_numpy().reshape(batch.num_rows, -1) - centre)
            x = np.column_stack([np.ones(len(x)), x])
            found, which = np.unique(gaps, axis=0, return_inverse=True)
            for i, pattern in enumerate(found):
                mine = x[which.ravel() == i]
                name = "".join("1" if g else "0" for g in pattern)
                total[name] = total.get(name, 0.0) + mine.T @ mine
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(total), pa.int32()), pa.array(list(total), pa.string()),
             pa.array([m.ravel() for m in total.values()], pa.list_(pa.float64()))], names=["part", "pattern", "v"])

    parts = picked.mapInArrow(partial, "part int, pattern string, v array<double>")
    return {r["pattern"]: r["v"].toArray().reshape(size, size) for r in sum_vectors(parts, "pattern")}
