"""Counts, shares, cross-tabs, and the tables behind charts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.operators.ordering import exact_quantiles, null_safe_join, top_k
from tabulon.session import materialize


def group_mean(df: DataFrame, keys: Sequence[str], value: str, out: str = "mean") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(out))


def group_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))


def best_group(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """Group with the highest mean; a tie goes to the alphabetically first."""
    means = group_mean(df, [*keys, group], value, "mean")
    w = Window.partitionBy(*keys).orderBy(F.desc("mean"), F.asc(group))
    return means.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def value_counts(df: DataFrame, cols: Sequence[str], normalize: bool = False) -> DataFrame:
    counts = df.groupBy(*cols).agg(F.count("*").alias("count"))
    if normalize:
        total = df.agg(F.count("*").alias("n")).scalar()
        counts = counts.withColumn("percent", F.col("count") * 100.0 / total)
    return counts


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def crosstab(df: DataFrame, row: str, col: str, levels: Sequence[str]) -> DataFrame:
    """Counts with one column per level; named levels need no extra job, and a
    level without rows is a column of zeros."""
    return df.groupBy(row).agg(*[
        F.count_if(F.col(col) == level).alias(level) for level in levels])


def crosstab_pct(df: DataFrame, row: str, col: str, levels: Sequence[str]) -> DataFrame:
    counts = crosstab(df, row, col, levels)
    total = sum((F.col(v) for v in levels), F.lit(0))
    return counts.select(row, *[F.try_divide(F.col(v) * 100.0, total).alias(v) for v in levels])


def group_share(df: DataFrame, group: str, col: str) -> DataFrame:
    """Share of each value inside its group, in percent.

    The window runs over the counted table, not over the rows.
    """
    counts = df.groupBy(group, col).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy(group))
    return counts.withColumn("total", total).withColumn("percentage", F.col("count") * 100.0 / F.col("total"))


def join_totals(counts: DataFrame, totals: DataFrame, key: str) -> DataFrame:
    return counts.join(totals, key)


def keep_frequent(df: DataFrame, col: str, min_n: int = 5) -> DataFrame:
    often = df.groupBy(col).agg(F.count("*").alias("n")).filter(F.col("n") >= min_n).select(col)
    return df.join(often, col, "left_semi")


def frequent_crosstab_pct(df: DataFrame, row: str, col: str, levels: Sequence[str], min_n: int = 5) -> DataFrame:
    """Row percentages of the groups with at least ``min_n`` rows.

    Same result as ``crosstab_pct(keep_frequent(...))``, but the size test is
    made on the counted rows, so the table is read and shuffled once.
    """
    counts = df.filter(F.col(row).isNotNull()).groupBy(row).agg(
        F.count("*").alias("__n"), *[F.count_if(F.col(col) == v).alias(v) for v in levels])
    total = sum((F.col(v) for v in levels), F.lit(0))
    return counts.filter(F.col("__n") >= min_n).select(
        row, *[F.try_divide(F.col(v) * 100.0, total).alias(v) for v in levels])


def top_groups_share(df: DataFrame, row: str, col: str, levels: Sequence[str], k: int = 4) -> DataFrame:
    """Proportions inside the ``k`` largest groups (ties by name)."""
    counts = crosstab(df.filter(F.col(row).isNotNull()), row, col, levels)
    total = sum((F.col(v) for v in levels), F.lit(0))
    largest = top_k(counts.withColumn("__t", total), [F.desc("__t"), F.asc(row)], k)
    return largest.select(row, *[F.try_divide(F.col(v).cast("double"), F.col("__t")).alias(v) for v in levels])


def band(col: str, edges: Sequence[float], below: str | None = None) -> Column:
    """Text band ``lo-hi``, closed on the left; outside all bands is null."""
    c = F.col(col)
    out = F.when(c < edges[0], F.lit(below if below is not None else f"Pre-{edges[0]}"))
    for lo, hi in zip(edges, edges[1:]):
        out = out.when((c >= lo) & (c < hi), F.lit(f"{lo}-{hi}"))
    return out


def band_crosstab(df: DataFrame, col: str, edges: Sequence[float], label: str, levels: Sequence[str]) -> DataFrame:
    banded = df.withColumn("band", band(col, edges)).filter(F.col("band").isNotNull())
    return crosstab_pct(banded, "band", label, levels)


def label_agreement(df: DataFrame, sources: Mapping[str, str]) -> DataFrame:
    """Count rows by label source and class, over rows that have every label."""
    both = df.na.drop(subset=list(sources.values()))
    pairs = both.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("source"), F.col(c).alias("class")) for name, c in sources.items()
    ])).alias("p")).select("p.*")
    return pairs.groupBy("source", "class").agg(F.count("*").alias("count"))


def histogram(df: DataFrame, col: str, width: float, by: Sequence[str] = (),
              lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Row count per bin of fixed width and group; optional range of values."""
    rows = df.filter(F.col(col).isNotNull())
    if lo is not None:
        rows = rows.filter(F.col(col) >= lo)
    if hi is not None:
        rows = rows.filter(F.col(col) <= hi)
    start = F.floor(F.col(col) / width) * F.lit(float(width))
    return rows.withColumn("bin_start", start).groupBy(*by, "bin_start").agg(F.count("*").alias("count"))


def histogram_bins(df: DataFrame, col: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Row count per equal bin between the least and the greatest value.

    One scan finds the range, the other bins the rows, so only bins are shuffled.
    """
    edges = df.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi")).alias("e")).scalar()
    lo, hi = edges["lo"], edges["hi"]
    index = F.when(hi > lo, F.least(F.floor((F.col(col) - lo) * bins / (hi - lo)), F.lit(bins - 1))).otherwise(0)
    binned = df.filter(F.col(col).isNotNull()).withColumn("bin", index.cast("int"))
    return binned.groupBy(*by, "bin").agg(F.count("*").alias("count"))


def count_by(df: DataFrame, col: str, by: str, order: Sequence[str]) -> DataFrame:
    """Counts by category and group with the category's place in a fixed order."""
    place = F.create_map(*[F.lit(x) for i, v in enumerate(order) for x in (v, i)])
    return df.groupBy(col, by).agg(F.count("*").alias("count")).withColumn("place", place[F.col(col)])


def _fences(df: DataFrame, value: str, by: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Stored values joined with their group's quartiles."""
    rows = materialize(df.select(*by, F.col(value).cast("double").alias(value)), "box")
    q = exact_quantiles(rows, by, value, probs, stored=True)
    return null_safe_join(rows.filter(F.col(value).isNotNull()), q, by, "inner")


def box_stats(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers and number of outliers per group, exact."""
    fenced = _fences(df, value, by, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return fenced.groupBy(*by).agg(
        F.first("n").alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col(value))).alias("whisker_lo"),
        F.max(F.when(inside, F.col(value))).alias("whisker_hi"),
        F.count_if(~inside).alias("outliers"))


def box_outliers(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Outlying values per group with their counts."""
    fenced = _fences(df, value, by, {"q1": 0.25, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    return fenced.filter(~F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)).groupBy(*by, value).agg(
        F.count("*").alias("n"))


# Distribution function of Poisson(1) at 0, 1, 2, ...
_POISSON_CDF = (
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563,
    0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.999998874797402, 0.9999998885745217,
    0.9999999899522336,
)


_HELD_GROUPS = 1_000  # groups whose replicate sums a task holds before it sends them on
_HELD_WEIGHTS = 1 << 20  # weights of one block, rows x replicates
_TASK_WEIGHTS = 1 << 20  # weights a task draws, unless there are more rows than that gives tasks


def _weights(names: Sequence[str], n: int, seed: int) -> np.ndarray:
    """Poisson(1) draws (rows, replicates): replicate r takes word r % 4 of the digest of (row, r // 4, seed)."""
    ends = [f":{i}:{seed}".encode() for i in range(-(-n // 4))]
    digests = []
    for name in names:
        start = hashlib.md5(name.encode())
        for end in ends:
            h = start.copy()
            h.update(end)
            digests.append(h.digest())
    words = np.frombuffer(b"".join(digests), ">u4").reshape(len(names), -1)[:, :n]
    return np.searchsorted(_POISSON_CDF, (words + 0.5) / 4294967296.0, "right").astype(float)


def bootstrap_mean_ci(df: DataFrame, keys: Sequence[str], value: str, row_key, n: int = 1000,
                      seed: int = 42, level: float = 0.95) -> DataFrame:
    """Mean and percentile interval of the mean per group.

    Each replicate weighs every row by a Poisson(1) draw from the row's key, so
    rows need not meet to be resampled and none is repeated.  A task multiplies
    blocks of weights with the rows' values and sends one row per group, with
    the sums of all replicates; replicates in which a group has no weight are
    left out.
    """
    row_keys = list(row_key) if isinstance(row_key, (list, tuple)) else [row_key]
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull())
    name = F.concat_ws(":", *[F.col(c).cast("string") for c in row_keys])
    group = F.to_json(F.array(*[F.col(k).cast("string") for k in keys])) if keys else F.lit("")
    picked = rows.select(group.alias("g"), name.alias("row"), F.col(value).cast("double").alias("v"))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), *[pa.array([s[i] for s in held.values()], pa.list_(pa.float64())) for i in (0, 1)]],
                names=["g", "wv", "w"])

        step = max(1, _HELD_WEIGHTS // n)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                v = part.column(2).to_numpy()
                w = _weights(part.column(1).to_pylist(), n, seed)
                coded = part.column(0).dictionary_encode()
                which = coded.indices.to_numpy()
                for i, g in enumerate(coded.dictionary.to_pylist()):
                    mine = which == i
                    sums = np.array([v[mine] @ w[mine], w[mine].sum(axis=0)])
                    held[g] = held[g] + sums if g in held else sums
                    if len(held) >= _HELD_GROUPS:
                        yield sent()
                        held.clear()
        if held:
            yield sent()

    # Weights are the work, and a small table may lie in a single partition.
    tasks = min(picked.count() * n // _TASK_WEIGHTS + 1, 2 * df.sparkSession.sparkContext.defaultParallelism)
    spread = picked.repartition(tasks, "row", "v") if tasks > 1 else picked
    parts = spread.mapInArrow(add_up, "g string, wv array<double>, w array<double>")
    cells = parts.select("g", F.posexplode(F.arrays_zip("wv", "w")).alias("replicate", "s"))
    means = cells.groupBy("g", "replicate").agg(F.try_divide(F.sum("s.wv"), F.sum("s.w")).alias("m"))
    tail = (1 - level) / 2
    # Groups x replicates rows: the built-in exact percentile holds n values.
    ci = means.groupBy(F.col("g").alias("__g")).agg(
        F.percentile("m", F.lit(tail)).alias("ci_lo"), F.percentile("m", F.lit(1 - tail)).alias("ci_hi"))
    centre = rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).withColumn("__g", group)
    return centre.join(ci, "__g").drop("__g")


def side_by_side_topk(a: DataFrame, b: DataFrame, name: str, value: str, k: int = 10) -> DataFrame:
    """Two ranked lists next to each other, joined on the place."""
    def ranked(df: DataFrame, tag: str) -> DataFrame:
        best = top_k(df, [F.desc(value), F.asc(name)], k)
        w = Window.partitionBy().orderBy(F.desc(value), F.asc(name))
        return best.select(F.row_number().over(w).alias("place"), F.col(name).alias(f"{name}_{tag}"),
                           F.col(value).alias(f"{value}_{tag}"))

    return ranked(a, "a").join(ranked(b, "b"), "place", "full_outer")


def rank_scatter(df: DataFrame, rank_a: str, rank_b: str, max_rank: int = 20, label_rank: int = 10) -> DataFrame:
    """Points up to a first rank, with a mark on those to annotate."""
    a, b = F.col(rank_a), F.col(rank_b)
    return df.filter(a <= max_rank).withColumn(
        "annotate", (a <= label_rank) | (b <= label_rank))


def topk_long(df: DataFrame, name: str, by: str, cols: Sequence[str], k: int = 10) -> DataFrame:
    """Top ``k`` rows by one column, one row per (name, column)."""
    best = top_k(df, [F.desc_nulls_last(by), F.asc(name)], k)
    return best.unpivot([name], list(cols), "strategy", "score")
