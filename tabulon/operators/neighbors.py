"""Exact nearest neighbours inside each class, without comparing all pairs.

The distance is squared Euclid over the numbers plus a fixed penalty for every
category that differs.  The work is cut up in three steps:

1. Equal rows are folded together: a vector with many copies is searched once,
   and only its first ``k + 1`` keys can ever be somebody's neighbour.
2. A few rows of each class are its pivots.  A cell holds the vectors that share
   their nearest pivot and lie in one ring around it; a table says how near and
   how far its vectors are from each pivot.  The distance is a metric, so by the
   triangle inequality this bounds the distance from a vector to a cell, in any
   number of columns.  A vector first searches its own cell, which bounds the
   distance of its k-th neighbour.
3. It then visits the few cells of least bound, and with the distances found
   there just the others whose bound is still within reach.

Cells are cut into blocks of limited size on both sides, so no task holds a
whole cell, however dense it is.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, MutableMapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.session import materialize

PIVOTS = 64
MAX_CELLS = 16_384     # of a class; the table of cells and pivots is at most 16 MB
BLOCK_ROWS = 8_192
CELL_ROWS = 4_096
SAMPLE_ROWS = 1_024    # rows of a class among which pivots are chosen
FIRST_VISITS = 4       # cells of least bound that are visited before the others
MAX_CLASSES = 1_000


@dataclass(frozen=True)
class Pivots:
    """Pivots of one class, and the rings around them once these are known."""

    points: np.ndarray        # (pivots, columns)
    n_num: int
    penalty2: float
    rings: int
    cuts: tuple[np.ndarray, ...] = ()

    def distances(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros((len(x), len(self.points)))
        for i in range(x.shape[1]):
            if i < self.n_num:
                total += (x[:, i, None] - self.points[None, :, i]) ** 2
            else:
                total += (x[:, i, None] != self.points[None, :, i]) * self.penalty2
        return np.sqrt(total)

    def cells(self, distances: np.ndarray) -> np.ndarray:
        own = distances.argmin(axis=1)
        near = distances[np.arange(len(own)), own]
        ring = np.zeros(len(own), np.int64)
        for p in np.unique(own):
            ring[own == p] = np.searchsorted(self.cuts[p], near[own == p], side="right")
        return own * self.rings + ring


def _far_apart(x: np.ndarray, n: int, n_num: int, penalty2: float) -> np.ndarray:
    """Up to n rows, each the farthest from those before it."""
    chosen, near = [0], None
    while len(chosen) < min(n, len(x)):
        to = Pivots(x[chosen[-1:]], n_num, penalty2, 1).distances(x)[:, 0]
        near = to if near is None else np.minimum(near, to)
        if near.max() == 0:
            break
        chosen.append(int(near.argmax()))
    return x[chosen]


def class_profile(df: DataFrame, label: str, num: Sequence[str]) -> dict[str, tuple[int, float]]:
    """Rows and squared category penalty per class, in one pass.

    The penalty is the median of the columns' standard deviations.
    """
    rows = df.groupBy(F.col(label).cast("string").alias("c")).agg(
        F.count("*").alias("n"), *[F.stddev_pop(F.col(c)).alias(f"s{i}") for i, c in enumerate(num)]).limit(
        MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError("too many classes")
    return {r["c"]: (r["n"], float(np.median([r[f"s{i}"] for i in range(len(num))])) ** 2 if num else 1.0)
            for r in rows}


def _sample(points: DataFrame, cols: Sequence[str], rows: int) -> dict[str, np.ndarray]:
    """A few rows per class, the same for any partitioning."""
    drawn = Window.partitionBy("cls").orderBy(F.xxhash64("key"), "key")
    found: dict[str, list] = {}
    some = points.withColumn("r", F.row_number().over(drawn)).filter(F.col("r") <= rows)
    for r in some.select("cls", F.array(*cols).alias("v")).collect():
        found.setdefault(r["cls"], []).append(r["v"])
    return {c: np.array(sorted(v), dtype=float) for c, v in found.items()}


def _rough_d2(q: np.ndarray, x: np.ndarray, n_num: int, penalty2: float) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by one matrix product, and a bound of their error.

    A category is laid out as one column per level, scaled so that two levels
    are one penalty apart; a category of many levels is compared directly.
    """
    centre = x[:, :n_num].mean(axis=0)
    left, right, extra = [q[:, :n_num] - centre], [x[:, :n_num] - centre], 0.0
    for i in range(n_num, q.shape[1]):
        levels = np.unique(x[:, i])
        if len(levels) > 64:
            extra = extra + (q[:, i][:, None] != x[:, i][None]) * penalty2
            continue
        here, there = q[:, i][:, None] == levels[None], x[:, i][:, None] == levels[None]
        half = np.sqrt(penalty2 / 2)
        # A level the block lacks is a column of its own.
        left += [here * half, (~here.any(axis=1))[:, None] * half]
        right += [there * half, np.zeros((len(x), 1))]
    a, b = np.hstack(left), np.hstack(right)
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    return aa[:, None] + bb[None] - 2 * (a @ b.T) + extra, 1e-12 * (aa + bb.max() + penalty2 * q.shape[1])


def _nearest(q: np.ndarray, x: np.ndarray, n_num: int, penalty2: float, k: int,
             bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest rows of x for each row of q as ``(q index, x index, d2)``.

    Rough distances pick the candidates, with their error to spare; the
    candidates' distances are then taken exactly, ties by place in x.  Rows
    farther than ``bound`` may be left out.
    """
    rough, error = _rough_d2(q, x, n_num, penalty2)
    if bound is not None:
        limit = bound
    elif k < len(x):
        limit = np.partition(rough, k - 1, axis=1)[:, k - 1]
    else:
        limit = np.full(len(q), np.inf)
    at, to = np.nonzero(rough <= (limit + 2 * error)[:, None])
    d2 = np.zeros(len(at))
    for i in range(n_num):
        diff = q[at, i] - x[to, i]
        d2 += diff * diff
    differ = np.zeros(len(at))
    for i in range(n_num, q.shape[1]):
        differ += q[at, i] != x[to, i]
    d2 += differ * penalty2
    order = np.lexsort((to, d2, at))
    at, to, d2 = at[order], to[order], d2[order]
    place = np.arange(len(at)) - np.searchsorted(at, at, side="left")
    keep = place < k
    return at[keep], to[keep], d2[keep]


def nearest_lists(df: DataFrame, key: str, label: str, num: Sequence[str], cat: Sequence[str] = (), k: int = 5,
                  cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS,
                  known: Mapping[str, tuple[int, float]] | None = None,
                  report: MutableMapping[str, int] | None = None) -> DataFrame:
    """For each distinct vector of a class the ``k + 1`` nearest rows.

    Output: ``cls``, ``v`` (the vector) and ``near``, an array of
    ``(d2, key, v)`` sorted by distance and key.  The vector's own rows count.
    ``report`` is told the number of cells, of vectors, and of visits to cells
    other than a vector's own.
    """
    num, cat = list(num), list(cat)
    cols, n_num, want = [*num, *cat], len(num), k + 1
    known = known or class_profile(df, label, num)
    penalty2 = {c: p for c, (_, p) in known.items()}
    rows = df.select(F.col(label).cast("string").alias("cls"), F.col(key).alias("key"),
                     *[(F.col(c).cast("double") + 0.0).alias(c) for c in cols])
    # A rank filter this low is applied before the shuffle, so a vector that a
    # third of the rows share arrives as k + 1 rows per map task.
    copies = Window.partitionBy("cls", *cols).orderBy("key")
    points = materialize(
        rows.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= want), "points")
    single = all(n <= min(cell_rows, block_rows) for n, _ in known.values())
    key_type = points.schema["key"].dataType
    placed_schema = T.StructType([
        T.StructField("cls", T.StringType()), T.StructField("cell", T.LongType()),
        T.StructField("near", T.DoubleType()), T.StructField("key", key_type), T.StructField("copy", T.IntegerType()),
        T.StructField("v", T.ArrayType(T.DoubleType()))])
    pivots: dict[str, Pivots] = {}
    if not single:
        scouts = _sample(points, cols, max(SAMPLE_ROWS, want))
        for c, x in scouts.items():
            cells = min(MAX_CELLS, -(-known[c][0] // cell_rows))
            chosen = _far_apart(x, min(PIVOTS, cells), n_num, penalty2[c])
            pivots[c] = Pivots(chosen, n_num, penalty2[c], -(-cells // len(chosen)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Nearest pivot and its distance; with cuts, the cell instead of the pivot."""
        for pdf in batches:
            x, cells, near = pdf[cols].to_numpy(float), np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf))
            for c in pdf["cls"].unique() if pivots else ():
                mine = (pdf["cls"] == c).to_numpy()
                d = pivots[c].distances(x[mine])
                near[mine] = d.min(axis=1)
                cells[mine] = pivots[c].cells(d) if pivots[c].cuts else d.argmin(axis=1)
            yield pd.DataFrame({"cls": pdf["cls"], "cell": cells, "near": near, "key": pdf["key"], "copy": pdf["copy"], "v": list(x)})

    placed = points.mapInPandas(place, placed_schema)
    ranges: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    if not single:
        most = max(p.rings for p in pivots.values())
        probs = [i / most for i in range(1, most)]
        quantiles: dict[tuple[str, int], list] = {}
        if probs:
            around = points.filter("copy = 1").mapInPandas(place, placed_schema).groupBy("cls", "cell").agg(
                F.percentile_approx("near", probs, max(10_000, 10 * most)).alias("q"))
            quantiles = {(r["cls"], r["cell"]): r["q"] for r in around.collect()}
        for c, p in list(pivots.items()):
            cuts = []
            for i in range(len(p.points)):
                every = np.unique(quantiles.get((c, i), []))
                take = np.linspace(0, len(every) - 1, min(p.rings - 1, len(every))).astype(int)
                cuts.append(every[take] if len(take) else np.zeros(0))
            pivots[c] = Pivots(p.points, n_num, p.penalty2, p.rings, tuple(cuts))
        placed = materialize(placed, "cells")
        ranges = _ranges(placed, pivots)
    placed = placed.drop("near")
    asking = placed.filter("copy = 1").select("cls", "cell", F.col("key").alias("qid"), F.col("v").alias("qv"),
                                              F.lit(float("inf")).alias("r2"))
    # At most MAX_CELLS grid cells per class: a table of bounded size.
    cells = placed.groupBy("cls", "cell").agg(F.count("*").alias("rows")).withColumn(
        "blocks", F.ceil(F.col("rows") / block_rows).cast("int"))

    out_schema = T.StructType([
        T.StructField("cls", T.StringType()), T.StructField("qid", key_type),
        T.StructField("d2", T.DoubleType()), T.StructField("key", key_type),
        T.StructField("v", T.ArrayType(T.DoubleType()))])

    def compare(who: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(who) or not len(block):
            return pd.DataFrame({f.name: [] for f in out_schema})
        block = block.sort_values("key", kind="stable")
        cls = who["cls"].iloc[0]
        x = np.stack(block["v"].to_numpy())
        qs = np.stack(who["qv"].to_numpy())
        r2 = who["r2"].to_numpy()
        keys, vs, qids = block["key"].to_numpy(), block["v"].to_numpy(), who["qid"].to_numpy()
        outs = []
        for at in range(0, len(qs), 512):
            bound = None if np.isinf(r2[at:at + 512]).all() else r2[at:at + 512]
            of, to, d2 = _nearest(qs[at:at + 512], x, n_num, penalty2[cls], want, bound)
            outs.append(pd.DataFrame({"cls": cls, "qid": qids[at:at + 512][of], "d2": d2, "key": keys[to],
                                      "v": vs[to]}))
        return pd.concat(outs)

    by = ["cls", "cell", "block", "qblock"]

    def search(visits: DataFrame) -> DataFrame:
        """Compare the visitors of each cell with the cell's blocks."""
        if single:
            zero = {"block": F.lit(0), "qblock": F.lit(0)}
            return pair_up(visits.withColumns(zero), placed.withColumns(zero))
        guests = visits.groupBy("cls", "cell").agg(F.count("*").alias("guests")).withColumn(
            "qblocks", F.ceil(F.col("guests") / block_rows).cast("int"))
        plan = cells.join(guests, ["cls", "cell"]).select("cls", "cell", "blocks", "qblocks")
        left = visits.join(plan, ["cls", "cell"]).withColumn(
            "qblock", F.pmod(F.xxhash64("qid"), F.col("qblocks")).cast("int")).withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        right = placed.join(plan, ["cls", "cell"]).withColumn(
            "block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn(
            "qblock", F.explode(F.sequence(F.lit(0), F.col("qblocks") - 1)))
        return pair_up(left, right)

    def pair_up(left: DataFrame, right: DataFrame) -> DataFrame:
        there = [f"at_{c}" for c in by]
        right = right.select(*[F.col(c).alias(f"at_{c}") for c in by], "key", "v")
        return left.select(*[F.col(c).alias(c) for c in by], "qid", "qv", "r2").groupBy(*by).cogroup(
            right.groupBy(*there)).applyInPandas(compare, out_schema)

    best = Window.partitionBy("cls", "qid").orderBy("d2", "key")

    def keep(found: DataFrame) -> DataFrame:
        return found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= want).drop("r")

    near = keep(search(asking))
    if not single:
        def route(part: slice):
            """Visits to the cells that the slice of a vector's cells, least bound first, holds within reach."""
            def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    for cls, rows in pdf.groupby("cls"):
                        ids, lo, hi = ranges[cls]
                        step = max(1, 2_000_000 // (len(ids) * len(pivots[cls].points)))
                        for at in range(0, len(rows), step):
                            some = rows.iloc[at:at + step]
                            qs = np.stack(some["qv"].to_numpy())
                            d = pivots[cls].distances(qs)
                            bound = np.zeros((len(qs), len(ids)))
                            for p in range(d.shape[1]):
                                np.maximum(bound, np.maximum(d[:, p, None] - hi[None, :, p], lo[None, :, p] - d[:, p, None]), out=bound)
                            bound -= 1e-9 * (d.max(axis=1, keepdims=True) + hi.max())
                            bound[ids[None] == some["cell"].to_numpy()[:, None]] = np.inf
                            order = np.argsort(bound, axis=1, kind="stable")[:, part]
                            reach = np.sqrt(some["r2"].to_numpy())
                            q, c = np.nonzero(np.take_along_axis(bound, order, axis=1) <= reach[:, None])
                            c = order[q, c]
                            yield pd.DataFrame({"cls": cls, "cell": ids[c], "qid": some["qid"].to_numpy()[q],
                                                "qv": some["qv"].to_numpy()[q], "r2": some["r2"].to_numpy()[q] * (1 + 1e-9) + 1e-12})

            return visit

        visited = 0
        for part in (slice(0, FIRST_VISITS), slice(FIRST_VISITS, None)):
            near = materialize(near, "near")
            bound = near.groupBy("cls", "qid").agg(
                F.when(F.count("*") >= want, F.max("d2")).otherwise(F.lit(float("inf"))).alias("r2"))
            visits = materialize(asking.drop("r2").join(bound, ["cls", "qid"], "left").withColumn(
                "r2", F.coalesce("r2", F.lit(float("inf")))).select(*asking.columns).mapInPandas(route(part), asking.schema), "visits")
            visited += visits.count()
            near = keep(near.unionByName(search(visits)))
        if report is not None:
            report.update(cells=sum(len(r[0]) for r in ranges.values()), vectors=asking.count(), visits=visited)
    lists = near.groupBy("cls", "qid").agg(F.array_sort(F.collect_list(F.struct("d2", "key", "v"))).alias("near"))
    return asking.join(lists, ["cls", "qid"]).select("cls", F.col("qv").alias("v"), "near")


def _ranges(placed: DataFrame, pivots: Mapping[str, Pivots]) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per class its cells, and the least and greatest distance of their rows from each pivot.

    A task holds and sends one row per cell it meets.
    """
    most = max(len(p.points) for p in pivots.values())

    def extremes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, int], np.ndarray] = {}
        for pdf in batches:
            for cls, rows in pdf.groupby("cls"):
                d = pivots[cls].distances(np.stack(rows["v"].to_numpy()))
                cells = rows["cell"].to_numpy()
                order = np.argsort(cells, kind="stable")
                found, starts = np.unique(cells[order], return_index=True)
                lo, hi = np.minimum.reduceat(d[order], starts), np.maximum.reduceat(d[order], starts)
                for i, c in enumerate(found.tolist()):
                    both = np.array([lo[i], -hi[i]])
                    held[cls, c] = np.minimum(held[cls, c], both) if (cls, c) in held else both
        yield pd.DataFrame({"cls": [c for c, _ in held], "cell": [c for _, c in held],
                            "lo": [b[0].tolist() for b in held.values()], "hi": [(-b[1]).tolist() for b in held.values()]})

    parts = placed.select("cls", "cell", "v").mapInPandas(extremes, "cls string, cell long, lo array<double>, hi array<double>")
    wide = parts.groupBy("cls", "cell").agg(*[F.min(F.get("lo", F.lit(i))).alias(f"lo{i}") for i in range(most)],
                                            *[F.max(F.get("hi", F.lit(i))).alias(f"hi{i}") for i in range(most)])
    found: dict[str, list] = {}
    for r in wide.orderBy("cls", "cell").collect():
        found.setdefault(r["cls"], []).append(r)
    out = {}
    for c, rows in found.items():
        n = len(pivots[c].points)
        out[c] = (np.array([r["cell"] for r in rows]), *[np.array([[r[f"{e}{i}"] for i in range(n)] for r in rows]) for e in ("lo", "hi")])
    return out


def neighbors(df: DataFrame, key: str, label: str, num: Sequence[str], cat: Sequence[str] = (), k: int = 5,
              **sizes) -> DataFrame:
    """Rows of ``df`` with ``near``: their ``k`` nearest rows of the same class."""
    lists = nearest_lists(df, key, label, num, cat, k, **sizes)
    cols = [*num, *cat]
    named = df.withColumn("cls", F.col(label).cast("string")).withColumn(
        "v", F.array(*[F.col(c).cast("double") + 0.0 for c in cols]))
    others = F.slice(F.filter("near", lambda n: n["key"] != F.col(key)), 1, k)
    return named.join(lists, ["cls", "v"]).withColumn("near", others).drop("cls")


def neighbor_table(df: DataFrame, key: str, label: str, num: Sequence[str], cat: Sequence[str] = (), k: int = 5,
                   **sizes) -> DataFrame:
    near = neighbors(df, key, label, num, cat, k, **sizes)
    return near.select(key, F.posexplode("near").alias("pos", "n")).select(
        key, (F.col("pos") + 1).alias("rank"), F.col("n.key").alias("neighbor"), F.sqrt("n.d2").alias("distance"))
