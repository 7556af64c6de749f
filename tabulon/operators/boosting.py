"""Boosted trees with one softmax over all classes, for many training sets at once.

Columns are cut into at most 256 bins per training set and rows keep one byte
per column.  Gradients are rounded to a fixed grid of 2**-30, so their sums are
whole numbers: the trees do not depend on partitions, order or path.

A training set above ``IN_TASK_ROWS`` rows is fitted level by level: each pass
over the rows adds up gradients by (set, class, node, bin), Spark sums them, and
one best split per node comes back.  All sets, classes and nodes of a level
share the pass.  A smaller set, bytes per row and column, goes to one task as a
group and takes all its rounds there; several sets run side by side.  A pass is a
Spark job, and a model has rounds x depth of them, so the bound is where a job
costs less than the rows do.  Both paths give the same trees.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators.linear import class_counts
from tabulon.session import discard, materialize

IN_TASK_ROWS = 1_000_000  # rows of a training set that one task may hold: some 200 bytes each with three classes and few columns
MARGIN_ROUNDS = 10     # rounds after which the rows' scores are written anew
MAX_MODEL_BYTES = 512 * 1024 * 1024
_GRID = float(1 << 30)
_LEAST_GAIN = 1e-6
_U = np.uint64


@dataclass(frozen=True)
class Settings:
    rounds: int = 300
    depth: int = 6
    rate: float = 0.08
    row_share: float = 0.8
    column_share: float = 0.8
    penalty: float = 1.0     # on squared leaf values
    min_child: float = 1.0   # least curvature of a child
    max_bins: int = 256
    seed: int = 42


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _uniform(ids: np.ndarray, *salts: int) -> np.ndarray:
    """Uniform in [0, 1) from 64-bit ids and salts."""
    h = ids.astype(np.int64).view(_U)
    for s in salts:
        h = _mixed(h + _U((0x9E3779B97F4A7C15 * (s + 1)) % (1 << 64)))
    return (h >> _U(11)).astype(float) / float(1 << 53)


# ---- bins ----

def bin_cuts(rows: DataFrame, n_features: int, max_bins: int) -> dict[tuple[int, int], np.ndarray]:
    """Cut points per (set, column): all midpoints of a column with few values, else quantiles.

    Tasks keep the distinct values of a column while there are at most
    ``max_bins``; only these are shuffled.  Other columns take approximate
    quantiles, which are exact up to 10,000 rows.  The result is bounded by
    sets x columns x bins.
    """
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], np.ndarray | None] = {}
        for batch in batches:
            sets = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy().reshape(len(sets), n_features)
            for s in np.unique(sets).tolist():
                for f in range(n_features):
                    known = seen.get((s, f), np.zeros(0))
                    if known is not None:
                        known = np.union1d(known, x[sets == s, f])
                        seen[s, f] = known if len(known) <= max_bins else None
        for (s, f), known in seen.items():
            values = [None] if known is None else known.tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([s] * len(values), pa.int32()), pa.array([f] * len(values), pa.int32()), pa.array(values, pa.float64())],
                names=["set", "f", "v"])

    values = materialize(rows.select("set", "x").mapInArrow(distinct, "set int, f int, v double").distinct(), "bin-values")
    sizes = values.groupBy("set", "f").agg(F.count("*").alias("n"), F.count("v").alias("known"))
    few = sizes.filter((F.col("n") == F.col("known")) & (F.col("n") <= max_bins))
    listed = values.join(few, ["set", "f"]).groupBy("set", "f").agg(F.sort_array(F.collect_list("v")).alias("v")).collect()
    cuts = {}
    for r in listed:
        v = np.array(r["v"])
        cuts[r["set"], r["f"]] = (v[:-1] + v[1:]) / 2
    discard(values)
    sets = [r["set"] for r in rows.select("set").distinct().collect()]
    wide = sorted({f for s in sets for f in range(n_features) if (s, f) not in cuts})
    if wide:
        shares = [i / max_bins for i in range(1, max_bins)]
        quantiles = rows.groupBy("set").agg(*[F.percentile_approx(F.col("x")[f], shares, 10_000).alias(f"q{f}") for f in wide])
        for r in quantiles.collect():
            for f in wide:
                cuts.setdefault((r["set"], f), np.unique(r[f"q{f}"]))
    return cuts


@dataclass(frozen=True)
class Grid:
    """Bins of one training set, numbered through all columns."""

    cuts: list[np.ndarray]
    starts: np.ndarray = field(init=False)  # first slot of each column, and the number of slots
    column: np.ndarray = field(init=False)  # column of each slot

    def __post_init__(self):
        sizes = [len(c) + 1 for c in self.cuts]
        object.__setattr__(self, "starts", np.concatenate([[0], np.cumsum(sizes)]))
        object.__setattr__(self, "column", np.repeat(np.arange(len(sizes)), sizes))

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(self.cuts)]).astype(np.uint8)


# ---- one tree; node i has the children 2 i + 1 and 2 i + 2 ----

@dataclass
class Tree:
    feature: np.ndarray  # -1: leaf or no node
    bin: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n))

    def route(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """Node of each row after at most so many tests."""
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(levels):
            f = self.feature[node]
            on = f >= 0
            if not on.any():
                break
            right = bins[rows, np.maximum(f, 0)] > self.bin[node]
            node = np.where(on, 2 * node + 1 + right, node)
        return node

    def settle(self, node: int, g: int, h: int, s: Settings) -> None:
        self.value[node] = -s.rate * (g / _GRID) / (h / _GRID + s.penalty)
        self.cover[node] = h / _GRID

    def split(self, node: int, best: tuple, s: Settings) -> bool:
        """Take a best split if it gains; its children become leaves."""
        gain, feature, cut, g_left, h_left, g, h = best
        if node == 0:
            self.settle(0, g, h, s)
        if not gain > _LEAST_GAIN:
            return False
        self.feature[node], self.bin[node] = feature, cut
        self.settle(2 * node + 1, g_left, h_left, s)
        self.settle(2 * node + 2, g - g_left, h - h_left, s)
        return True


def gradients(margins: np.ndarray, label: np.ndarray, rid: np.ndarray, round_: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Whole-number first and second derivatives (rows, classes); rows left out of the round have zeros."""
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    h = np.maximum(2 * p * (1 - p), 1e-16)
    p[np.arange(len(p)), label] -= 1.0
    drawn = (_uniform(rid, s.seed, round_) < s.row_share)[:, None]
    return np.where(drawn, np.rint(p * _GRID), 0.0), np.where(drawn, np.rint(h * _GRID), 0.0)


def histogram(bins: np.ndarray, node: np.ndarray, g: np.ndarray, h: np.ndarray, nodes: int, grid: Grid,
              columns: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sums (nodes, slots); exact, as whole numbers below 2**53.  With ``columns``, slots of the others are zero."""
    sums = np.zeros((2, nodes, int(grid.starts[-1])), np.int64)
    for at in range(0, len(bins), 1 << 20):
        part = slice(at, at + (1 << 20))
        for f in range(bins.shape[1]) if columns is None else columns.tolist():
            first, end = grid.starts[f], grid.starts[f + 1]
            place = node[part] * (end - first) + bins[part, f]
            for out, what in zip(sums, (g, h)):
                counted = np.bincount(place, what[part], minlength=nodes * (end - first))
                out[:, first:end] += counted.astype(np.int64).reshape(nodes, -1)
    return sums[0], sums[1]


def columns_of(n: int, set_: int, cls: int, round_: int, s: Settings) -> np.ndarray:
    """The columns a tree may test: the given share, least hashes first."""
    keep = max(1, int(s.column_share * n))
    allowed = np.zeros(n, bool)
    allowed[np.argsort(_uniform(np.arange(n), s.seed, set_, cls, round_), kind="stable")[:keep]] = True
    return allowed


def best_splits(g: np.ndarray, h: np.ndarray, grid: Grid, allowed: np.ndarray, s: Settings) -> list[tuple]:
    """Per node (gain, column, bin, left sums, sums); ties go to the first column and bin."""
    starts, column = grid.starts, grid.column
    before_g = np.concatenate([np.zeros((len(g), 1), np.int64), np.cumsum(g, axis=1)], axis=1)
    before_h = np.concatenate([np.zeros((len(h), 1), np.int64), np.cumsum(h, axis=1)], axis=1)
    g_left = before_g[:, 1:] - before_g[:, starts[:-1]][:, column]
    h_left = before_h[:, 1:] - before_h[:, starts[:-1]][:, column]
    g_all, h_all = before_g[:, starts[1]], before_h[:, starts[1]]
    gl, hl, ga, ha = g_left / _GRID, h_left / _GRID, g_all[:, None] / _GRID, h_all[:, None] / _GRID
    gr, hr = (g_all[:, None] - g_left) / _GRID, (h_all[:, None] - h_left) / _GRID
    gain = gl ** 2 / (hl + s.penalty) + gr ** 2 / (hr + s.penalty) - ga ** 2 / (ha + s.penalty)
    good = (hl >= s.min_child) & (hr >= s.min_child) & allowed[column]
    good[:, starts[1:] - 1] = False  # nothing lies right of a column's last bin
    gain = np.where(good, gain, -np.inf)
    at = gain.argmax(axis=1)
    rows = np.arange(len(g))
    return [*zip(gain[rows, at].tolist(), column[at].tolist(), (at - starts[column[at]]).tolist(),
                 g_left[rows, at].tolist(), h_left[rows, at].tolist(), g_all.tolist(), h_all.tolist())]


def grow(bins: np.ndarray, g: np.ndarray, h: np.ndarray, grid: Grid, allowed: np.ndarray, s: Settings) -> tuple[Tree, np.ndarray]:
    """A whole tree from rows at hand, and the node of each row.

    Rows left out of the round add nothing.  Of two children only the one with
    fewer rows is added up: the sums are whole numbers, so the other is exactly
    the rest of the parent.
    """
    tree, active = Tree.empty(s.depth), [0]
    drawn = np.flatnonzero((g != 0) | (h != 0))
    own, own_g, own_h = np.asfortranarray(bins[drawn]), g[drawn], h[drawn]
    columns = np.flatnonzero(allowed | (np.arange(len(allowed)) == 0))  # the first column gives a node's total
    node, rows = np.zeros(len(bins), np.int32), np.arange(len(bins))
    sums = histogram(own, np.zeros(len(own), np.int64), own_g, own_h, 1, grid, columns)
    for level in range(s.depth):
        best = best_splits(*sums, grid, allowed, s)
        taken = [i for i, n in enumerate(active) if tree.split(n, best[i], s)]
        if not taken:
            break
        f = tree.feature[node]
        right = bins[rows, np.maximum(f, 0)] > tree.bin[node]
        node = np.where(f >= 0, 2 * node + 1 + right, node).astype(np.int32)
        parents, active = [active[i] for i in taken], [c for i in taken for c in (2 * active[i] + 1, 2 * active[i] + 2)]
        if level + 1 == s.depth:
            break
        at = node[drawn]
        sizes = np.bincount(at, minlength=len(tree.feature))
        fewer = [2 * n + 1 + int(sizes[2 * n + 2] < sizes[2 * n + 1]) for n in parents]
        local = np.full(len(tree.feature), -1, np.int64)
        local[fewer] = np.arange(len(fewer))
        place = local[at]
        mine = np.flatnonzero(place >= 0)
        some = histogram(own[mine], place[mine], own_g[mine], own_h[mine], len(fewer), grid, columns)
        second = np.array([c % 2 == 0 for c in fewer])
        both = []
        for before, part in zip(sums, some):
            rest, out = before[taken] - part, np.empty((len(active), before.shape[1]), np.int64)
            out[0::2], out[1::2] = np.where(second[:, None], rest, part), np.where(second[:, None], part, rest)
            both.append(out)
        sums = tuple(both)
    return tree, node


# ---- the two paths ----

_TREES = "set int, round int, cls int, feature array<int>, threshold array<double>, value array<double>, cover array<double>"


def _tree_row(set_: int, round_: int, cls: int, tree: Tree, grid: Grid) -> tuple:
    threshold = [float(grid.cuts[f][b]) if f >= 0 else 0.0 for f, b in zip(tree.feature.tolist(), tree.bin.tolist())]
    return set_, round_, cls, tree.feature.tolist(), threshold, tree.value.tolist(), tree.cover.tolist()


def _fit_in_tasks(binned: DataFrame, grids: Mapping[int, Grid], n_classes: int, s: Settings) -> DataFrame:
    """Every set as one group: all rounds in a task."""
    shared = binned.sparkSession.sparkContext.broadcast({k: g.cuts for k, g in grids.items()})
    names = [c.split(" ")[0] for c in _TREES.split(", ")]

    def fit(rows: pa.Table) -> pa.Table:
        set_ = rows.column("set")[0].as_py()
        grid = Grid(shared.value[set_])
        label, rid = rows.column("label").to_numpy(), rows.column("rid").to_numpy()
        bins = np.frombuffer(b"".join(rows.column("bins").to_pylist()), np.uint8).reshape(len(label), -1)
        margins, out = np.zeros((len(label), n_classes)), []
        for r in range(s.rounds):
            g, h = gradients(margins, label, rid, r, s)
            for c in range(n_classes):
                tree, node = grow(bins, g[:, c], h[:, c], grid, columns_of(bins.shape[1], set_, c, r, s), s)
                margins[:, c] += tree.value[node]
                out.append(_tree_row(set_, r, c, tree, grid))
        schema = pa.schema([("set", pa.int32()), ("round", pa.int32()), ("cls", pa.int32()), ("feature", pa.list_(pa.int32())),
                            *[(n, pa.list_(pa.float64())) for n in names[4:]]])
        return pa.Table.from_arrays([pa.array([t[i] for t in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return binned.groupBy("set").applyInArrow(fit, _TREES)


def _fit_by_passes(binned: DataFrame, grids: Mapping[int, Grid], n_classes: int, s: Settings) -> DataFrame:
    """All sets together, one pass per level of a round."""
    spark = binned.sparkSession
    rows = materialize(binned.withColumn("margins", F.array_repeat(F.lit(0.0), n_classes)), "boosting")
    stored = rows.schema
    keys, since, done = [(k, c) for k in grids for c in range(n_classes)], [], None
    cuts = spark.sparkContext.broadcast({k: g.cuts for k, g in grids.items()})

    def replayed(batch: pa.RecordBatch, past: list) -> Iterator[tuple]:
        """Per set of a batch its number, rows, bins and scores after the past rounds."""
        sets = batch.column("set").to_numpy()
        bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(len(sets), -1)
        margins = batch.column("margins").flatten().to_numpy().reshape(len(sets), n_classes).copy()
        for k in np.unique(sets).tolist():
            mine = np.flatnonzero(sets == k)
            own, m = bins[mine], margins[mine]
            for trees in past:
                for c in range(n_classes):
                    m[:, c] += trees[k, c].value[trees[k, c].route(own, s.depth)]
            yield k, mine, own, m

    def pass_of(past: list, trees: Mapping, active: Mapping, round_: int, level: int) -> list:
        state = spark.sparkContext.broadcast((past, trees, active))

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            past, trees, active = state.value
            for batch in batches:
                for k, mine, bins, margins in replayed(batch, past):
                    grid = Grid(cuts.value[k])
                    g, h = gradients(margins, batch.column("label").to_numpy()[mine], batch.column("rid").to_numpy()[mine], round_, s)
                    for c in range(n_classes):
                        if not active[k, c]:
                            continue
                        node = trees[k, c].route(bins, level)
                        local = np.full(len(trees[k, c].feature), -1, np.int64)
                        local[active[k, c]] = np.arange(len(active[k, c]))
                        on = local[node] >= 0
                        sums = histogram(bins[on], local[node[on]], g[on, c], h[on, c], len(active[k, c]), grid)
                        which, slot = np.nonzero(sums[0] | sums[1])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(slot), v, np.int32)) for v in (k, c)]
                            + [pa.array(np.array(active[k, c], np.int32)[which]), pa.array(slot.astype(np.int32)),
                               pa.array(sums[0][which, slot]), pa.array(sums[1][which, slot])],
                            names=["set", "cls", "node", "slot", "g", "h"])

        def choose(part: pa.Table) -> pa.Table:
            k, c, node = (part.column(n)[0].as_py() for n in ("set", "cls", "node"))
            grid = Grid(cuts.value[k])
            sums = np.zeros((2, 1, int(grid.starts[-1])), np.int64)
            for i, n in enumerate(("g", "h")):
                sums[i, 0, part.column("slot").to_numpy()] = part.column(n).to_numpy()
            best = best_splits(*sums, grid, columns_of(len(grid.cuts), k, c, round_, s), s)[0]
            return pa.Table.from_pydict({"set": [k], "cls": [c], "node": [node], "gain": [best[0]], "best": [list(best[1:])]}, pa.schema(
                [("set", pa.int32()), ("cls", pa.int32()), ("node", pa.int32()), ("gain", pa.float64()), ("best", pa.list_(pa.int64()))]))

        parts = rows.mapInArrow(add_up, "set int, cls int, node int, slot int, g long, h long")
        sums = parts.groupBy("set", "cls", "node", "slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        found = sums.groupBy("set", "cls", "node").applyInArrow(choose, "set int, cls int, node int, gain double, best array<bigint>").collect()
        state.unpersist()
        return found

    for r in range(s.rounds):
        trees, active = {k: Tree.empty(s.depth) for k in keys}, {k: [0] for k in keys}
        for level in range(s.depth):
            found = pass_of(since, trees, active, r, level)
            active = {k: [] for k in keys}
            for f in sorted(found, key=lambda f: (f["set"], f["cls"], f["node"])):
                k, node = (f["set"], f["cls"]), f["node"]
                if trees[k].split(node, (f["gain"], *f["best"]), s):
                    active[k] += [2 * node + 1, 2 * node + 2]
            if not any(active.values()):
                break
        since.append(trees)
        if len(since) == MARGIN_ROUNDS or r == s.rounds - 1:
            made = [_tree_row(k, r - len(since) + 1 + i, c, t[k, c], grids[k]) for i, t in enumerate(since) for k, c in keys]
            part = materialize(spark.createDataFrame(made, _TREES), "trees")
            done = part if done is None else done.unionByName(part)
            state, old = spark.sparkContext.broadcast(since), rows

            def write(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    margins = np.zeros((batch.num_rows, n_classes))
                    for _, mine, _, m in replayed(batch, state.value):
                        margins[mine] = m
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns[:-1], pa.ListArray.from_arrays(
                            pa.array(np.arange(0, margins.size + 1, n_classes, dtype=np.int32)), pa.array(margins.ravel()))],
                        names=batch.schema.names)

            if r < s.rounds - 1:
                rows = materialize(old.mapInArrow(write, stored), "boosting")
                discard(old)
            since = []
    discard(rows)
    return done


@dataclass(frozen=True)
class BoostedModel:
    """The trees of one training set, in Parquet; as many as the settings say, whatever the number of rows."""

    trees: DataFrame
    classes: tuple[float, ...]
    n_features: int
    depth: int

    def arrays(self) -> dict[str, np.ndarray]:
        """Trees in order of round and class, one row of nodes each."""
        nodes = 2 ** (self.depth + 1) - 1
        if self.trees.count() * nodes * 28 > MAX_MODEL_BYTES:
            raise ValueError("too many trees for one broadcast")
        rows = self.trees.orderBy("round", "cls").collect()
        kinds = {"cls": np.int32, "feature": np.int32, "threshold": float, "value": float, "cover": float}
        return {n: np.array([r[n] for r in rows], kind) for n, kind in kinds.items()}

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """``df`` with ``probability`` (per class) and ``prediction``."""
        shared = df.sparkSession.sparkContext.broadcast(self.arrays())
        depth, n_classes = self.depth, len(self.classes)

        @F.pandas_udf("array<double>")
        def probability(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype=object)
            x, m = np.stack(vectors.to_numpy()), shared.value
            margins, rows = np.zeros((len(x), n_classes)), np.arange(len(x))[:, None]
            for at in range(0, len(m["cls"]), 60):
                part = slice(at, at + 60)
                trees = np.arange(len(m["cls"][part]))[None, :]
                node = np.zeros((len(x), trees.size), np.int64)
                for _ in range(depth):
                    f = m["feature"][part][trees, node]
                    right = x[rows, np.maximum(f, 0)] > m["threshold"][part][trees, node]
                    node = np.where(f >= 0, 2 * node + 1 + right, node)
                values = m["value"][part][trees, node]
                for c in range(n_classes):
                    margins[:, c] += values[:, m["cls"][part] == c].sum(axis=1)
            e = np.exp(margins - margins.max(axis=1, keepdims=True))
            return pd.Series(list(e / e.sum(axis=1, keepdims=True)))

        scored = df.withColumn("probability", probability(vector_to_array(F.col(features))))
        best = F.array_position("probability", F.array_max("probability")).cast("int")
        return scored.withColumn("prediction", F.array(*[F.lit(c) for c in self.classes])[best - 1])


@dataclass(frozen=True)
class SoftmaxBoosting:
    """Fits one model, or with ``fit_sets`` one model for each training set of a table."""

    settings: Settings = Settings()
    in_task_rows: int = IN_TASK_ROWS

    def __call__(self, df: DataFrame) -> BoostedModel:
        """Rows (label, features[, rid]); ``rid`` says which rows a round draws, else the row's content does."""
        rid = F.col("rid") if "rid" in df.columns else F.xxhash64("label", vector_to_array("features"))
        return self.fit_sets(df.select(F.lit(0).alias("set"), rid.alias("rid"), "label", "features"))[0]

    def fit_sets(self, df: DataFrame) -> dict[int, BoostedModel]:
        """One model per value of ``set``, from rows (set, rid, label, features).

        The classes are those of the whole table.  Features must not be null.
        Equal row ids are drawn together.
        """
        s = self.settings
        if s.max_bins > 256:
            raise ValueError("a bin is one byte")
        rows = materialize(df.select(F.col("set").cast("int").alias("set"), F.col("rid").cast("long").alias("rid"),
                                     F.col("label").cast("double").alias("label"), vector_to_array("features").alias("x")), "boosting-rows")
        classes = tuple(class_counts(rows))
        sizes = {r["set"]: r["count"] for r in rows.groupBy("set").count().collect()}
        first = rows.select(F.size("x").alias("n")).first()
        if first is None:
            return {}
        cuts = bin_cuts(rows, first["n"], s.max_bins)
        grids = {k: Grid([cuts[k, f] for f in range(first["n"])]) for k in sizes}
        shared = rows.sparkSession.sparkContext.broadcast({k: g.cuts for k, g in grids.items()})

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = batch.column("set").to_numpy()
                x = batch.column("x").flatten().to_numpy().reshape(len(sets), -1)
                bins = np.zeros(x.shape, np.uint8)
                for k in np.unique(sets).tolist():
                    bins[sets == k] = Grid(shared.value[k]).bins(x[sets == k])
                label = np.searchsorted(classes, batch.column("label").to_numpy()).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("set"), batch.column("rid"), pa.array(label), pa.array([b.tobytes() for b in bins], pa.binary())],
                    names=["set", "rid", "label", "bins"])

        binned = materialize(rows.mapInArrow(code, "set int, rid long, label int, bins binary"), "boosting-bins")
        discard(rows)
        small = [k for k, n in sizes.items() if n <= self.in_task_rows]
        large = [k for k in sizes if k not in small]
        parts = [fit(binned.filter(F.col("set").isin(which)), {k: grids[k] for k in which}, len(classes), s)
                 for fit, which in ((_fit_in_tasks, small), (_fit_by_passes, large)) if which]
        trees = materialize(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), "trees")
        discard(binned)
        return {k: BoostedModel(trees.filter(F.col("set") == k), classes, first["n"], s.depth) for k in sizes}
