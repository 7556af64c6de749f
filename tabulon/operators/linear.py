"""Linear scores per class, and squared-hinge machines by Newton steps on moment matrices."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.operators.gram import sum_vectors

MAX_CLASSES = 1_000
_HALVINGS = 40


@dataclass(frozen=True)
class LinearScores:
    """Linear scores per class; the largest score wins."""

    weights: np.ndarray  # (classes, features)
    intercepts: np.ndarray
    classes: tuple[float, ...] = field(default=())

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        x = vector_to_array(F.col(features))
        scores = []
        for c, (w, b) in enumerate(zip(self.weights, self.intercepts)):
            products = F.zip_with(x, F.array(*[F.lit(float(v)) for v in w]), lambda a, v: a * v)
            score = F.aggregate(products, F.lit(float(b)), lambda s, p: s + p)
            scores.append(F.struct(score.alias("score"), F.lit(-c).alias("neg")))
        best = -F.greatest(*scores)["neg"] if len(scores) > 1 else F.lit(0)
        place = F.array(*[F.lit(float(c)) for c in self.classes])
        return df.withColumn("prediction", place[best.cast("int")])


def class_counts(df: DataFrame, label: str = "label") -> dict[float, int]:
    """Rows per class, in class order; more classes than a linear model can hold are an error."""
    rows = df.groupBy(label).count().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    return {r[label]: r["count"] for r in sorted(rows, key=lambda r: r[label])}


def _hinge_moments(rows: DataFrame, betas: Mapping[float, np.ndarray], above: Mapping[float, float], c: float) -> dict[float, tuple]:
    """Per class (objective, gradient, curvature) at its coefficients, in one pass over the rows.

    A row counts where its margin is below one; rows of the class itself weigh
    ``above``.  Tasks send one vector per class, whose size depends on columns only.
    """
    size = len(next(iter(betas.values())))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, part = list(betas), 0
        total = np.zeros((len(names), 1 + size + size * size))
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(2)[0].as_py()
            x = np.column_stack([batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1), np.ones(batch.num_rows)])
            label = batch.column(0).to_numpy()
            for i, k in enumerate(names):
                y = np.where(label == k, 1.0, -1.0)
                z = x @ betas[k]
                active = y * z < 1.0
                a, gap = x[active], (z - y)[active]
                s = np.where(y[active] > 0, above[k], 1.0)
                weighted = a * s[:, None]
                total[i] += np.concatenate([[s @ gap ** 2], weighted.T @ gap, (weighted.T @ a).ravel()])
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(names), pa.int32()), pa.array(names, pa.float64()), pa.array(list(total), pa.list_(pa.float64()))],
            names=["part", "class", "v"])

    out = {}
    for r in sum_vectors(rows.mapInArrow(partial, "part int, class double, v array<double>"), "class"):
        k, v = r["class"], r["v"].toArray()
        out[k] = (0.5 * betas[k] @ betas[k] + c * v[0], betas[k] + 2 * c * v[1:1 + size],
                  np.eye(size) + 2 * c * v[1 + size:].reshape(size, size))
    return out


def fit_squared_hinge(df: DataFrame, c: float = 1.0, balanced: bool = True, tol: float = 1e-10, max_iter: int = 1000) -> LinearScores:
    """One machine per class: least 1/2 |beta|^2 + c * sum of weight * max(0, 1 - y z)^2.

    The intercept is the coefficient of a column of ones and penalised like the
    others.  ``balanced`` weighs the rows of a machine's own class by
    rows / (classes * rows of the class); other rows weigh one.  The loss is
    quadratic as long as the rows with a margin below one stay the same, so a
    Newton step on these rows ends at the optimum as soon as the set is right;
    a step that does not lower the objective is halved.  All classes take their
    steps in the same pass; one that has converged drops out.  ``tol`` bounds
    the decrease that a full step could still bring, relative to the objective;
    ``max_iter`` bounds the passes.
    """
    counts = class_counts(df)
    total = sum(counts.values())
    above = {k: total / (len(counts) * n) if balanced else 1.0 for k, n in counts.items()}
    p = len(df.select(vector_to_array("features").alias("x")).first()["x"])
    rows = df.select(F.col("label").cast("double").alias("label"), vector_to_array("features").alias("x"),
                     F.spark_partition_id().alias("part"))
    best = {k: np.zeros(p + 1) for k in counts}
    state = _hinge_moments(rows, best, above, c)
    step, length = {}, {}

    def aim(k: float) -> bool:
        """Set the next step of a class; false where it has converged."""
        objective, gradient, curvature = state[k]
        d = 1.0 / np.sqrt(np.diag(curvature))  # columns differ by orders of magnitude
        step[k] = -d * np.linalg.solve(curvature * np.outer(d, d), d * gradient)
        length[k] = 1.0
        return -(gradient @ step[k]) > tol * max(objective, 1e-300)

    open_ = [k for k in counts if aim(k)]
    for _ in range(max_iter):
        if not open_:
            break
        tried = {k: best[k] + length[k] * step[k] for k in open_}
        seen = _hinge_moments(rows, tried, above, c)
        left = []
        for k in open_:
            if seen[k][0] <= state[k][0] + 1e-4 * length[k] * (state[k][1] @ step[k]):
                best[k], state[k] = tried[k], seen[k]
                if aim(k):
                    left.append(k)
            elif length[k] > 0.5 ** _HALVINGS:  # beyond, rounding hides any further decrease
                length[k] /= 2
                left.append(k)
        open_ = left
    weights = np.array([best[k] for k in counts])
    return LinearScores(weights[:, :-1], weights[:, -1], tuple(counts))
