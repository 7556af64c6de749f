"""Softmax boosting: both paths, an independent plain fit, and scores."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulon.operators import boosting, folds, models
from tabulon.operators.boosting import Settings, SoftmaxBoosting
from tabulon.operators.encode import assemble

FEATS = ["a", "b", "c"]
FIELDS = ["feature", "threshold", "value", "cover"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.normal(size=500), "b": rng.integers(0, 4, 500) * 1.0, "c": rng.normal(size=500).round(1)})
    pdf["label"] = (pdf.a + (pdf.b == 2) > 0.5).astype(float) + (pdf.c * pdf.a > 0.8)
    pdf["id"] = np.arange(500)
    df = spark.createDataFrame(pdf)
    sets = assemble(df, FEATS).withColumn("rid", F.xxhash64("id")).withColumn("set", F.when(F.col("id") % 3 == 0, 4).otherwise(7))
    return pdf, df, sets


def plain_fit(x, y, classes, rounds, depth, rate, cuts):
    """The same trees by plain loops, without draws of rows or columns."""
    margins = np.zeros((len(x), classes))
    trees = []
    for _ in range(rounds):
        e = np.exp(margins - margins.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        for c in range(classes):
            g, h = p[:, c] - (y == c), np.maximum(2 * p[:, c] * (1 - p[:, c]), 1e-16)
            nodes = {}

            def go(node, rows, level):
                G, H = g[rows].sum(), h[rows].sum()
                nodes[node] = -rate * G / (H + 1)
                best = (1e-6, None)
                for f in range(x.shape[1]) if level < depth else ():
                    for cut in cuts[f]:
                        left = x[rows, f] <= cut
                        gl, hl = g[rows[left]].sum(), h[rows[left]].sum()
                        if hl < 1 or H - hl < 1:
                            continue
                        gain = gl ** 2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G ** 2 / (H + 1)
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, cut, left))
                if best[1] is None:
                    margins[rows, c] += nodes[node]
                    return
                f, cut, left = best[1]
                nodes[node] = (f, cut)
                go(2 * node + 1, rows[left], level + 1)
                go(2 * node + 2, rows[~left], level + 1)

            go(0, np.arange(len(x)), 0)
            trees.append(nodes)
    return trees, margins


def test_trees_equal_a_plain_fit(data):
    pdf, df, _ = data
    model = SoftmaxBoosting(Settings(rounds=4, depth=3, rate=0.3, row_share=1.0, column_share=1.0))(assemble(df, FEATS))
    x, y = pdf[FEATS].to_numpy(), pdf.label.to_numpy().astype(int)
    cuts = []
    for f in range(3):
        v = np.unique(x[:, f])
        cuts.append((v[:-1] + v[1:]) / 2 if len(v) <= 256 else np.array(
            [r for r in df.select(F.percentile_approx("a", [i / 256 for i in range(1, 256)], 10_000)).first()[0]]))
    trees, margins = plain_fit(x, y, 3, 4, 3, 0.3, [np.unique(c) for c in cuts])
    got = model.arrays()
    assert got["cls"].tolist() == [0, 1, 2] * 4
    for t, nodes in enumerate(trees):
        for node, what in nodes.items():
            if isinstance(what, tuple):
                assert (got["feature"][t][node], got["threshold"][t][node]) == pytest.approx(what)
            else:
                assert got["feature"][t][node] == -1 and got["value"][t][node] == pytest.approx(what, abs=1e-6)
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    want = e / e.sum(axis=1, keepdims=True)
    scored = model.transform(assemble(df, FEATS)).orderBy("id").toPandas()
    assert np.allclose(np.stack(scored["probability"]), want, atol=1e-6)
    assert (scored["prediction"] == want.argmax(axis=1)).all()


def test_both_paths_give_the_same_trees(data, monkeypatch):
    """Row and column draws included; a set above the bound goes level by level."""
    _, _, sets = data
    monkeypatch.setattr(boosting, "MARGIN_ROUNDS", 2)
    s = Settings(rounds=3, depth=3, rate=0.2)
    small = SoftmaxBoosting(s).fit_sets(sets)
    passes = SoftmaxBoosting(s, in_task_rows=0).fit_sets(sets.repartition(5))
    mixed = SoftmaxBoosting(s, in_task_rows=200).fit_sets(sets)
    assert small.keys() == passes.keys() == mixed.keys() == {4, 7}
    for k in small:
        want = small[k].arrays()
        assert (want["feature"] >= 0).any() and len(want["cls"]) == 9
        for other in (passes, mixed):
            got = other[k].arrays()
            assert all((got[n] == want[n]).all() for n in ["cls", *FIELDS])


def test_only_the_lesser_child_is_added_up(monkeypatch):
    """A level costs at most half the drawn rows; sums, nodes and values are those of the whole rows."""
    rng = np.random.default_rng(5)
    bins, rid, s = rng.integers(0, 16, (4000, 4)).astype(np.uint8), np.arange(4000), Settings(depth=4)
    grid, label = boosting.Grid([np.arange(15.0)] * 4), (bins[:, 1] + bins[:, 2] > 15).astype(int)
    g, h = boosting.gradients(np.zeros((4000, 2)), label, rid, 0, s)
    allowed, seen, real = np.array([False, True, True, True]), [], boosting.histogram
    monkeypatch.setattr(boosting, "histogram", lambda b, *rest: seen.append(len(b)) or real(b, *rest))
    tree, node = boosting.grow(bins, g[:, 0], h[:, 0], grid, allowed, s)
    drawn = int((g[:, 0] != 0).sum())
    assert seen[0] == drawn and len(seen) == 4 and all(n <= drawn / 2 for n in seen[1:])
    assert (node == tree.route(bins, s.depth)).all() and not (tree.feature == 0).any()
    path = {0: np.ones(4000, bool)}
    for n in range(15):
        if tree.feature[n] >= 0:
            left = bins[:, tree.feature[n]] <= tree.bin[n]
            path[2 * n + 1], path[2 * n + 2] = path[n] & left, path[n] & ~left
    for n, rows in path.items():
        assert tree.cover[n] == h[rows, 0].sum() / 2.0 ** 30


def test_many_rows_need_no_pass_per_level(spark, monkeypatch):
    monkeypatch.setattr(boosting, "_fit_by_passes", None)
    rows = assemble(spark.range(60_000).select((F.col("id") % 2).cast("double").alias("label"), (F.col("id") % 7).cast("double").alias("a")), ["a"])
    assert len(SoftmaxBoosting(Settings(rounds=1, depth=2))(rows).arrays()["cls"]) == 2


def test_draws_leave_out_a_share_of_rows_and_columns():
    s = Settings()
    rid = np.arange(20_000)
    g, _ = boosting.gradients(np.zeros((20_000, 2)), np.zeros(20_000, int), rid, 5, s)
    assert abs((g[:, 0] != 0).mean() - 0.8) < 0.02
    g2, _ = boosting.gradients(np.zeros((20_000, 2)), np.zeros(20_000, int), rid, 6, s)
    assert ((g != 0) != (g2 != 0)).any()
    assert boosting.columns_of(10, 0, 1, 2, s).sum() == 8 and boosting.columns_of(1, 0, 1, 2, s).sum() == 1


def test_many_values_are_cut_at_quantiles(spark):
    rows = spark.range(5000).select(F.lit(1).alias("set"), F.array(F.col("id").cast("double"), (F.col("id") % 300).cast("double"),
                                                                   (F.col("id") % 256).cast("double")).alias("x"))
    cuts = boosting.bin_cuts(rows, 3, 256)
    assert len(cuts[1, 0]) == 255 and len(cuts[1, 1]) <= 255 and cuts[1, 2].tolist() == [i + 0.5 for i in range(255)]
    assert np.abs(np.diff(cuts[1, 0]) - 5000 / 256).max() < 2


def test_folds_are_fitted_together_and_each_row_scored_once(data, monkeypatch):
    _, df, _ = data
    calls = []
    real = SoftmaxBoosting.fit_sets
    monkeypatch.setattr(SoftmaxBoosting, "fit_sets", lambda self, rows: calls.append(1) or real(self, rows))
    made = folds.repeated_folds(df, "id", "label", 3, 2)
    pred = models.fit_predict(df, "id", FEATS, made, {"GradientBoosting": models.boosted_trees(20, 3)}, models.Resampler(tuple(FEATS)))
    rows = pred.groupBy("Fold").agg(F.count("*").alias("n"), F.countDistinct("id").alias("d"), F.avg((F.col("y") == F.col("yhat")).cast("int")).alias("ok")).collect()
    assert len(calls) == 1 and len(rows) == 6 and sum(r.n for r in rows) == 1000
    assert all(r.n == r.d and r.ok > 0.7 for r in rows)


def test_constant_columns_and_one_class(spark):
    df = assemble(spark.createDataFrame([(1.0, 5.0)] * 9, "label double, a double"), ["a"])
    model = SoftmaxBoosting(Settings(rounds=2))(df)
    assert {(r["prediction"], tuple(r["probability"])) for r in model.transform(df).collect()} == {(1.0, (1.0,))}
    assert SoftmaxBoosting().fit_sets(df.limit(0).select(F.lit(0).alias("set"), F.lit(1).alias("rid"), "label", "features")) == {}
