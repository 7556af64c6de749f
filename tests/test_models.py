import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulon.operators import folds, importance, models, treeshap
from tabulon.operators.encode import assemble

FEATS = list("abcde")
CLASSES = ["L", "S", "U"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(rng.normal(size=(240, 5)), columns=FEATS)
    pdf["label"] = (pdf.a + pdf.b * pdf.c > 0).astype(float) + (pdf.d > 1)
    pdf["id"] = np.arange(len(pdf))
    return pdf, spark.createDataFrame(pdf).cache()


@pytest.fixture(scope="module")
def forest(data):
    return models.random_forest(5, max_depth=4)(assemble(data[1], FEATS))


def conditional(nodes, x, known):
    """Tree average with unknown features replaced by training shares."""
    total = np.zeros(3)
    for _, part in nodes.groupby("treeID"):
        rows = {r.id: r for r in part.itertuples()}

        def go(i):
            r = rows[i]
            if r.leftChild < 0:
                s = np.array(r.impurityStats)
                return s / s.sum()
            if r.feature in known:
                return go(r.leftChild if x[r.feature] <= r.threshold else r.rightChild)
            a, b = (sum(rows[c].impurityStats) for c in (r.leftChild, r.rightChild))
            return (a * go(r.leftChild) + b * go(r.rightChild)) / (a + b)

        total += go(0)
    return total / nodes["treeID"].nunique()


def walked(model, x):
    """SHAP values (features, classes, rows) and halves of interactions (features, features, classes, rows)."""
    trees = treeshap.tree_table(model)
    walks = [treeshap.Walk(t, trees.n_classes, trees.n_features) for b in trees.batches for t in treeshap._collect(trees, b)]
    n = trees.n_features
    phi, inter = np.zeros((n, trees.n_classes, len(x))), np.zeros((n, n, trees.n_classes, len(x)))
    for w in walks:
        w.shap(x.T.copy(), phi)
        w.interactions(x.T.copy(), inter, range(trees.n_classes))
    return phi, inter


def test_shap_values_and_interactions_match_subset_enumeration(spark, data):
    """Paths test a feature again and again: trees are deeper than there are features."""
    pdf, df = data
    model = models.random_forest(4, max_depth=9)(assemble(df, FEATS))
    nodes = treeshap._saved_nodes(model).toPandas()
    x = pdf[FEATS].to_numpy()[:3]
    phi, inter = walked(model, x)
    n = len(FEATS)
    for i in range(3):
        game = {s: conditional(nodes, x[i], set(s)) for r in range(n + 1) for s in itertools.combinations(range(n), r)}
        for j in range(n):
            want = sum(math.factorial(len(s)) * math.factorial(n - 1 - len(s)) / math.factorial(n)
                       * (game[tuple(sorted((*s, j)))] - game[s]) for s in game if j not in s)
            assert np.allclose(phi[j, :, i], want, atol=1e-12)
        for a, b in itertools.combinations(range(n), 2):
            want = sum(math.factorial(len(s)) * math.factorial(n - 2 - len(s)) / (2 * math.factorial(n - 1))
                       * (game[tuple(sorted((*s, a, b)))] - game[tuple(sorted((*s, a)))]
                          - game[tuple(sorted((*s, b)))] + game[s]) for s in game if a not in s and b not in s)
            assert np.allclose(inter[a, b, :, i], want, atol=1e-12)
    alone = {r.key: np.array(r.v).reshape(2, 3, n) for r in treeshap.single_expectations(model, df.filter("id < 3"), "id", FEATS).collect()}
    for i in range(3):
        for j in range(n):
            assert np.allclose(alone[i][0, :, j], conditional(nodes, x[i], {j}))
            assert np.allclose(alone[i][1, :, j], conditional(nodes, x[i], set(range(n)) - {j}))


def test_values_add_up_to_the_prediction(spark, data, forest):
    pdf, df = data
    base = treeshap.base_values(forest, CLASSES)
    prob = {r.id: r.probability.toArray() for r in forest.transform(assemble(df, FEATS)).collect()}
    for r in treeshap.shap_values(forest, df, "id", FEATS).collect():
        assert np.allclose([base[c] for c in CLASSES] + np.array(r.phi).sum(axis=1), prob[r.key])
    boosted = models.boosted_trees(5, 3, lr=0.3)(assemble(df, FEATS))
    base = treeshap.base_values(boosted, CLASSES)
    prob = {r.id: r.probability for r in boosted.transform(assemble(df, FEATS)).collect()}
    for r in treeshap.shap_values(boosted, df, "id", FEATS).collect():
        score = np.exp([base[c] for c in CLASSES] + np.array(r.phi).sum(axis=1))
        assert np.allclose(score / score.sum(), prob[r.key])


def test_batches_of_trees_and_tasks_do_not_matter(spark, data, forest, monkeypatch):
    _, df = data
    want = {r.key: r.phi for r in treeshap.shap_values(forest, df, "id", FEATS).collect()}
    monkeypatch.setattr(treeshap, "BATCH_BYTES", 1)
    monkeypatch.setattr(treeshap, "_TASK_CELLS", 1_000)
    monkeypatch.setattr(treeshap, "_CELLS", 50)
    trees = treeshap.tree_table(forest)
    assert len(trees.batches) == 5
    got = {r.key: r.phi for r in treeshap.shap_values(trees, df, "id", FEATS).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_integrals_are_taken_per_leaf_and_set_not_per_row(monkeypatch):
    """Rows that meet the same tests share the work, so it does not grow with rows times nodes."""
    tree = (-1, np.array([0, 1, -1, -1, 0, -1, -1]), np.array([0.0, 1, 0, 0, 2, 0, 0]), np.array([1, 2, -1, -1, 5, -1, -1]),
            np.array([4, 3, -1, -1, 6, -1, -1]), np.array([10.0, 6, 4, 2, 4, 3, 1]), np.arange(7.0))
    done, integrals = [], treeshap.Walk._integrals
    monkeypatch.setattr(treeshap.Walk, "_integrals", staticmethod(lambda share, met: done.append(len(share)) or integrals(share, met)))
    x = np.random.default_rng(0).normal(1, 2, size=(2, 50_000))
    x[0, :9], x[1, 5:20] = np.nan, np.nan
    walk, phi = treeshap.Walk(tree, 1, 2), np.zeros((2, 1, 50_000))
    walk.shap(x, phi)
    assert sum(done) <= 2 * 2 + 2 * 4  # two leaves with one feature, two with both
    leaf = np.where(x[0] <= 0, np.where(x[1] <= 1, 2.0, 3.0), np.where(x[0] <= 2, 5.0, 6.0))
    assert np.allclose(phi[:, 0].sum(axis=0) + walk.mean[0], leaf)


@pytest.mark.parametrize("n", [12, 18, 70])
def test_paths_of_many_features(n):
    """A chain that tests every feature once; beyond 62 features a set is no machine word."""
    node = np.arange(2 * n + 1)
    inner = node % 2 == 0
    inner[-1] = False
    tree = (-1, np.where(inner, node // 2, -1), np.zeros(2 * n + 1), np.where(inner, node + 1, -1), np.where(inner, node + 2, -1),
            np.where(node % 2 == 1, 1.0, n - node // 2 + 1.0), np.where(node % 2 == 1, node, -3.0))
    x = np.random.default_rng(1).normal(-1.5, 1, size=(n, 40)) * -1
    x[:, 0] = 1.0
    walk, phi, pairs = treeshap.Walk(tree, 1, n), np.zeros((n, 1, 40)), np.zeros((n, n, 1, 40))
    walk.shap(x, phi)
    walk.interactions(x, pairs, [0])
    every = walk.expected(x, np.ones((1, n), bool))[0, 0]
    first = (x <= 0).argmax(axis=0)
    assert np.allclose(every, np.where((x <= 0).any(axis=0), 2 * first + 1, -3.0))
    assert np.allclose(phi[:, 0].sum(axis=0) + walk.mean[0], every)
    alone = np.eye(n, dtype=bool)
    gap = every - walk.expected(x, alone)[:, 0] - walk.expected(x, ~alone)[:, 0] + walk.mean[0]
    assert np.allclose(2 * (pairs + pairs.transpose(1, 0, 2, 3)).sum(axis=1)[:, 0], gap)


def test_trees_of_a_single_leaf(spark):
    df = assemble(spark.createDataFrame([(1, 1.0, 2.0)] * 6, "id int, label double, a double"), ["a"])
    model = models.random_forest(2)(df)
    rows = treeshap.shap_values(model, df, "id", ["a"]).collect()
    assert len(rows) == 6 and all(np.allclose(r.phi, 0) for r in rows)


def test_shap_tables(spark, data, forest):
    pdf, df = data
    shap = treeshap.shap_values(forest, df, "id", FEATS).cache()
    phi, inter = walked(forest, pdf[FEATS].to_numpy())
    phi = phi.transpose(2, 0, 1)
    mean = {(r["class"], r.feature): r.mean_abs_shap for r in treeshap.mean_abs_shap(shap, FEATS, CLASSES).collect()}
    assert mean[("S", "a")] == pytest.approx(np.abs(phi[:, 0, 1]).mean())
    long = treeshap.shap_long(shap, FEATS, CLASSES)
    assert long.count() == 240 * 15
    assert long.filter("feature = 'b' and class = 'U' and key = 3").first().value == pytest.approx(phi[3, 1, 2])
    best = treeshap.top_features(treeshap.mean_abs_shap(shap, FEATS, CLASSES), "S", 2)
    swarm = treeshap.beeswarm(shap, FEATS, CLASSES, "S", 2)
    assert {r.feature for r in swarm.collect()} == set(best) and swarm.count() == 480
    dep = treeshap.dependence(shap, FEATS, CLASSES, "d", "S", "a", 1.0).filter("key = 7").first()
    assert (dep.value, dep.colour, dep.above_threshold) == (pdf.d[7], pdf.a[7], bool(pdf.d[7] > 1))
    strength = np.abs(inter).mean(axis=-1) * 2
    found = treeshap.interaction_strength(forest, df, "id", FEATS, CLASSES).collect()
    assert len(found) == 30
    for r in found:
        assert r.strength == pytest.approx(strength[FEATS.index(r.feature_1), FEATS.index(r.feature_2), CLASSES.index(r["class"])])
    one = treeshap.interaction_strength(forest, df, "id", FEATS, CLASSES, ["S"]).collect()
    assert sorted(one) == sorted(r for r in found if r["class"] == "S")


def test_parent_sums(spark):
    pairs = spark.createDataFrame([("c_x", "n", 1.0), ("c_y", "n", 2.0), ("c_x", "c_y", 9.0)],
                                  "feature_1 string, feature_2 string, strength double")
    parents = {"c_x": "c", "c_y": "c"}
    sums = treeshap.parent_interactions(pairs, parents)
    effects = treeshap.parent_effects(spark.createDataFrame(
        [("c_x", 1.0), ("c_y", 1.0), ("n", 4.0)], "feature string, mean_abs_shap double"), parents)
    r = treeshap.normalized_interactions(sums, effects).collect()
    assert len(r) == 1 and (r[0].interaction, r[0].strength, r[0].relative_pct) == ("c x n", 3.0, 100.0)


def test_ridge_matches_the_normal_equations(data):
    pdf, df = data
    got = models.ridge_classifier()(assemble(df, FEATS))
    x, y = pdf[FEATS].to_numpy(), pdf.label.to_numpy()
    w = np.array([len(y) / (3 * (y == v).sum()) for v in y])
    t = np.where(y[:, None] == np.arange(3), 1.0, -1.0)
    xc, tc = x - np.average(x, axis=0, weights=w), t - np.average(t, axis=0, weights=w)
    want = np.linalg.solve(xc.T @ (w[:, None] * xc) + np.eye(5), xc.T @ (w[:, None] * tc)).T
    assert np.allclose(got.weights, want)
    scores = x @ want.T + got.intercepts
    pred = got.transform(assemble(df, FEATS)).orderBy("id").toPandas()["prediction"].to_numpy()
    assert (pred == scores.argmax(axis=1)).all()


def test_registry_names():
    assert list(models.model_registry()) == [
        "DecisionTree", "RandomForest", "LogisticRegression", "RidgeClassifier", "LinearSVC", "GradientBoosting"]


def test_every_row_is_predicted_once_per_repeat(data):
    _, df = data
    made = folds.repeated_folds(df, "id", "label", 2, 2)
    fits = {"DecisionTree": models.decision_tree(3), "LogisticRegression": models.logistic(max_iter=20)}
    pred = models.fit_predict(df, "id", FEATS, made, fits, models.Resampler(tuple(FEATS)))
    counts = pred.groupBy("Model", "Fold").agg(F.count("*").alias("n"), F.countDistinct("id").alias("d")).collect()
    assert len(counts) == 8 and all(r.n == r.d for r in counts) and sum(r.n for r in counts) == 240 * 4


def test_importance_of_used_unused_and_constant_features(data, forest):
    _, df = data
    wide = df.withColumn("same", F.lit(0.0))
    model = models.random_forest(10, max_depth=5)(assemble(wide, [*FEATS, "same"]))
    for metric in ("accuracy", "macro_f1"):
        got = {r.Feature: r.Decrease for r in importance.permutation_scores(
            model, wide, "id", [*FEATS, "same"], metric).collect()}
        assert got["same"] == 0 and got["a"] > 0.05 and got["a"] > got["e"]


def test_elimination_keeps_the_signal(data):
    _, df = data
    out = {r.Feature: r for r in importance.rfecv(df, "id", ["a", "d", "e"], models.random_forest(5, max_depth=4), 2).collect()}
    assert out["a"].Support and min(r.Ranking for r in out.values()) == 1
    assert all(r.Support == (r.Ranking == 1) for r in out.values())


def test_few_training_rows_give_the_same_forest_whatever_their_partitions(data):
    _, df = data
    rows = assemble(df, FEATS).withColumn("rid", F.xxhash64("id")).select("label", "features", "rid")
    one, other = (models.random_forest(4, max_depth=5)(rows.repartition(n)) for n in (3, 7))
    assert one.toDebugString.split("\n", 1)[1] == other.toDebugString.split("\n", 1)[1]
