import itertools
import math

import numpy as np
import pandas as pd
import pytest

from tabulon.operators import evaluate, importance, stats
from tests import golden


def test_published_p_values_and_difference(spark):
    rows = [("s", m, i, v, v) for m, vs in golden.FOLD_SCORES.items() for i, v in enumerate(vs)]
    scores = spark.createDataFrame(rows, "Setting string, Model string, Fold int, MacroF1 double, Accuracy double")
    got = {r.Model: r for r in stats.model_equivalence(scores).collect()}
    assert {r.Best_Model for r in got.values()} == {"RandomForest"}
    for m, p in golden.P_VALUES.items():
        assert got[m].p_value == pytest.approx(p, abs=1e-12)
    diff = np.mean(golden.FOLD_SCORES["RandomForest"]) - np.mean(golden.FOLD_SCORES["XGBoost"])
    assert got["XGBoost"].Diff_Mean == pytest.approx(diff)
    assert got["DecisionTree"].p_holm == pytest.approx(2 * golden.P_VALUES["DecisionTree"])
    means = {r.Model: r for r in evaluate.summarize(scores).collect()}
    assert means["RandomForest"].MacroF1_mean == pytest.approx(0.5812, abs=5e-5)
    assert means["XGBoost"].MacroF1_mean == pytest.approx(0.5785, abs=5e-5)


def test_published_rank_correlation(spark):
    df = spark.createDataFrame(list(zip(golden.RANKS_A, golden.RANKS_B)), "a int, b int")
    r = stats.spearman(df, "a", "b").first()
    assert r.n == 34 and r.rho == pytest.approx(0.4955, abs=5e-5) and r.p_value == pytest.approx(0.0029, abs=5e-5)


@pytest.mark.parametrize("n", [1, 4, 8])
def test_signed_rank_p_by_listing_signs(n):
    rng = np.random.default_rng(n)
    d = rng.normal(size=n)
    rank = pd.Series(np.abs(d)).rank().to_numpy()
    plus = rank[d > 0].sum()
    w = min(plus, rank.sum() - plus)
    sums = [sum(r for r, s in zip(rank, signs) if s) for signs in itertools.product((0, 1), repeat=n)]
    want = min(1.0, 2 * np.mean([s <= w for s in sums]))
    assert stats.signed_rank_p(n, plus, 0, 0) == pytest.approx(want)


def test_rank_sum_p_by_listing_choices():
    for n1, n2, u in ((3, 4, 10), (2, 5, 10), (4, 4, 8)):
        us = [sum(c) - n1 * (n1 + 1) / 2 for c in itertools.combinations(range(1, n1 + n2 + 1), n1)]
        far = max(u, n1 * n2 - u)
        assert stats.rank_sum_p(n1, n2, u, 0) == pytest.approx(min(1.0, 2 * np.mean([x >= far for x in us])))


def test_incomplete_beta_identities():
    assert stats.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)
    assert stats.incomplete_beta(0.5, 0.5, 0.25) == pytest.approx(2 / math.pi * math.asin(0.5))
    assert stats.correlation_p(1.0, 10) == 0.0


def test_signed_rank_drops_zeros_and_ties(spark):
    rows = [("k", 1.0, 0.0), ("k", 0.0, 1.0), ("k", 3.0, 1.0), ("k", 2.0, 2.0), ("z", 1.0, 1.0)]
    got = {r.k: r for r in stats.signed_rank(spark.createDataFrame(rows, "k string, a double, b double"), ["k"], "a", "b").collect()}
    assert (got["k"].n, got["k"].zeros, got["k"].w, got["k"].ties) == (3, 1, 1.5, 6)
    assert got["z"].n == 0
    p = {r.k: r.p_value for r in stats.wilcoxon(spark.createDataFrame(rows, "k string, a double, b double"), ["k"], "a", "b").collect()}
    assert p["z"] == 1.0


def test_mann_whitney_of_separate_groups(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(4)] + [("b", float(i + 10)) for i in range(4)], "g string, v double")
    r = stats.mann_whitney(df, "g", "v", "a", "b").first()
    assert (r.u1, r.p_value) == (0.0, pytest.approx(2 / 70))


def test_tiers_start_where_features_differ(spark):
    rng = np.random.default_rng(1)
    rows = [("s", "m", f, i, base + rng.normal() * 0.01) for f, base in (("a", 1.0), ("b", 1.0), ("c", 0.2)) for i in range(25)]
    imp = spark.createDataFrame([tuple(map(lambda v: float(v) if isinstance(v, np.floating) else v, r)) for r in rows],
                                "Setting string, Model string, Feature string, Fold int, Decrease_in_Accuracy double")
    tiers = {r.Feature: r.Tier for r in stats.feature_tiers(imp).collect()}
    assert tiers["c"] == max(tiers.values()) and tiers["c"] > min(tiers.values())


def test_report_by_hand(spark):
    pred = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y string, yhat string")
    rep = {r["class"]: r for r in evaluate.report_pooled(pred).collect()}
    assert (rep["b"].precision, rep["b"].recall, rep["b"].f1) == pytest.approx((1 / 3, 1, 0.5))
    assert rep["c"].f1 == 0 and rep["accuracy"].f1 == 0.5 and rep["weighted avg"].support == 4
    assert rep["macro avg"].f1 == pytest.approx((2 / 3 + 0.5 + 0) / 3)
    assert evaluate.macro_f1(pred).first().macro_f1 == pytest.approx((2 / 3 + 0.5 + 0) / 3)
    assert evaluate.class_f1(pred, "zzz").first().class_f1 == 0.0


def test_rank_tables(spark):
    a = spark.createDataFrame([("x", 3.0), ("y", 1.0), ("z", 1.0)], "Feature string, Mean double")
    b = spark.createDataFrame([("x", 1.0), ("w", 2.0)], "Feature string, Mean double")
    got = {r.Feature: r for r in importance.compare_ranks({"a": a, "b": b}).collect()}
    assert (got["x"].a_rank, got["y"].a_rank, got["z"].a_rank, got["w"].a_rank) == (1, 2.5, 2.5, None)
    assert got["w"].b_rank == 1 and got["y"].b_score is None
    assert {r.Feature for r in importance.common_features(a, b).collect()} == {"x"}
    with pytest.raises(ValueError):
        importance.feature_pairs(a, "Feature", limit=2)


def test_ranks_with_a_value_in_a_third_of_all_rows(spark, monkeypatch):
    """Heavy values and heavy nulls are cut over partitions; ranks are the average ones."""
    import numpy as np
    import pandas as pd
    from pyspark.sql import functions as F

    from tabulon.operators import ordering

    rng = np.random.default_rng(1)
    v = rng.normal(size=6000).round(2)
    v[:2000], v[2000:2500], v[5990:] = 0.5, np.nan, np.inf
    pdf = pd.DataFrame({"id": np.arange(6000), "g": rng.integers(0, 3, 6000), "v": v})
    rows = [(int(i), None if g == 2 else int(g), None if np.isnan(x) else float(x)) for i, g, x in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, "id int, g int, v double").repartition(5)
    few = {r["id"]: r["r"] for r in ordering.average_rank(df, "v", "r", ["g"]).collect()}
    seen = []
    real = ordering.materialize
    monkeypatch.setattr(ordering, "RANK_TABLE_BYTES", -1)
    monkeypatch.setattr(ordering, "materialize", lambda t, name="table": seen.append(real(t, name)) or seen[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for keys, by in (([], None), (["g"], "g")):
            for descending in (True, False):
                got = ordering.average_rank(df, "v", "r", keys, descending).orderBy("id").toPandas()
                want = (pdf.groupby(by).v if by else pdf.v).rank(ascending=not descending)
                assert len(got) == 6000 and np.allclose(got["r"].astype(float), want, equal_nan=True)
        many = {r["id"]: r["r"] for r in ordering.average_rank(df, "v", "r", ["g"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert many == few
    ordered = next(t for t in seen if "__part" in t.columns)
    sizes = [r["n"] for r in ordered.groupBy("__part").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 8 and max(sizes) < 2 * 6000 / len(sizes)
    empty = ordering.average_rank(df.filter("id < 0"), "v", "r")
    assert empty.collect() == [] and empty.columns == ["id", "g", "v", "r"]
