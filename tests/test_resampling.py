import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulon.operators import folds, neighbors, resample


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(0)
    n = 400
    pdf = pd.DataFrame({"id": np.arange(n), "y": np.where(np.arange(n) < 120, "a", "b"),
                        "x1": rng.integers(0, 50, n) * 1.0, "x2": rng.normal(size=n).round(2),
                        "c1": rng.integers(0, 3, n) * 1.0, "c2": rng.integers(0, 40, n) * 1.0})
    pdf.loc[200:333, ["x1", "x2", "c1", "c2"]] = [1.0, 2.0, 1.0, 1.0]  # a third are copies
    return pdf, spark.createDataFrame(pdf).cache()


def brute(pdf, k):
    out = {}
    for _, g in pdf.groupby("y"):
        penalty = np.median(g[["x1", "x2"]].std(ddof=0)) ** 2
        x, c, ids = g[["x1", "x2"]].to_numpy(), g[["c1", "c2"]].to_numpy(), g["id"].to_numpy()
        for i in range(len(g)):
            d2 = (x[i, 0] - x[:, 0]) ** 2 + (x[i, 1] - x[:, 1]) ** 2 + (c[i] != c).sum(1) * penalty
            d2[i] = np.inf
            out[ids[i]] = list(ids[np.lexsort((ids, d2))[:k]])
    return out


@pytest.mark.parametrize("sizes", [{}, {"cell_rows": 20, "block_rows": 16}, {"cell_rows": 5}])
def test_neighbors_match_brute_force(mixed, sizes):
    pdf, df = mixed
    got = {}
    table = neighbors.neighbor_table(df, "id", "y", ["x1", "x2"], ["c1", "c2"], 5, **sizes)
    for r in table.orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbor"])
    assert got == brute(pdf, 5)


def test_pivots_in_many_columns_visit_few_cells(spark):
    """Thirty columns: neighbours are exact, and bounds spare most cells where rows form groups."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(20, 30)) * 6
    x = centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 30))
    names = [f"x{i}" for i in range(30)]
    pdf = pd.DataFrame(x, columns=names)
    pdf["c"], pdf["id"], pdf["y"] = rng.integers(0, 5, 3000) * 1.0, np.arange(3000), "a"
    report = {}
    df = spark.createDataFrame(pdf)
    lists = neighbors.nearest_lists(df, "id", "y", names, ["c"], 4, cell_rows=50, block_rows=40, report=report)
    got = {r["near"][0]["key"]: [n["key"] for n in r["near"]] for r in lists.collect()}
    penalty = np.median(x.std(axis=0)) ** 2
    for i in rng.integers(0, 3000, 200):
        d2 = ((x[i] - x) ** 2).sum(axis=1) + (pdf.c[i] != pdf.c).to_numpy() * penalty
        assert got[i] == list(np.lexsort((np.arange(3000), d2))[:5])
    assert len(got) == report["vectors"] == 3000 and report["cells"] >= 40
    assert report["visits"] < 0.35 * report["vectors"] * report["cells"]


def test_smotenc_balances_and_stays_inside_the_class(mixed):
    pdf, df = mixed
    out = resample.smotenc(df, "id", "y", ["x1", "x2"], ["c1", "c2"], 5).toPandas()
    assert out.groupby("y").size().to_dict() == {"a": 280, "b": 280}
    real = out[~out["synthetic"]].drop(columns="synthetic").sort_values("id").reset_index(drop=True)
    pd.testing.assert_frame_equal(real[pdf.columns], pdf, check_dtype=False)
    new, a = out[out["synthetic"]], pdf[pdf["y"] == "a"]
    assert set(new["y"]) == {"a"}
    for c in ("x1", "x2"):
        assert new[c].between(a[c].min(), a[c].max()).all()
    for c in ("c1", "c2"):
        assert set(new[c]) <= set(a[c])


def test_small_class_falls_back_to_the_raw_rows(spark, caplog):
    df = spark.createDataFrame([(i, "a" if i < 4 else "b", float(i)) for i in range(20)], "id int, y string, x double")
    with pytest.raises(ValueError):
        resample.smote(df, "id", "y", ["x"], 5)
    out = resample.smote(df, "id", "y", ["x"], 5, few="keep")
    assert out.count() == 20 and "used as they are" in caplog.text


def test_folds_cover_rows_evenly_for_any_partitioning(spark):
    df = spark.range(503).withColumn("y", F.when(F.col("id") % 10 == 0, "rare").otherwise("often"))
    a = folds.repeated_folds(df.repartition(1), "id", "y", 5, 2).join(df, "id").toPandas()
    b = folds.repeated_folds(df.repartition(6), "id", "y", 5, 2).join(df, "id").toPandas()
    order = ["repeat", "id"]
    pd.testing.assert_frame_equal(a.sort_values(order, ignore_index=True), b.sort_values(order, ignore_index=True))
    assert len(a) == 1006 and not a.duplicated(["repeat", "id"]).any()
    sizes = a.groupby(["repeat", "y", "fold"]).size().unstack()
    assert (sizes.max(axis=1) - sizes.min(axis=1)).max() <= 1
    first, second = (a[a["repeat"] == r].sort_values("id")["fold"].tolist() for r in (0, 1))
    assert first != second


def test_permutation_keeps_the_values_of_each_group(spark):
    df = spark.range(200).withColumn("g", F.col("id") % 2).withColumn("v", F.col("id") * 10)
    out = folds.permute_column(df, "id", "v", ["g"]).toPandas()
    assert len(out) == 200 and (out["v"] != out["id"] * 10).mean() > 0.9
    assert (out["v"] // 10 % 2 == out["g"]).all() and sorted(out["v"]) == [i * 10 for i in range(200)]
