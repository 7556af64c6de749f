import pytest
from pyspark.sql import functions as F

from tabulon import sources
from tabulon.operators import columns, encode, ordering, summaries


def test_read_name_and_unite_two_files(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_bytes("Unnamed: 0,Roof Slope.U,Name\n1,30,\"x, y\"\n2,un,z\n".encode())
    b.write_bytes("ROOF SLOPE.u,Città\n30.0,è\n".encode("latin-1"))
    first = sources.normalize_columns(sources.read_survey(spark, str(a)))
    second = sources.normalize_columns(sources.read_survey(spark, str(b), "ISO-8859-1"))
    assert second.columns == ["roof_slopeu", "città"]
    assert sources.common_columns(first, second) == ["roof_slopeu"]
    both = sources.union_sources(sources.with_source(first, "a"), sources.with_source(second, "b"))
    assert sources.drop_unnamed(both).columns == ["roof_slopeu", "name", "dataset_source", "città"]
    rows = {r["name"]: r for r in both.collect()}
    assert rows["x, y"]["città"] is None and rows[None]["città"] == "è"
    assert sources.columns_like(both, "SLOPE") == ["roof_slopeu"]
    assert sources.header_is_data(spark.createDataFrame([("roof slope", "Name")], "a string, b string"),
                                  ["Roof Slope", "name"])
    assert not sources.header_is_data(both, ["Roof Slope", "name", "x"])


def test_colliding_names_are_an_error(spark):
    with pytest.raises(ValueError):
        sources.normalize_columns(spark.createDataFrame([(1, 2)], ["A b", "a.b "]).withColumnRenamed("a.b ", "a_b"))


def test_profile_counts(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "b")], "n int, s string")
    got = {r["column"]: r for r in sources.profile(df).collect()}
    assert (got["n"].rows, got["n"].non_null, got["n"].distinct, got["n"].type) == (3, 3, 2, "int")
    assert (got["s"].non_null, got["s"].distinct, got["s"].min_value) == (2, 2, "a")


def test_feature_sets():
    assert "distance_km" not in columns.feature_set("Hazard-Neutral").all
    assert "ef_numeric" in columns.feature_set("Hazard-Inclusive").all
    assert "aspect_ratio" in columns.feature_set("Engineered").all
    assert columns.feature_set("Status-Target").label == "status_target"
    assert columns.drop_leaky(["a", "degree_of_Damage_u"]) == ("a",)
    with pytest.raises(ValueError):
        columns.feature_set("none")


def test_existing_columns(spark):
    df = spark.createDataFrame([(1,)], ["a"])
    assert columns.existing(["a", "b"], df) == ["a"]
    with pytest.raises(ValueError):
        columns.existing(["a", "b"], df, strict=True)


@pytest.mark.parametrize("partitions, accuracy", [(1, 10_000), (5, 10_000), (5, 40)])
def test_ranks_and_quantiles_with_a_hot_value(spark, partitions, accuracy):
    data = [("g", 7.0)] * 400 + [("g", float(i % 13)) for i in range(200)] + [("h", float(i)) for i in range(4)] + [("h", None)]
    df = spark.createDataFrame(data, "k string, v double").repartition(partitions)
    import pandas as pd

    pdf = pd.DataFrame(data, columns=["k", "v"])
    want = pdf.assign(r=pdf.groupby("k")["v"].rank(ascending=False)).dropna().groupby(["k", "v"])["r"].first().to_dict()
    ranked = ordering.average_rank(df, "v", "r", ["k"])
    assert ranked.count() == len(data)
    got = {(r.k, r.v): r.r for r in ranked.collect()}
    assert got.pop(("h", None)) is None and got == want
    q = {r.k: (r.n, r.a, r.b) for r in ordering.exact_quantiles(df, ["k"], "v", {"a": 0.3, "b": 0.5}, accuracy).collect()}
    for k, part in pdf.dropna().groupby("k"):
        assert q[k] == pytest.approx((len(part), part["v"].quantile(0.3), part["v"].median()))


def test_bracketed_quantiles_of_many_values(spark):
    import numpy as np

    values = np.random.default_rng(5).gamma(0.3, size=5000)
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(7)
    probs = {"p0": 0.0, "p01": 0.001, "p25": 0.25, "p50": 0.5, "p99": 0.999, "p100": 1.0}
    r = ordering.exact_quantiles(df, [], "v", probs, accuracy=200).first()
    assert r.n == 5000
    for name, p in probs.items():
        assert r[name] == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_prefix_sums_over_many_partitions(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3).withColumn("w", F.col("id") % 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordering.prefix_sums(df, ["k"], [F.col("id").desc()], {"before": "w"}).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for r in got:
        assert r.before == sum(i % 7 for i in range(r.id + 3, 1000, 3))


def test_hash_position_numbers_every_row_once(spark):
    df = spark.range(500).withColumn("k", F.when(F.col("id") < 400, "a")).withColumn("h", F.md5(F.col("id").cast("string")))
    got = ordering.hash_position(df, "h", "p", ["k"], ["id"]).collect()
    for k in ("a", None):
        rows = sorted((r for r in got if r.k == k), key=lambda r: r.h)
        assert [r.p for r in rows] == list(range(len(rows))) and rows


def test_encoders(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string")
    codes, levels = encode.ordinal_encode(df, ["c"])
    assert levels == {"c": ["a", "b", "nan"]} and [r.c for r in codes.collect()] == [1.0, 0.0, 2.0, 1.0]
    later = spark.createDataFrame([("z",), ("a",)], "c string")
    assert [r.c for r in encode.ordinal_encode(later, ["c"], levels)[0].collect()] == [-1.0, 0.0]
    kept, _ = encode.ordinal_encode(df, ["c"], keep_null=True)
    assert [r.c for r in kept.collect()] == [1.0, 0.0, None, 1.0]
    hot, made = encode.one_hot(df, ["c"])
    assert hot.columns == ["c_b", "c_nan"] and made.parents == {"c_b": "c", "c_nan": "c"}
    assert [tuple(r) for r in hot.collect()] == [(1, 0), (0, 0), (0, 1), (1, 0)]
    with pytest.raises(ValueError):
        encode.check_levels(df, ["c"], limit=1)


def test_median_of_even_count_and_empty_column(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None), (4.0, None), (None, None)], "a double, b double")
    out, fitted = encode.impute_median(df, ["a"])
    assert fitted == {"a": 2.5} and sorted(r.a for r in out.collect()) == [1, 2, 2.5, 3, 4]
    assert columns.drop_all_null(df, ["a", "b"]).columns == ["a"]
    with pytest.raises(ValueError):
        encode.impute_median(df, ["a", "b"])


def test_medians_from_narrow_brackets(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    data = {"a": rng.gamma(0.5, size=3001), "b": np.round(rng.normal(size=3001)), "c": np.full(3001, 7.0)}
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*data.values())], "a double, b double, c double")
    got = {r["column"]: r["median"] for r in encode.medians(df.repartition(6), list(data), accuracy=100).collect()}
    assert got == {c: pytest.approx(np.median(v)) for c, v in data.items()}


def test_iterative_imputation_finds_a_linear_rule(spark):
    rows = [(i, float(i), 2.0 * i + 1 if i % 5 else None, float(i % 3), float(i % 3) if i % 7 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, x double, y double, z double, c double")
    out = {r.id: r for r in encode.impute_iterative(df, ["x", "y", "z", "c"], 6, codes=["c"]).collect()}
    for i in range(0, 200, 5):
        assert out[i].y == pytest.approx(2 * i + 1, abs=0.5)
    assert all(out[i].c == i % 3 for i in range(0, 200, 7))
    assert out[1].y == 3.0


def test_iterative_imputation_stays_bounded_on_collinear_gaps(spark):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(150):
        a, b = rng.uniform(1, 5), rng.uniform(1, 5)
        full = [a, b, a + b, a - b, 2 * a + b]
        gap = rng.random() < 0.4
        rows.append(tuple([i, *[None if gap and j > 0 else v for j, v in enumerate(full)]]))
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double, e double")
    out = encode.impute_iterative(df, list("abcde"), 8).agg(*[f for c in "abcde" for f in (F.min(c), F.max(c))]).first()
    assert all(v is not None and -20 < v < 40 for v in out)


@pytest.mark.parametrize("rounds", [1, 6])
def test_gap_patterns_give_the_numbers_of_column_passes(spark, rounds):
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) + [0, 10, 1000, -3, 5]
    x[rng.random(x.shape) < [0.0, 0.1, 0.4, 0.2, 0.05]] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double, e double").repartition(7)
    want = encode.impute_iterative(df, list("abcde"), rounds, refit="column").orderBy("id").toPandas()
    got = encode.impute_iterative(df, list("abcde"), rounds).orderBy("id").toPandas()
    assert list(got.columns) == list(want.columns)
    assert np.allclose(got.to_numpy(), want.to_numpy(), rtol=1e-7, atol=1e-7)
    assert np.array_equal(got[list("abcde")].to_numpy()[~np.isnan(x)], x[~np.isnan(x)])


def test_many_gap_patterns_go_by_columns(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i) if i % 3 else None, float(2 * i) if i % 5 else None) for i in range(60)], "id int, x double, y double")
    want = encode.impute_iterative(df, ["x", "y"], 3).orderBy("id").collect()
    monkeypatch.setattr(encode, "MAX_PATTERNS", 2)
    got = encode.impute_iterative(df, ["x", "y"], 3).orderBy("id").collect()
    assert all(a.x == pytest.approx(b.x) and a.y == pytest.approx(b.y) for a, b in zip(got, want))
    with pytest.raises(ValueError):
        encode.impute_iterative(df.withColumn("z", F.lit(None).cast("double")), ["x", "z"])


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2, "y string")
    assert {r.y: r.weight for r in encode.class_weights(df, "y").collect()} == {"a": 8 / 12, "b": 2.0}
    assert {r.y: r.weight for r in encode.add_class_weight(df, "y").collect()} == {"a": 8 / 12, "b": 2.0}


def test_box_and_bands(spark):
    df = spark.createDataFrame([("g", float(v)) for v in [1, 2, 3, 4, 5, 100]], "k string, v double")
    r = summaries.box_stats(df, "v", ["k"]).first()
    assert (r.q1, r.median, r.q3, r.whisker_lo, r.whisker_hi, r.outliers) == (2.25, 3.5, 4.75, 1, 5, 1)
    assert summaries.box_outliers(df, "v", ["k"]).first().v == 100
    years = spark.createDataFrame([(1870, "a"), (1880, "a"), (1899, "b"), (1960, "a")], "y int, t string")
    got = {r.band: (r.a, r.b) for r in summaries.band_crosstab(years, "y", [1880, 1900], "t", ["a", "b"]).collect()}
    assert got == {"Pre-1880": (100.0, 0.0), "1880-1900": (50.0, 50.0)}


def test_bootstrap_draws_are_those_of_the_words(spark):
    import hashlib

    import numpy as np

    rows = [(i, "ab"[i % 3 == 0], float(i * i % 17) if i != 4 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, g string, v double").repartition(3)
    got = {r["g"]: r for r in summaries.bootstrap_mean_ci(df, ["g"], "v", "id", 10, seed=7).collect()}
    for g in "ab":
        mine = [(i, v) for i, k, v in rows if k == g and v is not None]
        means = []
        for rep in range(10):
            w = []
            for i, _ in mine:
                word = hashlib.md5(f"{i}:{rep // 4}:7".encode()).hexdigest()[8 * (rep % 4):8 * (rep % 4) + 8]
                u = (int(word, 16) + 0.5) / 2 ** 32
                w.append(sum(u >= p for p in summaries._POISSON_CDF))
            means.append(np.dot(w, [v for _, v in mine]) / sum(w) if sum(w) else np.nan)
        means = np.array([m for m in means if not np.isnan(m)])
        assert got[g]["n"] == len(mine) and got[g]["mean"] == pytest.approx(np.mean([v for _, v in mine]))
        assert (got[g]["ci_lo"], got[g]["ci_hi"]) == pytest.approx((np.quantile(means, 0.025), np.quantile(means, 0.975)))


def test_bootstrap_keeps_null_and_many_groups(spark, monkeypatch):
    monkeypatch.setattr(summaries, "_HELD_GROUPS", 3)
    df = spark.createDataFrame([(i, None if i % 9 == 0 else i % 9, float(i)) for i in range(180)], "id int, g int, v double")
    got = summaries.bootstrap_mean_ci(df.coalesce(1), ["g"], "v", "id", 40).collect()
    assert len(got) == 9 and all(r["ci_lo"] <= r["mean"] <= r["ci_hi"] and r["n"] == 20 for r in got)


def test_bootstrap_interval_covers_the_mean(spark):
    df = spark.range(300).withColumn("g", F.lit("x")).withColumn("v", (F.col("id") % 10).cast("double"))
    r = summaries.bootstrap_mean_ci(df, ["g"], "v", "id", 200).first()
    assert r["mean"] == 4.5 and r.ci_lo < 4.5 < r.ci_hi and 0.4 < r.ci_hi - r.ci_lo < 0.9
