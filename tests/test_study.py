import pytest
from pyspark.sql import functions as F

from tabulon.operators import models
from tabulon.operators.columns import feature_set
from tabulon.operators.models import random_forest
from tabulon.plans import queries_models, study
from tabulon.sources import read_survey

COLUMNS = ["Degree of damage_u", "Status_U", "Tornado_EF", "Latitude", "Longitude", "tornado_start_lat",
           "tornado_start_long", "tornado_end_lat", "tornado_end_long", "Year built_u", "Building_area_m2.",
           "buidling_height_m", "wall_length_front", "wall_length_side", "wall_thickness", "parapet_height_m",
           "wall_fenestration_per_n", "roof_slope_u", "archetype"]


def write_source(path, shift, encoding):
    lines = [",".join(["Unnamed: 0", *COLUMNS])]
    for i in range(45):
        damage = ["0", "0", "0", "1", "3"][i % 5]
        status = {"0": "undamaged", "1": "Minor", "3": "severe"}[damage]
        lines.append(",".join(map(str, [
            i, damage if i != 7 else "1.5", status, ["subEF", "EF2", "N/A"][i % 3], 36 + i / 100, -87 + shift, 36, -87,
            36.5, -86.5, 1880 + i if i % 9 else "un", '"1,200"' if i % 2 else "Unknown ", 5 + int(damage), 10, 20 if i else 0,
            300 if i % 4 else "na", 0.5, 12, "30.0" if shift else "30", "résidence" if i % 2 else "n/a"])))
    path.write_bytes("\n".join(lines).encode(encoding))


@pytest.fixture(scope="module")
def survey(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("survey")
    write_source(folder / "a.csv", 0.0, "utf-8")
    write_source(folder / "b.csv", 0.2, "latin-1")
    raw = {"a": read_survey(spark, str(folder / "a.csv")), "b": read_survey(spark, str(folder / "b.csv"), "ISO-8859-1")}
    df = study.load_survey(raw).withColumn("row_id", F.concat("dataset_source", F.lit("-"), "unnamed:_0"))
    fs = feature_set("Engineered")
    return study.engineer(df, "row_id", fs.numeric, fs.categorical)


def test_engineered_columns(survey):
    rows = {r.row_id: r for r in survey.collect()}
    assert len(rows) == 90
    assert rows["a-7"].target is None and rows["a-3"].target == "Low" and rows["a-3"].status_target == "Low"
    assert rows["a-0"].ef_numeric == -1 and rows["a-2"].ef_numeric is None
    assert rows["a-1"].building_area_m2 == 1200 and rows["a-2"].building_area_m2 is None
    assert {r.roof_slope_u for r in rows.values()} == {"30"}
    assert rows["b-1"].archetype == "résidence" and rows["b-2"].archetype is None
    assert rows["a-0"].distance_km == pytest.approx(0) and rows["b-0"].distance_km > 1
    assert rows["a-0"].aspect_ratio is None and rows["a-1"].aspect_ratio == pytest.approx(0.5)
    assert rows["a-4"].wall_slenderness is None and rows["a-0"].mean_fenestration == 12


def test_prepared_tables_have_no_gaps(survey):
    fs = feature_set("Engineered")
    for strategy, flags in (("median", ()), ("iterative", ()), ("indicator", ("wall_thickness",))):
        prep = study.prepare(survey, "row_id", fs, strategy, flags)
        assert prep.classes == ["Low", "Significant", "Undamaged"]
        nulls = prep.table.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in prep.features]).first()
        assert prep.table.count() == 88 and not any(nulls)
        assert ("wall_thickness_is_missing" in prep.features) == (strategy == "indicator")


def test_cross_validation_end_to_end(survey):
    prep = study.prepare(survey, "row_id", feature_set("Distance"))
    scores, pred = study.cross_validate(prep, "row_id", {"RandomForest": random_forest(5, max_depth=4)}, 2, 1)
    rows = scores.collect()
    assert len(rows) == 2 and all(0.8 < r.Accuracy <= 1 for r in rows)  # height gives the label away
    assert pred.count() == 88


def test_bounded_fits_score_every_row(spark):
    rows = [(i, float(i % 3), float(i % 3 * 10 + i % 7)) for i in range(600)]
    table = spark.createDataFrame(rows, "id long, label double, x double")
    prep = study.Prepared(table, ["x"], ["x"], [], ["a", "b", "c"])
    fitted = []

    def fit(train):
        fitted.append(train.count())
        return models.random_forest(5, 1)(train)

    _, pred = study.cross_validate(prep, "id", {"RandomForest": fit}, 3, 1, resample=False, fit_rows=90)
    assert fitted == [90] * 3
    assert sorted(r["id"] for r in pred.select("id").collect()) == list(range(600))


def test_survey_query_scores_the_whole_survey(spark, monkeypatch):
    sizes = []

    def cross_validate(prep, key, *args, **kwargs):
        sizes.append(prep.table.count())
        raise InterruptedError

    monkeypatch.setattr(queries_models, "FIT_ROWS", 50)
    monkeypatch.setattr(study, "cross_validate", cross_validate)
    sf = "/root/testdata/sf0.001"
    with pytest.raises(InterruptedError):
        queries_models.survey_cross_validation(spark, sf)
    assert sizes[0] > 1000


def test_survey_query_fits_to_every_training_row(spark, monkeypatch, tmp_path):
    """Four fifths of the labelled rows, with no bound on their number."""
    n = 6_000
    spark.range(n).select(
        F.col("id").alias("l_orderkey"), (F.col("id") % 50).alias("l_partkey"), (F.col("id") % 7).alias("l_suppkey"),
        F.lit(1).alias("l_linenumber"), F.expr("id % 50 + 1").cast("double").alias("l_quantity"),
        F.expr("id % 997 + 900").cast("double").alias("l_extendedprice"), F.expr("(id % 11) / 100").cast("double").alias("l_discount"),
        F.expr("(id % 9) / 100").cast("double").alias("l_tax"), F.lit("O").alias("l_linestatus")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(50).select(F.col("id").alias("p_partkey"), (F.col("id") % 40 + 1).cast("int").alias("p_size"),
                           F.lit("tin").alias("p_type"), F.lit("b1").alias("p_brand")).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(n).select(F.col("id").alias("o_orderkey"), F.lit("5-LOW").alias("o_orderpriority")).write.parquet(f"{tmp_path}/orders.parquet")
    labelled, seen = [], []

    def training_rows(train, *args):
        seen.append(train.count())
        raise InterruptedError

    real = study.cross_validate
    monkeypatch.setattr(study, "cross_validate", lambda prep, *args, **kw: (labelled.append(prep.table.count()), real(prep, *args, **kw))[1])
    monkeypatch.setattr(models, "training_rows", training_rows)
    with pytest.raises(InterruptedError):
        queries_models.survey_cross_validation(spark, str(tmp_path))
    assert labelled[0] > 5_500 and min(seen) >= labelled[0] * 4 // 5 - 1
