import math

import pytest
from pyspark.sql import functions as F

from tabulon.functions import clean, geo, hashing, ratios, text


def values(df, col):
    return [r[0] for r in df.select(col).collect()]


def frame(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_unknown_words_become_null_and_others_stay(spark):
    df = frame(spark, ["un", " Unknown\t", "N/A", "na", "none", "not_applicable", " brick ", None, "NAN"])
    assert values(df, clean.null_if_unknown("x")) == [None] * 4 + ["none", "not_applicable", " brick ", None, "NAN"]
    kept = values(clean.clean_reader_nulls(df), "x")
    assert kept[2] is None and kept[4] == "none" and kept[8] == "NAN"


def test_numbers_from_text(spark):
    df = frame(spark, ["1,200", "1 200", " 12 ", "30.0", "inf", "nan", "1d", "abc", None, "-3e2", ".5"])
    assert values(df, clean.to_numeric("x")) == [1200, 1200, 12, 30, None, None, None, None, None, -300, 0.5]
    assert values(df, clean.to_numeric("x", strip_grouping=False))[:2] == [None, None]


def test_labels(spark):
    df = frame(spark, [0.0, 0.5, 1.0, 1.5, 2.0, 5.0, -1.0, None], "double")
    want = ["Undamaged", None, "Low", None, "Significant", "Significant", None, None]
    assert values(df, clean.damage_label("x")) == want
    assert values(df, clean.damage_code("x")) == [0, None, 1, None, 2, 2, None, None]
    text_ = frame(spark, ["Undamaged", " MINOR", "moderate", "severe", "Destroyed ", "odd", None])
    assert values(text_, clean.status_label("x")) == [
        "Undamaged", "Low", "Significant", "Significant", "Significant", None, None]


def test_rating_parse(spark):
    df = frame(spark, ["subEF", "EF0", " ef2 ", "2", "2.7", "-1.5", "EFx", "", None])
    assert values(df, clean.parse_ef("x")) == [-1, 0, 2, 2, 2, -1, None, None, None]
    assert values(frame(spark, [-1, 3], "int"), clean.ef_display("x")) == ["sub", "3"]


def test_truthy_and_categories(spark):
    df = frame(spark, ["Yes", " y", "TRUE", "1", "no", None])
    assert values(df, clean.is_truthy("x")) == [True] * 4 + [False] * 2
    assert values(frame(spark, ["30.0", "30", "a.0", "-2.00"]), clean.canonical_category("x")) == ["30", "30", "a.0", "-2"]


def test_distances_by_hand(spark):
    one_degree = 6371.0 * math.pi / 180
    rows = [(1.0, 0.5, 0.0, 0.0, 0.0, 1.0),   # beside the track
            (0.0, 2.0, 0.0, 0.0, 0.0, 1.0),   # beyond its end
            (0.0, -1.0, 0.0, 0.0, 0.0, 1.0),  # before its start
            (1.0, 0.0, 0.0, 0.0, 0.0, 0.0),   # track of no length
            (None, 0.0, 0.0, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double")
    got = values(df, geo.segment_distance_km(*"abcdef"))
    assert got[:4] == pytest.approx([one_degree] * 4, abs=1e-9) and got[4] is None
    planar = values(df, geo.segment_distance_km(*"abcdef", method="planar"))
    assert planar[0] == pytest.approx(111.0) and planar[3] == pytest.approx(111.0) and planar[4] is None
    with pytest.raises(ValueError):
        geo.segment_distance_km(*"abcdef", method="flat")


def test_distance_is_symmetric_and_planar_is_within_the_end_distances(spark):
    # The haversine form projects in degrees, so its foot need not be the nearest point.
    df = spark.range(200).select(
        *[(F.rand(7 + i) * 2 + base).alias(c) for i, (c, base) in enumerate(zip("abcdef", (36, -87) * 3))])
    scale = F.cos(F.radians((F.col("c") + F.col("e") + F.col("a")) / 3)) * 111.0

    def end(lat, lon):
        return F.hypot((F.col("a") - F.col(lat)) * 111.0, (F.col("b") - F.col(lon)) * scale)

    row = df.select(geo.haversine_km("a", "b", "c", "d").alias("p"), geo.haversine_km("c", "d", "a", "b").alias("q"),
                    F.least(end("c", "d"), end("e", "f")).alias("r"),
                    geo.segment_distance_km(*"abcdef", method="planar").alias("s"))
    for x in row.collect():
        assert x["p"] == pytest.approx(x["q"], abs=1e-9)
        assert x["s"] <= x["r"] + 1e-9


def test_ratios_with_gaps_and_zeros(spark):
    cols = ["buidling_height_m", "wall_length_front", "wall_length_side", "building_area_m2", "wall_thickness",
            "parapet_height_m", *ratios.FENESTRATION]
    df = spark.createDataFrame([(6.0, 10.0, 20.0, 180.0, 300.0, 0.6, 10.0, None, 30.0, None),
                                (6.0, 0.0, 20.0, 180.0, 0.0, 0.6, None, None, None, None)],
                               ", ".join(f"{c} double" for c in cols))
    a, b = ratios.geometric_ratios(df).collect()
    assert (a.aspect_ratio, a.wall_slenderness, a.roof_wall_ratio, a.parapet_slenderness, a.plan_aspect_ratio,
            a.mean_fenestration) == pytest.approx((0.6, 20.0, 0.5, 2.0, 2.0, 20.0))
    assert b.aspect_ratio is None and b.wall_slenderness is None and b.mean_fenestration is None


def test_noise_does_not_depend_on_partitions(spark):
    one = hashing.add_noise(spark.range(5000).repartition(1), "id").orderBy("id")
    many = hashing.add_noise(spark.range(5000).repartition(7), "id").orderBy("id")
    a, b = values(one, "random_noise"), values(many, "random_noise")
    assert a == b
    mean = sum(a) / len(a)
    assert abs(mean) < 0.05 and abs(sum((x - mean) ** 2 for x in a) / len(a) - 1) < 0.06


def test_sentences(spark):
    df = frame(spark, ["See Fig. 3 now. It is final. Really?  Yes, e.g. this!\nEnd", "none", " a. "])
    words = values(df, text.split_sentences("x"))
    assert words[0] == ["See Fig. 3 now.", "It is final.", "Really?", "Yes, e.g. this!", "End"]
    assert words[1:] == [["none"], [" a."]]
    assert values(df, text.split_sentences("x", whole_words=False))[0][1] == "It is final. Really?"


def test_display_texts(spark):
    df = spark.createDataFrame([(0.0004, "b", "a"), (0.8125, "a", "b"), (0.0123, "c", "c"), (None, "a", "c")],
                               "p double, f string, g string")
    assert values(df, text.format_p("p")) == ["p < 0.001", "p = 0.812", "p = 0.012", None]
    assert values(df, text.pair_label("f", "g")) == ["a x b", "a x b", "c x c", "a x c"]
    left, right = text.split_pair(text.pair_label("f", "g"))
    assert values(df, left)[0] == "a" and values(df, right)[0] == "b"
    assert values(df, text.parent_of("f", {"a": "A"})) == ["b", "A", "c", "A"]
    assert values(df, text.count_label("f", F.lit(3)))[0] == "b\n(n=3)"


def test_expressions_work_on_a_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("EF2", "1,5"), ("subEF", "x")], "a string, b string").write.parquet(src)
    stream = spark.readStream.schema("a string, b string").parquet(src)
    q = (stream.select(clean.parse_ef("a").alias("ef"), clean.to_numeric("b").alias("n"))
         .writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start())
    q.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.table("cleaned").na.fill(-9.0).collect()) == [(-1, -9.0), (2, 15.0)]
