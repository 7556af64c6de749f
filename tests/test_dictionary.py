"""Level dictionaries of any size."""

import pytest
from pyspark.sql import functions as F

from tabulon.operators import dictionary, encode


def test_codes_equal_the_small_encoder(spark):
    rows = [(i, None if i % 11 == 0 else f"v{i % 7}") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, c string").repartition(4)
    for keep_null in (False, True):
        want = {r["id"]: r["c"] for r in encode.ordinal_encode(df, ["c"], keep_null=keep_null)[0].collect()}
        made = dictionary.fit_dictionary(df, "c", keep_null)
        got = {r["id"]: r["c"] for r in dictionary.dictionary_encode(df, {"c": made}, keep_null).collect()}
        assert got == want


def test_many_levels_with_one_in_a_third_of_all_rows(spark):
    df = spark.range(60_000).withColumn("c", F.when(F.col("id") % 3 == 0, "m").otherwise(F.concat(F.lit("x"), (F.col("id") % 20_011).cast("string"))))
    made = dictionary.fit_dictionary(df, "c")
    out = dictionary.dictionary_encode(df.withColumn("old", F.col("c")), {"c": made})
    levels = sorted({"m"} | {f"x{i % 20_011}" for i in range(60_000) if i % 3})
    code = {v: float(i) for i, v in enumerate(levels)}
    rows = out.collect()
    assert len(rows) == 60_000 and all(r["c"] == code[r["old"]] for r in rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_unseen_levels_and_sparse_vectors(spark):
    seen = spark.createDataFrame([("b",), ("a",), ("c",), (None,)], "c string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, "zz"), (4, None), (5, "c")], "id int, c string")
    made = dictionary.fit_dictionary(seen, "c")
    assert {r["id"]: r["c"] for r in dictionary.dictionary_encode(new, {"c": made}).collect()} == {1: 0, 2: 1, 3: -1, 4: 3, 5: 2}
    hot, _ = dictionary.sparse_one_hot(new, ["c"], {"c": made})
    rows = {r["id"]: (r["c"], r["c_hot"].toArray().tolist()) for r in hot.collect()}
    assert rows == {1: ("a", [0, 0, 0]), 2: ("b", [1, 0, 0]), 3: ("zz", [0, 0, 0]), 4: (None, [0, 0, 1]), 5: ("c", [0, 1, 0])}
    with pytest.raises(ValueError):
        dictionary.sparse_one_hot(seen.filter("c = 'a'"), ["c"])
