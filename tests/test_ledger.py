"""A study that is killed and taken up again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import models
from tabulon.plans import ledger, study


@pytest.fixture(scope="module")
def prep(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(240, 3))
    label = (x[:, 0] > 0).astype(float) + (x[:, 1] > 1)
    rows = [(i, float(y), *map(float, r)) for i, (y, r) in enumerate(zip(label, x))]
    return study.Prepared(spark.createDataFrame(rows, "id long, label double, a double, b double, c double"), ["a", "b", "c"],
                          ["a", "b", "c"], [], ["u", "v", "w"])


def fits(calls, stop_after=None):
    def fit(train):
        if stop_after is not None and len(calls) >= stop_after:
            raise InterruptedError
        calls.append(1)
        return models.decision_tree(3)(train)

    return fit


def test_a_killed_study_goes_on_where_it_stopped(prep, tmp_path):
    calls = []
    with pytest.raises(InterruptedError):
        ledger.run_study(prep, "id", {"Tree": fits(calls, 4)}, str(tmp_path), k=3, repeats=2, workers=1)
    assert len(calls) == 4
    scores, predictions, importance = ledger.run_study(prep, "id", {"Tree": fits(calls)}, str(tmp_path), k=3, repeats=2, workers=1)
    assert len(calls) == 6
    assert predictions.count() == predictions.select("Fold", "id").distinct().count() == 480
    assert scores.count() == 6 and importance.count() == 18
    again = ledger.run_study(prep, "id", {"Tree": fits(calls)}, str(tmp_path), k=3, repeats=2)
    assert len(calls) == 6 and sorted(again[0].collect()) == sorted(scores.collect())
    whole = ledger.run_study(prep, "id", {"Tree": fits([])}, str(tmp_path / "other"), k=3, repeats=2)
    assert sorted(whole[0].collect()) == sorted(scores.collect()) and sorted(whole[2].collect()) == sorted(importance.collect())


def test_a_unit_that_was_not_finished_is_done_again(prep, tmp_path):
    calls = []
    first = ledger.run_study(prep, "id", {"Tree": fits(calls)}, str(tmp_path), k=2, repeats=1, importance=False)[0].collect()
    made = ledger.FoldLedger.open(prep, "id", str(tmp_path), k=2, repeats=1)
    (tmp_path / made.unit("predictions", "Tree", 1) / "_SUCCESS").unlink()
    again = ledger.run_study(prep, "id", {"Tree": fits(calls)}, str(tmp_path), k=2, repeats=1, importance=False)
    assert len(calls) == 3 and again[1].count() == 240
    assert sorted(again[0].collect()) == sorted(first)


def test_models_are_added_and_folds_read_their_own_files(prep, tmp_path):
    terms = {"k": 2, "repeats": 2, "importance": False}
    ledger.run_study(prep, "id", {"Tree": fits([])}, str(tmp_path), **terms)
    calls = []
    both = {"Tree": fits(calls), "Boosted": models.boosted_trees(3, 2)}
    _, predictions, _ = ledger.run_study(prep, "id", both, str(tmp_path), **terms)
    assert not calls and {(r["Model"], r["n"]) for r in predictions.groupBy("Model").agg(F.count("*").alias("n")).collect()} == {
        ("Tree", 480), ("Boosted", 480)}
    made = ledger.FoldLedger.open(prep, "id", str(tmp_path), k=2, repeats=2)
    plan = made.held(3)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "(repeat#" in plan.split("PartitionFilters")[1]
    with pytest.raises(ValueError):
        ledger.run_study(prep, "id", both, str(tmp_path), k=3, repeats=2)
