"""Every query with a checking SQL text, on the smallest tables."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
# Exact p-values by listing signs need untied scores, which the smallest tables do not have.
UNTIED = {"feature_tiers", "model_equivalence", "significance_flags"}
LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    made = {}
    for sf in (SF, LARGER):
        made[sf] = duckdb.connect()
        for t in TABLES:
            made[sf].execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return made


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    pdf = pdf.where(pdf.notna(), None)
    return sorted((tuple(round(float(v), 6) if isinstance(v, (float, np.floating)) else v for v in r)
                   for r in pdf.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_matches_sql(spark, db, name):
    sf = LARGER if name in UNTIED else SF
    got = contract.queries()[name](spark, sf).toPandas()
    want = db[sf].execute(contract.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() == 3
