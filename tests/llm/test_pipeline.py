"""The pipeline against a version in plain Python."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tabulon.llm import mixing as mx
from tabulon.llm import piece_dropout as pd_
from tabulon.llm.kneser_ney import classify_quality
from tests.llm.test_native import brute
from tests.llm.test_pairs import brute_shingles

SF = "/root/testdata/sf0.001"


def draw(mean, key):
    digest = hashlib.md5(f"0:{key}:0".encode()).hexdigest()
    u = ((int(digest[:15], 16) >> 8) + 0.5) / 2**52
    return sum(s < u for s in mx.poisson_steps(mean))


def test_pipeline_matches_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    keep = {r["doc_id"] for r in classify_quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r["keep"]}
    texts = brute({i: rows[i]["text"] for i in keep}, 20)
    first = {i for i, _, c in brute_shingles(sorted(texts.items())) if i == c}
    texts = {i: texts[i] for i in first}
    mass = {}
    name = {i: rows[i]["source"] if rows[i]["source"] in mx.WEIGHTS else None for i in texts}
    for i, t in texts.items():
        mass[name[i]] = mass.get(name[i], 0) + len(t or "") + 1
    share = {s: w for s, w in {**mx.WEIGHTS, None: mx.OTHER}.items() if s in mass}
    rate = {s: w / sum(share.values()) * sum(mass.values()) / mass[s] for s, w in share.items()}
    encoder = pd_.PieceEncoder(pd_.load_piece_model(pd_.default_model()))
    want = []
    for i, t in texts.items():
        ids = np.frombuffer(encoder.encode(t, str(i)), np.uint16).tolist()
        want += [(i, len(ids), ids, True)] * draw(rate[name[i]], i)
    got = [tuple(r) for r in cp.run(spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    assert [n for n, _ in cp.STAGES] == ["quality", "lines", "near_duplicates", "mix", "encode"]
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]


PROSE = [" ".join(f"{w}{(i * 7 + j * j) % 41}" for j in range(60)) for i, w in enumerate(["oak", "elm", "ash", "fir"])]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, PROSE[0]), (2, PROSE[0]), (2, PROSE[1]), (2, PROSE[1]), (3, PROSE[2]), (3, PROSE[2]), (None, PROSE[0]), (None, None), (4, None),
            (5, ""), (5, " \n\n "), (6, PROSE[3] + " " + "long " * 30_000), (-7, "one two")]
    rows = [(k, t, "en" if k else None, "web", len(t) if t is not None else None, 1, "x") for k, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __row int, component_id string")


def test_stages_take_nulls_repeats_empty_and_long_texts_and_other_columns(spark, odd):
    n = odd.count()
    for name, stage in cp.STAGES:
        out = stage(spark, odd, SF)
        if name != "encode":
            assert out.columns == odd.columns
        assert out.count() == n if name in ("lines", "encode") else out.count() <= n or name == "mix"
        assert stage(spark, odd.limit(0), SF).collect() == []


def test_near_duplicates_keep_one_row_of_a_group_and_other_texts_of_its_key(spark, odd):
    got = sorted(((r["doc_id"], r["text"] and r["text"][:4]) for r in cp.stage_near_duplicates(spark, odd, SF).collect()), key=repr)
    want = [(1, "oak0"), (2, "elm7"), (3, "ash1"), (None, "oak0"), (None, None), (4, None), (5, ""), (5, " \n\n "), (6, "fir2"), (-7, "one ")]
    assert got == sorted(want, key=repr)


def test_one_bad_text_does_not_take_a_good_one_of_its_key_along(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged = classify_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    bad, good = (judged.where(F.col("keep") == k).where("n_tokens > 30").orderBy("doc_id").first()["doc_id"] for k in (False, True))
    texts = {r["doc_id"]: r for r in docs.where(F.col("doc_id").isin(bad, good)).collect()}
    added = spark.createDataFrame([(bad, *texts[good][1:])], docs.schema)
    left = cp.stage_quality(spark, docs.unionByName(added), SF).where(F.col("doc_id") == bad).collect()
    assert [r["text"] for r in left] == [texts[good]["text"]]


def test_without_trusted_text_all_documents_stay(spark, tmp_path):
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert cp.stage_quality(spark, docs, str(tmp_path)).count() == docs.count()
