"""Byte-level BPE in padded matrices against the library that owns the rank files."""

import base64
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabulon.llm import padded_bpe as pb

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  ", "\n", "a", " a", "a ", "a \nb", "x\n\ny", "  a  b\tc\n ﬁ Å x ", "日本語  です", "x'll it's  \n\n y",
       "١٢ ½ ²³ x̂ 😀👩‍👩 a\xa0b　c\x1cz \x85 q", "a" * 700, "ab" * 400, "ab " * 900, "<|endoftext|> x", "x" * 255 + " " + "y" * 256 + " " + "z" * 257,
       "".join(chr(33 + i * 7 % 90) for i in range(900))]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(pb.default_ranks()[0], "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ranks():
    return pb.load_ranks(*pb.default_ranks())


def encode(encoder, texts):
    ids, bounds = encoder(texts)
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def test_odd_texts_are_the_library_s(ranks, library):
    assert encode(pb.TextEncoder(ranks), ODD) == library.encode_ordinary_batch(ODD)


@given(st.lists(st.text(alphabet=st.sampled_from("aeth ns  .,\n\t'é日😀1x\xa0\x85"), max_size=80), max_size=6))
@settings(max_examples=150, deadline=None)
def test_any_text_is_the_library_s(ranks, library, texts):
    assert encode(pb.TextEncoder(ranks), texts) == library.encode_ordinary_batch(texts)


def test_every_vocabulary_string_is_the_library_s(ranks, library):
    """Also those that no sequence of merges reaches."""
    words = []
    for t in ranks.tokens:
        try:
            words.append(t.decode())
        except UnicodeDecodeError:
            pass
    assert encode(pb.TextEncoder(ranks), words) == library.encode_ordinary_batch(words)
    alone = [w for w in words if len(w) > 1 and len(library.encode_ordinary(w)) == 1]
    merged, ends = pb.PairMerger(ranks).encode([w.encode() for w in alone])
    assert (np.diff(ends, prepend=0) >= 1).all() and len(merged) >= len(alone)


def test_matrices_equal_the_agenda(ranks, monkeypatch):
    rng = np.random.default_rng(3)
    pieces = [bytes(rng.choice(list(b"etaoin shrdlu"), n).tolist()) for n in rng.integers(2, 250, 300)]
    merger = pb.PairMerger(ranks)
    ids, ends = merger.encode(pieces)
    monkeypatch.setattr(pb, "_BUCKETS", (1,))
    again, ends_again = merger.encode(pieces)
    assert ids.tolist() == again.tolist() and ends.tolist() == ends_again.tolist()


def test_forgetting_changes_nothing(ranks, library, monkeypatch):
    monkeypatch.setattr(pb, "_KEPT_IDS", 3)
    encoder = pb.TextEncoder(ranks)
    for texts in (["the cat sat", "a dog ran"], ["the dog", ""], ["unbelievableness the"]):
        assert encode(encoder, texts) == library.encode_ordinary_batch(texts)


def test_query_over_whole_documents(spark, library):
    from tabulon.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op11_padded_bpe"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_nulls_repeats_long_texts_and_clashing_names(spark, library):
    long = "word and " * 60_000 + "é" * 3_000
    docs = spark.createDataFrame([(1, None, 0, 0), (1, "", 0, 0), (None, "a b", 0, 0), (2, long, 0, 0), (3, "a b", 1, 1), (3, "a b", 1, 1)],
                                 "doc_id long, text string, ids int, decoded int")
    path, pattern = pb.default_ranks()
    rows = pb.decode_ids(pb.encode_texts(docs, path, pattern), path).collect()
    got = sorted(((r["doc_id"], r["ids"], bytes(r["decoded"]).decode()) for r in rows), key=repr)
    want = sorted(((k, library.encode_ordinary(t or ""), t or "") for k, t, *_ in docs.collect()), key=repr)
    assert got == want
    named = docs.select(F.col("doc_id").alias("ids"), "text")
    assert pb.encode_texts(named, path, pattern, key="ids").columns == ["ids", "ids_"]
    kept = docs.select(F.array(F.lit(64), F.lit(None)).alias("x"), F.col("decoded"))
    assert bytes(pb.decode_ids(kept, path, "x").first()["decoded_"]) == library.decode_bytes([64])


def test_empty_table(spark):
    path, pattern = pb.default_ranks()
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pb.decode_ids(pb.encode_texts(empty, path, pattern), path).collect() == []
