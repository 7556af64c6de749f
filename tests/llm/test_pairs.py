"""Similarity joins, searches and components against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import cover_tree as ct
from tabulon.llm import hamming as hm
from tabulon.llm import shingle_join as sj
from tabulon.llm.graph import components
from tabulon.llm.words import WordHasher, byte_table, text_slices

SF = "/root/testdata/sf0.001"


class Sets:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


# ---- components ----

def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    edges += [(5000, i) for i in range(5001, 5200)] + [(7, 7)]
    want = Sets({x for e in edges for x in e})
    for a, b in edges:
        want.join(a, b)
    df = spark.createDataFrame([*edges, (None, 3), (3, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert got == {x: want.find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(df.limit(0)).count() == 0


# ---- words ----

@pytest.mark.parametrize("marks", [False, True])
def test_word_hashes_follow_the_words(marks):
    import re

    import pyarrow as pa

    texts = ["The cat, the  CAT\n", None, "", "x" * 5000 + " y", "é the|the\tcat", " \x0b", "a b a"]
    words, got = {}, WordHasher(byte_table(fold=True, split_marks=marks))
    seen = {}
    for first, to, data, bounds in text_slices(pa.array(texts)):
        hashes, at = got(data, bounds)
        for r in range(to - first):
            t = (texts[first + r] or "").encode().lower()
            pattern = rb"[^\x00-\x20!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+" if marks else rb"[^\x20\x09-\x0d]+"
            own = re.findall(pattern, t)
            assert len(own) == at[r + 1] - at[r]
            for w, h in zip(own, hashes[at[r]:at[r + 1]], strict=True):
                assert words.setdefault(w, h) == h and seen.setdefault(h, w) == w


# ---- shingles ----

def brute_shingles(docs, width=5, percent=75):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k:k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    groups = Sets(sets)
    keys = [i for i in sets if sets[i]]
    for n, a in enumerate(keys):
        for b in keys[:n]:
            o = len(sets[a] & sets[b])
            if o and 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                groups.join(a, b)
    return sorted((i, len(sets[i]), groups.find(i)) for i in sets)


@pytest.mark.parametrize("limit", [32, 3])
def test_shingle_query_on_given_documents(spark, monkeypatch, limit):
    monkeypatch.setattr(sj, "LIST", limit)  # 3: most lists go by leaders
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, sj.op8(spark, SF).collect())) == brute_shingles(docs)


def test_shingles_of_near_groups_and_passages(spark, monkeypatch):
    monkeypatch.setattr(sj, "LIST", 4)
    monkeypatch.setattr(sj, "_BUFFER", 300)  # several flushes per task
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(0, 5000)}"
    base = [word() for _ in range(60)]
    passage = [word() for _ in range(30)]
    docs = []
    for i in range(40):  # near copies of one text, with chains between them
        w = list(base)
        for _ in range(rng.integers(0, 4)):
            w[rng.integers(0, 60)] = word()
        docs.append((i, " ".join(w)))
    docs += [(100 + i, " ".join([word() for _ in range(25)] + passage + [word() for _ in range(5)])) for i in range(25)]
    docs += [(200 + i, " ".join(passage + [word() for _ in range(rng.integers(0, 12))])) for i in range(25)]
    docs += [(300, "One two"), (301, "one  TWO"), (302, "one two three"), (303, None), (304, " \n"), (305, "a " * 4000), (306, "a " * 3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, sj.shingle_components(df).collect()))
    assert got == brute_shingles(docs)


def test_shingle_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 1), (1, "a b c d e f", 1), (None, "a b c d e f", 2), (2, None, 3), (3, "", 4)],
                               "doc_id long, text string, s int")
    got = sorted((tuple(r) for r in sj.shingle_components(df).collect()), key=repr)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None), (2, 0, 2), (3, 0, 3)], key=repr)
    assert sj.shingle_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [32, 1])
def test_shingles_of_repeated_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(sj, "LIST", limit)  # 1: all lists are long
    rng = np.random.default_rng(12)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    rows = []
    for g in range(30):
        half, most = words(71), words(91)  # 67 and 87 of 100 shingles: similarity 0.504 and 0.770
        for shared, first in ((half, 10 * g), (most, 10 * g + 5)):
            text = " ".join(shared + words(104 - len(shared)))
            rows += [(first, text)] * 2 + [(first, text.upper()), (first + 1, " ".join(shared + words(104 - len(shared))))]
        rows += [(10 * g + 1, " ".join(words(104))), (10 * g + 3, rows[-1][1])]  # a repeated key with another text
    got = sorted(map(tuple, sj.shingle_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()))
    low = {}
    whole = brute_shingles([(i, t) for i, (_, t) in enumerate(rows)])
    for i, _, c in whole:
        low[c] = min(low.get(c, rows[i][0]), rows[i][0])
    assert got == sorted((rows[i][0], n, low[c]) for i, n, c in whole)


# ---- vectors ----

def brute_vectors(rows, cosine=0.95):
    fine = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            x = x / np.abs(x).max()
            fine[i] = x / np.linalg.norm(x)
    groups, links = Sets([i for i, _ in rows if i is not None]), dict.fromkeys([i for i, _ in rows], 0)
    keys = list(fine)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            if len(fine[a]) == len(fine[b]) and fine[a] @ fine[b] >= cosine:
                groups.join(a, b)
                links[a] += 1
                links[b] += 1
    return sorted(((i, links[i], groups.find(i), groups.find(i) == i) if i is not None else (None, 0, None, False) for i, _ in rows), key=repr)


def test_vectors_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ct, "BLOCK", 40)
    monkeypatch.setattr(ct, "SAMPLE", 50)
    rng = np.random.default_rng(11)
    rows, n = [], 0
    for centre in rng.normal(size=(12, 16)):
        for spread in (0.02, 0.08, 0.3):
            for _ in range(12):
                rows.append((n, [float(x) for x in centre + rng.normal(size=16) * spread]))
                n += 1
    rows += [(n + i, rows[5][1]) for i in range(70)]  # copies of one vector
    rows += [(n + 100 + i, [2 * x for x in rows[5][1]]) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((tuple(r) for r in ct.near_duplicates(df).collect()), key=repr)
    assert got == brute_vectors(rows)


def test_vectors_in_tiles_and_rounds(spark, monkeypatch):
    """Unrelated vectors meet in every pair of blocks; a round sends each point to few tasks."""
    for name, value in (("BLOCK", 8), ("SAMPLE", 50), ("TILE", 2), ("COPIES", 3)):
        monkeypatch.setattr(ct, name, value)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(120)]
    sent = []

    def materialize(df, name):
        out = real(df, name)
        if name == "ct-round":
            sent.append(out.count())
        return out

    real = ct.materialize
    monkeypatch.setattr(ct, "materialize", materialize)
    got = ct.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_vectors(rows)
    assert len(sent) >= 3 and all(sent)


def test_vectors_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, []),
            (8, [1.0, 0.0, 0.0]), (9, [float("inf"), 1.0]), (None, [1.0, 0.0]), (1, [1.0, 0.0]), (10, [1e-300, 0.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, p int")
    got = sorted((tuple(r) for r in ct.near_duplicates(df).collect()), key=repr)
    assert got == brute_vectors([r for n, r in enumerate(rows) if n != 10])
    assert ct.near_duplicates(df.limit(0)).count() == 0
    assert ct.near_duplicates(df.where("vec_id = 3")).collect()[0][1:] == (0, 3, True)


def test_tree_bounds_cover_all_points():
    rng = np.random.default_rng(0)
    x = ct.unit(rng.normal(size=300 * 8), 300)
    centres = []
    for level, radius in zip(ct.block_levels(x), ct.RADII, strict=True):
        assert set(centres) <= set(level)  # nested
        centres = level
        assert (np.linalg.norm(x - x[level], axis=1) <= radius + 1e-9).all()


# ---- codes ----

def brute_codes(codes, queries, k):
    seen, out = sorted({c for c in codes if None not in c}), []
    for q, c in sorted(queries):
        order = sorted((((c ^ d) & (2**64 - 1)).bit_count(), i) for i, d in seen)[:k]
        out += [(q, n, i, dist) for n, (dist, i) in enumerate(order, 1)]
    return out


@pytest.mark.parametrize("block", [4096, 16])
def test_codes_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hm, "BLOCK", block)
    rng = np.random.default_rng(2)
    far = [int(x) for x in rng.integers(-2**63, 2**63 - 1, 120)]
    near = [far[0] ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (60, 2))]
    codes = [(i, c) for i, c in enumerate([*far, *near, *[far[3]] * 30, -1, 0, -2**63])]
    queries = [(i, c) for i, c in codes if i % 20 == 0] + [(9999, 12345)]
    df = spark.createDataFrame([*codes, (None, 4), (500, None), codes[0]], "id long, code long")
    asked = spark.createDataFrame([*queries, (None, 4), (501, None), queries[0]], "id long, code long")
    got = sorted(tuple(r) for r in hm.nearest_codes(df, asked, 5).collect())
    assert got == brute_codes(codes, queries, 5)


def test_few_or_no_codes(spark):
    df = spark.createDataFrame([(1, 5), (2, 7)], "id long, code long")
    assert sorted(tuple(r) for r in hm.nearest_codes(df, df, 10).collect()) == [(1, 1, 1, 0), (1, 2, 2, 1), (2, 1, 2, 0), (2, 2, 1, 1)]
    assert hm.nearest_codes(df.limit(0), df, 3).count() == 0
    assert hm.nearest_codes(df, df.limit(0), 3).count() == 0


def test_sign_codes(spark):
    rows = [([1.0] * 63 + [-1.0],), ([-1.0] * 63 + [0.0],), (None,), ([1.0],), ([float("nan")] + [1.0] * 63,), ([None] + [1.0] * 63,)]
    got = [r[0] for r in spark.createDataFrame(rows, "v array<float>").select(hm.sign_code(F.col("v"))).collect()]
    assert got == [2**63 - 1, -2**63, None, None, None, None]
