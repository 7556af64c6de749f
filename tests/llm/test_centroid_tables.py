"""Centroid clustering against plain integers in Python."""

import hashlib
import math
import random

import pytest

from tabulon.llm import centroid_tables as ct


def by_the_book(rows, k, rounds, dims, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
        return min(range(len(d)), key=lambda i: (d[i], i)), min(d)

    for _ in range(rounds):
        members = [[] for _ in centroids]
        for _, v in kept:
            members[nearest(v)[0]].append(v)
        centroids = [[sum(x[d] for x in m) // len(m) for d in range(dims)] if m else c
                     for m, c in zip(members, centroids)]
    return sorted(((i, *nearest(v)) for i, v in kept), key=repr), centroids


def vectors(n, dims, seed=5):
    rng = random.Random(seed)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(dims)]) for i in range(n)]
    rows += [(i, rows[i][1]) for i in range(0, n, 7)]           # repeated rows
    rows += [(n + i, rows[3][1]) for i in range(n // 2)]        # one vector in a third of the rows
    rows += [(-1, None), (-2, []), (-3, [0.0] * (dims - 1)), (-4, [float("nan")] * dims), (-5, [None] * dims),
             (-6, [float("inf")] + [0.0] * (dims - 1)), (None, [0.5] * dims), (-7, [-0.0] * dims), (-8, [1e-300] * dims), (-9, [-1e-300] * dims)]
    return rows


@pytest.mark.parametrize("block", [3, ct.BLOCK])
def test_clusters_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ct, "BLOCK", block)
    rows = vectors(90, 5)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assigned, centroids = ct.cluster_vectors(df, k=6, rounds=3, dims=5, scale=64.0)
    want, want_centroids = by_the_book(rows, 6, 3, 5, 64.0)
    assert centroids == want_centroids
    assert sorted(((r[0], r[1], r[2]) for r in assigned.collect()), key=repr) == want
    described = ct.describe_clusters(assigned, centroids).collect()
    assert len(described) == len(want)
    for r in described:
        assert r["inertia"] == sum(d for _, _, d in want)
        assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, want_centroids[r["cluster"]])).encode()).hexdigest()


def test_ties_go_to_the_smaller_number(spark):
    """Equal vectors make equal centroids: the first of them takes all."""
    df = spark.createDataFrame([(i, [0.25, 0.5]) for i in range(9)], "vec_id long, embedding array<double>")
    assigned, centroids = ct.cluster_vectors(df, k=4, rounds=2, dims=2, scale=4.0)
    assert centroids == [[1, 2]] * 4
    assert {(r["cluster"], r["distance"]) for r in assigned.collect()} == {(0, 0)}


def test_means_are_floored_and_large_sums_exact(spark):
    rows = [(i, [-1.0 * (1 << 26) - (i % 2), 1.0 * (1 << 26)]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    _, centroids = ct.cluster_vectors(df, k=1, rounds=1, dims=2, scale=1.0)
    assert centroids == [[-(1 << 26) - 1, 1 << 26]]


def test_few_vectors_empty_tables_and_clashing_names(spark):
    df = spark.createDataFrame([(7, [0.1, 0.2], 1, 2)], "cluster long, embedding array<float>, distance int, q int")
    assigned, centroids = ct.cluster_vectors(df, key="cluster", k=16, dims=2)
    assert assigned.columns == ["cluster", "cluster_", "distance"] and assigned.collect()[0][:2] == (7, 0) and centroids == [[6, 12]]
    empty = spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")
    assigned, centroids = ct.cluster_vectors(empty)
    assert centroids == [] and assigned.collect() == []
    assert ct.describe_clusters(assigned, centroids).collect() == []


def test_components_beyond_the_bound_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception):
        ct.cluster_vectors(df, k=1, dims=2)
