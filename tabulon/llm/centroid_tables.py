"""Centroid clustering of integer vectors with scalar lookup tables.

Vectors are stored once in blocks: per dimension the sorted integers that occur
in the block, and per vector its place among them.  A round tabulates, for each
dimension, occurring integer and centroid, the squared difference; a vector's
distances are the sums of its rows in these tables.  A task sends one row per
centroid: a count and exact sums.  Everything is integer, so the result does not
depend on partitions or order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.registry import free_name, query, table
from tabulon.session import discard, materialize

LARGEST = 1 << 27  # components beyond could give a distance that no long holds
BLOCK = 2_048      # vectors of a block; tables hold at most so many integers per dimension


def grid_components(vector: Column, scale: float) -> Column:
    """Components as integers floor(scale * x); null for a vector with a null or non-finite component."""
    x = F.transform(vector, lambda v: v.cast("double"))
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(good, F.transform(x, lambda v: F.floor(v * scale)))


def _blocks(rows: DataFrame, key: str, dims: int) -> DataFrame:
    """(keys, values, sizes, codes) per block; codes are 16-bit places, dimension by dimension."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = part.column(1).flatten().to_numpy().reshape(-1, dims)
                if x.size and max(-int(x.min()), int(x.max())) > LARGEST:
                    raise ValueError(f"a component is beyond {LARGEST}")
                found = [np.unique(x[:, d], return_inverse=True) for d in range(dims)]
                values = np.concatenate([v for v, _ in found])
                sizes = [len(v) for v, _ in found]
                codes = np.concatenate([c for _, c in found]).astype(np.uint16).tobytes()
                keys = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array([values], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())),
                     pa.array([codes], pa.binary())], names=["keys", "values", "sizes", "codes"])

    return rows.mapInArrow(run, f"keys array<{kind}>, values array<bigint>, sizes array<int>, codes binary")


def _nearest(values: np.ndarray, sizes: np.ndarray, codes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, distance) of a block's vectors; ties go to the smaller number."""
    dims = len(sizes)
    codes = codes.reshape(dims, -1)
    total = np.zeros((codes.shape[1], len(centroids)), np.int64)
    start = 0
    for d in range(dims):
        squares = (values[start:start + sizes[d], None] - centroids[None, :, d]) ** 2
        total += squares[codes[d]]
        start += sizes[d]
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(total)), cluster]


def _read(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    for i in range(batch.num_rows):
        yield (batch.column("keys")[i].values, batch.column("values")[i].values.to_numpy(), batch.column("sizes")[i].values.to_numpy(),
               np.frombuffer(batch.column("codes")[i].as_buffer(), np.uint16))


def _sums(blocks: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Per non-empty cluster its count and componentwise sums, added up as decimals."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for _, values, sizes, codes in _read(batch):
                cluster, _ = _nearest(values, sizes, codes, centroids)
                count += np.bincount(cluster, minlength=len(centroids))
                places, start = codes.reshape(dims, -1), 0
                for d in range(dims):
                    cells = np.bincount(cluster * sizes[d] + places[d], minlength=len(centroids) * sizes[d])
                    total[:, d] += cells.reshape(len(centroids), -1) @ values[start:start + sizes[d]]
                    start += sizes[d]
        some = np.flatnonzero(count)
        if len(some):
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.int64()))],
                names=["cluster", "n", "total"])

    parts = blocks.select("keys", "values", "sizes", "codes").mapInArrow(run, "cluster int, n long, total array<bigint>")
    added = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("total")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(dims)])
    return {r["cluster"]: (r["n"], [int(r[f"s{d}"]) for d in range(dims)]) for r in added.collect()}


def first_centroids(rows: DataFrame, key: str, vector: str, k: int, seed: str) -> list[list[int]]:
    """The k vectors whose sha256 of ``<seed>:<key>`` is smallest, in that order; null keys come last, ties by components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    return [r[vector] for r in rows.orderBy(order.asc_nulls_last(), vector).select(vector).limit(k).collect()]


def cluster_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64,
                    scale: float = 64.0, seed: str = "1") -> tuple[DataFrame, list[list[int]]]:
    """(key, cluster, distance) per kept vector, and the final centroids.

    Kept are vectors with exactly ``dims`` components, none null or non-finite.
    The first centroids are kept vectors chosen by ``first_centroids``; each of
    ``rounds`` rounds assigns every vector to its nearest centroid (ties: smaller
    number) and moves each non-empty centroid to floor(sum / count).  Vectors are
    then assigned once more.  Repeated rows count each, null keys are kept, other
    columns are not read.  With fewer than k kept vectors there are as many
    centroids as vectors; with none the result is empty.  Components beyond
    2**27 after scaling are an error.  The returned table lies in the shared folder.
    """
    q = free_name("q", [key])
    rows = vectors.where(F.size(vector) == dims).select(key, grid_components(F.col(vector), scale).alias(q)).where(F.col(q).isNotNull())
    centroids = first_centroids(rows, key, q, k, seed)
    kind = rows.schema[key].dataType.simpleString()
    out = [key, free_name("cluster", [key]), free_name("distance", [key])]
    schema = f"`{key}` {kind}, `{out[1]}` int, `{out[2]}` long"
    if not centroids:
        return vectors.sparkSession.createDataFrame([], schema), []
    blocks = materialize(_blocks(rows, key, dims), "blocks")
    for _ in range(rounds):
        moved = _sums(blocks, np.array(centroids, np.int64))
        centroids = [[s // moved[c][0] for s in moved[c][1]] if c in moved else old for c, old in enumerate(centroids)]
    last = np.array(centroids, np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, values, sizes, codes in _read(batch):
                cluster, distance = _nearest(values, sizes, codes, last)
                yield pa.RecordBatch.from_arrays([keys, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=out)

    assigned = materialize(blocks.mapInArrow(assign, schema), "assigned")
    discard(blocks)
    return assigned, centroids


def describe_clusters(assigned: DataFrame, centroids: Sequence[Sequence[int]], cluster: str = "cluster", distance: str = "distance") -> DataFrame:
    """``assigned`` with cluster_inertia, inertia and centroid_sha256; the joined side has a row per centroid."""
    spark = assigned.sparkSession
    names = spark.createDataFrame([(c, ",".join(map(str, x))) for c, x in enumerate(centroids)], f"`{cluster}` int, listed string")
    per = assigned.groupBy(cluster).agg(F.sum(F.col(distance).cast("decimal(38,0)")).alias("part"))
    parts = {r[cluster]: int(r["part"]) for r in per.collect()}
    added = spark.createDataFrame([(c, p) for c, p in parts.items()], f"`{cluster}` int, cluster_inertia long")
    side = names.join(added, cluster).select(
        cluster, "cluster_inertia", F.lit(sum(parts.values())).cast("long").alias("inertia"), F.sha2("listed", 256).alias("centroid_sha256"))
    return assigned.join(F.broadcast(side), cluster)


_K, _ROUNDS, _DIMS = 16, 3, 64


def _oracle() -> str:
    """The rounds written out, one after another."""
    steps = [f"""v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS q FROM embeddings
        WHERE len(embedding) = {_DIMS} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
    r AS (SELECT *, row_number() OVER () AS rid FROM v),
    l AS (SELECT rid, unnest(range(1, {_DIMS + 1})) AS d, unnest(q) AS x FROM r),
    c0 AS (SELECT c, unnest(range(1, {_DIMS + 1})) AS d, unnest(q) AS x FROM
        (SELECT q, row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, q) - 1 AS c FROM r) WHERE c < {_K})"""]
    for i in range(_ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT rid, c, dist FROM (SELECT rid, c, dist, row_number() OVER (PARTITION BY rid ORDER BY dist, c) AS n
        FROM (SELECT l.rid, k.c, sum((l.x - k.x) * (l.x - k.x))::BIGINT AS dist FROM l JOIN c{i} k USING (d) GROUP BY ALL)) WHERE n = 1)""")
        if i < _ROUNDS:
            steps.append(f"""m{i} AS (SELECT c, d, sum(l.x)::BIGINT AS s, count(*) AS n FROM a{i} JOIN l USING (rid) GROUP BY ALL),
    c{i + 1} AS MATERIALIZED (SELECT k.c, k.d, CASE WHEN m.n IS NULL THEN k.x ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS x
        FROM c{i} k LEFT JOIN m{i} m USING (c, d))""")
    last = _ROUNDS
    return "WITH " + ",\n    ".join(steps) + f"""
    SELECT r.vec_id, a.c::INTEGER AS cluster, a.dist AS distance, (sum(a.dist) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
        (sum(a.dist) OVER ())::BIGINT AS inertia, h.sha AS centroid_sha256
    FROM a{last} a JOIN r USING (rid) JOIN (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS sha FROM c{last} GROUP BY c) h USING (c)"""


@query("op12_centroid_tables", _oracle())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, centroids = cluster_vectors(table(spark, sf_dir, "embeddings"), k=_K, rounds=_ROUNDS, dims=_DIMS)
    return describe_clusters(assigned, centroids).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
