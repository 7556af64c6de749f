"""Exact nearest binary codes by incremental multi-index hashing.

A 64-bit code is cut into m segments.  If every segment of every code is
searched within a radius r, all codes up to Hamming distance m (r + 1) - 1 have
been seen.  So a query grows the radius, one ring at a time, until its k-th
verified distance is covered; then the answer is exact and the query is done.

Equal codes are one code with its k smallest ids, which is all that any answer
can take from it.  The codes are kept once per segment, in ranges of the
segment's leading bits; a range that holds many codes is cut by a hash.  A
round sends a query only to the ranges that its ring touches.  Ranges and
queries meet in one sorted stream per task: a block of at most some thousands
of codes is held, the queries pass by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.llm.registry import query, table
from tabulon.llm.words import U64, signed
from tabulon.session import materialize

BITS, SEGMENTS = 64, 4
WIDTH = BITS // SEGMENTS
BLOCK = 4_096  # codes of a segment range held by a task at a time, about
RINGS = 2  # rings searched per round


def sign_code(vector: Column, bits: int = BITS) -> Column:
    """Code of a vector: bit i is set where component i is at least zero.

    Null where the vector is null, has another length, or holds null or
    non-finite components.
    """
    fine = (F.size(vector) == bits) & ~F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    # The last component is the sign bit of the long.
    low = F.aggregate(F.sequence(F.lit(0), F.lit(bits - 2)), F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(
        F.when(F.get(vector, i) >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))))
    top = F.when(F.get(vector, F.lit(bits - 1)) >= 0, F.lit(-(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
    return F.when(fine, low.bitwiseOR(top))


def _masks(width: int) -> list[np.ndarray]:
    """All values of a width, grouped by their number of set bits."""
    values = np.arange(1 << width, dtype=U64)
    ones = np.bitwise_count(values)
    return [values[ones == r] for r in range(width + 1)]


def _search(codes: np.ndarray, shift: int, q: np.ndarray, rings: range, masks: list[np.ndarray], limit: np.ndarray,
            lead: np.ndarray, lead_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query index, code index, distance) of codes of one block whose segment lies on the rings.

    ``codes`` are sorted by the segment that starts at ``shift``; ``lead`` is the
    distance of each query in the bits all codes of the block share.  Distances
    above ``limit`` are left out.
    """
    mask = U64((1 << WIDTH) - 1)
    segment = (codes >> U64(shift)) & mask
    low_bits = WIDTH - lead_bits
    base = segment[0] & ~U64((1 << low_bits) - 1) & mask
    starts = np.searchsorted(segment, base + np.arange((1 << low_bits) + 1, dtype=U64))
    own = (q >> U64(shift)) & U64((1 << low_bits) - 1)
    for ring in rings:
        left = ring - lead
        for rest in np.unique(left[(left >= 0) & (left <= low_bits)]):
            asked = np.flatnonzero(left == rest)
            for some in np.array_split(asked, max(1, len(asked) * len(masks[rest]) // 1_000_000)):
                value = (own[some][:, None] ^ masks[rest][None, :]).astype(np.int64)
                a, n = starts[value], starts[value + 1] - starts[value]
                n_flat = n.ravel()
                hit = np.flatnonzero(n_flat)
                sizes = n_flat[hit]
                who = np.repeat(some[hit // n.shape[1]], sizes)
                at = np.repeat(a.ravel()[hit] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                distance = np.bitwise_count(q[who] ^ codes[at]).astype(np.int64)
                keep = distance <= limit[who]
                yield who[keep], at[keep], distance[keep]


def _smallest(rows: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each group; Spark keeps k per task before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def nearest_codes(codes: DataFrame, queries: DataFrame, k: int = 10, key: str = "id", code: str = "code") -> DataFrame:
    """(query_id, rank, id, distance): the k nearest of ``codes`` for each query, exactly.

    Both tables have (key, code) with 64-bit codes as longs.  Order is by
    distance, then id; a query that is itself among the codes finds itself.
    Null keys and codes take no part.  Rows that repeat a key with one code
    count once; a key with several codes counts with each, and a query key with
    several codes is answered for the smallest.  If there are fewer than k
    codes, all are returned; empty tables give an empty result.
    """
    spark = codes.sparkSession
    rows = codes.select(F.col(key).alias("id"), F.col(code).alias("code")).na.drop().distinct()
    ids = materialize(_smallest(rows, ["code"], ["id"], k).groupBy("code").agg(
        F.sort_array(F.collect_list("id")).alias("ids")), "mih-codes")
    n = ids.count()
    wanted = materialize(queries.select(F.col(key).alias("id"), F.col(code).alias("code")).na.drop()
                         .groupBy("id").agg(F.min("code").alias("code")), "mih-queries")
    asked = materialize(wanted.select(F.col("code").alias("q")).distinct(), "mih-asked")
    kind = rows.schema["id"].dataType.simpleString()
    done_schema = f"query_id {kind}, rank int, id {kind}, distance int"
    if not n:
        return spark.createDataFrame([], done_schema)
    lead_bits = min(max((n // BLOCK).bit_length(), 0), WIDTH)
    spread = lambda s: F.shiftrightunsigned("code", s * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1))
    index = ids.select("code", F.explode(F.array(*[F.lit(s) for s in range(SEGMENTS)])).alias("seg"))
    value = F.lit(0).cast("long")
    for s in range(SEGMENTS):
        value = F.when(F.col("seg") == s, spread(s)).otherwise(value)
    index = index.withColumn("lead", F.shiftright(value, WIDTH - lead_bits).cast("int"))
    sizes = index.groupBy("seg", "lead").agg(F.count("*").alias("n")).withColumn(
        "cuts", F.ceil(F.col("n") / (2 * BLOCK)).cast("int"))
    index = materialize(index.join(sizes, ["seg", "lead"]).withColumn(
        "cut", F.pmod(F.xxhash64("code"), F.col("cuts")).cast("int")).select("seg", "lead", "cut", "code"), "mih-index")
    blocks = materialize(sizes.select("seg", "lead", "cuts"), "mih-blocks")
    tasks = max(16, index.count() // (4 * BLOCK))

    def flips(most: int) -> Column:  # at most 2 ** WIDTH values
        return F.filter(F.sequence(F.lit(0), F.lit((1 << lead_bits) - 1)), lambda x: F.bit_count(x) <= most)

    best = spark.createDataFrame([], "q long, code long, distance int")
    open_queries, seen = asked.withColumn("limit", F.lit(BITS)), 0
    while seen <= WIDTH:
        rings = range(seen, min(seen + RINGS, WIDTH + 1))
        lead = F.lit(0)
        for s in range(SEGMENTS):
            own = F.shiftright(F.shiftrightunsigned("q", s * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1)), WIDTH - lead_bits)
            lead = F.when(F.col("seg") == s, own.cast("int")).otherwise(lead)
        calls = open_queries.select("q", "limit", F.explode(F.array(*[F.lit(s) for s in range(SEGMENTS)])).alias("seg"))
        calls = calls.withColumn("own", lead).withColumn("flip", F.explode(flips(rings[-1])))
        calls = calls.withColumn("flips", F.bit_count("flip")).withColumn(
            "lead", F.col("own").bitwiseXOR(F.col("flip"))).join(blocks, ["seg", "lead"])
        calls = calls.select("seg", "lead", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), "q", "limit", "flips")
        stream = index.select("seg", "lead", "cut", F.lit(None).cast("long").alias("q"), "code", F.lit(0).alias("limit"), F.lit(0).alias("flips"))
        stream = stream.unionByName(calls.withColumn("code", F.lit(None).cast("long")))
        stream = stream.repartition(tasks, "seg", "lead", "cut").sortWithinPartitions(
            "seg", "lead", "cut", F.col("q").isNotNull())

        def run(batches: Iterator[pa.RecordBatch], rings=rings, lead_bits=lead_bits, k=k) -> Iterator[pa.RecordBatch]:
            masks, block, held, codes = _masks(WIDTH - lead_bits), None, [], None
            for batch in batches:
                seg, ld, cut, limit, flips = (batch.column(i).to_numpy() for i in (0, 1, 2, 5, 6))
                is_query = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
                qs, cs = (batch.column(i).fill_null(0).to_numpy().view(np.uint64) for i in (3, 4))
                edge = np.flatnonzero(np.append(True, (seg[1:] != seg[:-1]) | (ld[1:] != ld[:-1]) | (cut[1:] != cut[:-1])))
                for a, b in zip(edge, [*edge[1:], len(seg)], strict=True):
                    name = (seg[a], ld[a], cut[a])
                    if name != block:
                        block, held, codes = name, [], None
                    own = is_query[a:b]
                    held.append(cs[a:b][~own])
                    if not own.any():
                        continue
                    if codes is None:
                        codes = np.concatenate(held)
                        shift = int(name[0]) * WIDTH
                        codes = codes[np.argsort((codes >> np.uint64(shift)) & np.uint64((1 << WIDTH) - 1), kind="stable")]
                    if not len(codes):
                        continue
                    q = qs[a:b][own]
                    found = [*_search(codes, int(name[0]) * WIDTH, q, rings, masks, limit[a:b][own], flips[a:b][own], lead_bits)]
                    if not found:
                        continue
                    who, at, distance = (np.concatenate([f[i] for f in found]) for i in range(3))
                    order = np.lexsort((distance, who))
                    who, at, distance = who[order], at[order], distance[order]
                    first = np.searchsorted(who, np.arange(len(q) + 1))
                    kth = np.where(np.diff(first) >= k, distance[np.minimum(first[:-1] + k - 1, max(len(distance) - 1, 0))], BITS) \
                        if len(distance) else np.full(len(q), BITS)
                    near = distance <= kth[who]  # ties of the k-th stay: ids decide between them
                    yield pa.RecordBatch.from_arrays(
                        [signed(q[who[near]]), signed(codes[at[near]]), pa.array(distance[near].astype(np.int32))],
                        names=["q", "code", "distance"])

        fresh = stream.mapInArrow(run, "q long, code long, distance int")
        best = best.union(fresh).distinct()
        counted = best.join(ids.select("code", F.size("ids").alias("have")), "code")
        upto = F.sum("have").over(Window.partitionBy("q").orderBy("distance").rangeBetween(Window.unboundedPreceding, Window.currentRow))
        before = F.coalesce(F.sum("have").over(Window.partitionBy("q").orderBy("distance").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
        best = materialize(counted.withColumn("upto", upto).withColumn("before", before)
                           .where(F.col("before") < k).select("q", "code", "distance", "upto"), "mih-best")
        covered = SEGMENTS * (rings[-1] + 1) - 1
        kth_distance = best.where(F.col("upto") >= k).groupBy("q").agg(F.min("distance").alias("kth"))
        best = best.select("q", "code", "distance")
        open_queries = materialize(asked.join(kth_distance, "q", "left").where(
            F.col("kth").isNull() | (F.col("kth") > covered)).select("q", F.coalesce("kth", F.lit(BITS)).alias("limit")), "mih-open")
        seen = rings[-1] + 1
        if not open_queries.take(1):
            break
    named = best.join(ids, "code").select("q", "distance", F.explode("ids").alias("id"))
    answer = _smallest(named, ["q"], ["distance", "id"], k)
    return wanted.withColumnsRenamed({"id": "query_id", "code": "q"}).join(answer, "q").select(
        "query_id", F.col("place").alias("rank"), "id", "distance")


K = 10


@query("op3_multi_index_hashing", f"""
    WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: x >= 0) AS code FROM embeddings
               WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
    d AS (SELECT q.vec_id AS query_id, c.vec_id AS id, list_sum(list_transform(range(1, 65),
              lambda i: (q.code[i] <> c.code[i])::INTEGER))::INTEGER AS distance
          FROM c q, c WHERE q.vec_id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INTEGER AS rank FROM d)
    SELECT query_id, rank, id, distance FROM r WHERE rank <= {K}""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code"))
    codes = materialize(vectors, "sign-codes")
    return nearest_codes(codes, codes.where(F.col("id") % 20 == 0), K)
