"""Near-duplicate vectors by cover trees and dual traversal.

Vectors are points on the unit sphere; cosine t is distance sqrt(2 - 2 t).
Equal vectors are one point with a weight.

An upper tree is fitted on at most ``SAMPLE`` points (a documented bound): nets
of halving radius, split only while a node is expected to hold more than
``BLOCK`` points.  All points are routed to its leaves and the covering radius
of each leaf is the largest distance over all its points, so bounds hold for
every point.  Leaves with more points are cut into blocks by a hash.  In each
block a lower tree of nested levels with halving radii is built where the
block is.

Two trees are traversed together: a pair of nodes whose centres are further
apart than both covering radii plus the threshold holds no link and goes; a
pair closer than the threshold less both radii holds only links and is counted
at once; other pairs descend, at last to points, compared in double precision.
Each task returns per point the weight of its links and a spanning forest of
them, never the pairs of a group.

A task takes all wanted pairs of blocks between two tiles of up to ``TILE`` blocks,
and pairs of tiles go in rounds that send a point at most ``COPIES`` times, so what
lies on disk at a time grows with the points, not with their square.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.graph import components, forest
from tabulon.llm.registry import query, table
from tabulon.session import discard, materialize

COSINE = 0.95
SAMPLE = 2_048
BLOCK = 4_096
TILE = 8  # blocks that a task holds of either side
COPIES = 8  # times that a round sends every point
RADII = (1.0, 0.5, 0.25)  # of the levels within a block
_EPS = 1e-6  # added to bounds, above the rounding of single precision


# ---- points ----

def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, all components numbers."""
    return F.coalesce(~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
                      & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(flat: np.ndarray, rows: int) -> np.ndarray:
    """Rows scaled to length one, in double precision and without overflow."""
    x = flat.astype(np.float64).reshape(rows, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _vectors(column: pa.Array) -> np.ndarray:
    return unit(column.flatten().to_numpy(zero_copy_only=False), len(column))


def distance_of(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


# ---- nets ----

def net(points: np.ndarray, radius: float, start: list[int], most: int | None = None) -> tuple[list[int], np.ndarray]:
    """Centres (``start`` first) so that each point is within the radius of one; and the nearest centre of each.

    Stops early at ``most`` centres; then points may be further away.
    """
    centres = list(start)
    best = np.full(len(points), -2.0)
    owner = np.zeros(len(points), np.int64)

    def add(c: int) -> None:
        cosine = points @ points[c]
        cosine[c] = 2.0
        closer = cosine > best
        best[closer], owner[closer] = cosine[closer], c

    for c in centres:
        add(c)
    cut = 1 - radius * radius / 2
    while most is None or len(centres) < most:
        far = int(np.argmin(best))
        if best[far] >= cut:
            break
        centres.append(far)
        add(far)
    return centres, owner


def upper_tree(sample: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """Nodes (parent, centre) of a tree whose leaves are expected to hold at most ``BLOCK`` of n points."""
    nodes = [(-1, sample[0])]
    todo = [(0, np.arange(len(sample)), 2.0)]
    while todo:
        node, members, radius = todo.pop()
        expected = n * len(members) / len(sample)
        wanted = int(np.ceil(expected / BLOCK))
        if wanted < 2 or len(members) < 2 or radius < 1e-3:
            continue
        centres, owner = net(sample[members], radius / 2, [0], wanted)
        if len(centres) == 1:  # one centre covers all: halve again
            todo.append((node, members, radius / 2))
            continue
        for c in centres:
            nodes.append((node, sample[members[c]]))
            todo.append((len(nodes) - 1, members[owner == c], radius / 2))
    return nodes


def route(points: np.ndarray, nodes: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Leaf of each point, by the nearest child at each level, and its distance to the leaf's centre."""
    children: dict[int, list[int]] = {}
    for i, (parent, _) in enumerate(nodes):
        children.setdefault(parent, []).append(i)
    leaf = np.zeros(len(points), np.int64)
    todo = [(0, np.arange(len(points)))]
    while todo:
        node, rows = todo.pop()
        below = children.get(node)
        if not below or not len(rows):
            leaf[rows] = node
            continue
        nearest = np.argmax(points[rows] @ np.stack([nodes[i][1] for i in below]).T, axis=1)
        todo += [(child, rows[nearest == j]) for j, child in enumerate(below)]
    centres = np.stack([c for _, c in nodes])
    return leaf, distance_of(np.einsum("ij,ij->i", points, centres[leaf]))


def leaf_pairs(nodes: list[tuple[int, np.ndarray]], radius: dict[int, float], reach: float) -> list[tuple[int, int]]:
    """Pairs of occupied leaves that may hold a link, by dual traversal from the root.

    The tree is bounded by the sample, and so is this list.
    """
    inner = dict(radius)
    for i in range(len(nodes) - 1, 0, -1):  # children stand after their parents
        parent = nodes[i][0]
        if i in inner:
            apart = float(distance_of(nodes[i][1] @ nodes[parent][1]))
            inner[parent] = max(inner.get(parent, 0.0), inner[i] + apart)
    children: dict[int, list[int]] = {}
    for i in range(1, len(nodes)):
        if i in inner:
            children.setdefault(nodes[i][0], []).append(i)
    found, todo = [], [(0, 0)]
    while todo:
        a, b = todo.pop()
        if float(distance_of(nodes[a][1] @ nodes[b][1])) > inner[a] + inner[b] + reach + _EPS:
            continue
        left, right = children.get(a), children.get(b)
        if not left and not right:
            found.append((a, b))
        elif a == b:
            todo += [(x, y) for k, x in enumerate(left) for y in left[k:]]
        elif left and (not right or inner[a] >= inner[b]):
            todo += [(x, b) for x in left]
        else:
            todo += [(a, y) for y in right]
    return [(min(p), max(p)) for p in found]


# ---- blocks ----

class Block:
    """Points of a block with the nested levels of its tree."""

    def __init__(self, ids: np.ndarray, weight: np.ndarray, points: np.ndarray, levels: list[np.ndarray]):
        self.ids, self.weight, self.points = ids, weight, points
        self.single = points.astype(np.float32)
        self.levels = []  # (centre of each node, node of each point, covering radius)
        for centre in levels:
            nodes, node = np.unique(centre, return_inverse=True)
            far = distance_of(np.einsum("ij,ij->i", points, points[centre]))
            radius = np.zeros(len(nodes))
            np.maximum.at(radius, node, far)
            self.levels.append((nodes, node, radius))
        order = np.argsort(self.levels[-1][1], kind="stable")
        self.members = np.split(order, np.cumsum(np.bincount(self.levels[-1][1]))[:-1])


def block_levels(points: np.ndarray) -> list[np.ndarray]:
    """Centre of each point at every level; the centres of a level are centres of the next."""
    levels, centres = [], [0]
    for radius in RADII:
        centres, owner = net(points, radius, centres)
        levels.append(owner)
    return levels


def candidate_nodes(a: Block, b: Block, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of lowest nodes that the bounds leave, level by level."""
    rows = cols = None
    last = len(RADII) - 1
    for level in range(last + 1):
        (na, _, ra), (nb, _, rb) = a.levels[level], b.levels[level]
        if level < last and 2 * (len(na) + len(nb)) > len(a.levels[last][0]) + len(b.levels[last][0]):
            continue  # the level is nearly as fine as the lowest: it would not pay
        i = np.arange(len(na)) if rows is None else np.flatnonzero(rows[a.points_parent(level)])
        j = np.arange(len(nb)) if cols is None else np.flatnonzero(cols[b.points_parent(level)])
        if not len(i) or not len(j):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        cosine = a.single[na[i]] @ b.single[nb[j]].T
        widest = min(ra[i].max() + rb[j].max() + reach + _EPS, 2.0)
        x, y = np.nonzero(cosine >= 1 - widest * widest / 2 - _EPS)
        bound = np.minimum(ra[i[x]] + rb[j[y]] + reach + _EPS, 2.0)
        keep = cosine[x, y] >= 1 - bound * bound / 2 - _EPS
        x, y = i[x[keep]], j[y[keep]]
        rows, cols = np.zeros(len(na), bool), np.zeros(len(nb), bool)
        rows[x], cols[y] = True, True
        a.kept, b.kept = level, level
    return x, y


def _parent(self: Block, level: int) -> np.ndarray:
    """Node at the last level used of each node of this level, by its centre."""
    return self.levels[self.kept][1][self.levels[level][0]]


Block.points_parent = _parent


def link_blocks(a: Block, b: Block, cosine: float, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, weight of links, id of a linked representative) of the points that have links."""
    same = a is b
    na, total = len(a.ids), len(a.ids) if same else len(a.ids) + len(b.ids)
    offset = 0 if same else na
    gain = np.zeros(total, np.int64)
    us, vs = [], []
    x, y = candidate_nodes(a, b, reach)
    if same:
        upper = x <= y
        x, y = x[upper], y[upper]
    size_a, size_b = np.array([len(m) for m in a.members]), np.array([len(m) for m in b.members])
    lone = (size_a[x] == 1) & (size_b[y] == 1)
    if same:
        lone &= x != y
    if lone.any():
        p = np.array([a.members[k][0] for k in x[lone]])
        q = np.array([b.members[k][0] for k in y[lone]])
        linked = np.einsum("ij,ij->i", a.points[p], b.points[q]) >= cosine
        p, q = p[linked], q[linked]
        np.add.at(gain, p, b.weight[q])
        np.add.at(gain, q + offset, a.weight[p])
        us.append(p)
        vs.append(q + offset)
    for k, l in zip(x[~lone], y[~lone], strict=True):
        p, q = a.members[k], b.members[l]
        if same and k == l:
            if len(p) == 1:
                continue
            if 2 * a.levels[-1][2][k] <= reach - _EPS:  # all pairs are links
                gain[p] += a.weight[p].sum() - a.weight[p]
                us.append(p[1:])
                vs.append(np.full(len(p) - 1, p[0]))
                continue
        else:
            apart = float(distance_of(a.points[a.levels[-1][0][k]] @ b.points[b.levels[-1][0][l]]))
            if apart + a.levels[-1][2][k] + b.levels[-1][2][l] <= reach - _EPS:
                gain[p] += b.weight[q].sum()
                gain[q + offset] += a.weight[p].sum()
                us += [p, np.full(len(q), p[0])]
                vs += [np.full(len(p), q[0] + offset), q + offset]
                continue
        near = a.points[p] @ b.points[q].T >= cosine
        if same and k == l:
            np.fill_diagonal(near, False)
        gain[p] += near @ b.weight[q]
        if not (same and k == l):
            gain[q + offset] += near.T @ a.weight[p]
        i, j = np.nonzero(near)
        us.append(p[i])
        vs.append(q[j] + offset)
    if not us:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids = a.ids if same else np.concatenate([a.ids, b.ids])
    root = forest(np.concatenate(us), np.concatenate(vs), total)
    has = np.flatnonzero(gain)
    return ids[has], gain[has], ids[root[has]]


def point_links(points: DataFrame, cosine: float) -> DataFrame:
    """(p, gain, root): weight of links of each point found by a task, and a point it is connected with there.

    ``points`` has (p, w, v): id, weight and vector, all of one length.
    """
    spark = points.sparkSession
    reach = float(np.sqrt(2 - 2 * cosine))
    n = points.count()
    sample = points.orderBy("p").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
    nodes = upper_tree(_vectors(sample), n)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf, far = route(_vectors(batch.column(2)), nodes)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), pa.array(far)], names=["p", "w", "v", "leaf", "far"])

    kind = points.schema["v"].dataType.simpleString()
    routed = materialize(points.select("p", "w", "v").mapInArrow(place, f"p long, w long, v {kind}, leaf long, far double"), "ct-routed")
    leaves = materialize(routed.groupBy("leaf").agg(F.max("far").alias("radius"), F.ceil(F.count("*") / BLOCK).alias("cuts")), "ct-leaves")
    known = leaves.orderBy("leaf").collect()  # nodes of the tree, bounded by the sample
    cuts = np.array([r["cuts"] for r in known])
    first, blocks_ = np.cumsum(cuts) - cuts, int(cuts.sum())
    tile = min(max(blocks_ // 8, 1), TILE)
    rounds = -(-(-(-blocks_ // tile)) // COPIES)
    numbered = spark.createDataFrame([(r["leaf"], r["cuts"], int(f)) for r, f in zip(known, first, strict=True)], "leaf long, cuts long, first long")
    pairs = spark.createDataFrame(sorted(set(leaf_pairs(nodes, {r["leaf"]: r["radius"] for r in known}, reach))), "a long, b long")
    sizes = numbered.select("leaf", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("cuts") - 1)).alias("block"))
    left = sizes.select(F.col("leaf").alias("a"), F.col("block").alias("ba"))
    right = sizes.select(F.col("leaf").alias("b"), F.col("block").alias("bb"))
    pairs = pairs.join(left, "a").join(right, "b").where((F.col("a") != F.col("b")) | (F.col("ba") <= F.col("bb")))
    low, high = F.least("ba", "bb"), F.greatest("ba", "bb")
    tiled = pairs.select(F.floor(low / tile).alias("ta"), F.floor(high / tile).alias("tb"), F.array(low, high).alias("ends"))
    tiled = materialize(tiled.groupBy("ta", "tb").agg(F.flatten(F.collect_list("ends")).alias("wanted")), "ct-pairs")

    def grow(batch: pa.Table) -> pa.Table:
        levels = block_levels(_vectors(batch.column("v").combine_chunks()))
        for i, owner in enumerate(levels):
            batch = batch.append_column(f"l{i}", pa.array(owner))
        return batch.append_column("at", pa.array(np.arange(batch.num_rows)))

    levels = [f"l{i}" for i in range(len(RADII))]
    block = F.col("first") + F.pmod(F.xxhash64("p", F.lit("cut")), F.col("cuts"))
    blocked = routed.join(F.broadcast(numbered), "leaf").select(block.alias("block"), "p", "w", "v")
    grown = materialize(blocked.groupBy("block").applyInArrow(
        grow, f"block long, p long, w long, v {kind}, {', '.join(f'{c} long' for c in levels)}, at long"), "ct-grown")
    discard(routed)

    def stream(number: int) -> DataFrame:
        """What tasks of a round read: per pair of tiles the wanted pairs of blocks, then the points of both."""
        mine = tiled.where(F.pmod(F.col("ta") + F.col("tb"), F.lit(rounds)) == number).withColumn("pair", F.xxhash64("ta", "tb"))
        ends = mine.select("pair", F.lit(0).alias("side"), F.col("ta").alias("tile")).union(
            mine.where("ta != tb").select("pair", F.lit(1), F.col("tb")))
        rows = ends.join(grown.withColumn("tile", F.floor(F.col("block") / tile)), "tile").select("pair", "side", "block", "at", "p", "w", "v", *levels)
        rows = mine.select("pair", F.lit(-1).alias("side"), "wanted").unionByName(rows, allowMissingColumns=True)
        return rows.repartition(max(16, mine.count()), "pair").sortWithinPartitions("pair", "side", "block", "at")

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: pa.Table) -> dict[int, Block]:
            rows, out = rows.combine_chunks(), {}
            number = rows.column("block").to_numpy()
            starts = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
            for s, e in zip(starts, [*starts[1:], len(number)], strict=True):
                part = rows.slice(s, e - s)
                out[int(number[s])] = Block(part.column("p").to_numpy(), part.column("w").to_numpy(), _vectors(part.column("v").combine_chunks()),
                                            [part.column(c).to_numpy() for c in levels])
            return out

        def blocks(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            ahead = pc.equal(rows.column("side"), -1)
            wanted = np.concatenate([r for r in rows.filter(ahead).column("wanted").to_pylist()]).reshape(-1, 2).tolist()
            rows = rows.filter(pc.invert(ahead)).drop_columns(["wanted", "pair"])
            held = {}
            for side in (0, 1):
                part = rows.filter(pc.equal(rows.column("side"), side))
                held |= made(part) if part.num_rows else {}
            for a, b in wanted:
                if a in held and b in held:  # a cut of a leaf may have got no point
                    found = link_blocks(held[a], held[b], cosine, reach)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["p", "gain", "root"])

        held, current = [], None
        for batch in batches:
            name = batch.column(0).to_numpy()
            edge = np.flatnonzero(np.append(True, name[1:] != name[:-1])) if len(name) else []
            for s, e in zip(edge, [*edge[1:], len(name)], strict=True):
                if current is not None and name[s] != current:
                    yield from blocks(pa.Table.from_batches(held))
                    held = []
                current = name[s]
                held.append(batch.slice(s, e - s))
        if held:
            yield from blocks(pa.Table.from_batches(held))

    done = [materialize(stream(number).mapInArrow(traverse, "p long, gain long, root long"), "ct-round") for number in range(rounds)]
    discard(grown)
    return reduce(DataFrame.union, done)


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per vector: key, ``n_links``, ``component_id`` and ``kept``.

    All vectors are compared, by cosine in double precision.  Vectors that are
    null, empty or zero, or hold null or non-finite components, link with
    nothing; nor do vectors of different lengths with each other.  Rows that
    repeat a key with the same vector are one.  Rows with a null key take no
    part: they have no links, a null component and are not kept.  Only the two
    named columns are read; an empty table gives an empty table.
    """
    rows = materialize(vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")).distinct(), "ct-rows")
    good = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    points = materialize(good.groupBy("v").agg(F.min("id").alias("low"), F.count("*").alias("w")).select(
        F.xxhash64("v").alias("p"), "low", "w", "v", F.size("v").alias("length")), "ct-points")
    found = None
    for r in points.select("length").distinct().collect():
        part = point_links(points.where(F.col("length") == r["length"]), cosine)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"),
                           F.col("id").isNotNull().alias("kept"))
    found = materialize(found, "ct-links")
    gains = found.groupBy("p").agg(F.sum("gain").alias("gain"))
    parts = components(found, "p", "root").select(F.col("node").alias("p"), F.col("component").alias("part"))
    classes = points.join(gains, "p", "left").join(parts, "p", "left").select(
        "v", "low", (F.col("w") - 1 + F.coalesce("gain", F.lit(0))).alias("links"), F.coalesce("part", "p").alias("part"))
    least = classes.groupBy("part").agg(F.min("low").alias("component"))
    classes = classes.join(least, "part").select("v", "links", "component")
    linked = good.join(classes, "v").select("id", "links", "component")
    alone = rows.where(F.col("id").isNull() | ~usable(F.col("v"))).select("id", F.lit(0).cast("long"), F.col("id"))
    return linked.union(alone).select(
        F.col("id").alias(key), F.col("links").alias("n_links"), F.col("component").alias("component_id"),
        (F.col("id").isNotNull() & (F.col("id") == F.col("component"))).alias("kept"))


@query("op2_cover_tree", f"""
    WITH RECURSIVE v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
        WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
          AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
              AND list_cosine_similarity(a.e, b.e) >= {COSINE}),
    reach(a, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.c = links.a),
    low AS (SELECT a AS vec_id, min(c) AS component_id FROM reach GROUP BY a),
    n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM low LEFT JOIN n USING (vec_id)""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
