"""Jaccard join of documents on word shingles by vertical partitioning.

The shingles of a document, as 64-bit hashes, stand in one global order, the
order of the hashes; the order is cut into fragments, and a document's set is
cut at the same places.  Overlaps are counted fragment by fragment and the
partial counts are summed per pair.

1. Equal sets are one class, known by a hash of the set.
2. The head of a set is the fragment in which similar sets must meet: two sets
   with Jaccard t share at least 1 + e of their n - ceil(t n) + 1 + e smallest
   hashes.  Each task passes a head hash on once, so a frequent one stays small;
   hashes of a single class go.
3. Lists of up to ``LIST`` classes count partial overlaps of all their pairs.
   Pairs whose heads share less than similar sets of their sizes must, even if
   all their hashes in longer lists were shared, go.  Of the rest, all fragments
   are intersected one by one and the partial counts summed; what reaches the
   threshold is a link.
4. Longer lists only matter between classes with more than e hashes in them.
   These stand in a second order, rarest hashes first, where long passages that
   many documents share come last.  In its lists a class first meets the leader
   that most of its lists have.  Lists that still hold several components are
   gathered into clusters, cut into blocks, and pairs of blocks sum the overlaps
   of their classes over all fragments, whole groups at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.llm.graph import components, forest
from tabulon.llm.registry import query, table
from tabulon.llm.words import U64, WordHasher, byte_table, mix, signed, text_slices
from tabulon.session import discard, materialize

WIDTH, PERCENT = 5, 75
FRAGMENTS = 8
LIST = 32  # classes of a list whose pairs are counted directly; longer lists go by leaders
BLOCK, BLOCK_HASHES = 1_024, 1 << 18  # classes and hashes of a block of a cluster, about
_STRIPE = 4_096  # hashes laid out as columns at a time
_BUFFER = 1 << 20  # head hashes a task gathers before it passes them on
_SHARD = 1 << 20  # head hashes a task of the meeting stage should have
_SMALL = 1_000_000  # keys of 8 bytes up to which a side is broadcast; beyond, both sides are shuffled
_SPREAD = [U64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                                0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


# ---- sets ----

def need(n, percent: int = PERCENT):
    """Least overlap of a set of size n with any similar set."""
    return -(-n * percent // 100)


def slack(n):
    """Extra hashes of a head (e): how many frequent ones a class may have there without meeting over them."""
    return n // 20


def head_size(n, percent: int = PERCENT):
    return n - need(n, percent) + 1 + slack(n)


def shingle_rows(column: pa.Array, hasher: WordHasher, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per slice: first row, row offsets and the distinct shingles of each row in ascending order."""
    weights = [U64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) | 1) for i in range(width)]
    for first, to, data, bounds in text_slices(column):
        words, at = hasher(data, bounds)
        rows, sizes = to - first, np.diff(at)
        full = np.zeros(len(words), U64)
        span = max(len(words) - width + 1, 0)
        for i, k in enumerate(weights):
            full[:span] += words[i:i + span] * k
        full = mix(full)
        row = np.repeat(np.arange(rows), sizes)
        inside = np.arange(len(words)) + width <= at[1:][row]
        keys, owner = full[inside], row[inside]
        short = np.flatnonzero((sizes > 0) & (sizes < width))
        if len(short):  # fewer words than a shingle: the whole sequence is one
            whole = [mix(np.add.reduce(words[at[r]:at[r + 1]] * np.array(weights[:sizes[r]], U64), keepdims=True)
                         + U64(sizes[r]))[0] for r in short]
            keys, owner = np.concatenate([keys, np.array(whole, U64)]), np.concatenate([owner, short])
        order = np.lexsort((keys, owner))
        keys, owner = keys[order], owner[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        keys, owner = keys[fresh], owner[fresh]
        yield first, np.searchsorted(owner, np.arange(rows + 1)), keys


def set_hashes(at: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A hash of each row's set."""
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(keys * _SPREAD[2]), dtype=U64)])
    return mix((total[at[1:]] - total[at[:-1]]) * _SPREAD[3] + np.diff(at).astype(U64))


def set_table(docs: DataFrame, key: str, text: str, width: int = WIDTH) -> DataFrame:
    """(doc, n, s): size and hash of each row's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(byte_table(fold=True, split_marks=False))
        for batch in batches:
            for first, at, keys in shingle_rows(batch.column(1), hasher, width):
                a = set_hashes(at, keys)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(a)), pa.array(np.diff(at)), signed(a)], names=["doc", "n", "s"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc"), text).mapInArrow(run, f"doc {kind}, n long, s long")


_ENTRY = np.dtype([("t", "<u8"), ("s", "<u8")])


def _entries(entries: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [signed(np.ascontiguousarray(entries["t"])), signed(np.ascontiguousarray(entries["s"]))], names=["t", "s"])


def head_lists(docs: DataFrame, text: str, total: int, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(t, s): head hashes that more than one class may have, with the classes that have them.

    A task gathers heads and sends each hash once: alone with its class, or as
    a mark (class 0) when several classes of the task have it, whose entries
    then only pass through.
    """
    shards = max(64, -(-total * 3 // (10 * _SHARD)))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = WordHasher(byte_table(fold=True, split_marks=False)), [], 0

        def flush() -> pa.RecordBatch:
            entries = np.unique(np.concatenate(held))
            held.clear()
            starts = np.flatnonzero(np.append(True, entries["t"][1:] != entries["t"][:-1])) if len(entries) else np.zeros(0, int)
            several = np.diff(np.append(starts, len(entries))) > 1
            first = entries[starts].copy()
            first["s"][several] = 0
            through = entries[np.repeat(several, np.diff(np.append(starts, len(entries))))]
            blobs = []
            for part in (first, through):
                shard = (part["t"] >> U64(40)) % U64(shards)
                order = np.argsort(shard, kind="stable")
                cut = np.searchsorted(shard[order], np.arange(shards + 1, dtype=U64))
                part = part[order]
                blobs.append([part[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.arange(shards, dtype=np.int32)), pa.array(blobs[0], pa.binary()), pa.array(blobs[1], pa.binary())],
                names=["shard", "once", "through"])

        for batch in batches:
            for _, at, keys in shingle_rows(batch.column(0), hasher, width):
                a, n = set_hashes(at, keys), np.diff(at)
                take = np.where(n > 0, np.minimum(head_size(n, percent), n), 0)
                in_head = np.arange(len(keys)) - np.repeat(at[:-1], n) < np.repeat(take, n)
                entries = np.empty(int(take.sum()), _ENTRY)
                entries["t"], entries["s"] = keys[in_head], np.repeat(a, take)
                held.append(entries)
                size += len(entries)
                if size >= _BUFFER:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for blob in batch.column(2).to_pylist():
                if blob:
                    yield _entries(np.frombuffer(blob, _ENTRY))
            held.extend(np.frombuffer(b, _ENTRY) for b in batch.column(1).to_pylist() if b)
        if held:
            entries = np.unique(np.concatenate(held))
            same = entries["t"][1:] == entries["t"][:-1]
            shared = np.append(False, same) | np.append(same, False)
            yield _entries(entries[shared & (entries["s"] != 0)])

    sent = docs.select(text).mapInArrow(gather, "shard int, once binary, through binary")
    sent = sent.where((F.length("once") > 0) | (F.length("through") > 0))
    return sent.repartition(shards, "shard").mapInArrow(meet, "t long, s long").distinct()


def _cut_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(doc, s, f, part): the sets of all rows that have a wanted key, cut into fragments of the global order."""
    few = wanted.count() <= _SMALL
    rows = docs.select(F.col(key).alias("doc"), text).join(F.broadcast(wanted) if few else wanted, "doc", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(byte_table(fold=True, split_marks=False))
        for batch in batches:
            for first, at, keys in shingle_rows(batch.column(1), hasher, width):
                a = set_hashes(at, keys)
                rows = len(a)
                cell = np.repeat(np.arange(rows), np.diff(at)) * FRAGMENTS + (keys >> U64(61)).astype(np.int64)
                cuts = np.searchsorted(cell, np.arange(rows * FRAGMENTS + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(first + np.repeat(np.arange(rows), FRAGMENTS))), signed(np.repeat(a, FRAGMENTS)),
                     pa.array(np.tile(np.arange(FRAGMENTS, dtype=np.int32), rows)),
                     pa.ListArray.from_arrays(pa.array(cuts), signed(keys))], names=["doc", "s", "f", "part"])

    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"doc {kind}, s long, f int, part array<long>").where(F.size("part") > 0)


def fragment_rows(
    docs: DataFrame, wanted: DataFrame, sets: DataFrame, key: str, text: str, width: int = WIDTH,
) -> DataFrame:
    """(s, f, part), once per class and fragment: the sets of the wanted (s, doc), one document per class.

    A key with one row gives its class once, so nothing is shuffled for it.  The
    rows of a repeated key are the same class again or other classes: only the
    wanted ones stay, once each.
    """
    rows = sets.join(wanted.select("doc").distinct(), "doc", "left_semi").groupBy("doc").agg(F.count("*").alias("rows"))
    counted = materialize(wanted.join(rows, "doc"), "counted")
    out = _cut_sets(docs, counted.where("rows = 1").select("doc"), key, text, width).drop("doc")
    again = counted.where("rows > 1").select("doc", "s")
    if again.take(1):
        cut = _cut_sets(docs, again.select("doc").distinct(), key, text, width)
        out = out.unionByName(cut.join(again, ["doc", "s"], "left_semi").drop("doc").dropDuplicates(["s", "f"]))
    return out


# ---- pairs ----

def _similar_sizes(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _head_need(a: Column, b: Column, percent: int) -> Column:
    """Least overlap of the heads of two similar sets of sizes a and b.

    Shared hashes stand in the same order in both sets, so all but those behind
    the head of one of them lie in both heads.
    """
    def behind(n: Column) -> Column:
        return F.ceil(n * percent / 100) - 1 - F.floor(n / 20)

    return F.ceil((a + b) * percent / (100 + percent)) - F.greatest(behind(a), behind(b))


def verified(pairs: DataFrame, fragments: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) whose partial overlaps sum up to the threshold, as (a, b)."""
    left = fragments.select(F.col("s").alias("a"), "f", F.col("part").alias("pa"))
    right = fragments.select(F.col("s").alias("b"), "f", F.col("part").alias("pb"))
    partial = pairs.join(left, "a").join(right, ["b", "f"]).select(
        "a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).alias("o"))
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    return total.where(100 * F.col("o") >= percent * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def _ordered(rows: DataFrame) -> DataFrame:
    """Pairs (x, nx, y, ny) as distinct (a, b, na, nb) with a < b."""
    swap = F.col("x") > F.col("y")
    return rows.select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"),
        F.when(swap, F.col("ny")).otherwise(F.col("nx")).alias("na"),
        F.when(swap, F.col("nx")).otherwise(F.col("ny")).alias("nb")).distinct()


def rare_first_lists(fragments: DataFrame, percent: int) -> DataFrame:
    """(t, s, n): for each class, the n - ceil(t n) + 1 hashes that fewest of these classes have.

    Similar classes share at least one of them.  Hashes of a single class go.
    """
    tokens = fragments.select("s", "n", F.explode("part").alias("t"))
    shared = tokens.groupBy("t").agg(F.count("*").alias("m"))
    place = F.row_number().over(Window.partitionBy("s").orderBy("m", "t"))
    ranked = tokens.join(shared, "t").withColumn("place", place)
    head = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    return ranked.where((F.col("place") <= head) & (F.col("m") > 1)).select("t", "s", "n")


def _with_component(rows: DataFrame, parts: DataFrame | None) -> DataFrame:
    if parts is None:
        return rows.withColumn("c", F.col("s"))
    return rows.join(parts, rows["s"] == parts["node"], "left").withColumn(
        "c", F.coalesce("component", "s")).drop("node", "component")


def shingle_links(docs: DataFrame, sets: DataFrame, key: str, text: str, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(a, b): links between classes, enough for the components of all links.

    ``sets`` is the table of ``set_table``.  All pairs that short lists bring
    together are decided; in longer lists, pairs within a component already
    known are left out.
    """
    classes = sets.where(F.col("n") > 0).groupBy("s").agg(F.min("doc").alias("doc"), F.max("n").alias("n"))
    total = sets.agg(F.sum("n")).first()[0] or 0
    lists = materialize(head_lists(docs, text, total, width, percent), "heads")
    size = lists.groupBy("t").agg(F.count("*").alias("m")).where(F.col("m") > 1)
    rows = materialize(lists.join(size, "t").join(classes.select("s", "n"), "s"), "lists")
    discard(lists)
    frequent = materialize(rows.where(F.col("m") > LIST).groupBy("s", "n").agg(F.count("*").alias("h")), "frequent")
    unsafe = frequent.where(F.col("h") > F.floor(F.ceil(F.col("n") * percent / 100) / 20)).select("s", "n")

    short = rows.where(F.col("m") <= LIST)
    x = short.select("t", F.col("s").alias("x"), F.col("n").alias("nx"))
    y = short.select("t", F.col("s").alias("y"), F.col("n").alias("ny"))
    met = (x.join(y, "t").where((F.col("x") < F.col("y")) & _similar_sizes(F.col("nx"), F.col("ny"), percent))
           .groupBy("x", "nx", "y", "ny").agg(F.count("*").alias("o")))
    for side in ("x", "y"):
        met = met.join(frequent.select(F.col("s").alias(side), F.col("h").alias(f"h{side}")), side, "left")
    missed = F.least(F.coalesce("hx", F.lit(0)), F.coalesce("hy", F.lit(0)))
    short_pairs = materialize(_ordered(met.where(F.col("o") + missed >= _head_need(F.col("nx"), F.col("ny"), percent))), "short-pairs")

    involved = (short_pairs.select(F.col("a").alias("s")).union(short_pairs.select("b")).union(unsafe.select("s")).distinct()
                .join(classes, "s").select("s", "doc"))
    wanted = materialize(involved, "wanted")
    discard(rows)
    fragments = materialize(fragment_rows(docs, wanted, sets, key, text, width), "fragments")
    links = materialize(verified(short_pairs, fragments, percent), "short-links")
    discard(wanted, short_pairs)
    in_long = materialize(rare_first_lists(fragments.join(unsafe, "s"), percent), "long-lists")
    discard(frequent)
    if in_long.take(1):
        now = materialize(_with_component(in_long, components(links)), "open")
        links = links.union(materialize(verified(_leader_pairs(now, percent), fragments, percent), "leader-links"))
        now = materialize(_with_component(in_long, components(links)), "open")
        links = links.union(materialize(block_links(_mixed(now), fragments, percent), "block-links"))
    discard(in_long, fragments)
    return links


def _mixed(rows: DataFrame) -> DataFrame:
    """Rows of the lists that hold several components."""
    ends = rows.groupBy("t").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    return rows.join(ends.where(F.col("low") != F.col("high")).select("t"), "t", "left_semi")


def _leader_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Each class with the leader that most of its lists have, if that is of another component."""
    open_rows = _mixed(rows)
    leader = open_rows.groupBy("t").agg(F.max(F.struct(F.xxhash64("s"), "s", "n", "c")).alias("l")).select(
        "t", F.col("l.s").alias("y"), F.col("l.n").alias("ny"), F.col("l.c").alias("cy"))
    led = open_rows.join(leader, "t").where((F.col("c") != F.col("cy")) & _similar_sizes(F.col("n"), F.col("ny"), percent))
    votes = led.groupBy("s", "n", "y", "ny").agg(F.count("*").alias("k"))
    best = votes.groupBy("s", "n").agg(F.max(F.struct("k", "y", "ny")).alias("v"))
    return _ordered(best.select(F.col("s").alias("x"), F.col("n").alias("nx"), F.col("v.y").alias("y"), F.col("v.ny").alias("ny")))


def block_links(rows: DataFrame, fragments: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between classes of different components that lists bring together.

    ``rows`` is (t, s, n, c).  Lists that share classes are one cluster.  A
    cluster is cut into blocks of bounded size and each pair of blocks is a
    task, which sums the overlaps of its classes over the fragments and returns
    a spanning forest of the links, so no pair is ever a row.
    """
    leader = rows.groupBy("t").agg(F.max("s").alias("y"))
    cluster = components(rows.join(leader, "t").select(F.col("s").alias("a"), F.col("y").alias("b")))
    members = rows.select("s", "n", "c").distinct().join(cluster.withColumnsRenamed({"node": "s", "component": "k"}), "s")
    sizes = members.groupBy("k").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_HASHES)).alias("cuts"))
    placed = members.join(sizes, "k").withColumn("i", F.pmod(F.xxhash64(F.lit("block"), "s"), F.col("cuts")))
    meets = placed.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1))).select(
        "k", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), (F.col("i") > F.col("j")).alias("right"), "s", "n", "c")
    stream = meets.join(fragments.select("s", "part"), "s").select("k", "lo", "hi", "right", "s", "n", "c", "part")
    stream = stream.repartition("k", "lo", "hi").sortWithinPartitions("k", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table_ = pa.Table.from_batches(held)
            one_block = table_.column("lo")[0] == table_.column("hi")[0]
            code, first, owner = np.unique(table_.column("s").to_numpy(), return_index=True, return_inverse=True)
            n, c = table_.column("n").to_numpy()[first], table_.column("c").to_numpy()[first]
            right = table_.column("right").to_numpy()[first]
            a = np.arange(len(code)) if one_block else np.flatnonzero(~right)
            b = a if one_block else np.flatnonzero(right)
            parts = table_.column("part").combine_chunks()
            owner = np.repeat(owner, np.diff(parts.offsets.to_numpy()))
            _, token, seen = np.unique(parts.flatten().to_numpy(), return_inverse=True, return_counts=True)
            owner, token = owner[seen[token] > 1], token[seen[token] > 1]
            _, token = np.unique(token, return_inverse=True)
            overlap = np.zeros((len(a), len(b)), np.float32)
            order = np.argsort(token, kind="stable")
            owner, token = owner[order], token[order]
            for low in range(0, int(token[-1]) + 1 if len(token) else 0, _STRIPE):
                s, e = np.searchsorted(token, [low, low + _STRIPE])
                stripe = np.zeros((len(code), _STRIPE), np.float32)
                stripe[owner[s:e], token[s:e] - low] = 1
                overlap += stripe[a] @ stripe[b].T
            near = 100 * overlap >= percent * (n[a][:, None] + n[b][None, :] - overlap)
            i, j = np.nonzero(near & (c[a][:, None] != c[b][None, :]))
            root = forest(a[i], b[j], len(code))
            linked = np.flatnonzero(root != np.arange(len(code)))
            return pa.RecordBatch.from_arrays([pa.array(code[linked]), pa.array(code[root[linked]])], names=["a", "b"])

        held, current = [], None
        for batch in batches:
            name = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            edge = np.flatnonzero(np.append(True, (name[1:] != name[:-1]).any(axis=1))) if len(name) else []
            for s, e in zip(edge, [*edge[1:], len(name)], strict=True):
                if current is not None and tuple(name[s]) != current:
                    yield found(held)
                    held = []
                current = tuple(name[s])
                held.append(batch.slice(s, e - s))
        if held:
            yield found(held)

    return stream.mapInArrow(run, "a long, b long")


def shingle_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT,
) -> DataFrame:
    """Per row: key, ``n_shingles`` and ``component_id`` (smallest key reachable by links).

    A-Z are folded; words are runs of bytes other than 0x20 and 0x09-0x0D.  A
    text with fewer words than ``width`` is one shingle; null texts and texts
    without words have none and are linked with nothing.  Two documents link
    when their sets' Jaccard similarity is at least ``percent`` / 100.  Rows with
    a null key have a null component.  Rows repeating a key link like copies;
    only key and text are read.  An empty table gives an empty table.
    """
    sets = materialize(set_table(docs, key, text, width), "sets")
    links = shingle_links(docs.where(F.col(key).isNotNull()), sets.where(F.col("doc").isNotNull()), key, text, width, percent)
    parts = components(links).withColumnRenamed("component", "part")
    classes = sets.where(F.col("n") > 0).groupBy("s").agg(F.min("doc").alias("low"))
    grouped = classes.join(parts, classes["s"] == parts["node"], "left").select(
        "s", "low", F.coalesce("part", "s").alias("part"))
    least = grouped.groupBy("part").agg(F.min("low").alias("component"))
    named = grouped.join(least, "part").select("s", "component")
    filled = sets.where(F.col("n") > 0).join(named, "s").select("doc", "n", "component")
    empty = sets.where(F.col("n") == 0).select("doc", "n", F.col("doc").alias("component"))
    return filled.union(empty).select(
        F.col("doc").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("doc").isNotNull(), F.col("component")).alias("component_id"))


@query("op8_shingle_join", f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
        FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {WIDTH} THEN list_transform(range(1, len(w) - {WIDTH - 2}),
            lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh
        FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
    one AS (SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= {PERCENT} * (x.n + y.n - o)),
    links AS (SELECT a, b FROM one UNION SELECT b, a FROM one),
    reach(a, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.c = links.a)
    SELECT reach.a AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(c) AS component_id
    FROM reach LEFT JOIN n ON reach.a = n.doc_id GROUP BY reach.a""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_components(table(spark, sf_dir, "documents"))
