"""Quality classifier: perplexity under an interpolated modified Kneser-Ney trigram model.

The model is trained on one half of all trusted documents (labelled good), the
other half sets the thresholds.  Counting, continuation counts, discounts and
the interpolation of an order with the one below are joins and groupings of
count tables.  Only the vocabulary is broadcast.  The finished tables (n-gram
key, log probability, back-off weight) are dealt into shards by the middle word
of a trigram, which all its n-grams share; very frequent words are dealt out
further.  Tasks read the documents once and send the trigrams of a block, sorted
and compressed, to the shards; a shard looks them up by binary search and sends
back one sum per document of the block.  Documents never move.

The threshold of a language is a high quantile over all its trusted documents
that the model has not seen, times a margin, so clean text stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabulon.llm.registry import query, table
from tabulon.llm.words import U64, WordHasher, byte_table, signed, text_slices
from tabulon.session import discard, materialize

START, UNKNOWN = 1, 2  # ids that no word hash takes in practice
CODES = 3  # first code of a known word
BROADCAST_KEYS = 500_000  # trusted keys up to which they are broadcast; beyond, both sides are shuffled
SHARD_BYTES = 128 << 20  # text whose trigrams meet one shard of the model
BLOCK_TOKENS = 1 << 22  # tokens that a task gathers before it sends them
_GRID = float(1 << 28)  # losses are summed as whole numbers: the same for any blocks and shards
QUANTILE, MARGIN = 0.995, 1.1
SHRINK = 10  # tokens of average text that a document's mean is drawn towards
_MASK = (1 << 64) - 1
# Primes of the hash.
_XX = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
MIN_LANG_DOCS = 50  # trusted documents a language needs for a threshold of its own


# ---- counts ----

def _trigram_rows(column: pa.Array, hasher: WordHasher) -> Iterator[tuple[np.ndarray, ...]]:
    """Per slice: ids (u, v, w) of every token and the row of each token."""
    for first, to, data, bounds in text_slices(column):
        words, at = hasher(data, bounds)
        row = np.repeat(np.arange(first, to), np.diff(at))
        u, v = np.full(len(words), START, U64), np.full(len(words), START, U64)
        v[1:], u[2:] = words[:-1], words[:-2]
        heads = at[:-1][np.diff(at) > 0]
        v[heads] = START
        u[heads] = START
        u[heads[heads + 1 < len(words)] + 1] = START
        yield u, v, words, row


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(w, n) over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(byte_table(fold=False, split_marks=True))
        for batch in batches:
            for _, _, data, bounds in text_slices(batch.column(0)):
                words, n = np.unique(hasher(data, bounds)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([signed(words), pa.array(n)], names=["w", "n"])

    return docs.select(text).mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))


def _coded(listed: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Codes of word hashes: short numbers, so that n-grams take little room where they are shuffled."""
    at, there = _look(listed, words)
    return np.where(there, at + CODES, UNKNOWN)


def trigram_counts(docs: DataFrame, known: Broadcast, text: str = "text") -> DataFrame:
    """(u, v, w, c) over all texts in codes: places of ``known`` words after the fixed codes, else ``UNKNOWN``, before the first word ``START``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, listed = WordHasher(byte_table(fold=False, split_marks=True)), known.value
        for batch in batches:
            for grams in _trigram_rows(batch.column(0), hasher):
                if len(grams[2]):
                    codes = [np.where(x == START, START, _coded(listed, x)).astype(U64) for x in grams[:3]]
                    grams, c = np.unique(np.stack(codes, 1), axis=0, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [signed(np.ascontiguousarray(grams[:, i])) for i in range(3)] + [pa.array(c)], names=["u", "v", "w", "c"])

    return docs.select(text).mapInArrow(run, "u long, v long, w long, c long").groupBy("u", "v", "w").agg(F.sum("c").alias("c"))


def _discounts(counts: DataFrame, c: str) -> tuple[float, float, float]:
    """D1, D2, D3+ of modified Kneser-Ney from the numbers of n-grams seen 1 to 4 times."""
    seen = {r[0]: r[1] for r in counts.where(F.col(c) <= 4).groupBy(c).count().collect()}
    n = [seen.get(i, 0) for i in range(1, 5)]
    if 0 in n[:3]:
        return 0.5, 0.75, 0.9  # too little text for the estimate
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3))


def _cut(c: Column, d: tuple[float, float, float]) -> Column:
    return F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


def _context(counts: DataFrame, keys: list[str], c: str, d: tuple[float, float, float], names: tuple[str, str]) -> DataFrame:
    """Total count of each context and the weight it leaves to the order below."""
    total, left = names
    n = F.col(c)
    return counts.groupBy(*keys).agg(
        F.sum(n).cast("double").alias(total), (F.sum(_cut(n, d)) / F.sum(n)).alias(left))


@dataclass(frozen=True)
class TrigramModel:
    """Sorted shards: keys with log probabilities, contexts with log back-off weights."""

    vocabulary: np.ndarray
    p1: np.ndarray
    absent: float
    keys2: np.ndarray
    p2: np.ndarray
    contexts1: np.ndarray
    back1: np.ndarray
    keys3: np.ndarray
    p3: np.ndarray
    contexts2: np.ndarray
    back2: np.ndarray


def _key(*parts: np.ndarray, start: np.ndarray | int = 42) -> np.ndarray:
    """Spark's ``xxhash64`` of longs, for arrays; ``start`` continues a key by further parts."""
    p1, p2, p3, p4, p5 = (U64(x) for x in _XX)  # the published primes
    for x in parts:
        k = x * p2
        k = ((k << U64(31)) | (k >> U64(33))) * p1
        h = (start + p5 + U64(8) if isinstance(start, np.ndarray) else U64((start + _XX[4] + 8) & _MASK)) ^ k
        h = ((h << U64(27)) | (h >> U64(37))) * p1 + p4
        h = (h ^ (h >> U64(33))) * p2
        h = (h ^ (h >> U64(29))) * p3
        start = h ^ (h >> U64(32))
    return start


def _shard(df: DataFrame, key: Column, value: Column) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and natural logs of a table that fits the driver, 12 bytes a row."""
    got = df.select(key.alias("k"), F.ln(value).cast("float").alias("p")).toArrow()
    keys, logs = got.column("k").to_numpy().view(U64), got.column("p").to_numpy()
    order = np.argsort(keys)
    return keys[order], logs[order]


@dataclass(frozen=True)
class TrigramTables:
    """The vocabulary as arrays, the n-grams in codes as tables that Spark holds: (v, w, p), (u, v, w, p), (u, v, p)."""

    listed: np.ndarray  # sorted hashes of the known words
    vocabulary: np.ndarray
    p1: np.ndarray
    absent: float
    contexts1: np.ndarray
    back1: np.ndarray
    pairs: DataFrame
    triples: DataFrame
    contexts: DataFrame
    middles: DataFrame  # (v, c): how often a word is in the middle of a trigram


def train_tables(docs: DataFrame, text: str = "text", min_count: int = 2) -> TrigramTables:
    """Fit the model on all of ``docs``.

    Words seen less than ``min_count`` times are one unknown word, whose
    probability is shared equally by as many words as it stands for.
    """
    words = materialize(word_counts(docs, text), "kn-words")
    listed = words.where(F.col("n") >= min_count).select("w").toArrow().column("w").to_numpy().view(U64)
    spared = max(words.where(F.col("n") < min_count).count(), 1)
    listed = np.sort(listed)
    known = docs.sparkSession.sparkContext.broadcast(listed)
    c3 = materialize(trigram_counts(docs, known, text), "kn-3")
    known.destroy()
    c2 = materialize(c3.groupBy("v", "w").agg(F.count("*").alias("c")), "kn-2")
    c1 = materialize(c2.groupBy("w").agg(F.count("*").alias("c")), "kn-1")
    d3, d2, d1 = _discounts(c3, "c"), _discounts(c2, "c"), _discounts(c1, "c")

    size, total, left = c1.agg(F.count("*"), F.sum("c"), F.sum(_cut(F.col("c"), d1))).first()
    if not size:
        raise ValueError("no text to train on")
    floor = left / total / (size + 1)
    p1 = c1.select("w", ((F.col("c") - _cut(F.col("c"), d1)) / total + floor).alias("p1"))
    e2 = _context(c2, ["v"], "c", d2, ("t2", "b2"))
    p2 = materialize(c2.join(e2, "v").join(p1, "w").select(
        "v", "w", ((F.col("c") - _cut(F.col("c"), d2)) / F.col("t2") + F.col("b2") * F.col("p1")).alias("p2")), "kn-p2")
    e3 = materialize(_context(c3, ["u", "v"], "c", d3, ("t3", "b3")), "kn-e3")
    p3 = c3.join(e3, ["u", "v"]).join(p2, ["v", "w"]).select(
        "u", "v", "w", ((F.col("c") - _cut(F.col("c"), d3)) / F.col("t3") + F.col("b3") * F.col("p2")).alias("p3"))

    def spread(p: str) -> Column:
        return F.when(F.col("w") == UNKNOWN, F.col(p) / spared).otherwise(F.col(p))

    vocabulary, logp1 = _shard(p1, F.col("w"), spread("p1"))
    unknown = logp1[vocabulary == UNKNOWN]
    contexts1, back1 = _shard(e2, F.col("v"), F.col("b2"))
    absent = float(unknown[0]) if len(unknown) else math.log(floor)
    middles = materialize(c3.groupBy("v").agg(F.sum("c").alias("c")), "kn-middles")
    triples = materialize(p3.select("u", "v", "w", spread("p3").alias("p")), "kn-p3")
    discard(words, c3, c2, c1)
    return TrigramTables(listed, vocabulary, logp1, absent, contexts1, back1, materialized(p2, p2.select("v", "w", spread("p2").alias("p"))), triples,
                         materialized(e3, e3.select("u", "v", F.col("b3").alias("p"))), middles)


def materialized(stored: DataFrame, view: DataFrame) -> DataFrame:
    """A view of a stored table that is deleted with it."""
    view.scratch = stored.scratch
    return view


def train(docs: DataFrame, text: str = "text", min_count: int = 2) -> TrigramModel:
    """The model of few documents as arrays; their number is the caller's bound."""
    t = train_tables(docs, text, min_count)
    words = np.concatenate([np.array([0, START, UNKNOWN], U64), t.listed])

    def by_hash(codes: list[np.ndarray], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = [words[c.astype(np.int64)] for c in codes]
        keys = _key(*keys) if len(keys) > 1 else keys[0]
        order = np.argsort(keys)
        return keys[order], values[order]

    def collected(df: DataFrame, *names: str) -> tuple[np.ndarray, np.ndarray]:
        got = df.select(*names, F.ln("p").cast("float").alias("p")).toArrow()
        return by_hash([got.column(c).to_numpy() for c in names], got.column("p").to_numpy())

    (keys2, p2), (keys3, p3), (contexts2, back2) = (
        collected(*x) for x in ((t.pairs, "v", "w"), (t.triples, "u", "v", "w"), (t.contexts, "u", "v")))
    discard(t.pairs, t.triples, t.contexts, t.middles)
    (vocabulary, p1), (contexts1, back1) = by_hash([t.vocabulary], t.p1), by_hash([t.contexts1], t.back1)
    return TrigramModel(vocabulary, p1, t.absent, keys2, p2, contexts1, back1, keys3, p3, contexts2, back2)


# ---- scores ----

def _look(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def log_probabilities(m: TrigramModel, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Natural log of P(w | u, v) for arrays of ids; words out of vocabulary count as unknown."""
    at, there = _look(m.vocabulary, w)
    w = np.where(there, w, U64(UNKNOWN))
    p = np.where(there, m.p1[at], np.float32(m.absent))
    known = [_look(m.vocabulary, x)[1] | (x == START) for x in (u, v)]
    u, v = (np.where(k, x, U64(UNKNOWN)) for k, x in zip(known, (u, v), strict=True))
    at, there = _look(m.contexts1, v)
    p = p + np.where(there, m.back1[at], np.float32(0))
    at, there = _look(m.keys2, _key(v, w))
    p = np.where(there, m.p2[at], p)
    context = _key(u, v)
    at, there = _look(m.contexts2, context)
    seen = np.flatnonzero(there)
    p[seen] += m.back2[at[seen]]
    at, there = _look(m.keys3, _key(w[seen], start=context[seen]))
    p[seen[there]] = m.p3[at[there]]
    return p


def _distinct(row: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, rows: int) -> np.ndarray:
    """Distinct trigrams of each row, told apart by a 64-bit hash."""
    gram = _key(u, v, w)
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
    return np.bincount(row[fresh], minlength=rows)


def score_documents(docs: DataFrame, shared: Broadcast | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its key, ``n_tokens``, ``n_distinct`` (trigrams) and ``loss`` (summed negative log probability) under a shipped model.

    Without a model the loss is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hasher = TrigramModel(*shared.value) if shared else None, WordHasher(byte_table(fold=False, split_marks=True))
        for batch in batches:
            rows = batch.num_rows
            n, distinct, loss = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows)
            for u, v, w, row in _trigram_rows(batch.column(1), hasher):
                n += np.bincount(row, minlength=rows)
                distinct += _distinct(row, u, v, w, rows)
                if m is not None:
                    loss -= np.bincount(row, log_probabilities(m, u, v, w), minlength=rows)
            losses = pa.array(loss) if m is not None else pa.nulls(rows, pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(distinct), losses], names=[key, "n_tokens", "n_distinct", "loss"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, n_distinct long, loss double")


def _packed(*parts: np.ndarray) -> bytes:
    return pa.compress(b"".join(np.ascontiguousarray(x).tobytes() for x in parts), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


def _model_rows(t: TrigramTables, parts: DataFrame, shards: int) -> DataFrame:
    """(shard, kind, k, p): every n-gram in the shards that may ask for it; kind 1 a context, 2 a pair, 3 a trigram."""

    def row(kind: int, salt: Column, *key: str) -> list[Column]:
        return [F.pmod(F.xxhash64("v", salt), F.lit(shards).cast("long")).cast("int").alias("shard"), F.lit(kind).alias("kind"),
                F.xxhash64(*key).alias("k"), F.ln("p").cast("float").alias("p")]

    def with_parts(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(parts), "v", "left").withColumn("n", F.coalesce("n", F.lit(1).cast("long")))

    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("salt")
    pairs, contexts = with_parts(t.pairs).select("*", every), with_parts(t.contexts).select("*", every)
    return with_parts(t.triples).select(*row(3, F.pmod(F.xxhash64("u", "w"), "n"), "u", "v", "w")).unionByName(
        pairs.select(*row(2, F.col("salt"), "v", "w"))).unionByName(contexts.select(*row(1, F.col("salt"), "u", "v")))


def score_by_shards(docs: DataFrame, t: TrigramTables, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """As ``score_documents``, under a model of any size; only its vocabulary is broadcast."""
    context = docs.sparkSession.sparkContext
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(size // shard_bytes + 1, 2 * context.defaultParallelism)
    total = t.middles.agg(F.sum("c")).first()[0]
    # A word with more than a quarter of a shard is dealt out by its neighbours: at most 4 words a shard.
    parts = t.middles.where(F.col("c") * (4 * shards) > total).select("v", F.ceil(F.col("c") * (4 * shards) / total).alias("n"))
    deal = np.ones(len(t.listed) + CODES, np.int64)
    for r in parts.collect():
        deal[r["v"]] = r["n"]
    shared = context.broadcast((t.listed, deal, t.vocabulary, t.p1, t.absent, t.contexts1, t.back1))
    row_type = docs.schema[key].dataType
    info = StructType().add("block", "long").add("place", "integer").add("row", row_type).add("n", "long").add("d", "long").add("size", "integer")
    asked = StructType([*info.fields]).add("shard", "integer").add("grams", "binary")
    told = StructType([*info.fields]).add("at", "binary").add("loss", "binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, deal = shared.value[:2]
        hasher = WordHasher(byte_table(fold=False, split_marks=True))
        block, rows, held, size, kind = TaskContext.get().partitionId() << 24, 0, [], 0, None

        def record(n_rows: int, **columns: pa.Array) -> pa.RecordBatch:
            types = {"block": pa.int64(), "place": pa.int32(), "row": kind, "n": pa.int64(), "d": pa.int64(), "size": pa.int32(),
                     "shard": pa.int32(), "grams": pa.binary()}
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n_rows, x) for c, x in types.items()], names=[*types])

        def flush() -> pa.RecordBatch:
            u, v, w, row = (np.concatenate(x) for x in zip(*held, strict=True))
            salt, split = np.zeros(len(v), np.int64), np.flatnonzero(deal[v] > 1)
            salt[split] = _key(u[split].astype(U64), w[split].astype(U64)).view(np.int64) % deal[v[split]]
            shard = (_key(v.astype(U64), salt.view(U64)).view(np.int64) % shards).astype(np.int32)
            order = np.lexsort((v.astype(np.int64) << 32 | w, shard))
            u, v, w, row, shard = (x[order] for x in (u, v, w, row, shard))
            ends = np.flatnonzero(np.append(shard[1:] != shard[:-1], True)) + 1
            pieces = [slice(a, b) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            return record(len(pieces), block=pa.array(np.full(len(pieces), block)), shard=pa.array(shard[ends - 1]),
                          size=pa.array([p.stop - p.start for p in pieces], pa.int32()),
                          grams=pa.array([_packed(u[p], v[p], w[p], row[p]) for p in pieces], pa.binary()))

        for batch in batches:
            kind = batch.column(0).type
            n, distinct = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for u, v, w, row in _trigram_rows(batch.column(1), hasher):
                n += np.bincount(row, minlength=len(n))
                distinct += _distinct(row, u, v, w, len(n))
                if len(w):
                    code = _coded(listed, w).astype(np.int32)
                    ahead = [np.where(x == START, START, np.concatenate([np.full(min(k, len(code)), START), code[:-k]])).astype(np.int32)
                             for x, k in ((u, 2), (v, 1))]
                    held.append((*ahead, code, (row + rows).astype(np.int32)))
                    size += len(w)
            yield record(len(n), block=pa.array(np.full(len(n), block)), place=pa.array(np.arange(rows, rows + len(n), dtype=np.int32)),
                         row=batch.column(0), n=pa.array(n), d=pa.array(distinct), shard=pa.array(np.full(len(n), block % shards, np.int32)))
            rows += len(n)
            if size >= BLOCK_TOKENS:
                yield flush()
                block, rows, held, size = block + 1, 0, [], 0
        if held:
            yield flush()

    def look_up(questions: pa.Table, model: pa.Table) -> pa.Table:
        _, _, vocabulary, p1, absent, contexts1, back1 = shared.value
        kind, k, p = (model.column(c).to_numpy() for c in ("kind", "k", "p"))
        tables = {}
        for i in (1, 2, 3):
            keys, logs = k[kind == i].view(U64), p[kind == i]
            order = np.argsort(keys)
            tables[i] = keys[order], logs[order]
        m = TrigramModel(vocabulary, p1, absent, *tables[2], contexts1, back1, *tables[3], *tables[1])
        at, loss, sizes = [], [], []
        grams = questions.column("grams")
        for data, n in zip(grams, questions.column("size"), strict=True):
            if not data.is_valid:
                at.append(None), loss.append(None), sizes.append(None)
                continue
            u, v, w, row = _unpacked(data.as_py(), 4 * n.as_py(), np.int32).reshape(4, -1)
            cost = np.rint(log_probabilities(m, *(x.astype(U64) for x in (u, v, w))).astype(float) * -_GRID)
            rows, back = np.unique(row, return_inverse=True)
            at.append(_packed(rows)), loss.append(_packed(np.bincount(back, cost).astype(np.int64))), sizes.append(len(rows))
        kept = questions.select(["block", "place", "row", "n", "d"])
        return kept.append_column("size", pa.array(sizes, pa.int32())).append_column("at", pa.array(at, pa.binary())).append_column(
            "loss", pa.array(loss, pa.binary()))

    def add_up(block: pa.Table) -> pa.Table:
        infos = block.filter(block.column("at").is_null())
        place = infos.column("place").to_numpy()
        total = np.zeros(int(place.max()) + 1 if len(place) else 0, np.int64)
        answers = block.filter(block.column("at").is_valid())
        for at, loss, n in zip(*(answers.column(c) for c in ("at", "loss", "size")), strict=True):
            total[_unpacked(at.as_py(), n.as_py(), np.int32)] += _unpacked(loss.as_py(), n.as_py(), np.int64)
        return pa.Table.from_arrays([*(infos.column(c) for c in ("row", "n", "d")), pa.array(total[place] / _GRID)],
                                    names=[key, "n_tokens", "n_distinct", "loss"])

    questions = docs.select(key, text).mapInArrow(cut, asked)
    answers = questions.groupBy("shard").cogroup(_model_rows(t, parts, shards).groupBy("shard")).applyInArrow(look_up, told)
    out = StructType().add(key, row_type).add("n_tokens", "long").add("n_distinct", "long").add("loss", "double")
    return answers.groupBy("block").applyInArrow(add_up, out)


def language_quantiles(scored: DataFrame, quantile: float, min_docs: int = MIN_LANG_DOCS) -> tuple[DataFrame, float]:
    """Quantile of ``score`` per ``lang`` and over all, exact to 0.001 and the same for any partitioning.

    Scores are counted in steps of 0.001, so a language is a bounded number of
    rows.  Languages with fewer than ``min_docs`` scores are left to the overall value.
    """
    steps = scored.select("lang", F.ceil(F.col("score") * 1000).alias("step"))

    def cut(rows: DataFrame, keys: list[str]) -> DataFrame:
        counted = rows.groupBy(*keys, "step").count()
        table_ = counted.groupBy(*keys).agg(
            F.sum("count").alias("n"), F.sort_array(F.collect_list(F.struct("step", "count"))).alias("steps"))
        reach = F.aggregate("steps", F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("at")),
                            lambda a, s: F.struct((a["n"] + s["count"]).alias("n"), F.when(
                                a["at"].isNull() & (a["n"] + s["count"] >= F.col("n") * quantile), s["step"]).otherwise(a["at"]).alias("at")))
        return table_.select(*keys, "n", (reach["at"] / 1000).alias("cut"))

    overall = cut(steps, []).first()
    by_lang = cut(steps, ["lang"]).where((F.col("n") >= min_docs) & F.col("lang").isNotNull()).select("lang", "cut")
    return by_lang, overall["cut"] if overall and overall["cut"] is not None else float("inf")


def classify_quality(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
    quantile: float = QUANTILE, margin: float = MARGIN, carry: Sequence[str] = (),
) -> DataFrame:
    """Per row: key, lang, n_tokens, perplexity, threshold, repetition, repetition_threshold and ``keep``.

    ``labels`` has (key, quality); rows with quality 1 are trusted.  A document
    goes if its perplexity, or the share of its trigrams that repeat an earlier
    one, is above what its language's trusted texts reach at the quantile, with
    a margin: text that repeats a few words has an ordinary perplexity.  The mean
    loss of a document is drawn towards the mean of its language by ``SHRINK``
    tokens, and its repetition towards none, so a short text is not judged by one
    word.  Null and empty texts have no tokens: their perplexity is null and they
    are kept.  A null or rare language has the overall thresholds.  Rows that
    repeat a key are scored each by its own text; a key counts as trusted once.
    Half of the trusted keys train the model, the other half sets thresholds; if
    none is there for thresholds, or there is no text to train on, nothing is
    rejected by perplexity and without a model perplexities are null.  An empty table gives an empty one.  Only the
    named columns are read; ``carry`` names columns that are handed on.
    """
    trusted = labels.where(F.col("quality") == 1).select(F.col(key).alias("__key")).na.drop().distinct()
    half = F.pmod(F.xxhash64(F.lit("train"), "__key"), F.lit(2))
    chosen, held = (materialize(trusted.where(half == i), "kn-chosen") for i in (0, 1))  # the others set thresholds
    texts = docs.select(F.col(key).alias("__k"), F.col(text).alias("text"))
    keys = F.broadcast(chosen) if chosen.count() <= BROADCAST_KEYS else chosen
    taught = texts.join(keys, F.col("__k") == F.col("__key"))
    model = train_tables(taught) if taught.where(F.trim("text") != "").take(1) else None
    rows = docs.select(F.struct(F.col(key).alias("key"), F.col(lang).alias("lang"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)]
                                ).alias("row"), F.col(text).alias("text"))
    scored = score_documents(rows, None, "row") if model is None else score_by_shards(rows, model, "row")
    raw = materialize(scored.select("row.*", "n_tokens", "n_distinct", "loss"), "kn-scores")
    if model is not None:
        discard(model.pairs, model.triples, model.contexts, model.middles)  # the scores are written
    probe = raw.join(held, raw["key"] == held["__key"], "left_semi").where(F.col("n_tokens") > 0)
    mean = probe.agg(F.sum("loss") / F.sum("n_tokens")).first()[0] or 0.0
    score = (F.col("loss") + SHRINK * mean) / (F.col("n_tokens") + SHRINK)
    repetition = (F.col("n_tokens") - F.col("n_distinct")) / (F.col("n_tokens") + SHRINK)
    cuts, overall = language_quantiles(probe.where(F.col("loss").isNotNull()).withColumn("score", score), quantile)
    again, most = language_quantiles(probe.withColumn("score", repetition), quantile)
    limit = F.coalesce(F.col("cut"), F.lit(overall)) + math.log(margin)
    most_repeated = F.coalesce(F.col("again"), F.lit(most)) + (margin - 1)
    perplexity = F.when(F.col("n_tokens") > 0, F.exp(score))
    fine = (F.coalesce(score <= limit, F.lit(True))) & (repetition <= most_repeated)
    return raw.join(cuts, "lang", "left").join(again.withColumnRenamed("cut", "again"), "lang", "left").select(
        F.col("key").alias(key), F.col("lang").alias(lang), *[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)], "n_tokens",
        perplexity.alias("perplexity"), F.exp(limit).alias("threshold"), repetition.alias("repetition"),
        most_repeated.alias("repetition_threshold"), ((F.col("n_tokens") == 0) | fine).alias("keep"))


@query("op9_kneser_ney_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
