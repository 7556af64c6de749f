"""Cross-entropy difference of documents under matched target and background bigram models.

Both models share one vocabulary, every word of all documents.  The background
model is counted over all documents, the target model over all trusted ones.
Both are interpolated with their unigrams by the number of distinct followers of
a word.  A document gets, per token, the loss under the target model less the
loss under the background model.

Nothing that grows with the vocabulary is collected or broadcast.  Tasks cut the
documents into blocks and keep a block's tokens as places in its own list of
words.  A block sends its distinct pairs, with their counts, to shards by first
word, which very frequent words share out by second word; a shard adds up the
counts of a pair over all blocks, sends them back in the order asked, and tells
the followers of its first words.  The counts of a block's words come back in the
same way.  With both a block works out the loss of its distinct pairs, and from
these the sums of its documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StructType

from tabulon.llm.kneser_ney import _look, _packed, _unpacked
from tabulon.llm.registry import query, table
from tabulon.llm.words import U64, WordHasher, byte_table, mix, signed, text_slices
from tabulon.session import materialize

VOCABULARY: int | None = None  # a number keeps the most frequent words only and deals out the others to classes
OTHER_CLASSES = 16  # ids 1 to 16 are the words outside such a list, dealt out by their hash
BROADCAST_KEYS = 500_000  # target keys up to which they are broadcast; beyond, both sides are shuffled
SHARD_BYTES = 16 << 20  # text whose pairs meet in one shard
BLOCK_DOCS = 1 << 20  # documents of a block, however short
START = 0  # the word before the first; no hash takes it in practice
_BUFFER = 1 << 20  # words that a task gathers before it passes them on
_DOC, _BLOCK, _PAIRS, _WORDS = range(4)  # kinds of rows: a document, a block's tokens, and what a block asks about its pairs and words
_PIECE = "block long, shard int, size int, data binary"


class Ids:
    """Word hashes to ids of a list; 0 is the start of a text.  Without a list a word's hash is its id."""

    def __init__(self, listed: np.ndarray | None):
        self.listed = listed  # sorted hashes; the id of a word is its place plus an offset

    def __call__(self, words: np.ndarray) -> np.ndarray:
        if self.listed is None:
            return words
        other = U64(1) + words % U64(OTHER_CLASSES)
        at, there = _look(self.listed, words)
        return np.where(there, (at + 1 + OTHER_CLASSES).astype(U64), other)


def word_counts(docs: DataFrame, listed: np.ndarray | None = None) -> DataFrame:
    """(w, b, t) from (text, __t): counts of every word over all texts and over target texts; START stands for texts with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, ids, held, size = WordHasher(byte_table(fold=True, split_marks=True)), Ids(listed), [], 0

        def flush() -> pa.RecordBatch:
            every, chosen = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            words, place, n = np.unique(every, return_inverse=True, return_counts=True)
            return pa.RecordBatch.from_arrays([signed(words), pa.array(n), pa.array(np.bincount(place, chosen, len(words)).astype(np.int64))],
                                              names=["w", "b", "t"])

        for batch in batches:
            wanted = batch.column(1).to_numpy(zero_copy_only=False)
            for first, to, data, bounds in text_slices(batch.column(0)):
                words, at = hasher(data, bounds)
                n = np.diff(at)
                if not len(words):
                    continue
                some = wanted[first:to]
                held.append((np.concatenate([ids(words), np.full((n > 0).sum(), START, U64)]), np.concatenate([np.repeat(some, n), some[n > 0]])))
                size += len(words)
                if size >= _BUFFER:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    return docs.select("text", "__t").mapInArrow(run, "w long, b long, t long").groupBy("w").agg(F.sum("b").alias("b"), F.sum("t").alias("t"))


def shared_vocabulary(docs: DataFrame) -> np.ndarray | None:
    """Sorted hashes of the most frequent words of all documents if ``VOCABULARY`` asks for so many; else none, for every word."""
    if VOCABULARY is None:
        return None
    top = word_counts(docs).where(F.col("w") != START).orderBy(F.desc("b"), "w").limit(VOCABULARY - 1 - OTHER_CLASSES)
    return np.sort(np.array([r["w"] for r in top.select("w").collect()], np.int64).view(U64))


def _home(words: np.ndarray, shards: int) -> np.ndarray:
    return (mix(words) % U64(shards)).astype(np.int32)


def _shard_of(v: np.ndarray, w: np.ndarray, hot: np.ndarray, parts: np.ndarray, shards: int) -> np.ndarray:
    """Shards of pairs: by the first word, and for hot ones by the second too."""
    at, there = _look(hot, v)
    salt = np.zeros(len(v), U64)
    salt[there] = mix(w[there]) % parts[at[there]]
    return _home(v + mix(salt), shards)


def _distinct_pairs(words: np.ndarray, tokens: np.ndarray, n: np.ndarray, dealt: tuple) -> tuple[np.ndarray, ...]:
    """Distinct pairs of a block as places of both words, the pair of each token, counts, shards, and the order by shard.

    ``tokens`` are places in ``words``, the tokens of one text after the other; ``n`` counts those of each text.
    """
    before = np.empty(len(tokens), np.int64)
    before[1:] = tokens[:-1]
    before[(np.cumsum(n) - n)[n > 0]] = np.flatnonzero(words == START)[0]
    pairs, pair, count = np.unique(before << 32 | tokens, return_inverse=True, return_counts=True)
    v, w = pairs >> 32, pairs & 0xFFFFFFFF
    shard = _shard_of(words[v], words[w], *dealt)
    return v, w, pair, count, shard, np.argsort(shard, kind="stable")


def _cut(docs: DataFrame, listed: np.ndarray | None, shards: int, kind: DataType) -> DataFrame:
    """The rows of all blocks, from (row, text, __t): a row per document with its key and number of tokens, and one per block.

    That one holds the block's words, which are in order of their shards, its tokens as places among them, and the
    number of tokens of each text and whether it is a target.
    """
    schema = StructType().add("block", "long").add("kind", "integer").add("place", "integer").add("row", kind).add("n", "long").add(
        "sizes", ArrayType(IntegerType())).add("words", "binary").add("tokens", "binary").add("texts", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, ids = WordHasher(byte_table(fold=True, split_marks=True)), Ids(listed)
        block, rows, held, texts, size = TaskContext.get().partitionId() << 24, 0, [], [], 0

        def record(kind: int, n_rows: int, key: pa.DataType, **columns: pa.Array) -> pa.RecordBatch:
            types = {"block": pa.int64(), "kind": pa.int32(), "place": pa.int32(), "row": key, "n": pa.int64(),
                     "sizes": pa.list_(pa.int32()), "words": pa.binary(), "tokens": pa.binary(), "texts": pa.binary()}
            columns |= {"block": pa.array(np.full(n_rows, block)), "kind": pa.array(np.full(n_rows, kind, np.int32))}
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n_rows, t)) for c, t in types.items()], names=[*types])

        def flush(key: pa.DataType) -> pa.RecordBatch:
            words, tokens = np.unique(np.append(np.concatenate(held), U64(START)), return_inverse=True)
            order = np.argsort(_home(words, shards), kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            n, chosen = (np.concatenate(x) for x in zip(*texts, strict=True))
            sizes = [len(words), len(tokens) - 1, len(n)]
            packed = {"words": (words[order],), "tokens": (place[tokens[:-1]],), "texts": (n, chosen.astype(np.int64))}
            return record(_BLOCK, 1, key, sizes=pa.array([sizes], pa.list_(pa.int32())),
                          **{c: pa.array([_packed(*x)], pa.binary()) for c, x in packed.items()})

        for batch in batches:
            wanted, key = batch.column(2).to_numpy(zero_copy_only=False), batch.column(0).type
            for first, to, data, bounds in text_slices(batch.column(1)):
                words, at = hasher(data, bounds)
                n = np.diff(at)
                if len(words):
                    held.append(ids(words))
                    size += len(words)
                texts.append((n, wanted[first:to]))
                yield record(_DOC, len(n), key, place=pa.array(np.arange(rows, rows + len(n), dtype=np.int32)),
                             row=batch.column(0).slice(first, to - first), n=pa.array(n))
                rows += len(n)
                if size >= _BUFFER or rows >= BLOCK_DOCS:
                    if size:
                        yield flush(key)
                    block, rows, held, texts, size = block + 1, 0, [], [], 0
        if size:
            yield flush(key)

    return docs.select("row", "text", "__t").mapInArrow(run, schema)


def _ask(blocks: DataFrame, kind: int, dealt: tuple) -> DataFrame:
    """The distinct pairs of every block, with counts over all texts and target texts, or its words, a row for each shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                words = _unpacked(r["words"], r["sizes"][0], U64)
                if kind == _WORDS:
                    shard, values = _home(words, dealt[2]), (words,)
                    order = np.arange(len(words))
                else:
                    tokens = _unpacked(r["tokens"], r["sizes"][1], np.int32).astype(np.int64)
                    n, chosen = _unpacked(r["texts"], 2 * r["sizes"][2], np.int64).reshape(2, -1)
                    v, w, pair, count, shard, order = _distinct_pairs(words, tokens, n, dealt)
                    target = np.bincount(pair, np.repeat(chosen, n), len(v)).astype(np.int64)
                    values = words[v].view(np.int64), words[w].view(np.int64), count, target
                found, first = np.unique(shard[order], return_index=True)
                pieces = np.split(order, first[1:])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["block"]] * len(found), pa.int64()), pa.array(found, pa.int32()), pa.array([len(p) for p in pieces], pa.int32()),
                     pa.array([_packed(*(x[p] for x in values)) for p in pieces], pa.binary())], names=["block", "shard", "size", "data"])

    return blocks.where(F.col("kind") == _BLOCK).select("block", "sizes", "words", "tokens", "texts").mapInArrow(run, _PIECE)


def _count_pairs(part: pa.Table) -> pa.Table:
    """Counts over all blocks of the pairs of a shard, as asked, and of the followers of its first words."""
    sizes, data = part.column("size").to_pylist(), part.column("data").to_pylist()
    v, w, b, t = np.concatenate([_unpacked(x, 4 * n, np.int64).reshape(4, -1) for x, n in zip(data, sizes, strict=True)], axis=1)
    _, first, pair = np.unique(mix(mix(v.view(U64)) + w.view(U64)), return_index=True, return_inverse=True)
    b, t = (np.bincount(pair, x).astype(np.int64) for x in (b, t))
    words, of = np.unique(v[first], return_inverse=True)
    told, at = [], 0
    for n in sizes:
        told.append(_packed(b[pair[at:at + n]], t[pair[at:at + n]]))
        at += n
    sums = [np.bincount(of, x).astype(np.int64) for x in (b, np.ones(len(b)), t, t > 0)]
    asked = part.select(["block", "shard", "size"]).append_column("data", pa.array(told, pa.binary()))
    follow = pa.table([pa.array(words), *map(pa.array, sums)], names=["v", "nb", "kb", "nt", "kt"])
    return pa.concat_tables([asked, follow], promote_options="default")


_COUNTED = "block long, shard int, size int, data binary, v long, nb long, kb long, nt long, kt long"
_STATS = ("b", "t", "nb", "kb", "nt", "kt")


def _tell_words(asked: pa.Table, counted: pa.Table) -> pa.Table:
    """The words that blocks ask about, followed by their counts."""
    words = counted.column("w").to_numpy().view(U64)
    order = np.argsort(words)
    words, stats = words[order], [counted.column(c).to_numpy()[order] for c in _STATS]
    told = []
    for data, n in zip(asked.column("data").to_pylist(), asked.column("size").to_pylist(), strict=True):
        wanted = _unpacked(data, n, U64)
        at, _ = _look(words, wanted)
        told.append(_packed(wanted.view(np.int64), *(x[at] for x in stats)))
    return asked.select(["block", "shard", "size"]).append_column("data", pa.array(told, pa.binary()))


def _with_home(shards: int):
    """Puts the shard of a word before its counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("w").to_numpy().view(U64)
            yield pa.RecordBatch.from_arrays([pa.array(_home(words, shards)), *batch.columns], names=["shard", *batch.schema.names])

    return run


def _losses(stats: dict[str, np.ndarray], c: str, v: np.ndarray, w: np.ndarray, count: np.ndarray, total: int, size: int) -> np.ndarray:
    """Loss of pairs under one model: their counts, and those of their words, over texts ``c``."""
    n, kinds = stats["n" + c][v], stats["k" + c][v]
    seen = n > 0
    all_, left = np.where(seen, n + kinds, 1), np.where(seen, kinds / np.maximum(n + kinds, 1), 1.0)
    return -np.log(left * ((stats[c][w] + 0.5) / (total + 0.5 * size)) + count / all_)


def score_cross_entropy(docs: DataFrame, target_keys: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, mean losses under both models, and ``score``, their difference.

    ``target_keys`` has the key column; nulls and repeats in it do not count.
    Low scores are text like the target.  Null and empty texts have no tokens
    and null losses.  Repeated rows stay repeated; only key and text are read.
    Without target documents, or on an empty table, the models are even.
    """
    context = docs.sparkSession.sparkContext
    chosen = materialize(target_keys.select(F.col(key).alias("__key")).na.drop().distinct(), "ce-target")
    keys = F.broadcast(chosen) if chosen.count() <= BROADCAST_KEYS else chosen
    marked = docs.select(F.col(key).alias("row"), F.col(text).alias("text")).join(keys, F.col("row") == F.col("__key"), "left").select(
        "row", "text", F.col("__key").isNotNull().alias("__t"))
    listed = shared_vocabulary(marked)
    ones = materialize(word_counts(marked, listed), "ce-words")
    length, *totals, words = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0, *ones.where(F.col("w") != START).agg(
        F.coalesce(F.sum("b"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0)), F.count("*")).first()
    size = VOCABULARY or words
    shards = max(length // SHARD_BYTES + 1, 2 * context.defaultParallelism)
    # A word before more than a quarter of a shard's tokens is dealt out: at most 4 words a shard and the start.
    hot = ones.where(F.col("b") * (4 * shards) > totals[0]).select("w", F.ceil(F.col("b") * (4 * shards) / F.lit(max(totals[0], 1))).alias("n")).collect()
    hot = sorted((r["w"] & (1 << 64) - 1, r["n"]) for r in hot)
    dealt = (np.array([w for w, _ in hot], U64), np.array([n for _, n in hot], U64), shards)

    kind = docs.schema[key].dataType
    blocks = materialize(_cut(marked, listed, shards, kind), "ce-blocks")
    pairs = materialize(_ask(blocks, _PAIRS, dealt).groupBy("shard").applyInArrow(_count_pairs, _COUNTED), "ce-pairs")
    follow = pairs.where("v IS NOT NULL").groupBy("v").agg(*[F.sum(c).alias(c) for c in _STATS[2:]])
    counted = ones.join(follow, F.col("w") == F.col("v"), "left").select("w", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _STATS])
    stats = counted.mapInArrow(_with_home(shards), ", ".join(["shard int", "w long", *(f"{c} long" for c in _STATS)]))
    told = _ask(blocks, _WORDS, dealt).groupBy("shard").cogroup(stats.groupBy("shard")).applyInArrow(_tell_words, _PIECE)

    def add_up(part: pa.Table) -> pa.Table:
        of = {k: part.filter(pc.equal(part.column("kind"), k)).sort_by("place" if k == _DOC else "shard") for k in range(4)}
        n = of[_DOC].column("n").to_numpy()
        sums = [np.zeros(len(n)), np.zeros(len(n))]
        if n.sum():
            def columns(k: int, width: int) -> np.ndarray:
                pieces = zip(of[k].column("data").to_pylist(), of[k].column("size").to_pylist(), strict=True)
                return np.concatenate([_unpacked(x, width * m, np.int64).reshape(width, -1) for x, m in pieces], axis=1)

            words, *counts = columns(_WORDS, 1 + len(_STATS))
            block = of[_BLOCK].select(["sizes", "tokens"]).to_pylist()[0]
            tokens = _unpacked(block["tokens"], block["sizes"][1], np.int32).astype(np.int64)
            v, w, pair, _, _, order = _distinct_pairs(words.view(U64), tokens, n, dealt)
            got = np.empty((2, len(v)), np.int64)
            got[:, order] = columns(_PAIRS, 2)
            row = np.repeat(np.arange(len(n)), n)
            sums = [np.bincount(row, _losses(dict(zip(_STATS, counts)), c, v, w, got[i], totals[i], size)[pair], len(n))
                    for c, i in (("t", 1), ("b", 0))]
        t, b = sums
        none, safe = n == 0, np.maximum(n, 1)
        return pa.Table.from_arrays([of[_DOC].column("row"), pa.array(n), pa.array(t / safe, mask=none), pa.array(b / safe, mask=none),
                                     pa.array((t - b) / safe, mask=none)], names=[key, "n_tokens", "target_loss", "background_loss", "score"])

    parts = blocks.select("block", "kind", "place", "row", "n", "sizes", "tokens", *[F.lit(None).cast(t).alias(c) for c, t in (
        ("shard", "int"), ("size", "int"), ("data", "binary"))])
    for answers, which in ((pairs.where("v IS NULL"), _PAIRS), (told, _WORDS)):
        parts = parts.unionByName(answers.select("block", F.lit(which).alias("kind"), "shard", "size", "data"), allowMissingColumns=True)
    out = StructType().add(key, kind).add("n_tokens", "long").add("target_loss", "double").add("background_loss", "double").add("score", "double")
    return parts.groupBy("block").applyInArrow(add_up, out)


@query("op5_cross_entropy_difference")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0")
    return score_cross_entropy(table(spark, sf_dir, "documents"), labels)
