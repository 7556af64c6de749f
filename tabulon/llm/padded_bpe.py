"""Byte-level BPE over rank files, merged in length-bucketed padded matrices.

Texts are cut into pre-tokens by the pattern.  A pre-token that is itself a
vocabulary string is that id; all others are rows of integer matrices, one
matrix per bucket of byte lengths, padded at the end.  In a round every row
merges its leftmost pair of least rank: pairs are looked up in an
open-addressing hash table of (left id, right id), the merged column is closed
up, and rows without a pair leave the matrix.  Every row that stays loses one
column, so the matrix narrows by one each round.

A matrix of L columns takes up to L rounds whatever its number of rows, so the
few pre-tokens above ``LONG`` bytes go through the agenda of ``bpe`` instead,
whose work is n log n; both give the same ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.bpe import NEVER, merge_agenda
from tabulon.llm.registry import free_name, query, ship, table

LONG = 256
_BUCKETS = (2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, LONG)  # columns of the padded matrices
_NONE = np.int32(2**31 - 1)
_CELLS = 1 << 20          # cells of one matrix
_TEXT = 2 << 20           # characters of the texts handled at once; one text is never cut
_KEPT_IDS = 1_500_000     # ids that a task remembers for pre-tokens it has seen
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Ranks:
    """Vocabulary strings by id, and the hash table of joinable pairs (key -1: free slot)."""

    tokens: list[bytes]
    keys: np.ndarray
    merged: np.ndarray
    pattern: str


def white_space_as_property(pattern: str) -> str:
    """Spell white space as the Unicode property, which is what the rank files' library means by it."""
    return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


def _slots(keys: np.ndarray, size: int) -> np.ndarray:
    return ((keys.view(np.uint64) * _SPREAD) >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64)


def _hash_table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Open addressing with linear probing, at most a quarter full."""
    size = 1 << max(4, (4 * len(keys)).bit_length())
    table_keys, table_values = np.full(size, -1, np.int64), np.full(size, _NONE, np.int32)
    open_, slot = np.arange(len(keys)), _slots(keys, size)
    while len(open_):
        free = table_keys[slot[open_]] == -1
        table_keys[slot[open_[free]]] = keys[open_[free]]  # of several claims on a slot one stays
        table_values[slot[open_[free]]] = values[open_[free]]
        open_ = open_[table_keys[slot[open_]] != keys[open_]]
        slot[open_] = (slot[open_] + 1) & (size - 1)
    return table_keys, table_values


def load_ranks(path: str, pattern: str) -> Ranks:
    """Read a rank file on the driver: base64 strings with their ranks, which must be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must be consecutive and hold every single byte")
    pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t))
             if t[:i] in ranks and t[i:] in ranks]
    keys, merged = np.array(pairs, np.int64).reshape(-1, 2).T
    return Ranks(tokens, *_hash_table(np.ascontiguousarray(keys), merged.astype(np.int32)), white_space_as_property(pattern))


class PairMerger:
    """Merges rows of padded matrices."""

    def __init__(self, ranks: Ranks):
        self.keys, self.merged = ranks.keys, ranks.merged
        ids = {t: i for i, t in enumerate(ranks.tokens)}
        self.ids = ids
        self.of_byte = np.array([ids[bytes([b])] for b in range(256)], np.int32)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of joining each two ids, which is also the joined id; ``_NONE`` where there is none or one is padding."""
        out = np.full(left.shape, _NONE, np.int32)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        wanted = left.ravel()[open_].astype(np.int64) << 32 | right.ravel()[open_]
        slot = _slots(wanted, len(self.keys))
        while len(open_):
            found = self.keys[slot]
            hit = found == wanted
            out.ravel()[open_[hit]] = self.merged[slot[hit]]
            on = ~hit & (found != -1)
            open_, wanted, slot = open_[on], wanted[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out

    def merge(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of rows padded with -1: the finished rows, padded, and their numbers of ids."""
        done, sizes = np.full_like(rows, -1), np.zeros(len(rows), np.int64)
        place, now = np.arange(len(rows)), rows
        ranks = self.ranks_of(now[:, :-1], now[:, 1:])
        while len(place):
            width = now.shape[1]
            at = ranks.argmin(axis=1) if width > 1 else np.zeros(len(place), np.int64)
            best = ranks[np.arange(len(place)), at] if width > 1 else np.full(len(place), _NONE)
            live = best != _NONE
            if not live.all():
                over = ~live
                done[place[over], :width] = now[over]
                sizes[place[over]] = (now[over] >= 0).sum(axis=1)
                place, now, ranks, at, best = place[live], now[live], ranks[live], at[live], best[live]
                if not len(place):
                    break
            line, spot = np.arange(len(place)), at[:, None]
            columns = np.arange(width - 1)
            now = np.where(columns > spot, now[:, 1:], now[:, :-1])
            now[line, at] = best
            ranks = np.where(columns[:-1] >= spot, ranks[:, 1:], ranks[:, :-1])
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
            ranks[before, at[before] - 1] = self.ranks_of(now[before, at[before] - 1], best[before])
            ranks[after, at[after]] = self.ranks_of(best[after], now[after, at[after] + 1])
        return done, sizes

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the ids of all pieces, one after another, and where each piece ends."""
        found: list[np.ndarray | None] = [None] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        bucket = np.searchsorted(_BUCKETS, sizes)
        for b, width in enumerate(_BUCKETS):
            mine = np.flatnonzero(bucket == b)
            for part in np.array_split(mine, max(1, -(-len(mine) * width // _CELLS))):
                if not len(part):
                    continue
                rows = np.full((len(part), width), -1, np.int32)
                data = np.frombuffer(b"".join([pieces[i] for i in part]), np.uint8)
                rows[np.arange(width) < sizes[part][:, None]] = self.of_byte[data]
                done, lengths = self.merge(rows)
                for i, row, n in zip(part.tolist(), done, lengths.tolist()):
                    found[i] = row[:n]
        for i in np.flatnonzero(bucket == len(_BUCKETS)).tolist():
            parts = merge_agenda([bytes([c]) for c in pieces[i]], lambda a, b: self.ids.get(a + b, NEVER))
            found[i] = np.array([self.ids[t] for t in parts], np.int32)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        return (np.concatenate(found) if found else np.zeros(0, np.int32)).astype(np.int32), ends


class _Numbers(dict):
    """Number of each pre-token, given when it is first seen."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


class TextEncoder:
    """Encodes the texts of one task; a pre-token's ids are remembered, which changes no result."""

    def __init__(self, ranks: Ranks):
        self.merger = PairMerger(ranks)
        self.cut = regex.compile(ranks.pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.flat, self.bounds = _Numbers(), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        known = [self.merger.ids.get(p) for p in raw]
        rest = [i for i, k in enumerate(known) if k is None]
        ids, ends = self.merger.encode([raw[i] for i in rest])
        sizes = np.ones(len(raw), np.int64)
        sizes[rest] = np.diff(ends, prepend=0)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.empty(bounds[-1], np.int32)
        whole = np.ones(len(flat), bool)
        starts = bounds[:-1][rest]
        whole[np.repeat(starts - ends + sizes[rest], sizes[rest]) + np.arange(len(ids))] = False
        flat[whole] = [k for k in known if k is not None]
        flat[~whole] = ids
        self.flat = np.concatenate([self.flat, flat])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + bounds[1:]])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of all texts, one after another."""
        if len(self.flat) > _KEPT_IDS:
            self._forget()
        seen, numbers, ends = len(self.numbers), [], [0]
        for text in texts:
            numbers += map(self.numbers.__getitem__, self.cut(text))
            ends.append(len(numbers))
        if len(self.numbers) > seen:
            self._learn(list(self.numbers)[seen:])
        at = np.array(numbers, np.int64)
        starts, sizes = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[np.repeat(starts - upto[:-1], sizes) + np.arange(upto[-1])], upto[ends]


def _portions(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > _TEXT:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def encode_texts(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its key and ``ids`` (array of int), by the ranks in ``path``, without special tokens.

    Only the key and the text column are read, so other columns may have any
    name; a key called ``ids`` keeps its name and the ids take ``ids_``.  A null
    or empty text has no ids, a null key stays null, repeated rows stay
    repeated, and a text of any length is encoded whole.  No order of rows.
    """
    shared = ship(docs.sparkSession, load_ranks(path, pattern))
    out = free_name("ids", [key])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(Ranks(*shared.value))
        for batch in batches:
            row = 0
            for texts in _portions([t or "" for t in batch.column(1).to_pylist()]):
                ids, bounds = encoder(texts)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), lists], names=[key, out])
                row += len(texts)

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField(out, T.ArrayType(T.IntegerType()))])
    return docs.select(key, text).mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with a binary column ``decoded``: the strings of each row's ids, joined.

    A null list or null id gives no bytes; an id that the vocabulary does not
    have is an error, as in the library.  All other columns are kept; where one
    is called ``decoded``, the bytes take the next free name.
    """
    spark = encoded.sparkSession
    with open(path, "rb") as f:
        pairs = sorted((int(b), base64.b64decode(a)) for a, b in map(bytes.split, f))
    shared = spark.sparkContext.broadcast([t for _, t in pairs])
    out = free_name("decoded", encoded.columns)
    place = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(shared.value, pa.binary())
        for batch in batches:
            lists = batch.column(place)
            for row in range(0, len(lists), 256):
                some = pc.fill_null(lists.slice(row, 256), pa.scalar([], lists.type))
                flat = some.flatten()
                sizes = pc.list_value_length(some).to_numpy(zero_copy_only=False).astype(np.int64)
                bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                strings = pc.fill_null(tokens.take(flat), b"")
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), strings), b"")
                yield pa.RecordBatch.from_arrays([c.slice(row, 256) for c in batch.columns] + [joined], names=[*batch.schema.names, out])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(out, T.BinaryType())]))


def default_ranks() -> tuple[str, str]:
    """File and pattern of the multilingual public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@query("op11_padded_bpe")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = default_ranks()
    decoded = decode_ids(encode_texts(table(spark, sf_dir, "documents"), path, pattern), path)
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))
