"""SentencePiece encoding with seeded merge dropout, and decoding.

A BPE ``.model`` file is read on the driver and its pieces (a fixed file of
some 32,000 entries) are broadcast.  Each task splits a text into units that
no piece can cross, and joins the characters of a unit by the merge agenda.
Every candidate merge that comes up is skipped with probability ``dropout``, by
draws keyed by (seed, row key, copy, position of the unit): each occurrence of a
unit has its own segmentation, a row has the same pieces wherever it is encoded,
and other seeds give other ones.  A draw is the number of candidates up to the
next skip, so what is remembered is exact: the ids of a unit for a list of
skipped candidates, and how many candidates come after the last of them.

Decoding gives the text back exactly: characters without a piece, and the
space mark itself when it stands in a text, are written as byte pieces.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.bpe import NEVER, merge_agenda
from tabulon.llm.registry import query, ship, table
from tabulon.llm.words import U64, mix

SPACE_MARK = "▁"
_MASK = (1 << 64) - 1
_KEPT_UNIT = 48  # characters; longer units are not remembered
_KEPT_UNITS = 400_000  # units remembered by a task


@dataclass(frozen=True)
class PieceModel:
    """Pieces of a BPE model: text, score and id of the normal ones, ids of bytes."""

    pieces: dict[str, tuple[float, int]]
    byte_ids: tuple[int, ...]
    decoded: tuple[bytes, ...]


def load_piece_model(path: str) -> PieceModel:
    """Read a ``.model`` file on the driver and prove what the encoder relies on."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, decoded, byte_ids = {}, [], [-1] * 256
    for i in range(lib.vocab_size()):
        piece = lib.id_to_piece(i)
        if lib.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            decoded.append(bytes([int(piece[3:5], 16)]))
        elif lib.is_control(i) or lib.is_unknown(i):
            decoded.append(b"")
        else:
            if SPACE_MARK in piece.lstrip(SPACE_MARK):
                raise ValueError(f"piece {piece!r} crosses words")
            if "\n" in piece:
                raise ValueError(f"piece {piece!r} crosses lines")
            pieces[piece] = (-lib.get_score(i), i)
            decoded.append(piece.replace(SPACE_MARK, " ").encode())
    if -1 in byte_ids or len(decoded) > 1 << 16:
        raise ValueError("a model with 256 byte pieces and at most 65,536 pieces is needed")
    return PieceModel(pieces, tuple(byte_ids), tuple(decoded))


def _unit_encoder(model: PieceModel, dropout: float, seed: int, replica: int) -> Callable[[str], bytes]:
    """Function from a unit (space marks, then characters) to its ids as uint16."""
    pieces, byte_ids = model.pieces, model.byte_ids
    limit, digest, unit_seed = int(dropout * (1 << 64)), xxhash.xxh64_intdigest, (seed * 1_000_003 + replica) & _MASK

    none = (NEVER, -1)

    def rank_of(a: str, b: str, get=pieces.get) -> float:
        return get(a + b, none)[0]

    def encode(unit: str) -> bytes:
        skip = None
        if limit:
            key = digest(unit, unit_seed) | 1  # a random odd multiplier hashes (position, piece)

            def skip(i: int, joined: str) -> bool:
                return ((i << 17) + pieces[joined][1] + 1) * key & _MASK < limit

        ids = []
        for symbol in merge_agenda(unit, rank_of, skip):
            hit = pieces.get(symbol)
            if hit is not None:
                ids.append(hit[1])
            else:
                ids.extend(byte_ids[b] for b in symbol.encode("utf-8", "surrogatepass"))
        return array("H", ids).tobytes()

    return encode


class _Units(dict):
    """Remembered units of one replica."""

    def __init__(self, prefix: str, encode: Callable[[str], bytes]):
        super().__init__()
        self.prefix, self.encode = prefix, encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(self.prefix + word)
        if len(word) <= _KEPT_UNIT:
            if len(self) >= _KEPT_UNITS:
                self.clear()
            self[word] = ids
        return ids


class _Draws:
    """Ids of the occurrences of units, each given its 64-bit draw."""

    def __init__(self, model: PieceModel, dropout: float):
        self.model, self.log_keep = model, math.log1p(-dropout) if dropout else 0.0
        self.ranks = {piece: rank for piece, (rank, _) in model.pieces.items()}
        self.pass_ = [int((1 - dropout) ** k * (1 << 64)) for k in range(256)]  # draws below: no skip in k candidates
        self.known: dict = {}  # unit, or (unit, skipped candidates...): (ids, first draw that skips once more)

    def _gap(self, draw: int) -> int:
        return int(math.log((draw + 1) / (1 << 64)) / self.log_keep)

    def _gaps(self, draws: np.ndarray) -> np.ndarray:
        if not self.log_keep:
            return np.zeros(len(draws), np.int64)
        return np.minimum(np.log((draws.astype(float) + 1) / float(1 << 64)) / self.log_keep, float(1 << 62)).astype(np.int64)

    def _ids(self, symbols: Sequence[str]) -> bytes:
        pieces, byte_ids, ids = self.model.pieces, self.model.byte_ids, []
        for symbol in symbols:
            hit = pieces.get(symbol)
            if hit is not None:
                ids.append(hit[1])
            else:
                ids.extend(byte_ids[b] for b in symbol.encode("utf-8", "surrogatepass"))
        return array("H", ids).tobytes()

    def _merge(self, unit: str, skip: Callable[[int, str], bool] | None) -> bytes:
        return self._ids(merge_agenda(unit, lambda a, b, get=self.ranks.get: get(a + b, NEVER), skip))

    def _drawn(self, unit: str, first: int, second: int, draw: int) -> bytes:
        """One pass of the agenda, as ``merge_agenda`` takes it; its end is remembered.

        ``first`` and ``second`` are the candidates up to the next skip and to the one after, ``draw`` says the others.
        """
        rank, parts, seen, skipped = self.ranks.get, list(unit), 0, ()
        ranks = [rank(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        least = first if self.log_keep else -1
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            i = ranks.index(best)
            if seen == least:
                seen, ranks[i] = seen + 1, NEVER
                if skipped:
                    second, draw = self._gap(draw), _next(draw)
                skipped, least = (*skipped, least), seen + second
                continue
            seen += 1
            joined = parts[i] = parts[i] + parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + joined, NEVER)
            if i < len(ranks):
                ranks[i] = rank(joined + parts[i + 1], NEVER)
        left = seen - (skipped[-1] + 1 if skipped else 0)
        ids = self._ids(parts)
        if len(self.known) >= _KEPT_UNITS:
            self.known.clear()
        self.known[(unit, *skipped) if skipped else unit] = ids, self.pass_[left] if left < 256 else 0
        return ids

    def long(self, unit: str, draw: int) -> bytes:
        """A unit that is not remembered: one pass of the agenda, drawing as it goes."""
        if not self.log_keep:
            return self._merge(unit, None)
        left = self._gap(draw)

        def skip(i: int, joined: str) -> bool:
            nonlocal left, draw
            if left:
                left -= 1
                return False
            draw = _next(draw)
            left = self._gap(draw)
            return True

        return self._merge(unit, skip)

    def skipping(self, unit: str, first: int, second: int, draw: int) -> bytes:
        """A unit in which at least two candidates are skipped."""
        skipped, at, last = (first, first + 1 + second), first + 1 + second, draw
        while True:
            node = self.known.get((unit, *skipped))
            if node is None:
                return self._drawn(unit, first, second, draw)
            if last < node[1]:
                return node[0]
            at += 1 + self._gap(last)
            skipped, last = (*skipped, at), _next(last)

    def join(self, units: Sequence[str], draws: Sequence[int]) -> bytes:
        out, get, draws = [], self.known.get, np.asarray(draws, U64)
        after = _after(draws)
        third = _after(after)
        for unit, draw, gap, again, gap2, last in zip(
                units, *(x.tolist() for x in (draws, self._gaps(draws), after, self._gaps(after), third)), strict=True):
            node = get(unit)
            if node is not None and draw >= node[1]:
                node = get((unit, gap))
                if node is not None and again >= node[1]:
                    out.append(self.skipping(unit, gap, gap2, last))
                    continue
            if node is not None:
                out.append(node[0])
            elif len(unit) > _KEPT_UNIT:
                out.append(self.long(unit, draw))
            else:
                out.append(self._drawn(unit, gap, gap2, last))
        return b"".join(out)


def _next(draw: int) -> int:
    """The draw after this one, of which it says nothing."""
    x = (draw ^ draw >> 30) * 0xBF58476D1CE4E5B9 + 0x9E3779B97F4A7C15 & _MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _MASK
    return x ^ x >> 31


def _after(draws: np.ndarray) -> np.ndarray:
    """``_next`` of an array."""
    x = (draws ^ draws >> U64(30)) * U64(0xBF58476D1CE4E5B9) + U64(0x9E3779B97F4A7C15)
    x = (x ^ x >> U64(27)) * U64(0x94D049BB133111EB)
    return x ^ x >> U64(31)


_RUNS = re.compile(f"\n|{SPACE_MARK}*[^{SPACE_MARK}\n]+|{SPACE_MARK}+")


class PieceEncoder:
    """Encodes texts of one task.

    With ``replicas``, a unit has at most so many segmentations per seed, told
    apart by row key and line; without, every occurrence is drawn by itself.
    """

    def __init__(self, model: PieceModel, dropout: float = 0.1, seed: int = 0, replicas: int | None = None):
        self.seed, self.replicas = seed, None if replicas is None else replicas if dropout else 1
        encoders = [_unit_encoder(model, dropout, seed, r) for r in range(self.replicas or 1)]
        self.words = [_Units(SPACE_MARK, e) for e in encoders]
        self.heads = [_Units("", e) for e in encoders]
        self.draws = _Draws(model, dropout)
        self.newline = encoders[0]("\n")
        self.mark = array("H", [model.byte_ids[b] for b in SPACE_MARK.encode()]).tobytes()

    def _runs(self, marked: str, r: int) -> bytes:
        return b"".join(map(self.heads[r].__getitem__, _RUNS.findall(marked)))

    def encode(self, text: str, key: str, copy: int = 0) -> bytes:
        """Ids as uint16; the first word is preceded by a space, as the model asks."""
        if not text:
            return b""
        if self.replicas is None:
            return self._drawn(text, f"{key}\0{copy}" if copy else key)
        r = xxhash.xxh64_intdigest(key, self.seed & _MASK) % self.replicas
        if SPACE_MARK in text:  # a mark in the text is bytes, not a space
            parts = [p.replace(" ", SPACE_MARK) for p in text.split(SPACE_MARK)]
            return self._runs(SPACE_MARK + parts[0], r) + b"".join(self.mark + self._runs(p, r) for p in parts[1:])
        if "  " in text or text[0] == " ":
            return self._runs(SPACE_MARK + text.replace(" ", SPACE_MARK), r)
        out = []
        for n, line in enumerate(text.split("\n")):
            words, heads = self.words[r], self.heads[r]
            if n:
                out.append(self.newline)
            first, *rest = line.split(" ")
            if first or not n:
                out.append((heads if n else words)[first])
            out.extend(map(words.__getitem__, rest))
            r = (r + 1) % self.replicas
        return b"".join(out)

    def _drawn(self, text: str, key: str) -> bytes:
        parts = [p.replace(" ", SPACE_MARK) for p in text.split(SPACE_MARK)]
        parts[0] = SPACE_MARK + parts[0]
        units = [_RUNS.findall(p) for p in parts]
        base = U64(xxhash.xxh64_intdigest(key, self.seed & _MASK))
        draws = mix(base + np.arange(1, sum(map(len, units)) + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
        out, at = [], 0
        for u in units:
            out.append(self.draws.join(u, draws[at:at + len(u)]))
            at += len(u)
        return self.mark.join(out)


def decode_ids(ids: Sequence[int], decoded: Sequence[bytes]) -> str:
    """Text of the ids, without the space that stands before the first word."""
    raw = b"".join(map(decoded.__getitem__, ids))
    return raw[1:].decode("utf-8", "surrogatepass") if raw else ""


def encode_pieces(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", dropout: float = 0.1, seed: int = 0,
    replicas: int | None = None, copy: str | None = None,
) -> DataFrame:
    """Per row its key, ``n_pieces``, ``ids`` and ``lossless`` (ids decode to the text).

    Only the key and the text column are read, so other columns may have any
    names.  A null text gives null in all three columns, an empty text an empty
    list.  Rows that repeat key and text get equal ids unless the integer column
    ``copy`` tells them apart; a null key is a key like any other.  ``dropout`` 0 gives the library's own segmentation.
    """
    if not 0 <= dropout < 1 or replicas is not None and replicas < 1:
        raise ValueError("dropout must be in [0, 1), replicas at least 1")
    spark = docs.sparkSession
    shared = ship(spark, load_piece_model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(*shared.value)
        encoder = PieceEncoder(model, dropout, seed, replicas)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts, keys = part.column(1).to_pylist(), part.column(0).cast(pa.string()).to_pylist()
                copies = part.column(2).to_pylist() if copy else [0] * len(texts)
                blobs = [b"" if t is None else encoder.encode(t, k or "", c or 0)
                         for t, k, c in zip(texts, keys, copies, strict=True)]
                sizes = [len(b) // 2 for b in blobs]
                flat = np.frombuffer(b"".join(blobs), np.uint16)
                flat_list, at, same = flat.tolist(), 0, []
                for t, n in zip(texts, sizes, strict=True):
                    same.append(None if t is None else decode_ids(flat_list[at:at + n], model.decoded) == t)
                    at += n
                null = np.array([t is None for t in texts])
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32),
                                   mask=np.append(null, False))
                yield pa.RecordBatch.from_arrays([
                    part.column(0),
                    pa.array(np.array(sizes, np.int64), mask=null),
                    pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32))),
                    pa.array(same, pa.bool_()),
                ], names=[key, "n_pieces", "ids", "lossless"])

    schema = T.StructType([
        T.StructField(key, docs.schema[key].dataType), T.StructField("n_pieces", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("lossless", T.BooleanType())])
    return docs.select(key, text, *([copy] if copy else [])).mapInArrow(run, schema)


def decode_pieces(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row its key and ``text``; null ids give a null text, an empty list an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_piece_model(path).decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode_ids(x, shared.value) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    schema = T.StructType([T.StructField(key, encoded.schema[key].dataType), T.StructField("text", T.StringType())])
    return encoded.select(key, F.col(ids)).mapInArrow(run, schema)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op1_piece_dropout")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), default_model())
