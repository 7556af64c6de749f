"""Token counts of a byte-level BPE vocabulary with the whole-token shortcut.

Offline, on the driver, every vocabulary string is put through the merges: the
ones that come out as one token are proven whole.  A pre-token among them
counts one without any merging; only the rest is merged, and remembered by the
task.  The vocabulary and the merges are a fixed file of some 50,000 entries.

A space between two other characters always starts a pre-token and a single
line break between two others is one, so a text without neighbouring white
space is cut there first and the pattern runs over the pieces not seen before.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tabulon.llm.bpe import NEVER, merge_agenda
from tabulon.llm.registry import query, ship, table

_KEPT_WORD, _KEPT_WORDS = 48, 400_000  # characters of a remembered piece; pieces a task remembers

# Unicode white space, and the pattern of byte-level pre-tokens with it spelled out.
WHITE = r"\t-\r \x85\xa0  -     　"
PATTERN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


@dataclass(frozen=True)
class Merges:
    ranks: dict[tuple[str, str], int]
    whole: frozenset[str]
    special: tuple[str, ...]


def load_merges(path: str) -> Merges:
    """Read a ``.json`` file on the driver and prove which strings are whole tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec["pre_tokenizer"]
    if spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
        raise ValueError("only plain byte-level vocabularies are supported")
    ranks = {}
    for n, pair in enumerate(spec["model"]["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        ranks[a, b] = n
    whole = frozenset(s for s in spec["model"]["vocab"] if len(merge_agenda(s, lambda a, b: ranks.get((a, b), NEVER))) == 1)
    return Merges(ranks, whole, tuple(t["content"] for t in spec["added_tokens"]))


class _Counts(dict):
    def __init__(self, prefix: str, count: Callable[[str], int]):
        super().__init__()
        self.prefix, self.count = prefix, count

    def __missing__(self, word: str) -> int:
        n = self.count(self.prefix + word)
        if len(word) <= _KEPT_WORD:
            if len(self) >= _KEPT_WORDS:
                self.clear()
            self[word] = n
        return n


class TokenCounter:
    """Counts tokens of texts in one task."""

    def __init__(self, merges: Merges):
        self.ranks, self.whole = merges.ranks, merges.whole
        self.pre_tokens = regex.compile(PATTERN).findall
        self.letters = dict(enumerate(byte_letters()))
        self.special = re.compile("|".join(map(re.escape, merges.special))) if merges.special else None
        self.marks = merges.special
        self.near_white = re.compile(rf"[{WHITE}][{WHITE}]").search
        self.spaced, self.first = _Counts(" ", self._count), _Counts("", self._count)

    def _count(self, piece: str) -> int:
        n = 0
        for pre in self.pre_tokens(piece):
            token = pre.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
            n += 1 if token in self.whole else len(merge_agenda(token, self._rank))
        return n

    def _rank(self, a: str, b: str) -> float:
        return self.ranks.get((a, b), NEVER)

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        if self.near_white(text) or text[0] == "\n" or text[-1] in " \n":
            return self._count(text)
        n = 0
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            if rest and not first:  # a single space opens the text
                first, rest = " " + rest[0], rest[1:]
            n += self.first[first] + sum(map(self.spaced.__getitem__, rest))
        return n + text.count("\n") * self.first["\n"]

    def count(self, text: str) -> int:
        """Tokens of a text; a special string inside it is one token."""
        if self.special is None or not any(m in text for m in self.marks):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


def count_tokens(docs: DataFrame, path: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its key, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    Only the key and the text column are read.  A null text counts as empty;
    empty texts have 0 bytes and tokens.  Repeated rows stay repeated.
    """
    shared = ship(docs.sparkSession, load_merges(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(Merges(*shared.value))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = np.array([counter.count(t) for t in texts], np.int64)
            sizes = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)],
                names=[key, "n_bytes", "n_tokens", "over_limit"])

    schema = T.StructType([
        T.StructField(key, docs.schema[key].dataType), T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return docs.select(key, text).mapInArrow(run, schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), default_vocabulary())
