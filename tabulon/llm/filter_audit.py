"""How document filters interact: every order of them, counted at once.

One pass of a table-driven byte transducer over the UTF-8 of whole texts gives
word, capital, code point and symbol counts; the state after a byte depends on
that byte only (inside a word or between words), so the pass is one table gather
and a comparison of neighbours.  The spans of the words it emits go into an
open-addressing hash table that compares the bytes of equal hashes, which counts
each text's distinct words exactly.

A document is then a mask of the filters it fails.  Whatever the order, all
counts follow from the number of documents per part, mask and label, so the
documents are aggregated once and only these few rows meet the orders.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.registry import query, table
from tabulon.llm.words import WordHasher, byte_table, text_slices

SYMBOLS = "#$%&*|"
_GAP, _CAPITAL, _POINT, _SYMBOL = 1, 2, 4, 8  # what a byte is: bits of the transducer's table
_EIGHTS = 64  # bytes of a word compared as 8-byte numbers; longer words are compared as bytes

COUNTS = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")


def byte_flags(symbols: str = SYMBOLS) -> np.ndarray:
    """The transducer's table: white space 0x20 and 0x09-0x0D, A-Z, first bytes of code points, symbols."""
    flags = np.zeros(256, np.uint8)
    flags[[9, 10, 11, 12, 13, 32]] |= _GAP
    flags[ord("A"):ord("Z") + 1] |= _CAPITAL
    flags[[b for b in range(256) if b & 0xC0 != 0x80]] |= _POINT
    flags[[ord(c) for c in symbols]] |= _SYMBOL
    return flags


class SpanTable:
    """Counts distinct words per row; equal hashes are verified on the bytes."""

    def __init__(self, data: np.ndarray):
        self.raw = data
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self.eights = np.ndarray((len(data) + 1,), np.uint64, buffer=padded.data, strides=(1,))

    def same(self, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether the spans starting at ``a`` and ``b``, of equal sizes, hold the same bytes."""
        out = np.ones(len(a), bool)
        open_, at = np.arange(len(a)), 0
        while len(open_) and at < _EIGHTS:
            left = np.minimum(sizes[open_] - at, 8).astype(np.uint64)
            differ = (self.eights[a[open_] + at] ^ self.eights[b[open_] + at]) << ((np.uint64(8) - left) * np.uint64(8))
            out[open_[differ != 0]] = False
            at += 8
            open_ = open_[(differ == 0) & (sizes[open_] > at)]
        for i in open_.tolist():
            out[i] = np.array_equal(self.raw[a[i]:a[i] + sizes[i]], self.raw[b[i]:b[i] + sizes[i]])
        return out

    def distinct(self, rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, n_rows: int) -> np.ndarray:
        """Number of distinct words of each row."""
        places = 1 << max(4, (2 * len(starts)).bit_length())
        owner = np.full(places, -1, np.int64)
        slot = ((hashes ^ (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(8)).astype(np.int64) & (places - 1)
        counts, open_ = np.zeros(n_rows, np.int64), np.arange(len(starts))
        while len(open_):
            at = slot[open_]
            free = owner[at] < 0
            owner[at[free]] = open_[free]  # of several claims on a slot one stays
            holder = owner[at]
            counts += np.bincount(rows[open_[holder == open_]], minlength=n_rows)
            alike = (rows[holder] == rows[open_]) & (hashes[holder] == hashes[open_]) & (sizes[holder] == sizes[open_])
            check = np.flatnonzero(alike & (holder != open_))
            alike[check] = self.same(starts[holder[check]], starts[open_[check]], sizes[open_[check]])
            open_ = open_[~alike]
            slot[open_] = (slot[open_] + 1) & (places - 1)
        return counts


class Transducer:
    """Counts of the texts of one task."""

    def __init__(self, symbols: str = SYMBOLS):
        self.flags, self.hasher = byte_flags(symbols), WordHasher(byte_table(fold=False, split_marks=False))

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(rows, 5) counts in the order of COUNTS for texts lying one after another."""
        n_rows = len(bounds) - 1
        out = np.zeros((n_rows, len(COUNTS)), np.int64)
        if not len(data):
            return out
        flags = self.flags[data]
        for column, bit in ((2, _CAPITAL), (3, _POINT), (4, _SYMBOL)):
            hits = np.flatnonzero(flags & bit)
            out[:, column] = np.diff(np.searchsorted(hits, bounds))
        inside = (flags & _GAP) == 0
        edge = np.zeros(len(data) + 1, bool)  # state changes; a text starts and ends between words
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[bounds] = True
        edges = np.flatnonzero(edge)
        word = inside[edges[:-1]]
        starts, ends = edges[:-1][word], edges[1:][word]
        hashes, first = self.hasher(data, bounds)
        out[:, 0] = np.diff(first)
        rows = np.repeat(np.arange(n_rows), out[:, 0])
        out[:, 1] = SpanTable(data).distinct(rows, starts, ends - starts, hashes, n_rows)
        return out


def text_counts(docs: DataFrame, keep: Sequence[str], text: str = "text", symbols: str = SYMBOLS) -> DataFrame:
    """Columns ``keep`` and, per row, the COUNTS of its whole text; a null text is empty.

    Only these columns are read.  The counts must not clash with ``keep``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Transducer(symbols)
        for batch in batches:
            texts = batch.column(len(keep))
            parts = [count(data, bounds) for _, _, data, bounds in text_slices(texts)]
            made = np.concatenate(parts) if parts else np.zeros((0, len(COUNTS)), np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], *[pa.array(made[:, i]) for i in range(len(COUNTS))]], names=[*keep, *COUNTS])

    schema = T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(c, T.LongType()) for c in COUNTS]])
    return docs.select(*keep, text).mapInArrow(run, schema)


@dataclass(frozen=True)
class Limits:
    """What the text filters fail: few words, few distinct words, many capitals, any symbol."""

    words: int = 200
    distinct_pct: int = 50
    capital_pct: int = 3

    def failures(self) -> dict[str, Column]:
        c = F.col
        return {
            "A": c("n_words") < self.words,
            "B": 100 * c("n_distinct") < self.distinct_pct * c("n_words"),
            "C": 100 * c("n_capitals") > self.capital_pct * c("n_points"),
            "D": c("n_symbols") > 0,
        }


COPY = "E"


def failure_masks(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), key: str = "doc_id", text: str = "text",
                  part: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): documents by part, failed filters (bits in order A..E) and label.

    E fails where a smaller key of the table has the identical text.  Copies are
    told by the sha256 of the text.  Rows are first folded by text, key and part;
    the smallest key of each text is joined back on text *and* key, so the copies
    of one text stay spread.  Rows with a null key neither fail E nor make others
    fail it, and have no label.  A key is good or toxic if any of its label rows says 1.
    """
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("h", F.unhex(F.sha2("t", 256)))
    counted = text_counts(rows, ["k", "part", "h"], "t")
    bits = F.lit(0)
    for i, failed in enumerate(limits.failures().values()):
        bits = bits + F.when(failed, 1 << i).otherwise(0)
    folded = counted.groupBy("h", "k", "part", bits.alias("bits")).agg(F.count("*").alias("n"))
    first = rows.where(F.col("k").isNotNull()).groupBy("h").agg(F.min("k").alias("k")).withColumn("first", F.lit(True))
    marked = folded.join(first, ["h", "k"], "left")
    copy = F.when(F.col("first").isNull() & F.col("k").isNotNull(), 1 << len(limits.failures())).otherwise(0)
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    return marked.join(known, "k", "left").groupBy(
        "part", (F.col("bits") + copy).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.sum("n").alias("n"))


def audit_orders(masks: DataFrame, filters: str) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``masks`` is what ``failure_masks`` returns: a few rows per part.  The
    steps of all orders are a fixed list, unfolded beside each of these rows, so
    every part has all orders, zeros included.  An empty table gives none.
    ``shapley`` is a filter's removed at any step, summed over the orders.
    """
    place = {f: i for i, f in enumerate(filters)}
    orders = ["".join(p) for p in itertools.permutations(filters)]
    steps = [{"filter_order": o, "step": s + 1, "own": 1 << place[f], "before": sum(1 << place[g] for g in o[:s])}
             for o in orders for s, f in enumerate(o)]
    listed = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, own int, before int>>")
    cells = masks.select("part", "mask", "good", "toxic", "n", F.explode(listed).alias("s")).select(
        "part", "mask", "good", "toxic", "n", "s.*")
    fails, earlier = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    # a document that fails m filters falls to each of them in one m-th of the orders
    share = (F.col("n") * F.lit(len(orders)) / F.bit_count("mask")).cast("long")

    def total(when: Column, what: Column | str = "n") -> Column:
        return F.sum(F.when(when, F.col(what) if isinstance(what, str) else what).otherwise(0))

    return cells.groupBy("part", "filter_order", "step", "own").agg(
        total(~fails & ~earlier).alias("kept"), total(fails & ~earlier).alias("removed"), total(fails & earlier).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"), total(fails & ~earlier & F.col("good")).alias("good_lost"),
        total(fails & ~earlier & F.col("toxic")).alias("toxic_lost"), total(fails, share).alias("shapley")).drop("own")


def _oracle(limits: Limits = Limits()) -> str:
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
    y AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
    f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
            (len(words) < {limits.words})::INT AS a,
            (100 * len(list_distinct(words)) < {limits.distinct_pct} * len(words))::INT AS b,
            (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {limits.capital_pct} * length(t))::INT AS c,
            regexp_matches(t, '[#$%&*|]')::INT AS d,
            coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)::INT AS e
          FROM w LEFT JOIN y USING (doc_id)),
    m AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, a + b + c + d + e AS m, good, toxic, count(*) AS n FROM f GROUP BY ALL),
    l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
    o AS (SELECT p.f || q.f || r.f || s.f || u.f AS filter_order, [p.bit, q.bit, r.bit, s.bit, u.bit] AS bits
          FROM l p, l q, l r, l s, l u WHERE p.bit + q.bit + r.bit + s.bit + u.bit = 31
          AND (p.bit | q.bit | r.bit | s.bit | u.bit) = 31),
    s AS (SELECT filter_order, i AS step, bits[i] AS own, coalesce(list_sum(bits[1:i - 1]), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6)) AS i)),
    x AS (SELECT part, filter_order, step, own, n, good, toxic, mask, m,
            (mask & own) <> 0 AS fails, (mask & before) <> 0 AS earlier FROM m, s),
    r AS (SELECT part, filter_order, step::INTEGER AS step, own,
            (sum(n) FILTER (NOT fails AND NOT earlier)) AS kept, (sum(n) FILTER (fails AND NOT earlier)) AS removed,
            (sum(n) FILTER (fails AND earlier)) AS redundant, (sum(n) FILTER (mask = own)) AS unique_fails,
            (sum(n) FILTER (fails AND NOT earlier AND good = 1)) AS good_lost,
            (sum(n) FILTER (fails AND NOT earlier AND toxic = 1)) AS toxic_lost
          FROM x GROUP BY ALL)
    SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
        coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
        coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
        (sum(coalesce(removed, 0)) OVER (PARTITION BY part, own))::BIGINT AS shapley
    FROM r"""


@query("op13_filter_audit", _oracle())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = failure_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit_orders(masks, "ABCD" + COPY)
