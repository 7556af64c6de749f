"""Filter interactions against a plain count over documents and orders."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tabulon.llm import filter_audit as fa
from tabulon.llm.words import text_slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["", " ", "a", "A b\tB\n b", "Ünï çödé 日本 日本 \x85 x\xa0y", "#" * 9, "a$b & c|d * %", "x\x1cy x\x1cy", "aaaaaaaab aaaaaaaac aaaaaaaab",
         "w" * 200 + " " + "w" * 200 + "x " + "w" * 200, "😀 😀 😀😀", "  lead and trail  "]


def counts(text):
    words = WORD.findall(text)
    return [len(words), len(set(words)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))]


def run(texts):
    column = pa.array(texts, pa.string())
    transduce = fa.Transducer()
    return np.concatenate([transduce(d, b) for _, _, d, b in text_slices(column)]).tolist()


def test_counts_of_odd_texts():
    assert run([*TEXTS, None]) == [counts(t) for t in [*TEXTS, ""]]


def test_counts_of_many_texts():
    rng = random.Random(2)
    words = ["".join(rng.choice("abAB é#日") for _ in range(rng.randint(1, 12))) for _ in range(60)]
    texts = [rng.choice(["", " ", "\n"]).join(rng.choices(words, k=rng.randint(0, 400))) for _ in range(300)]
    texts.append(" ".join(rng.choices(words, k=200_000)))  # a slice of its own
    assert run(texts) == [counts(t) for t in texts]


def test_equal_hashes_are_verified():
    data = np.frombuffer(b"aa bb aa cc bb aa aa", np.uint8)
    starts = np.array([0, 3, 6, 9, 12, 15, 18])
    rows = np.array([0, 0, 0, 0, 0, 1, 1])
    table = fa.SpanTable(data)
    assert table.distinct(rows, starts, np.full(7, 2), np.zeros(7, np.uint64), 3).tolist() == [3, 1, 0]
    mixed = fa.SpanTable(np.frombuffer(b"abcdefghijX abcdefghijY abcdefghijX", np.uint8))
    assert mixed.distinct(np.zeros(3, np.int64), np.array([0, 12, 24]), np.full(3, 11), np.zeros(3, np.uint64), 1).tolist() == [2]


def by_the_book(docs, labels, filters="ABCDE"):
    good = {k for k, q, t in labels if q == 1 and k is not None}
    toxic = {k for k, q, t in labels if t == 1 and k is not None}
    first = {}
    for k, text, *_ in docs:
        if k is not None:
            first[text or ""] = min(k, first.get(text or "", k))
    judged = []
    for k, text, lang, *_ in docs:
        words, distinct, capitals, points, symbols = counts(text or "")
        fails = {"A": words < 200, "B": 100 * distinct < 50 * words, "C": 100 * capitals > 3 * points, "D": symbols > 0,
                 "E": k is not None and k > first[text or ""]}
        judged.append((lang or "", {f for f in fails if fails[f]}, k in good, k in toxic))
    out = []
    for part in {j[0] for j in judged}:
        mine = [j for j in judged if j[0] == part]
        rows, share = [], dict.fromkeys(filters, 0)
        for order in map("".join, itertools.permutations(filters)):
            for s, f in enumerate(order):
                before = set(order[:s])
                removed = [j for j in mine if f in j[1] and not j[1] & before]
                share[f] += len(removed)
                rows.append((part, order, s + 1, sum(not j[1] & {*before, f} for j in mine), len(removed),
                             sum(f in j[1] and bool(j[1] & before) for j in mine), sum(j[1] == {f} for j in mine),
                             sum(j[2] for j in removed), sum(j[3] for j in removed), f))
        out += [(*r[:-1], share[r[-1]]) for r in rows]
    return sorted(out)


@pytest.fixture(scope="module")
def table():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for k in range(60):
        text = " ".join(rng.choices(words[:rng.choice([5, 120, 400])], k=rng.choice([0, 3, 199, 200, 201, 500])))
        text += rng.choice(["", "", "", " #", " " + "ABC" * 40])
        docs.append((k, text, rng.choice(["en", "de", "", None]), 1, 2))
    docs += [(100 + i, docs[5][1], "en", 1, 2) for i in range(40)]      # a group of copies with a third of all rows
    docs += [docs[5], docs[5], (5, "other text of a repeated key", "fr", 1, 2)]
    docs += [(None, docs[5][1], "de", 1, 2), (None, None, None, 1, 2), (-3, None, "en", 1, 2), (-4, "", None, 1, 2), (-4, "", "de", 1, 2)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 120, 2)]
    labels += [(2, 1, 1), (2, 0, 0), (None, 1, 1)]
    return docs, labels


def test_audit_equals_brute_force(spark, table):
    docs, labels = table
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, mask int, n int")
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = fa.audit_orders(fa.failure_masks(d, y), "ABCDE")
    want = by_the_book(docs, labels)
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in got.select(names).collect()) == want


def test_empty_tables(spark, table):
    docs, _ = table
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit_orders(fa.failure_masks(empty, none), "ABCDE").collect() == []
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, part int, bits int")
    rows = fa.audit_orders(fa.failure_masks(d, none), "ABCDE").collect()
    assert rows and {(r["good_lost"], r["toxic_lost"]) for r in rows} == {(0, 0)}
