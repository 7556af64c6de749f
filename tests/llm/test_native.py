"""URL lists, mixing and line removal."""

import datetime as dt
import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulon.llm import line_dedup as ld
from tabulon.llm import mixing as mx
from tabulon.llm import url_lists as ul


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


# ---- URL lists ----

def test_capture_meets_entries_of_its_time(spark):
    events = spark.createDataFrame([
        ("example.com", "add", day(10)), ("example.com", "remove", day(20)), ("example.com", "add", day(30)),
        ("a.example.com/ads/", "add", day(0)), ("both.org", "add", day(5)), ("both.org", "remove", day(5)),
        (None, "add", day(1)), ("x.net", "add", None), ("x.net", "remove", day(3))], "entry string, action string, at date")
    cases = [
        ("http://a.example.com/x", 9, None, 0), ("http://a.example.com/x", 10, "example.com", 1),
        ("https://A.Example.COM./x", 19, "example.com", 1), ("http://a.example.com/x", 20, None, 0),
        ("http://user:pw@a.example.com:80/ads/b.html?q=/", 30, "a.example.com/ads/", 2),
        ("http://a.example.com/ads", 25, None, 0), ("http://notexample.com/", 15, None, 0), ("http://both.org/", 6, None, 0),
        ("http://x.net/", 9, None, 0), ("no url", 15, None, 0), (None, 15, None, 0), ("", 15, None, 0)]
    rows = [(i, u, day(t), "extra") for i, (u, t, _, _) in enumerate(cases)] + [(99, "http://example.com/", None, "extra")]
    captures = spark.createDataFrame(rows + rows[:2], "page_id long, url string, fetched_at date, entry string")
    got = {r["page_id"]: r for r in ul.filter_captures(captures, events).collect()}
    assert len(got) == len(rows)
    for i, (_, _, entry, n) in enumerate(cases):
        assert (got[i]["entry"], got[i]["n_entries"], got[i]["blocked"]) == (entry, n, n > 0), cases[i]
    assert not got[99]["blocked"]
    none = ul.filter_captures(captures, events.limit(0))
    assert none.where("blocked").count() == 0 and none.count() == len(rows)
    assert ul.filter_captures(captures.limit(0), events).count() == 0


def test_intervals(spark):
    events = spark.createDataFrame([("e", "add", 1), ("e", "add", 3), ("e", "remove", 5), ("f", "remove", 2)],
                                   "entry string, action string, at int")
    got = sorted(tuple(r) for r in ul.validity_intervals(events).collect())
    assert got == [("e", 1, 3), ("e", 3, 5)]


# ---- mixing ----

def test_rates_reach_the_weights(spark):
    docs = spark.createDataFrame(
        [(i, "x" * 9, "a" if i % 4 else "b") for i in range(4000)] + [(5000, "x" * 9, None), (5001, None, "c")],
        "doc_id long, text string, source string")
    named, rest = mx.source_rates(docs, {"a": 0.2, "b": 0.6, "missing": 5.0}, 0.2, 1.0)
    whole = 4001 * 10 + 1
    assert named["a"] == pytest.approx(0.2 * whole / 30_000) and named["b"] == pytest.approx(0.6 * whole / 10_000)
    assert rest == pytest.approx(0.2 * whole / 11)
    mixed = mx.mix_sources(docs, {"a": 0.2, "b": 0.6}, 0.2, seed=3)
    mass = Counter()
    for r in mixed.collect():
        mass[r["source"] if r["source"] in ("a", "b") else None] += 10
    assert mass["a"] / whole == pytest.approx(0.2, abs=0.02) and mass["b"] / whole == pytest.approx(0.6, abs=0.03)
    assert sorted(map(repr, mixed.collect())) == sorted(map(repr, mx.mix_sources(docs.repartition(7), {"a": 0.2, "b": 0.6}, 0.2, seed=3).collect()))


@pytest.mark.parametrize("mean", [0.0, 0.3, 2.5, 70.0])
def test_counts_are_poisson(spark, mean):
    n = spark.range(20_000).select(mx.poisson_count(mean, 1, mx.F.col("id")).alias("n"))
    got = Counter(r["n"] for r in n.collect())
    assert sum(k * c for k, c in got.items()) / 20_000 == pytest.approx(mean, abs=4 * math.sqrt(mean / 20_000) + 1e-9)
    if 0 < mean < 3:
        for k in range(5):
            p = math.exp(-mean) * mean**k / math.factorial(k)
            assert got[k] / 20_000 == pytest.approx(p, abs=4 * math.sqrt(p / 20_000) + 1e-3)


def test_mixing_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, None, 1), (1, "", "a", 2), (1, "", "a", 2)], "doc_id long, text string, source string, copy int")
    got = mx.mix_sources(docs, {"a": 0.5}, 0.5, ratio=20.0).collect()
    assert got and set(got[0].asDict()) == {"doc_id", "text", "source", "copy", "copy_", "shuffle_key"}
    per_row = Counter(r["copy_"] for r in got if r["doc_id"] == 1)
    assert set(per_row.values()) == {2}
    assert mx.mix_sources(docs.limit(0), {"a": 1.0}).count() == 0
    with pytest.raises(ValueError):
        mx.mix_sources(docs, {"a": -1.0})


# ---- lines ----

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def brute(docs, min_chars):
    first = {}
    for key, text in sorted(docs.items()):
        for pos, line in enumerate((text or "").split("\n")):
            if line.strip(" "):
                first.setdefault(line, (key, pos))
    near = {y for y in first if len(y) >= min_chars for x in first if len(x) >= min_chars and first[x] < first[y]
            and abs(len(x) - len(y)) < 2 and distance(x, y) == 1}
    out = {}
    for key, text in docs.items():
        out[key] = text if text is None else "\n".join(
            x for pos, x in enumerate(text.split("\n")) if not x.strip(" ") or (first[x] == (key, pos) and x not in near))
    return out


@given(st.lists(st.lists(st.text(alphabet="abé ", max_size=7), max_size=4).map("\n".join), min_size=1, max_size=12))
@settings(max_examples=5, deadline=None)
def test_lines_match_brute_force(spark_session, texts):
    docs = dict(enumerate(texts))
    df = spark_session.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in ld.dedup_lines(df, min_chars=3).collect()}
    assert got == brute(docs, 3)


@pytest.fixture(scope="module")
def spark_session(spark):
    return spark


def test_lines_odd_rows(spark):
    line = "a line that is long enough to be near"
    rows = [(1, f"{line}\n\n{line}\nok", 7), (2, f"{line}!\n{line[1:]}\nother text of some length here", 8), (3, None, 9), (4, "", 9),
            (5, line, 1), (5, line, 1), (None, f"{line}?\nnull comes first", 2), (6, "y" * 30_000 + "\n" + "y" * 30_001, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_dropped int")
    got = [tuple(r) for r in ld.dedup_lines(df).collect()]
    assert sorted(got, key=repr) == sorted([
        (1, "\nok", 7, 2), (2, "other text of some length here", 8, 2), (3, None, 9, 0), (4, "", 9, 0),
        (5, "", 1, 1), (5, "", 1, 1), (None, f"{line}?\nnull comes first", 2, 0), (6, "y" * 30_000, 3, 1)], key=repr)
    assert ld.dedup_lines(df.limit(0)).count() == 0
    exact = {r["doc_id"]: r["n_dropped_"] for r in ld.dedup_lines(df, near=False).collect()}
    assert exact == {1: 1, 2: 0, 3: 0, 4: 0, 5: 1, None: 0, 6: 0}


def test_one_hub_for_many_replacements(spark):
    base = "the same long line with one letter changed: "
    texts = [(i, base[:5] + chr(97 + i) + base[6:]) for i in range(26)]
    got = {r["doc_id"]: r["n_dropped"] for r in ld.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {0: 0, **{i: 1 for i in range(1, 26)}}
