"""Both language models against plain Python, and what they tell apart."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabulon.llm import cross_entropy as ce
from tabulon.llm import kneser_ney as kn
from tabulon.llm.registry import ship
from tabulon.llm.words import U64, WordHasher, byte_table

SF = "/root/testdata/sf0.01"


def words_of(text, fold):
    text = (text or "").encode()
    return re.findall(rb"[^\x00-\x20!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+", text.lower() if fold else text)


class Brute:
    """Interpolated modified Kneser-Ney trigrams over words, by the book."""

    def __init__(self, texts, min_count=2):
        docs = [words_of(t, False) for t in texts]
        n = Counter(w for d in docs for w in d)
        self.known = {w for w, c in n.items() if c >= min_count}
        self.spared = max(sum(c < min_count for c in n.values()), 1)
        c3 = Counter()
        for d in docs:
            d = ["<s>", "<s>", *[w if w in self.known else "<u>" for w in d]]
            c3.update(zip(d, d[1:], d[2:]))
        c2 = Counter((v, w) for _, v, w in c3)
        c1 = Counter(w for _, w in c2)
        self.levels = [self.level(c, {k: k[:-1] for k in c}) for c in (c3, c2)]
        d = self.discounts(c1)
        self.c1, self.total = c1, sum(c1.values())
        self.d1, self.floor = d, sum(d(c) for c in c1.values()) / self.total / (len(c1) + 1)

    @staticmethod
    def discounts(counts):
        n = Counter(counts.values())
        if 0 in (n[1], n[2], n[3]):
            return lambda c: (0.5, 0.75, 0.9)[min(c, 3) - 1]
        y = n[1] / (n[1] + 2 * n[2])
        d = [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) for k in (1, 2, 3)]
        return lambda c: d[min(c, 3) - 1]

    def level(self, counts, context):
        d, total, left = self.discounts(counts), Counter(), defaultdict(float)
        for k, c in counts.items():
            total[context[k]] += c
            left[context[k]] += d(c)
        return counts, d, total, left

    def p(self, *gram):
        gram = tuple(w if w in self.known or w == "<s>" else "<u>" for w in gram)
        if len(gram) == 1:
            c = self.c1[gram[0]]
            return (c - self.d1(c) if c else 0) / self.total + self.floor
        counts, d, total, left = self.levels[3 - len(gram)]
        below = self.p(*gram[1:])
        t = total[gram[:-1]]
        if not t:
            return below
        c = counts[gram]
        return (c - d(c) if c else 0) / t + left[gram[:-1]] / t * below

    def logp(self, *gram):
        return math.log(self.p(*gram) / (1 if gram[-1] in self.known else self.spared))


def hash_of(word):
    data = np.frombuffer(word, np.uint8)
    return WordHasher(byte_table(False, True))(data, np.array([0, len(data)]))[0][0]


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(4)
    common = [f"w{i}" for i in range(25)]
    weights = 1 / np.arange(1, 26)
    return [" ".join(rng.choice(common, 40, p=weights / weights.sum())) + f". Odd{i} !" for i in range(30)] + ["", None, "w1"]


def test_probabilities_by_the_book(spark, texts):
    model = kn.train(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    brute = Brute(texts)
    pool = ["<s>", *sorted(brute.known), b"never", b"seen"]
    code = {w: U64(kn.START) if w == "<s>" else hash_of(w) for w in pool}
    rng = np.random.default_rng(1)
    grams = [("<s>", "<s>", b"w0"), ("<s>", b"w0", b"w1")]
    grams += [tuple(rng.choice(np.array(pool[1:], object), 3)) for _ in range(400)]
    u, v, w = (np.array([code[g[i]] for g in grams], U64) for i in range(3))
    got = kn.log_probabilities(model, u, v, w)
    assert got == pytest.approx([brute.logp(*g) for g in grams], abs=2e-4)
    for context in (("<s>", "<s>"), (b"w0", b"w1"), (b"never", b"w2")):
        assert sum(brute.p(*context, x) for x in [*brute.known, b"never"]) == pytest.approx(1, abs=0.02)


def test_document_losses(spark, texts):
    model = kn.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    brute = Brute(texts)
    rows = [*enumerate(texts), (100, "w3 strange w0 w0"), (101, "w1 " * 3000)]
    got = {r["doc_id"]: r for r in kn.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), ship(spark, model)).collect()}
    for i, t in rows:
        d = ["<s>", "<s>", *words_of(t, False)]
        assert got[i]["n_tokens"] == len(d) - 2
        assert got[i]["loss"] == pytest.approx(-sum(brute.logp(*d[k - 2:k + 1]) for k in range(2, len(d))), rel=1e-4)


@pytest.mark.parametrize("blocks", [1 << 22, 300])
def test_shards_score_as_the_whole_model(spark, texts, monkeypatch, blocks):
    monkeypatch.setattr(kn, "BLOCK_TOKENS", blocks)
    taught = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = [*enumerate(texts), (100, "w3 strange w0 w0"), (101, "w1 " * 3000), (None, "w1"), (None, "w1"), (102, " "), (103, "w2 x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = kn.score_by_shards(df, kn.train_tables(taught), shard_bytes=500).collect()
    want = kn.score_documents(df, ship(spark, kn.train(taught))).collect()
    assert sorted([tuple(r)[:3] for r in got], key=repr) == sorted([tuple(r)[:3] for r in want], key=repr)
    for g, w in zip(*(sorted(x, key=lambda r: (str(r[0]), r["loss"])) for x in (got, want)), strict=True):
        assert g["loss"] == pytest.approx(w["loss"], abs=1e-6 * (1 + w["n_tokens"]))


def test_quality_learns_from_every_trusted_document(spark):
    words = F.concat_ws(" ", *[F.concat(F.lit("w"), F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(3000))) for i in range(4)])
    df = spark.range(9_400).select(F.col("id").alias("doc_id"), words.alias("text"), F.lit("en").alias("lang"))
    got = kn.classify_quality(df, df.select("doc_id", F.lit(1).alias("quality")))
    half = F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(2))
    taught = df.where(half == 0)
    assert taught.count() > 4_400
    scored = kn.score_documents(df, ship(spark, kn.train(taught)))
    mean = scored.where(half == 1).agg(F.sum("loss") / F.sum("n_tokens")).first()[0]
    want = F.exp((F.col("loss") + kn.SHRINK * mean) / (F.col("n_tokens") + kn.SHRINK))
    assert got.join(scored.select("doc_id", want.alias("want")), "doc_id").where(F.abs(F.col("perplexity") / F.col("want") - 1) < 1e-6).count() == 9_400


def test_quality_keeps_clean_and_rejects_junk(spark):
    got = kn.op9(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").groupBy("quality").agg(
        F.avg(F.col("keep").cast("int")).alias("kept"), F.count("*").alias("n")).collect()
    kept = {r["quality"]: r["kept"] for r in got}
    assert kept[1] >= 0.985 and kept[0] <= 0.2


def test_repeated_words_go_and_repeated_phrases_of_prose_stay(spark, texts):
    rng = np.random.default_rng(3)
    prose = [" ".join(rng.choice([f"w{i}" for i in range(200)], 80)) for _ in range(400)]
    docs = [(i, t, "en") for i, t in enumerate(prose)] + [(900, "w1 w2 w3 " * 200, "en"), (901, "w5 " * 40, "en"), (902, "w1 w2", "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, quality int")
    got = {r["doc_id"]: r["keep"] for r in kn.classify_quality(df, labels).collect()}
    assert not got[900] and not got[901] and got[902]
    assert sum(got[i] for i in range(400)) >= 392


def test_distinct_trigrams():
    row = np.array([0, 0, 0, 1, 1, 3])
    u, v, w = (np.array(x, U64) for x in ([1, 1, 1, 1, 2, 1], [5, 5, 6, 5, 5, 5], [7, 7, 7, 7, 7, 7]))
    assert kn._distinct(row, u, v, w, 5).tolist() == [2, 2, 0, 1, 0]


def test_quality_odd_rows(spark, texts):
    docs = [(i, t, "en", 0) for i, t in enumerate(texts * 8)] + [(None, "w1 w2", None, 0), (1, "w9 w9", "xx", 0), (900, "zz|" * 3000, "en", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, n_tokens int")
    labels = spark.createDataFrame([(i, 1) for i in range(200)] + [(None, 1), (3, 1), (5, None), (900, 0)], "doc_id long, quality int")
    got = kn.classify_quality(df, labels).collect()
    assert len(got) == len(docs)
    assert all(r["keep"] and r["perplexity"] is None for r in got if r["n_tokens"] == 0)
    assert not [r for r in got if r["doc_id"] == 900][0]["keep"]
    untrusted = kn.classify_quality(df, labels.limit(0)).collect()
    assert len(untrusted) == len(docs) and all(r["keep"] and r["perplexity"] is None for r in untrusted)
    assert kn.classify_quality(df.limit(0), labels).collect() == kn.classify_quality(df.limit(0), labels.limit(0)).collect() == []
    blank = df.withColumn("text", F.lit(" "))
    assert kn.classify_quality(blank, labels).where("keep").count() == len(docs)
    assert kn.classify_quality(df, labels).where("keep").count() >= 0.95 * (len(docs) - 1)


def test_language_quantiles(spark):
    rows = [("en", i / 1000) for i in range(1, 201)] + [("fr", 5.0)] * 60 + [("xx", 9.0), (None, 1.0)]
    cuts, overall = kn.language_quantiles(spark.createDataFrame(rows, "lang string, score double"), 0.9)
    assert {r["lang"]: r["cut"] for r in cuts.collect()} == {"en": 0.18, "fr": 5.0}
    assert overall == 5.0
    none, top = kn.language_quantiles(spark.createDataFrame([], "lang string, score double"), 0.9)
    assert none.count() == 0 and top == float("inf")


def test_cross_entropy_by_the_book(spark, monkeypatch):
    monkeypatch.setattr(ce, "VOCABULARY", 40)
    monkeypatch.setattr(ce, "_BUFFER", 50)
    rng = np.random.default_rng(8)
    docs = [(i, " ".join(f"{'a' if i < 8 else 'B'}{rng.integers(0, 14)}" for _ in range(30))) for i in range(20)]
    docs += [(20, None), (21, ""), (22, "Something else entirely"), (8, "a1 a2")]
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, score double").repartition(3)
    keys = spark.createDataFrame([(i,) for i in range(8)] + [(None,), (0,), (777,)], "doc_id long")
    n = Counter(hash_of(w) for _, t in docs for w in words_of(t, True))
    top = sorted(n, key=lambda h: (-n[h], np.array(h).view(np.int64)))[:40 - 1 - ce.OTHER_CLASSES]
    ids = {h: k + 1 + ce.OTHER_CLASSES for k, h in enumerate(sorted(top))}
    coded = [(i, [ids.get(h, 1 + int(h % U64(ce.OTHER_CLASSES))) for h in map(hash_of, words_of(t, True))]) for i, t in docs]

    def model(chosen):
        ones, pairs, after, kinds = Counter(), Counter(), Counter(), Counter()
        for d in chosen:
            pairs.update(zip([0, *d], d))
        for (v, w), c in pairs.items():
            ones[w] += c
            after[v] += c
            kinds[v] += 1
        total = sum(ones.values()) + 0.5 * 40
        return lambda v, w: -math.log((pairs[v, w] + max(kinds[v], 0 if after[v] else 1) * (ones[w] + 0.5) / total) / (after[v] + kinds[v] if after[v] else 1))

    target, background = model([d for i, d in coded if i in range(8)]), model([d for _, d in coded])
    got = sorted((tuple(r) for r in ce.score_cross_entropy(df, keys).collect()), key=repr)
    want = []
    for i, d in coded:
        t = [f for f in (sum(m(v, w) for v, w in zip([0, *d], d)) / len(d) if d else None for m in (target, background))]
        want.append((i, len(d), *t, t[0] - t[1] if d else None))
    want.sort(key=repr)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[2:] == pytest.approx(w[2:], abs=1e-5) if w[2] is not None else g[2:] == (None, None, None)


@pytest.mark.parametrize("buffer", [1 << 22, 700])
def test_cross_entropy_gives_every_word_its_own_counts(spark, monkeypatch, buffer):
    """More words than any fixed list; the two models differ in the rare ones only."""
    monkeypatch.setattr(ce, "_BUFFER", buffer)
    rng = np.random.default_rng(5)
    rare = [f"r{i}" for i in range(6000)]
    docs = [(i, " ".join(w for _ in range(20) for w in ("the", str(rng.choice(rare[:3000] if i < 100 else rare[3000:]))))) for i in range(300)]
    docs += [(300, None), (301, "the"), (302, "the r1 unheard"), (302, "the r1 unheard"), (None, "r1 the")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    coded = [(i, words_of(t, True)) for i, t in docs]
    vocabulary = {w for _, d in coded for w in d}
    assert len(vocabulary) > 2_500

    def model(chosen):
        pairs = Counter(p for d in chosen for p in zip([None, *d], d))
        ones, after, kinds = Counter(), Counter(), Counter()
        for (v, w), c in pairs.items():
            ones[w] += c
            after[v] += c
            kinds[v] += 1
        total = sum(ones.values()) + 0.5 * len(vocabulary)
        return lambda v, w: -math.log((pairs[v, w] + (kinds[v] if after[v] else 1) * (ones[w] + 0.5) / total) / (after[v] + kinds[v] if after[v] else 1))

    models = model([d for i, d in coded if i is not None and i < 100]), model([d for _, d in coded])
    got = sorted((tuple(r) for r in ce.score_cross_entropy(df, df.where("doc_id < 100").select("doc_id")).collect()), key=repr)
    want = []
    for i, d in coded:
        t = [sum(m(v, w) for v, w in zip([None, *d], d)) / len(d) if d else None for m in models]
        want.append((i, len(d), *t, t[0] - t[1] if d else None))
    for g, w in zip(got, sorted(want, key=repr), strict=True):
        assert g[:2] == w[:2] and g[2:] == (pytest.approx(w[2:], abs=1e-9) if w[1] else (None,) * 3)
    by_part = [[g[4] for g in got if g[0] is not None and g[0] in part] for part in (range(100), range(100, 300))]
    assert max(by_part[0]) < min(by_part[1])


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_cross_entropy_reads_every_target_document(spark, monkeypatch, broadcast):
    monkeypatch.setattr(ce, "BROADCAST_KEYS", broadcast)
    words = F.concat_ws(" ", *[F.concat(F.lit("w"), F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(9))) for i in range(6)])
    df = spark.range(20_400).withColumnRenamed("id", "doc_id").withColumn("text", words)
    got = ce.score_cross_entropy(df, df.select("doc_id"))  # the target is the whole table, so both models are one
    assert got.where((F.col("target_loss") == F.col("background_loss")) & (F.col("score") == 0)).count() == 20_400


def test_cross_entropy_without_target_or_rows(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert ce.score_cross_entropy(df.limit(0), df.select("doc_id")).count() == 0
    assert ce.score_cross_entropy(df, df.select("doc_id").limit(0)).count() == 1


def test_cross_entropy_orders_clean_before_junk(spark):
    got = ce.op5(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("quality", "score").collect()
    junk, clean = [r["score"] for r in got if r["quality"] == 0], [r["score"] for r in got if r["quality"] == 1]
    assert np.mean([[c < j for c in clean] for j in junk]) > 0.95


def test_keys_are_spark_s_hashes(spark):
    x = [(1, -5), (2**62, 0), (-(2**63), 7)]
    want = [r[0] for r in spark.createDataFrame(x, "a long, b long").select(F.xxhash64("a", "b")).collect()]
    a, b = (np.array([r[i] for r in x], np.int64).view(U64) for i in (0, 1))
    assert kn._key(a, b).view(np.int64).tolist() == want == kn._key(b, start=kn._key(a)).view(np.int64).tolist()


def test_signed_hashes_keep_their_bits():
    from tabulon.llm.words import signed

    x = np.array([0, 2**63, 2**64 - 1], U64)
    assert signed(x).to_pylist() == [0, -2**63, -1] and signed(x).type == pa.int64()
