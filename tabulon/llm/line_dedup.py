"""Removal of repeated and nearly repeated lines by a deletion-neighbourhood join.

Two lines are near when one edit (a character inserted, deleted or replaced)
turns one into the other.  A line emits all its variants with one character
deleted, as hashed keys.  Lines of one length that share a variant at one
position differ there at most; a line equal to a variant of a longer one differs
by an insertion.  Equal variants are joined as stars around the earliest line,
never as pairs within a group, and each pair's edit distance is verified.

Emitting variants is quadratic in a line's length, so lines that cannot have a
neighbour are set aside first, exactly: one edit leaves the first or the second
half of the shorter line in place, and a line whose halves no other line has is
alone.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.registry import free_name, query, table
from tabulon.session import materialize

MIN_CHARS = 20  # shorter lines are compared exactly
_SMALL = 500_000  # rows of 16 bytes up to which a side is broadcast; beyond, both sides are shuffled


def _half_keys(line: Column, n: Column) -> list[Column]:
    """First and second half of the line, as the shorter (length n) and as the longer (n - 1) of a pair."""
    keys = []
    for length in (n, n - 1):
        half = F.floor(length / 2).cast("int")
        keys += [F.xxhash64(F.lit("head"), length, F.substring(line, 1, half)),
                 F.xxhash64(F.lit("tail"), length, F.substring(line, n - (length - half) + 1, n))]
    return keys


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, pos, line, h1, h2) of every line that is not blank."""
    rows = docs.select(F.col(key).alias("doc"), F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    return rows.where(F.trim("line") != "").select(
        "doc", "pos", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"))


def _side(rows: DataFrame) -> DataFrame:
    """A written table as a join side: broadcast if it has few rows, else left to a shuffle."""
    return F.broadcast(rows) if rows.count() <= _SMALL else rows


def near_lines(known: DataFrame, lines: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2) of distinct lines that have an earlier line within one edit.

    ``known`` holds each distinct line once: (h1, h2, at, n, k0..k3), ``at``
    being its first place.  The earlier line need not itself be kept.
    """
    long = known.where(F.col("n") >= min_chars)
    keys = long.select("h1", "h2", F.posexplode(F.array("k0", "k1", "k2", "k3")).alias("i", "k"))
    shared = materialize(keys.groupBy("k").agg(F.min("h1").alias("a"), F.max("h1").alias("b"))
                         .where(F.col("a") != F.col("b")).select("k"), "lines-halves")
    is_head = F.col("i") % 2 == 0
    paired = materialize(keys.join(_side(shared), "k").groupBy("h1", "h2").agg(
        F.max(is_head).alias("head"), F.max(~is_head).alias("tail")), "lines-paired")
    texts = lines.join(_side(paired.select("h1", "h2")), ["h1", "h2"]).groupBy("h1", "h2").agg(F.first("line").alias("line"))
    left = materialize(texts.join(long.select("h1", "h2", "at", "n"), ["h1", "h2"]).join(paired, ["h1", "h2"]), "lines-left")

    low = F.when(F.col("tail"), 1).otherwise(F.floor((F.col("n") + 1) / 2).cast("int"))  # an equal head leaves the rest
    high = F.when(F.col("head"), F.col("n")).otherwise(F.floor(F.col("n") / 2).cast("int") + 1)
    spot = left.select("h1", "at", "n", "line", F.explode(F.sequence(low, high)).alias("p"))
    variant = F.xxhash64(F.concat(F.substring("line", F.lit(1), F.col("p") - 1),
                                  F.substring("line", F.col("p") + 1, F.col("n"))))
    variants = spot.select("h1", "at", "n", "p", variant.alias("v"))
    group = ["v", "n", "p"]
    several = (variants.groupBy(*group).agg(F.min("h1").alias("a"), F.max("h1").alias("b"))
               .where(F.col("a") != F.col("b")).select("v"))
    whole = left.select(F.col("h1").alias("v"), (F.col("n") + 1).alias("n"), F.col("at").alias("short_at"))
    wanted = materialize(several.union(whole.select("v")).distinct(), "lines-wanted")
    met = materialize(variants.join(_side(wanted), "v").drop("h1"), "lines-met")
    stars = met.groupBy(*group).agg(F.min("at").alias("first"))
    replaced = (met.join(stars, group).where(F.col("first") < F.col("at"))
                .select("first", F.col("at").alias("later")).distinct())
    inserted = (met.join(whole, ["v", "n"])
                .select(F.least("at", "short_at").alias("first"), F.greatest("at", "short_at").alias("later")).distinct())
    places = left.select("at", "line", "h1", "h2")
    pairs = replaced.union(inserted).distinct()
    pairs = pairs.join(places.select(F.col("at").alias("first"), F.col("line").alias("a")), "first")
    pairs = pairs.join(places.withColumnsRenamed({"at": "later", "line": "b"}), "later")
    return materialize(pairs.where(F.levenshtein("a", "b", 1) >= 0).select("h1", "h2").distinct(), "lines-near")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
                near: bool = True, dropped: str = "n_dropped") -> DataFrame:
    """``docs`` without lines that an earlier line repeats, and how many went.

    Earlier means a smaller (key, line number); null keys come first.  A line
    goes when an equal line stands earlier, or, from ``min_chars`` characters
    on, when a line within one edit is first seen earlier.  Blank lines stay.
    Documents are never removed: if all lines go, the text is empty; null and
    empty texts stay as they are.  Rows repeated with key and text count as one
    place and keep the same lines.  If ``docs`` has a column named like
    ``dropped``, the added one gets underscores at its end.
    """
    dropped, doc, lost_lines = (free_name(c, docs.columns) for c in (dropped, "__doc", "__gone"))
    lines = _lines(docs, key, text)
    n = F.length("line")
    half = _half_keys(F.col("line"), n)
    known = materialize(
        lines.select("h1", "h2", F.struct("doc", "pos").alias("at"), n.alias("n"), *[h.alias(f"k{i}") for i, h in enumerate(half)])
        .groupBy("h1", "h2").agg(F.min("at").alias("at"), F.count("*").alias("rows"), F.max("n").alias("n"),
                                 *[F.min(f"k{i}").alias(f"k{i}") for i in range(4)]), "lines-known")
    again = known.where(F.col("rows") > 1).select("h1", "h2", "at")
    if near:
        close = near_lines(known, lines, min_chars).select("h1", "h2", F.lit(None).cast(known.schema["at"].dataType).alias("at"))
        again = again.union(close).groupBy("h1", "h2").agg(F.when(F.count("*") == F.count("at"), F.min("at")).alias("at"))
    place = F.struct("doc", "pos")
    gone = (lines.select("doc", "pos", "h1", "h2").join(again, ["h1", "h2"])
            .where(F.col("at").isNull() | ~place.eqNullSafe(F.col("at")))
            .groupBy("doc").agg(F.collect_set(F.struct("pos", "h1")).alias(lost_lines)))
    gone = materialize(gone.withColumnRenamed("doc", doc), "lines-gone")
    joined = docs.join(gone, docs[key].eqNullSafe(gone[doc]), "left")
    parts = F.split(docs[text], "\n")
    kept = F.filter(parts, lambda x, i: ~F.array_contains(
        F.col(lost_lines), F.struct(i.alias("pos"), F.xxhash64(x).alias("h1"))))
    fresh = F.when(F.col(lost_lines).isNull(), docs[text]).otherwise(F.array_join(kept, "\n"))
    lost = F.when(F.col(lost_lines).isNull() | docs[text].isNull(), 0).otherwise(F.size(parts) - F.size(kept))
    return joined.select(*[fresh.alias(c) if c == text else docs[c] for c in docs.columns], lost.alias(dropped))


@query("op7_line_dedup", f"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                      generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    k AS (SELECT line, min((doc_id, pos)) AS place, length(line) AS n FROM l WHERE trim(line) <> '' GROUP BY line),
    g AS (SELECT line, place, n FROM k WHERE n >= {MIN_CHARS}),
    h AS (SELECT line, place, n, m, n - m AS d FROM (SELECT g.*, unnest([n, n - 1]) AS m FROM g)),
    c AS (SELECT a.line AS a, b.line AS b, a.place AS pa, b.place AS pb FROM h a JOIN h b
            ON a.m = b.m AND a.d + b.d < 2 AND left(a.line, a.m // 2) = left(b.line, b.m // 2) AND a.place < b.place
          UNION SELECT a.line, b.line, a.place, b.place FROM h a JOIN h b
            ON a.m = b.m AND a.d + b.d < 2 AND right(a.line, a.m - a.m // 2) = right(b.line, b.m - b.m // 2) AND a.place < b.place),
    near AS (SELECT DISTINCT b AS line FROM c WHERE
        (length(a) = length(b) AND list_bool_or(list_transform(range(1, length(a) + 1), lambda p:
            left(a, p - 1) = left(b, p - 1) AND substr(a, p + 1) = substr(b, p + 1))))
        OR (length(a) = length(b) + 1 AND list_bool_or(list_transform(range(1, length(a) + 1), lambda p:
            left(a, p - 1) || substr(a, p + 1) = b)))
        OR (length(b) = length(a) + 1 AND list_bool_or(list_transform(range(1, length(b) + 1), lambda p:
            left(b, p - 1) || substr(b, p + 1) = a)))),
    kept AS (SELECT l.doc_id, l.pos, l.line FROM l LEFT JOIN k USING (line) LEFT JOIN near USING (line)
             WHERE k.line IS NULL OR (near.line IS NULL AND (l.doc_id, l.pos) = k.place)),
    built AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n FROM kept GROUP BY doc_id)
    SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(b.text, '') END AS text, d.lang, d.source, d.n_chars,
           coalesce(len(string_split(d.text, chr(10))) - coalesce(b.n, 0), 0)::INTEGER AS n_dropped
    FROM documents d LEFT JOIN built b USING (doc_id)""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))
