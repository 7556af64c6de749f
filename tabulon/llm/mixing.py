"""Mixing sources to target weights by Poisson replication.

Each document is repeated as often as a Poisson draw says whose mean is the
repetition rate its source needs to reach its target weight.  The draw inverts
the Poisson distribution at a uniform number hashed from (seed, key), so it does
not depend on partitions or retries.  The copies are dealt out by a hash of
(seed, key, copy) and sorted by it within partitions: one shuffle, no sampling
pass, and the order over the whole output is a random permutation.

Only DataFrame functions are used.  Rates are known for the sources that the
caller names and, as one group, for all others, so no row travels to meet its
rate however many rows a source has.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.registry import free_name, query, table

_DRAW = 32.0  # largest mean of one draw; larger means are sums of independent draws


def _word(*parts: Column) -> Column:
    """60 bits of a digest as a long."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _uniform(word: Column) -> Column:
    """Uniform in (0, 1) from the upper 52 of 60 bits."""
    return (F.shiftright(word, 8).cast("double") + 0.5) / float(1 << 52)


def poisson_steps(mean: float) -> list[float]:
    """Distribution function at 0, 1, 2, ... up to where doubles end; one literal of bounded size."""
    if not 0 < mean <= _DRAW:
        raise ValueError(f"mean in (0, {_DRAW}] expected")
    steps, total, k = [], 0.0, 0
    while total < 1 - 2.0 ** -53 and k < mean + 200:
        total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        steps.append(total)
        k += 1
    return steps


def poisson_count(mean: float, seed: int, key: Column) -> Column:
    """Seeded Poisson draw per key: how many steps of the distribution lie below the uniform number."""
    if mean <= 0:
        return F.lit(0)
    draws = math.ceil(mean / _DRAW)
    steps = F.array(*[F.lit(s) for s in poisson_steps(mean / draws)])

    def one(j: Column) -> Column:
        u = _uniform(_word(F.lit(seed), key, j))
        return F.size(F.filter(steps, lambda s: s < u))

    if draws == 1:
        return one(F.lit(0))
    return F.aggregate(F.sequence(F.lit(0), F.lit(draws - 1)), F.lit(0), lambda n, j: n + one(j))


def source_rates(
    docs: DataFrame, weights: dict[str, float], other: float, ratio: float, source: str = "source", text: str = "text",
) -> tuple[dict[str, float], float]:
    """Mean repetition of each named source and of all others.

    The mass of a document is its number of characters plus one, over whole
    texts.  A source gets its share of ``ratio`` times the whole mass; weights of
    sources without a document are spread over the rest.
    """
    if any(w < 0 for w in weights.values()) or other < 0 or ratio <= 0:
        raise ValueError("weights must not be negative, ratio must be positive")
    name = F.when(F.col(source).isin(*weights), F.col(source)) if weights else F.lit(None).cast("string")
    rows = docs.groupBy(name.alias("name")).agg(F.sum(F.coalesce(F.length(text), F.lit(0)) + 1).alias("mass")).collect()
    mass = {r["name"]: r["mass"] for r in rows}
    share = {s: w for s, w in {**weights, None: other}.items() if s in mass}
    whole, all_shares = sum(mass.values()), sum(share.values())
    rate = {s: w / all_shares * ratio * whole / mass[s] if all_shares else 0.0 for s, w in share.items()}
    return {s: r for s, r in rate.items() if s is not None}, rate.get(None, 0.0)


def mix_sources(
    docs: DataFrame, weights: dict[str, float], other: float = 0.0, ratio: float = 1.0, seed: int = 0,
    key: str = "doc_id", source: str = "source", text: str = "text", copy: str = "copy", order: str = "shuffle_key",
) -> DataFrame:
    """All columns of ``docs`` for each copy, with ``copy`` (from 1) and ``shuffle_key``, in mixed order.

    ``weights`` names target shares of sources; ``other`` is the share of all
    sources not named, a null source among them.  Rows that repeat a key have
    the same count.  Null and empty texts weigh one character.  An empty table
    gives an empty table.  If ``docs`` has columns named like ``copy`` or
    ``order``, the added ones get underscores at their ends.
    """
    copy, order = free_name(copy, docs.columns), free_name(order, docs.columns)
    named, rest = source_rates(docs, weights, other, ratio, source, text)
    count = poisson_count(rest, seed, F.col(key))
    for s, rate in named.items():
        count = F.when(F.col(source) == s, poisson_count(rate, seed, F.col(key))).otherwise(count)
    copies = docs.withColumn(copy, count).where(F.col(copy) > 0)
    copies = copies.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy))))
    dealt = copies.withColumn(order, _word(F.lit(seed), F.col(key), F.lit("c"), F.col(copy)))
    return dealt.repartition(F.col(order)).sortWithinPartitions(order, key)


# Target shares used by the query and the pipeline: the largest source is held at a fifth.
WEIGHTS = {"src0": 0.2, **{f"src{i}": 0.05 for i in range(1, 10)}}
OTHER = 0.35


@query("op6_poisson_mixing", f"""
    WITH target(name, w) AS (VALUES ('src0', 0.2::DOUBLE), {", ".join(f"('src{i}', 0.05::DOUBLE)" for i in range(1, 10))}),
    d AS (SELECT *, CASE WHEN source IN (SELECT name FROM target) THEN source END AS name FROM documents),
    mass AS (SELECT name, sum(coalesce(length(text), 0) + 1)::DOUBLE AS mass FROM d GROUP BY name),
    share AS (SELECT mass.name, mass, coalesce(w, {OTHER}::DOUBLE) AS w FROM mass LEFT JOIN target USING (name)),
    rate AS (SELECT name, w / (SELECT sum(w) FROM share) * (SELECT sum(mass) FROM share) / mass AS rate FROM share),
    step AS (SELECT name, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY name ORDER BY k) AS f
             FROM rate, range(0, 60) t(k)),
    u AS (SELECT d.*, ((('0x' || substr(md5('0:' || doc_id || ':0'), 1, 15))::BIGINT >> 8)::DOUBLE + 0.5)
                      / 4503599627370496.0 AS u FROM d),
    n AS (SELECT doc_id, (SELECT count(*) FROM step WHERE step.name IS NOT DISTINCT FROM u.name AND f < u.u) AS n FROM u)
    SELECT documents.*, copy::INTEGER AS copy,
           ('0x' || substr(md5('0:' || doc_id || ':c:' || copy), 1, 15))::BIGINT AS shuffle_key
    FROM documents JOIN n USING (doc_id), range(1, 60) c(copy) WHERE copy <= n""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), WEIGHTS, OTHER)
