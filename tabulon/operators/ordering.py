"""Order statistics without a single-task sort.

A window over a whole column, or over one class that holds most rows, runs in
one task.  Here equal values are first counted together, the counted values are
range-partitioned over the cluster, and each partition only needs the total of
the partitions before it.  A value that holds a third of all rows is one row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.session import discard, materialize

RANK_TABLE_BYTES = 32 * 1024 * 1024  # of distinct values whose ranks are sent to all rows


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on keys where null equals null; keeps the left key columns.

    Without keys the right side is a single row of totals, added as a scalar.
    """
    if not keys:
        one = right.select(F.struct(*right.columns).alias("row")).scalar()
        return left.withColumn("__row", one).select(*left.columns, "__row.*")
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"__{k}" for k in keys])


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                sums: Mapping[str, str], totals: Mapping[str, str] | None = None) -> DataFrame:
    """Add, per row, the sum of columns over the rows that sort before it.

    ``sums`` maps new column to summed column; ``totals`` likewise adds the sum
    over the whole group.  ``order`` must tell rows apart.
    """
    keys, totals = list(keys), dict(totals or {})
    spread = df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id())
    spread = materialize(spread, "ordered")
    inside = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = spread.withColumns({o: F.coalesce(F.sum(c).over(inside), F.lit(0)) for o, c in sums.items()})
    # One row per (key, partition) that meet: as many as keys plus partitions.
    parts = spread.groupBy(*keys, "__part").agg(*[F.sum(c).alias(f"__{o}") for o, c in {**sums, **totals}.items()])
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = parts.select(*keys, "__part", *[F.coalesce(F.sum(f"__{o}").over(earlier), F.lit(0)).alias(f"__{o}") for o in sums],
                           *[F.sum(f"__{o}").over(whole).alias(o) for o in totals])
    out = null_safe_join(local, offsets, [*keys, "__part"], "inner")
    out = out.withColumns({o: F.col(o) + F.col(f"__{o}") for o in sums})
    return out.drop("__part", *[f"__{o}" for o in sums])


def value_counts_before(df: DataFrame, keys: Sequence[str], value: str, descending: bool = False) -> DataFrame:
    """Distinct values with their count ``n``, the count ``before`` them and
    the ``total`` of their group.

    Nulls are dropped after the grouping: a null test on the rows would be
    pushed to the scan and evaluate a computed value a second time.
    """
    counts = df.groupBy(*keys, value).agg(F.count(value).alias("n")).filter("n > 0")
    order = F.col(value).desc() if descending else F.col(value).asc()
    return prefix_sums(counts, keys, [order], {"before": "n"}, {"total": "n"})


def value_places(df: DataFrame, value: str, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Rows with a value, with the weight ``before`` and ``equal`` to it and the ``total`` of their group.

    Rows themselves are put in order by range, ties by their place in the input,
    so a value that many rows share is cut over several partitions like any
    other stretch.  Only the least and the greatest value of a partition can
    reach into its neighbours: one row per (group, partition) carries what lies
    before these two and how often they occur; nothing is joined on a value.
    ``weight`` counts a row so many times.
    """
    keys = list(keys)
    n = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    spread = df.withColumns({"__n": n, "__tie": F.monotonically_increasing_id()})
    spread = materialize(spread.repartitionByRange(*keys, F.col(value).asc(), "__tie").drop("__tie").withColumn(
        "__part", F.spark_partition_id()), "ordered")
    rows = spread.filter(F.col(value).isNotNull())
    counted = rows.groupBy(*keys, "__part", value).agg(F.sum("__n").alias("n"))
    end = F.struct(F.col(value).alias("v"), F.col("n").alias("n"))
    parts = counted.groupBy(*keys, "__part").agg(F.sum("n").alias("n"), F.min(end).alias("lo"), F.max(end).alias("hi"))
    # One row per (group, partition) that meet, and two per such row.
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"__offset": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "__total": F.sum("n").over(Window.partitionBy(*keys))})
    parts = materialize(parts, "parts")
    first = F.col("__offset") + F.when(F.col("end") == "lo", 0).otherwise(F.col("n") - F.col("e.n"))
    # Where a partition holds a single value, that value is both ends but counts once.
    both = F.create_map(F.lit("lo"), "lo", F.lit("hi"), "hi")
    once = F.when(F.col("lo.v") == F.col("hi.v"), F.create_map(F.lit("lo"), "lo")).otherwise(both)
    ends = parts.select(*keys, "__offset", "n", F.explode(once).alias("end", "e"))
    reach = ends.groupBy(*keys, F.col("e.v").alias("__v")).agg(F.min(first).alias("__first"), F.sum("e.n").alias("__equal"))
    known = parts.select(*keys, "__part", "__offset", "__total", F.col("lo.v").alias("__lo"), F.col("hi.v").alias("__hi"))
    for side in ("__lo", "__hi"):
        known = null_safe_join(known, reach.withColumnsRenamed({"__v": side, "__first": f"{side}_first", "__equal": f"{side}_equal"}), [*keys, side])
    inside = Window.partitionBy(*keys, "__part").orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    peers = Window.partitionBy(*keys, "__part", value)
    local = rows.withColumns({"__upto": F.sum("__n").over(inside), "equal": F.sum("__n").over(peers)})
    placed = null_safe_join(local, known, [*keys, "__part"], "inner")

    def at(end: str, else_: Column) -> Column:
        return F.when(F.col(value) == F.col("__lo"), F.col(f"__lo_{end}")).when(
            F.col(value) == F.col("__hi"), F.col(f"__hi_{end}")).otherwise(else_)

    return placed.select(*df.columns, at("first", F.col("__offset") + F.col("__upto") - F.col("equal")).alias("before"),
                         at("equal", F.col("equal")).alias("equal"), F.col("__total").alias("total"))


def average_rank(df: DataFrame, value: str, out: str = "rank", keys: Sequence[str] = (),
                 descending: bool = True) -> DataFrame:
    """Add the average-method rank; null values keep a null rank.

    The values are counted first.  While their ranks take at most
    ``RANK_TABLE_BYTES`` they are sent to the rows; otherwise the rows
    themselves are put in order (``value_places``).  The ranks are the same, and
    in neither way do the rows of one value meet in one task.
    """
    keys = list(keys)
    counts = materialize(df.groupBy(*keys, value).agg(F.count(value).alias("__n")).filter("__n > 0"), "values")
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in [*keys, value]), F.lit(48))
    size = counts.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]
    if size <= RANK_TABLE_BYTES:
        order = F.col(value).desc() if descending else F.col(value).asc()
        placed = prefix_sums(counts, keys, [order], {"__before": "__n"})
        ranks = placed.select(*keys, value, (F.col("__before") + (F.col("__n") + 1) / 2.0).alias("__rank"))
        ranked = null_safe_join(df.drop(out), F.broadcast(ranks), [*keys, value])
        return ranked.withColumnRenamed("__rank", out)
    discard(counts)
    kept = [c for c in df.columns if c != out]
    name = {c: f"__c{i}" for i, c in enumerate(df.columns)}
    placed = value_places(df.withColumnsRenamed(name), name[value], [name[k] for k in keys])
    up = F.col("before") + (F.col("equal") + 1) / 2.0
    rank = F.col("total") + 1 - up if descending else up
    ranked = placed.select(*[F.col(name[c]).alias(c) for c in kept], rank.alias(out))
    return ranked.unionByName(df.filter(F.col(value).isNull()).select(*kept, F.lit(None).cast("double").alias(out)))


def list_rank(value: str, keys: Sequence[str] = (), descending: bool = True) -> Column:
    """Average rank inside short lists (one row per feature, model or fold)."""
    c = F.col(value)
    order = Window.partitionBy(*keys).orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last())
    peers = F.count(c).over(Window.partitionBy(*keys, value))
    return F.when(c.isNotNull(), (F.rank().over(order) + (peers - 1) / 2.0).cast("double"))


def position(df: DataFrame, order: Sequence[Column], out: str = "position", keys: Sequence[str] = ()) -> DataFrame:
    """1-based place in sorted order; ``order`` must tell rows apart."""
    counted = df.withColumn("__one", F.lit(1).cast("long"))
    return prefix_sums(counted, keys, order, {out: "__one"}).withColumn(out, F.col(out) + 1).drop("__one")


def hash_position(df: DataFrame, digest: str, out: str = "position", keys: Sequence[str] = (),
                  ties: Sequence[str] = ()) -> DataFrame:
    """0-based place of a row inside its group, in the order of a hex digest.

    The first four hex digits cut every group into 65 536 even slices; a row's
    place is the size of the slices before it plus its place in its own slice.
    """
    keys = list(keys)
    sliced = df.withColumn("__slice", F.substring(digest, 1, 4))
    inside = Window.partitionBy(*keys, "__slice").orderBy(digest, *ties)
    placed = sliced.withColumn("__in", F.row_number().over(inside) - 1)
    sizes = sliced.groupBy(*keys, "__slice").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    out_df = null_safe_join(placed, sizes, [*keys, "__slice"], "inner")
    return out_df.withColumn(out, F.col("__off") + F.col("__in")).drop("__off", "__in", "__slice")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float],
                    accuracy: int = 10_000, stored: bool = False) -> DataFrame:
    """Exact interpolated quantiles per group, without sorting the rows.

    A mergeable sketch first brackets every quantile between two values that
    are ``8 / accuracy`` of the rows apart.  One more pass counts the rows
    below each bracket and the values inside it; only those few values are put
    in order.  Groups smaller than ``accuracy`` are bracketed as a whole.

    The two columns are written once because they are read twice; pass
    ``stored=True`` when ``df`` is a stored table already.
    """
    keys, names = list(keys), list(probs)
    rows = df.select(*keys, F.col(value).cast("double").alias("__v"))
    rows = rows if stored else materialize(rows, "values")
    reach, far = 4.0 / accuracy, float("inf")
    marks = [min(1.0, max(0.0, probs[n] + side * reach)) for n in names for side in (-1, 1)]
    sketch = rows.groupBy(*keys).agg(
        F.count("__v").alias("__total"), F.percentile_approx("__v", marks, accuracy).alias("__q"))

    def border(at: int, side: int):
        p = probs[names[at]] + side * reach
        wide = (F.col("__total") <= accuracy) if 0 < p < 1 else F.lit(True)
        return F.when(wide, F.lit(side * far)).otherwise(F.col("__q")[2 * at + (side > 0)])

    brackets = sketch.filter("__total > 0").select(*keys, "__total", F.array(*[
        F.struct(border(i, -1).alias("lo"), border(i, 1).alias("hi")) for i in range(len(names))]).alias("__b"))
    tested = null_safe_join(rows, brackets, keys, "inner").select(
        *keys, "__total", "__v", F.posexplode("__b").alias("__i", "__r")).filter("__v <= __r.hi")
    inside = F.col("__v") >= F.col("__r.lo")
    cells = tested.groupBy(*keys, "__total", "__i", inside.alias("__in"), F.when(inside, F.col("__v")).alias("__v")).agg(
        F.count("*").alias("__n"))
    placed = prefix_sums(cells, [*keys, "__i"], [F.col("__in"), F.col("__v")], {"__before": "__n"})
    picked, result = [F.first("__total").alias("n")], []
    for i, name in enumerate(names):
        at = (F.col("__total") - 1) * F.lit(float(probs[name]))
        for side, index in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (F.col("__i") == i) & (F.col("__before") <= index) & (index < F.col("__before") + F.col("__n"))
            picked.append(F.max(F.when(here, F.col("__v"))).alias(f"__{name}_{side}"))
        part = (F.col("n") - 1) * F.lit(float(probs[name]))
        lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        outside = F.raise_error(F.lit("quantile outside its bracket")).cast("double")
        result.append(F.coalesce(lo + (hi - lo) * (part - F.floor(part)), outside).alias(name))
    return placed.groupBy(*keys).agg(*picked).select(*keys, "n", *result)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows; Spark keeps only ``k`` rows per partition on the way."""
    return df.orderBy(*order).limit(k)
