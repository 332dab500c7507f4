"""Order statistics over all rows, without a window that holds a whole group.

``running`` range-partitions the rows by (group, order) in one shuffle, sums within partitions, and adds the totals of the partitions
before: a table of one row per partition and group. A group with a third of all rows is spread like any other, and so are the rows of one value:
ranks of ties come from the partitions' own counts, only values at the partitions' borders are put together. Quantiles, weighted quantiles, top
fractions and distribution distances all build on it. Order keys must end in a unique column, so that results don't depend on the partitioning.

Tables of one row per group or partition are joined without a hint: the optimizer broadcasts them as long as they are small.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.sources.shared import cut


def running(df: DataFrame, group: list[str], order: list[Column], value: Column | None = None, name: str = "cum") -> DataFrame:
    """Adds ``name``: the sum of ``value`` (default 1) over the rows of the group up to and with this one, in ``order``."""
    value = F.lit(1).cast("long") if value is None else value
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(g) for g in group]
    placed = cut(df.withColumn("_v", value).repartitionByRange(parts, *keys, *order).withColumn("_p", F.spark_partition_id()))
    local = Window.partitionBy("_p", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    totals = placed.groupBy(*[F.col(g).alias(f"_k{i}") for i, g in enumerate(group)], F.col("_p").alias("_q")).agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*[f"_k{i}" for i in range(len(group))]).orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_o", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    on = F.col("_p") == F.col("_q")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_k{i}"))
    joined = placed.withColumn("_c", F.sum("_v").over(local)).join(offsets, on)
    return joined.withColumn(name, F.col("_c") + F.col("_o")).drop("_v", "_p", "_c", "_o", "_q", *[f"_k{i}" for i in range(len(group))])


def _attach(df: DataFrame, totals: DataFrame, group: list[str]) -> DataFrame:
    """``df`` with its group's row of ``totals``; without groups that is one row, whose values become literals."""
    if group:
        return df.join(totals, group)
    row = totals.first()
    return df.select("*", *[F.lit(row[c] if row else None).cast(t).alias(c) for c, t in totals.dtypes])


def average_rank(df: DataFrame, group: list[str], value: str, unique: str, name: str = "rank") -> DataFrame:
    """Rank from 1 by ascending ``value``, ties sharing their mean; NULL values take no part and are dropped."""
    p = positions(df, group, value, unique)
    return p.withColumn(name, tied_rank()).drop(*POSITIONS)


#: Columns that ``positions`` adds.
POSITIONS = ("_row", "_start", "_all", "_size")


def tied_rank() -> Column:
    """Mean rank of the row's ties, from the columns of ``positions``."""
    return F.col("_start") + (F.col("_all") - 1) / F.lit(2.0)


def in_top(fraction: float) -> Column:
    """Whether the row is among the ceil(n * fraction), at least one, largest; of ties the first by the unique column. From the columns of ``positions``."""
    larger = F.col("_size") - F.col("_start") - F.col("_all") + 1
    return larger + F.col("_row") - F.col("_start") + 1 <= F.greatest(F.lit(1), F.ceil(F.round(F.col("_size") * fraction, 9)))


def positions(df: DataFrame, group: list[str], value: str, unique: str) -> DataFrame:
    """Adds _row, the number from 1 by (value, unique) in the group, _start and _all, the first number and the size of the row's ties, and _size of the group.

    NULL values are dropped. Rows of one value may fill any number of partitions: each counts its own, and what is joined is one row per partition for
    values at its borders.
    """
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(g) for g in group]
    placed = cut(df.where(F.col(value).isNotNull()).repartitionByRange(parts, *keys, F.col(value), F.col(unique)).withColumn("_p", F.spark_partition_id()))
    inside = Window.partitionBy("_p", *group)
    same = Window.partitionBy("_p", *group, value)
    ranked = placed.withColumn("_i", F.row_number().over(inside.orderBy(value, unique))).withColumn("_first", F.min("_i").over(same)).withColumn("_ties", F.count("*").over(same)).withColumn("_rows", F.count("*").over(inside))
    local = cut(ranked.withColumn("_edge", (F.col("_first") == 1) | (F.col("_first") + F.col("_ties") > F.col("_rows"))))
    k = [f"_k{i}" for i in range(len(group))]
    named = [F.col(g).alias(x) for g, x in zip(group, k)]
    totals = local.groupBy(*named, F.col("_p").alias("_q")).agg(F.max("_rows").alias("_t"))
    whole = Window.partitionBy(*k)  # one row per partition
    offsets = cut(totals.select(*k, "_q", F.coalesce(F.sum("_t").over(whole.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"), F.sum("_t").over(whole).alias("_size")))
    here = F.col("_p") == F.col("_q")
    for g, x in zip(group, k):
        here = here & F.col(g).eqNullSafe(F.col(x))
    with_offset = local.join(offsets, here).drop("_q", *k)
    # a border value may go on in other partitions
    ends = local.where("_edge").groupBy(*named, F.col(value).alias("_v"), F.col("_p").alias("_q")).agg(F.max("_first").alias("_f"), F.max("_ties").alias("_n"))
    on = [x.eqNullSafe(y) for x, y in zip([ends[c] for c in (*k, "_q")], [offsets[c] for c in (*k, "_q")])]
    joint = cut(ends.join(offsets, reduce(and_, on)).groupBy(*[ends[c] for c in k], "_v").agg(F.min(F.col("_o") + F.col("_f")).alias("_s"), F.sum("_n").alias("_m")))
    tied = F.col("_edge") & (F.col(value) == F.col("_v"))
    for g, x in zip(group, k):
        tied = tied & F.col(g).eqNullSafe(F.col(x))
    out = with_offset.join(F.broadcast(joint) if not group else joint, tied, "left")  # without groups, at most two values per partition
    out = out.withColumn("_row", F.col("_o") + F.col("_i")).withColumn("_start", F.coalesce("_s", F.col("_o") + F.col("_first"))).withColumn("_all", F.coalesce("_m", "_ties"))
    return out.drop("_p", "_i", "_first", "_ties", "_rows", "_edge", "_o", "_v", "_s", "_m", *k)


def quantiles(df: DataFrame, group: list[str], value: str, probs: list[float], unique: str) -> DataFrame:
    """group, n, q: array of linearly interpolated quantiles at (n - 1) * p; NULLs don't count."""
    r = cut(running(df.where(F.col(value).isNotNull()).select(*group, value, unique), group, [F.col(value), F.col(unique)], name="_r"))
    sizes = r.groupBy(*group).agg(F.count("*").alias("n"))
    grid = sizes.select(*group, "n", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("_i", "_pr"))
    at = (F.col("n") - 1) * F.col("_pr")
    want = grid.select(*group, "n", "_i", (at - F.floor(at)).alias("_f"), F.explode(F.array(F.floor(at), F.ceil(at))).alias("_at"))
    want = want.withColumn("_r", F.col("_at") + 1).groupBy(*group, "n", "_i", "_f", "_r").agg(F.max("_at").alias("_at"))
    hits = r.join(want, [*group, "_r"])
    one = hits.groupBy(*group, "n", "_i", "_f").agg(F.min(value).alias("a"), F.max(value).alias("b"))
    return one.groupBy(*group, "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", (F.col("a") + (F.col("b") - F.col("a")) * F.col("_f")).alias("v")))), lambda x: x["v"]).alias("q"))


def weighted_quantiles(df: DataFrame, group: list[str], value: str, weight: str, unique: str, probs: list[float]) -> DataFrame:
    """group, p, value: quantiles at mid-point positions (running weight - w/2) / total, interpolated, clamped at the ends.

    NULL values and weights that aren't positive are left out; a group without any row gives no row. Ties keep the order of ``unique``.
    """
    rows = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).select(*group, F.col(value).alias("x"), F.col(weight).alias("w"), unique)
    r = running(rows, group, [F.col("x"), F.col(unique)], F.col("w"), "c")
    total = rows.groupBy(*group).agg(F.sum("w").alias("t"))
    j = _attach(r, total, group)
    pos = (F.col("c") - F.col("w") / 2) / F.col("t")
    # slot k holds the rows between the probabilities k - 1 and k, so at most len(probs) + 1 rows per group go on
    point = F.struct("pos", "x")
    slots = j.select(*group, "x", pos.alias("pos")).withColumn("k", _slot(F.col("pos"), probs))
    slots = slots.groupBy(*group, "k").agg(F.max(point).alias("last"), F.min(point).alias("first"))
    # the probabilities take their places among the slots, so that windows over this small table find their brackets
    none = F.lit(None).cast("struct<pos:double,x:double>")
    grid = total.select(*group, F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("k", "p")).select(*group, "k", none.alias("last"), none.alias("first"), "p")
    both = slots.withColumn("p", F.lit(None).cast("double")).unionByName(grid)
    w = Window.partitionBy(*group).orderBy("k")
    b = both.withColumn("lo", F.max("last").over(w.rangeBetween(Window.unboundedPreceding, 0))).withColumn("hi", F.min("first").over(w.rangeBetween(1, Window.unboundedFollowing))).where("p IS NOT NULL")
    lo, hi = F.col("lo"), F.col("hi")
    v = F.when(lo.isNull(), hi["x"]).when(hi.isNull(), lo["x"]).otherwise(lo["x"] + (hi["x"] - lo["x"]) * (F.col("p") - lo["pos"]) / (hi["pos"] - lo["pos"]))
    return b.select(*group, "p", v.alias("value"))


def _slot(pos: Column, probs: list[float]) -> Column:
    """How many of the ascending ``probs`` lie below ``pos``; by arithmetic where they are many and even."""
    n = len(probs) - 1
    if n > 32 and all(abs(p - i / n) < 1e-12 for i, p in enumerate(probs)):
        return F.least(F.lit(n + 1), F.ceil(pos * n)).cast("int")
    return F.size(F.filter(F.array(*[F.lit(float(p)) for p in probs]), lambda p: p < pos))


def spearman(df: DataFrame, group: list[str], a: str, b: str, unique: str) -> DataFrame:
    """group, n, rho over rows with both values; NULL where one of them is constant."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*group, a, b, unique)
    ra = average_rank(both, group, a, unique, "_ra")
    r = average_rank(ra, group, b, unique, "_rb")
    return r.groupBy(*group).agg(F.count("*").alias("n"), pearson(F.col("_ra"), F.col("_rb")).alias("rho"))


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; NULL where one is constant."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > 1e-12) & (sy > 1e-12), F.covar_pop(x, y) / (sx * sy))


def top_fraction(df: DataFrame, group: list[str], value: str, unique: str, fraction: float, name: str = "top") -> DataFrame:
    """Adds ``name``: whether the row is among the ceil(n * fraction), at least one, largest values of its group; ties by ``unique``."""
    r = cut(running(df, group, [F.col(value).desc_nulls_last(), F.col(unique)], name="_r"))
    sizes = r.groupBy(*group).agg(F.count("*").alias("_n"))
    joined = _attach(r, sizes, group)
    keep = F.greatest(F.lit(1), F.ceil(F.round(F.col("_n") * fraction, 9)))
    return joined.withColumn(name, F.col("_r") <= keep).drop("_r", "_n")


def ks_distance(df: DataFrame, group: list[str], value: str, in_a: Column, unique: str) -> DataFrame:
    """group, n_a, n_b, ks: largest distance of the two empirical distributions; ``in_a`` tells the sample of a row."""
    side = df.where(F.col(value).isNotNull()).select(*group, F.col(value).alias("x"), in_a.cast("long").alias("a"), F.lit(1).cast("long").alias("one"))
    by_value = side.groupBy(*group, "x").agg(F.sum("a").alias("na"), F.sum(F.col("one") - F.col("a")).alias("nb"))
    r = running(running(by_value, group, [F.col("x")], F.col("na"), "ca"), group, [F.col("x")], F.col("nb"), "cb")
    r = cut(r)
    n = r.groupBy(*group).agg(F.max("ca").alias("n_a"), F.max("cb").alias("n_b"))
    j = _attach(r, n, group)
    gap = F.abs(F.try_divide(F.col("ca"), F.col("n_a")) - F.try_divide(F.col("cb"), F.col("n_b")))
    return j.groupBy(*group, "n_a", "n_b").agg(F.max(gap).alias("ks"))


def bh_adjust(df: DataFrame, group: list[str], p: str, unique: str, name: str = "q") -> DataFrame:
    """Adds Benjamini-Hochberg step-up values: min over larger p of p * m / rank, at most 1. One table of tests per group, bounded by design."""
    up = Window.partitionBy(*group).orderBy(F.col(p), F.col(unique))
    m = F.count("*").over(Window.partitionBy(*group))
    ranked = df.withColumn("_q", F.col(p) * m / F.row_number().over(up))
    back = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return ranked.withColumn(name, F.least(F.lit(1.0), F.min("_q").over(back))).drop("_q")
