"""Problem 3: one ranking from several differently scaled scores, by median rank aggregation.

Only ranks enter, so no score counts for more because its numbers are larger or its tails longer. Every item gets its average
rank in each score, as a share of the items that have that score, (rank - 1/2) / n; items are ordered by the weighted median of
their shares, then by the mean share, then by identifier.

Ranks over all rows without a window in one task: all (score, value, item) rows are range-partitioned in one shuffle, sorted
within the partitions, and numbered there batch by batch, of which a task holds no more than the rows of one value; the partitions' row counts
and the values at their borders (two per partition and score, so bounded by the number of partitions) are all that is put together to turn
local numbers into ranks, also for values that tie across partitions. The item breaks ties in the sort key, so a value that a third of all
items share is split over partitions like any other; the partitions grow in number with the rows (``PART_ROWS``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainmill.llm.common import cut, finite, read

PART_ROWS = 1_000_000  #: rows of a range partition at most, about
WEIGHTS = {"qurater_writing_style": 1.0, "dsir_books": 1.0, "q_primary": 1.0}


def _parts(spark: SparkSession, rows: int) -> int:
    """Range partitions for so many rows: those of the session, more where they would get too large."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))


def rank_shares(long: DataFrame, rows: int = 0) -> DataFrame:
    """(item, score, share) from rows (item, score int, value double), 0 for the largest value to 1; ties share their mean rank.

    NULL and NaN values take no part. Repeated (item, score) rows each count. ``rows``: how many there are about, which sets the partitions.
    """
    valid = long.where("value IS NOT NULL AND NOT isnan(value)").select("score", (-F.col("value")).alias("v"), "item")
    placed = valid.repartitionByRange(_parts(long.sparkSession, rows), "score", "v", "item").sortWithinPartitions("score", "v", "item")
    local = cut(placed.mapInArrow(_number, "part int, score int, v double, item string, first long, ties long, edge boolean"))
    sizes = local.groupBy("part", "score").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("score").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    before = sizes.select("score", "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"))
    totals = sizes.groupBy("score").agg(F.sum("rows").alias("n"))
    # a value at a partition's border may go on in others: at most two such values per partition and score
    edges = local.where("edge").select("score", "part", "v", "first", "ties").distinct().join(before, ["score", "part"])
    edges = edges.groupBy("score", "v").agg(F.min(F.col("offset") + F.col("first")).alias("edge_first"), F.sum("ties").alias("edge_ties"))
    out = local.join(F.broadcast(before), ["score", "part"]).join(F.broadcast(totals), "score").join(F.broadcast(edges), ["score", "v"], "left")
    rank = F.coalesce(F.col("edge_first"), F.col("offset") + F.col("first")) + (F.coalesce("edge_ties", "ties") - 1) / 2  # from 0
    return out.select("item", "score", ((rank + 0.5) / F.col("n")).alias("share"))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the sorted rows of one range partition per score: ``first`` row of the tie group from 0, its size, and whether it is at a border.

    All groups of a batch but the last are complete, so they go out at once; only the rows of the last one wait for the next batch.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()

    def emit(b: pa.RecordBatch, first, ties, edge) -> pa.RecordBatch:
        n = b.num_rows
        v = b.column(1).to_numpy() + 0.0  # -0.0 ties with 0.0
        full = lambda x, t: pa.array(np.broadcast_to(np.asarray(x, t), n))
        return pa.RecordBatch.from_arrays([full(part, np.int32), b.column(0), pa.array(v), b.column(2), full(first, np.int64), full(ties, np.int64), full(edge, bool)], ["part", "score", "v", "item", "first", "ties", "edge"])

    held: list[pa.RecordBatch] = []  # the rows of the value that may go on
    key, start, lowest = None, 0, True  # its (score, v), its first row, and whether it is the first value of its score

    def release(border: bool) -> Iterator[pa.RecordBatch]:
        ties = sum(h.num_rows for h in held)
        for h in held:
            yield emit(h, start, ties, lowest or border)

    for b in batches:
        if not b.num_rows:
            continue
        score, v = b.column(0).to_numpy(), b.column(1).to_numpy()
        starts = np.flatnonzero(np.r_[True, (score[1:] != score[:-1]) | (v[1:] != v[:-1])])
        if key == (score[0], v[0]):
            if len(starts) == 1:
                held.append(b)
                continue
            held.append(b.slice(0, starts[1]))
            b, score, v, starts = b.slice(starts[1]), score[starts[1] :], v[starts[1] :], starts[1:] - starts[1]
        if held:
            yield from release(key[0] != score[0])
            start = start + sum(h.num_rows for h in held) if key[0] == score[0] else 0
            lowest = key[0] != score[0]
        # row numbers within the score: those of the first score go on from before, others start at 0
        of = np.flatnonzero(np.r_[True, score[starts[1:]] != score[starts[:-1]]])  # the first group of each score
        base = np.repeat(np.where(of == 0, -start, starts[of]), np.diff(np.r_[of, len(starts)]))
        firsts, low = starts - base, np.zeros(len(starts), bool)
        low[of] = True
        low[0] = lowest
        last = len(starts) - 1
        if last:
            sizes = np.diff(starts)
            edge = low[:last] | (score[starts[:last]] != score[starts[1:]])
            yield emit(b.slice(0, starts[last]), np.repeat(firsts[:last], sizes), np.repeat(sizes, sizes), np.repeat(edge, sizes))
        held, key, start, lowest = [b.slice(starts[last])], (score[starts[last]], v[starts[last]]), int(firsts[last]), bool(low[last])
    if held:
        yield from release(True)


def aggregate_ranks(shares: DataFrame, weights: list[float]) -> DataFrame:
    """(item, n_scores, median_share, mean_share): the weighted median of an item's shares and their weighted mean.

    The weighted median is where the shares, in order, reach half of the weight present; exactly at half it is the midpoint to
    the next one. ``weights`` by number of the score, positive.
    """
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("score") + 1)
    per = shares.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("share", weight.alias("w")))).alias("s"))  # one entry per score
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x["w"])
    step = lambda a, x: F.struct(
        (a["done"] + x["w"]).alias("done"),
        F.when(a["lo"].isNull() & (a["done"] + x["w"] >= F.col("half") - 1e-12), x["share"]).otherwise(a["lo"]).alias("lo"),
        F.when(a["hi"].isNull() & (a["done"] + x["w"] > F.col("half") + 1e-12), x["share"]).otherwise(a["hi"]).alias("hi"),
    )
    none = F.lit(None).cast("double")
    start = F.struct(F.lit(0.0).alias("done"), none.alias("lo"), none.alias("hi"))
    mean = F.aggregate("s", F.lit(0.0), lambda a, x: a + x["w"] * x["share"])
    m = per.withColumn("half", total / 2).select("item", F.size("s").cast("bigint").alias("n_scores"), F.aggregate("s", start, step).alias("m"), (mean / total).alias("mean"))
    # rounded, so that the order doesn't hang on the order of summation
    return m.select("item", "n_scores", F.round((F.col("m.lo") + F.col("m.hi")) / 2, 12).alias("median_share"), F.round("mean", 12).alias("mean_share"))


def place(df: DataFrame, *order: str, rows: int = 0) -> DataFrame:
    """Adds ``place`` 1..n by ascending ``order`` (NULLs last), which must end in a unique key: range partitions, no global window."""
    spark = df.sparkSession
    keys = [F.col(c).asc_nulls_last() for c in order]
    ordered = df.repartitionByRange(_parts(spark, rows), *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    ordered = cut(ordered)
    sizes = ordered.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    before = sizes.select("part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"))
    local = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = ordered.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(before), "part")
    return numbered.withColumn("place", F.col("offset") + local + 1).drop("part", "at", "offset")


def rank_items(wide: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """(key, place, n_scores, median_share, mean_share) for one row per key with the columns of ``weights``.

    Every key that isn't NULL gets one place. Missing scores (NULL, NaN, infinite) don't count for or against an item: its median is over the
    scores that it has. Items without any score come last, in order of the key.
    """
    names = list(weights)
    pairs = F.array(*[F.struct(F.lit(i).alias("score"), finite(F.col(c)).alias("value")) for i, c in enumerate(names)])
    items = wide.where(F.col(key).isNotNull())
    # the items without a score keep a row with a NULL value, so one pass over the ranks yields every item
    n = items.count()
    long = items.select(F.col(key).alias("item"), F.explode(pairs).alias("x")).select("item", "x.score", "x.value")
    ranked = aggregate_ranks(rank_shares(long, n * len(names)), [weights[c] for c in names])
    empty = items.where(F.coalesce(*[finite(F.col(c)) for c in names]).isNull()).select(F.col(key).alias("item"), F.lit(0).cast("bigint").alias("n_scores"), F.lit(None).cast("double").alias("median_share"), F.lit(None).cast("double").alias("mean_share"))
    out = place(ranked.unionByName(empty), "median_share", "mean_share", "item", rows=n)
    return out.select(F.col("item").alias(key), "place", "n_scores", "median_share", "mean_share")


def scores_by_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per uid of either table. Repeated rows of ab_experiment are one; where they differ, the greatest value stands. q_primary is
    that of the latest scoring, and missing outside [0, 1]."""
    ab = read(spark, sf_dir, "ab_experiment", "uid", "qurater_writing_style", "dsir_books")
    sc = read(spark, sf_dir, "sample_scores", "uid", "q_primary", "scored_at")
    none = F.lit(None)
    q = finite(F.col("q_primary"))
    both = ab.select("uid", finite(F.col("qurater_writing_style")).alias("a"), finite(F.col("dsir_books")).alias("b"), none.cast("timestamp_ntz").alias("t"), none.cast("double").alias("q"), F.lit(False).alias("scored"))
    both = both.unionByName(sc.select("uid", none.cast("double").alias("a"), none.cast("double").alias("b"), F.col("scored_at").cast("timestamp_ntz").alias("t"), F.when(q.between(0, 1), q).alias("q"), F.lit(True).alias("scored")))
    one = both.where("uid IS NOT NULL").groupBy("uid").agg(F.max("a").alias("qurater_writing_style"), F.max("b").alias("dsir_books"), F.max(F.struct("scored", "t", "q"))["q"].alias("q_primary"))
    return one


def p3_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rank_items(cut(scores_by_uid(spark, sf_dir)), "uid", WEIGHTS)
    return out.select("uid", "place", "n_scores", F.round("median_share", 9).alias("median_share"), F.round("mean_share", 9).alias("mean_share"))


ORACLE = {
    "p3_ranking": """
WITH ab AS (SELECT uid, max(CASE WHEN isfinite(qurater_writing_style) THEN qurater_writing_style END) AS a,
                   max(CASE WHEN isfinite(dsir_books) THEN dsir_books END) AS b FROM ab_experiment WHERE uid IS NOT NULL GROUP BY uid),
sc AS (SELECT uid, arg_max(coalesce(CASE WHEN isfinite(q_primary) AND q_primary BETWEEN 0 AND 1 THEN q_primary END, -1), coalesce(scored_at, TIMESTAMP '0001-01-01')) AS q
       FROM sample_scores WHERE uid IS NOT NULL GROUP BY uid),
w AS (SELECT coalesce(ab.uid, sc.uid) AS uid, a, b, CASE WHEN q >= 0 THEN q END AS q FROM ab FULL JOIN sc ON ab.uid = sc.uid),
l AS (SELECT uid, 0 AS score, a AS v FROM w WHERE a IS NOT NULL UNION ALL SELECT uid, 1, b FROM w WHERE b IS NOT NULL
      UNION ALL SELECT uid, 2, q FROM w WHERE q IS NOT NULL),
s AS (SELECT uid, (rank() OVER (PARTITION BY score ORDER BY v DESC) + (count(*) OVER (PARTITION BY score, v) - 1) / 2 - 0.5::DOUBLE)
             / count(*) OVER (PARTITION BY score) AS share FROM l),
m AS (SELECT uid, count(*) AS n_scores, round(quantile_cont(share, 0.5), 12) AS median_share, round(sum(share) / count(*), 12) AS mean_share FROM s GROUP BY uid)
SELECT w.uid, row_number() OVER (ORDER BY median_share NULLS LAST, mean_share NULLS LAST, w.uid) AS place, coalesce(n_scores, 0) AS n_scores,
       round(median_share, 9) AS median_share, round(mean_share, 9) AS mean_share
FROM w LEFT JOIN m ON m.uid = w.uid"""
}
QUERIES = {"p3_ranking": p3_ranking}
