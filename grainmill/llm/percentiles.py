"""Problem 2: percentiles per group over very large columns, by exact bisection.

State: an interval of values per group and percentile, holding the target rank. Each pass counts the rows below the midpoints
of every interval (``WAYS`` - 1 of them at once, so one pass narrows as much as several plain ones), keeps the part that
holds the rank, and shrinks it to the least and greatest value seen in it. It ends when every interval is a single value:
the result is exact, error bound 0; with fewer passes the interval's width is the stated bound.

What adds up: all that a pass takes from the rows are counts, sums over any split of the rows. So files, days or partitions combine
by adding their counts, and the percentiles of (group, value, rows) tables that were merged are those of all rows together.

Scale: no rows are shuffled. They meet the intervals by a broadcast join, are counted in the scan's own stage, and at most
WAYS counts per interval and task go on. What is broadcast is bounded: where there are more than ``MAX_SPANS`` intervals, only those of
groups with at least a ``HEAVY``-th of all rows are, at most HEAVY groups by definition; the rows of the other groups, each of them
small, are joined by shuffle. Once few rows are left inside open intervals, they alone are written and read on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm.common import PATH_DOMAIN, clean_domain, cut, finite, path_domain, read

PERMILLES = (50, 250, 500, 750, 950, 990)
WAYS = 32
MAX_PASSES = 400
MAX_SPANS = 100_000  #: intervals that are broadcast, some 10 MB
HEAVY = 1000
SHRINK = 4  #: rows are written anew when no more than one in so many is still inside an interval


def value_counts(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """The mergeable partial result: ``groups``, v, n. NULL, NaN and infinite values don't count; NULL groups are a group."""
    return df.select(*groups, finite(F.col(value)).alias("v")).where("v IS NOT NULL").groupBy(*groups, "v").agg(F.count("*").alias("n"))


def merge_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """The partial result of both inputs together."""
    keys = [c for c in a.columns if c != "n"]
    return a.unionByName(b).groupBy(*keys).agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, groups: list[str], permilles: tuple[int, ...] = PERMILLES, max_passes: int = MAX_PASSES) -> DataFrame:
    """groups, permille, n, value, error_bound from value counts.

    The p-permille is the least value v with (rows <= v) * 1000 >= p * n (p = 0: the least value). An empty input gives no rows. If
    ``max_passes`` ends the search early, ``value`` is the lower end of the interval and the true one at most error_bound above it.
    """
    if not permilles or any(not 0 <= p <= 1000 for p in permilles):
        raise ValueError("permilles must be between 0 and 1000")
    if clash := {"v", "n", "permille", "value", "error_bound"} & {c.lower() for c in groups}:
        raise ValueError(f"groups clash with columns of the result: {sorted(clash)}")
    keys = [f"_k{i}" for i in range(len(groups))]
    rows, on = counts.select(*[F.col(g).alias(k) for g, k in zip(groups, keys)], "v", "n"), keys
    names = cut(rows.groupBy(*keys).agg(F.sum("n").alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("total > 0").withColumn("_g", F.monotonically_increasing_id()))
    state = names.select("_g", "lo", "hi", F.explode(F.array(*map(F.lit, permilles))).alias("p"), F.col("total").alias("inside"), "total")
    state = cut(state.withColumn("rank", F.expr("greatest(1L, (p * total + 999) div 1000)")).drop("total"))
    everything = held = names.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    for _ in range(max_passes):
        spans = state.where("lo < hi").groupBy("_g", "lo", "hi").agg(F.first("inside").alias("inside"))
        left = spans.agg(F.count("*").alias("n"), F.coalesce(F.sum("inside"), F.lit(0)).alias("rows")).first()
        if not left.n:
            break
        spans = spans.drop("inside").join(names.select("_g", "total", *keys), "_g")
        if left.rows * SHRINK <= held:
            rows, on, held = cut(_inside(rows, on, spans, left.n, everything).select("_g", "v", "n")), ["_g"], left.rows
        tally = _inside(rows, on, spans, left.n, everything).groupBy("_g", "lo", "hi", _part(F.col("v"), F.col("lo"), F.col("hi")).alias("part")).agg(F.sum("n").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
        # the parts of one interval are at most WAYS rows
        parts = tally.groupBy("_g", "lo", "hi").agg(F.sort_array(F.collect_list(F.struct("part", "c", "a", "b"))).alias("parts"))
        state = cut(state.join(parts, ["_g", "lo", "hi"], "left").select("_g", "p", F.when(F.col("parts").isNull(), F.struct("lo", "hi", "inside", "rank")).otherwise(_pick()).alias("s")).select("_g", "p", "s.*"))
    out = state.join(names.select("_g", "total", *keys), "_g")
    return out.select(*[F.col(k).alias(g) for k, g in zip(keys, groups)], F.col("p").alias("permille"), F.col("total").alias("n"), F.col("lo").alias("value"), (F.col("hi") - F.col("lo")).alias("error_bound"))


def _inside(rows: DataFrame, on: list[str], spans: DataFrame, count: int, everything: int) -> DataFrame:
    """Rows within the open intervals of their group: _g, lo, hi, v, n. Intervals of one group don't overlap, so a row is there at most once."""
    right = spans.select("_g", "lo", "hi", "total", *[F.col(k).alias(f"{k}_") for k in on])

    def join(left: DataFrame, part: DataFrame) -> DataFrame:
        match = (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))
        for k in on:
            match = match & F.col(k).eqNullSafe(F.col(f"{k}_"))
        left = left.drop("_g") if on != ["_g"] else left.withColumnRenamed("_g", "_r")
        match = match if on != ["_g"] else (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")) & (F.col("_r") == F.col("_g"))
        return left.join(part, match).select("_g", "lo", "hi", "v", "n")

    if count <= MAX_SPANS:
        return join(rows, F.broadcast(right))
    is_heavy = F.col("total") * HEAVY >= everything  # at most HEAVY groups
    heavy = F.broadcast(right.where(is_heavy))
    known = heavy.select(*[f"{k}_" for k in on]).distinct()
    match = F.lit(True)
    for k in on:
        match = match & F.col(k).eqNullSafe(F.col(f"{k}_"))
    light = rows.join(F.broadcast(known), match, "left_anti")
    return join(rows, heavy).unionByName(join(light, right.where(~is_heavy)))


def _pick() -> Column:
    """lo, hi, inside and rank of the part that holds the rank, from the counted parts in order."""
    none = lambda t: F.lit(None).cast(t)
    start = F.struct(F.lit(0).cast("long").alias("below"), none("double").alias("lo"), none("double").alias("hi"), none("long").alias("inside"), none("long").alias("rank"))

    def step(s: Column, x: Column) -> Column:
        here = s["rank"].isNull() & (s["below"] + x["c"] >= F.col("rank"))
        found = F.struct(s["below"].alias("below"), x["a"].alias("lo"), x["b"].alias("hi"), x["c"].alias("inside"), (F.col("rank") - s["below"]).alias("rank"))
        return F.when(here, found).otherwise(F.struct((s["below"] + x["c"]).alias("below"), s["lo"].alias("lo"), s["hi"].alias("hi"), s["inside"].alias("inside"), s["rank"].alias("rank")))

    return F.aggregate("parts", start, step, lambda s: F.struct(s["lo"].alias("lo"), s["hi"].alias("hi"), s["inside"].alias("inside"), s["rank"].alias("rank")))


def _part(v: Column, lo: Column, hi: Column) -> Column:
    """Number of the part of [lo, hi] that holds v: even in log scale over wide positive intervals, else even in value.

    The ends always fall in the first and the last part, so every pass splits an interval of two or more values.
    """
    scale = lambda x: F.log1p(x - lo)
    wide = (hi - lo) > 1000
    at = F.when(wide, scale(v) / scale(hi)).otherwise((v - lo) / (hi - lo))
    return F.when(v >= hi, F.lit(WAYS - 1)).otherwise(F.least(F.floor(at * (WAYS - 1)), F.lit(WAYS - 2))).cast("int")


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid word counts (finite, not negative) with q1's domain, file and day of crawling, every delivery counting: domain, file, day, v, n.

    A NULL domain is taken from the path; rows with neither stay, under the NULL domain.
    """
    q1 = read(spark, sf_dir, "q1", "_source_domain", "_source_path", "crawled_at", "rps_doc_word_count")
    domain = F.coalesce(clean_domain(F.col("_source_domain")), path_domain(F.col("_source_path")))
    rows = q1.select(domain.alias("domain"), F.col("_source_path").alias("file"), F.to_date("crawled_at").alias("day"), finite(F.col("rps_doc_word_count")).alias("v"))
    return rows.where("v >= 0").withColumn("n", F.lit(1).cast("long"))


def levels(rows: DataFrame) -> DataFrame:
    """Each row in its file, in its day and in its domain as a whole; a level's own columns tell what it is of. No shuffle."""
    no_file, no_day = F.lit(None).cast("string").alias("file"), F.lit(None).cast("date").alias("day")
    of = [F.struct(F.lit(name).alias("level"), "domain", f, d) for name, f, d in (("file", F.col("file"), no_day), ("day", no_file, F.col("day")), ("all", no_file, no_day))]
    return rows.select(F.explode(F.array(*of)).alias("g"), "v", "n").select("g.*", "v", "n")


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per domain, domain and day, domain and file."""
    out = percentiles(levels(cut(word_counts(spark, sf_dir))), ["level", "domain", "file", "day"])
    return out.select("level", "domain", "file", F.date_format("day", "yyyy-MM-dd").alias("day"), "permille", "n", "value", "error_bound")


ORACLE = {
    "p2_percentiles": f"""
WITH v AS (SELECT coalesce(nullif(lower(trim(_source_domain)), ''), nullif(lower(regexp_extract(_source_path, '{PATH_DOMAIN}', 1)), '')) AS domain,
                  _source_path AS file, CAST(crawled_at AS DATE) AS day, rps_doc_word_count AS w
           FROM q1 WHERE rps_doc_word_count >= 0 AND NOT isnan(rps_doc_word_count) AND NOT isinf(rps_doc_word_count)),
l AS (SELECT 'file' AS level, domain, file, NULL AS day, w FROM v UNION ALL SELECT 'day', domain, NULL, day, w FROM v UNION ALL SELECT 'all', domain, NULL, NULL, w FROM v),
r AS (SELECT level, domain, file, day, w, row_number() OVER (PARTITION BY level, domain, file, day ORDER BY w) AS k,
             count(*) OVER (PARTITION BY level, domain, file, day) AS n FROM l)
SELECT r.level, r.domain, r.file, strftime(r.day, '%Y-%m-%d') AS day, p.permille, r.n, r.w AS value, 0::DOUBLE AS error_bound
FROM r JOIN (SELECT unnest({list(PERMILLES)})::INTEGER AS permille) p ON r.k = greatest(1, (p.permille * r.n + 999) // 1000)"""
}
QUERIES = {"p2_percentiles": p2_percentiles}
