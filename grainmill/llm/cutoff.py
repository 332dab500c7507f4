"""Problem 4: per group, the score cutoff that keeps a target fraction, as a cutting-plane order statistic.

The k-th largest of n scores minimises the convex pinball loss L(c) = sum(s * max(x - c, 0)) + sum((1 - s) * max(c - x, 0)).
A minimum of a convex piecewise linear loss needs no sort: each pass aggregates, for every group at once, the loss and its
one-sided subgradients at one point, which give a tangent on each side of the minimum; the next point is where the two
tangents meet. The rows outside a bracket count through running totals; as soon as no more than one row in ``SHRINK`` is undecided, the
undecided ones are written anew and the later passes read them alone, so all passes together read a small multiple of the rows. When the
subgradients straddle zero, or no score is left inside the bracket, the cutoff snaps to the exact neighbouring score.

Bounds: the state on the driver is one row per target (``MAX_TARGETS``); scores never leave the executors. Every pass is
one map-side combined aggregation, so a group with a third of all rows is never in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.llm.common import clean_domain, cut, finite, read

MAX_TARGETS = 100_000  #: rows of the target table that the driver holds
MAX_PASSES = 200
#: After so many tangent steps a pass takes the middle of the bracket instead: bounds the passes for heavy tails.
TANGENT_STEPS = 3
SHRINK = 4


def latest_scores(scores: DataFrame) -> DataFrame:
    """One row (uid, domain, q) per uid: its row of the latest ``scored_at``, NULL times first; domain cleaned, q valid or NULL.

    NULL uids form no record. Ties in time are taken to be identical rows; otherwise the larger (q, domain) stands.
    """
    row = F.max(F.struct(F.col("scored_at"), finite(F.col("q_primary")).alias("q"), clean_domain(F.col("domain")).alias("domain"))).alias("r")
    last = scores.where("uid IS NOT NULL").groupBy("uid").agg(row)
    return last.select("uid", F.col("r.domain").alias("domain"), F.when(F.col("r.q").between(0, 1), F.col("r.q")).alias("q"))


def cutoffs(records: DataFrame, targets: DataFrame, group: str = "domain", score: str = "q") -> DataFrame:
    """One row per group with a target: n, cutoff, kept.

    ``targets``: group, permille; NULL permilles give no row, a repeated group's largest target holds. The cutoff is the highest score c
    with (count of scores >= c) * 1000 >= permille * n. Groups without scores have n = 0 and a NULL cutoff. A target of 0
    is met by every cutoff, so it gives the highest score. Targets over 1000 cannot be met: NULL cutoff, nothing kept.
    """
    spark = records.sparkSession
    x = records.select(F.col(group).alias("g"), F.col(score).cast("double").alias("x")).where("g IS NOT NULL AND x IS NOT NULL AND NOT isnan(x)")
    every = x
    wanted = targets.select(F.col(group).alias("g"), F.col("permille").cast("long").alias("t")).where("g IS NOT NULL AND t IS NOT NULL")
    rows = wanted.groupBy("g").agg(F.max("t").alias("t")).limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    target = {r.g: r.t for r in rows}
    first = x.join(F.broadcast(_frame(spark, "g string", [(g,) for g in target])), "g").groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("x").alias("s"))
    state: dict[str, Bracket] = {}
    done: dict[str, tuple[int, float | None]] = {g: (0, None) for g in target}
    for r in first.collect():
        k = max(1, -(-target[r.g] * r.n // 1000))  # rank from above that the cutoff must reach
        if k > r.n:
            done[r.g] = (r.n, None)
        else:
            state[r.g] = Bracket(r.n, k, r.lo, r.hi, r.s)
            done[r.g] = (r.n, state[r.g].value)  # known at once where all scores are equal
    held = sum(b.n for b in state.values())
    for _ in range(MAX_PASSES):
        state = {g: b for g, b in state.items() if not b.resolved}
        if not state:
            break
        probes = [(g, b.lo, b.hi, b.probe()) for g, b in state.items()]
        near = x.join(F.broadcast(_frame(spark, "g string, lo double, hi double, c double", probes)), "g").where("x >= lo AND x <= hi")
        left = sum(b.n - b.higher - b.lower for b in state.values())
        if left * SHRINK <= held:
            near, held = cut(near.select("g", "x", "lo", "hi", "c")), left
            x = near.select("g", "x")
        above, at, below = F.col("x") > F.col("c"), F.col("x") == F.col("c"), F.col("x") < F.col("c")
        seen = near.groupBy("g").agg(
            F.count_if(above).alias("above"), F.count_if(at).alias("at"), F.count_if(below).alias("below"),
            F.sum(F.when(above, F.col("x"))).alias("sum_above"), F.sum(F.when(below, F.col("x"))).alias("sum_below"),
            F.min(F.when(above, F.col("x"))).alias("next"), F.max(F.when(below, F.col("x"))).alias("previous"),
        )
        for r in seen.collect():
            state[r.g].take(r)
            if state[r.g].resolved:
                done[r.g] = (state[r.g].n, state[r.g].value)
    else:
        raise RuntimeError("cutoffs did not converge")
    found = _frame(spark, "g string, t long, n long, cutoff double", [(g, target[g], n, c) for g, (n, c) in done.items()])
    kept = every.join(F.broadcast(found.select("g", "cutoff")), "g").where("x >= cutoff").groupBy("g").agg(F.count("*").alias("kept"))
    out = found.join(kept, "g", "left").select("g", F.col("t").alias("permille"), "n", "cutoff", F.coalesce("kept", F.lit(0)).alias("kept"))
    return out.withColumnRenamed("g", group)


class Bracket:
    """Minimum of one group's pinball loss: scores in [lo, hi] are undecided, those outside are only counted and summed."""

    def __init__(self, n: int, k: int, lo: float, hi: float, total: float):
        self.n, self.k, self.lo, self.hi = n, k, lo, hi
        self.higher, self.sum_higher = 0, 0.0  # scores above hi
        self.lower, self.sum_lower = 0, 0.0  # scores below lo
        self.share = (k - 0.5) / n  # the loss with this share has its only minimum at the k-th largest score
        self.step, self.value = 0, lo if lo == hi else None
        # tangents (point, loss, slope): left of all scores the loss falls by share, right of all it rises by 1 - share
        self.left = (lo, self.share * (total - n * lo), -self.share * n)
        self.right = (hi, (1 - self.share) * (n * hi - total), (1 - self.share) * n)

    @property
    def resolved(self) -> bool:
        return self.value is not None

    def probe(self) -> float:
        """Where the tangents meet; every few steps, or if rounding put that outside, the middle of the bracket."""
        (a, fa, da), (b, fb, db) = self.left, self.right
        self.step += 1
        c = (fa - fb + b * db - a * da) / (db - da) if db > da else self.lo
        if not self.lo < c < self.hi or self.step % (TANGENT_STEPS + 1) == 0:
            c = self.lo + (self.hi - self.lo) / 2
        self.c = c
        return c

    def take(self, r) -> None:
        above, below = self.higher + r.above, self.lower + r.below
        sum_above, sum_below = self.sum_higher + (r.sum_above or 0.0), self.sum_lower + (r.sum_below or 0.0)
        loss = self.share * (sum_above - above * self.c) + (1 - self.share) * (below * self.c - sum_below)
        if above >= self.k:  # the right subgradient is negative: the minimum lies above
            self.left = (self.c, loss, (1 - self.share) * (below + r.at) - self.share * above)
            self.lower, self.sum_lower, self.lo = below + r.at, sum_below + r.at * self.c, r.next
        elif above + r.at >= self.k:  # the subgradients straddle zero at a score
            self.value = self.c
        else:  # the left subgradient is positive: the minimum lies below
            self.right = (self.c, loss, (1 - self.share) * below - self.share * (above + r.at))
            self.higher, self.sum_higher, self.hi = above + r.at, sum_above + r.at * self.c, r.previous
        if self.value is None and self.lo == self.hi:
            self.value = self.lo


def _frame(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, T._parse_datatype_string(schema))


def keep(records: DataFrame, found: DataFrame, group: str = "domain", score: str = "q") -> DataFrame:
    """The records whose score reaches their group's cutoff; NULL scores, NULL groups and groups without cutoff keep none."""
    return records.join(F.broadcast(found.select(group, "cutoff")), group).where(F.col(score) >= F.col("cutoff")).drop("cutoff")


def _prepared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    scores = read(spark, sf_dir, "sample_scores", "uid", "domain", "q_primary", "scored_at")
    records = cut(latest_scores(scores).where("domain IS NOT NULL AND q IS NOT NULL"))
    targets = read(spark, sf_dir, "keep_targets").select(clean_domain(F.col("domain")).alias("domain"), F.col("target_permille").alias("permille"))
    return records, cutoffs(records, targets)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, found = _prepared(spark, sf_dir)
    return keep(records, found).select("uid")


def p4_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = _prepared(spark, sf_dir)
    return found.select("domain", "permille", "n", F.round("cutoff", 9).alias("cutoff"), "kept", F.round(F.try_divide(F.col("kept"), F.col("n")), 6).alias("kept_share"))


_SQL = """
WITH last AS (
  SELECT uid, max_by(lower(trim(domain)), coalesce(scored_at, TIMESTAMP '0001-01-01')) AS domain,
         max_by(q_primary, coalesce(scored_at, TIMESTAMP '0001-01-01')) AS q
  FROM (SELECT uid, scored_at, coalesce(domain, '') AS domain, coalesce(q_primary, 'nan') AS q_primary FROM sample_scores) s
  GROUP BY uid),
valid AS (SELECT uid, domain, q FROM last WHERE uid IS NOT NULL AND domain <> '' AND NOT isnan(q) AND q BETWEEN 0 AND 1),
ranked AS (SELECT domain, q, count(*) OVER (PARTITION BY domain ORDER BY q DESC RANGE UNBOUNDED PRECEDING) AS reached,
                  count(*) OVER (PARTITION BY domain) AS n FROM valid),
targets AS (SELECT lower(trim(domain)) AS domain, max(target_permille) AS permille FROM keep_targets
            WHERE target_permille IS NOT NULL AND domain IS NOT NULL GROUP BY 1),
found AS (SELECT t.domain, t.permille, max(r.q) FILTER (WHERE r.reached * 1000 >= t.permille * r.n) AS cutoff
          FROM targets t LEFT JOIN ranked r ON r.domain = t.domain GROUP BY 1, 2)
"""
ORACLE = {
    "p4_found": _SQL + "SELECT v.uid FROM valid v JOIN found f ON f.domain = v.domain AND v.q >= f.cutoff",
    "p4_cutoffs": _SQL
    + """SELECT f.domain, CAST(f.permille AS BIGINT) AS permille, count(v.uid) AS n, round(f.cutoff, 9) AS cutoff,
       count(*) FILTER (WHERE v.q >= f.cutoff) AS kept,
       round(CASE WHEN count(v.uid) > 0 THEN count(*) FILTER (WHERE v.q >= f.cutoff) / count(v.uid)::DOUBLE END, 6) AS kept_share
FROM found f LEFT JOIN valid v ON v.domain = f.domain GROUP BY f.domain, f.permille, f.cutoff""",
}
QUERIES = {"p4_found": p4_found, "p4_cutoffs": p4_cutoffs}
