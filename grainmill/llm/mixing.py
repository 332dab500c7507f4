"""Problem 8: mix sources to target token shares by entropy balancing.

For each (recipe, source): of all document rates w with 0 <= w <= max_repeats whose tokens sum to the target T, take those closest in
relative entropy to using each document once. They are exponential tilts w = min(max_repeats, exp(lambda * t / mean)), t the document's
tokens and mean the source's average; lambda solves the one equation of the convex dual, sum(w * t) = T. So a target below what the
source holds is met by fewer long documents rather than by dropping documents at random, one above it by repeating the longer ones.

Newton iterations solve the dual of all lines at once: each is one aggregation over the table (source, tokens, documents) that gives
gradient and curvature at the lines' multipliers. Every line keeps a bracket of its multiplier; a step that leaves it, or a curvature that
the cap has flattened, is replaced by the bracket's middle, so the iterations always end. A line that isn't solved after ``MAX_STEPS`` is an error.

If T passes what the source has at max_repeats, every document is used max_repeats times and the shortfall is reported.

Rates become whole copies by floor(w + u - 1/2 + shift), u the document's hash: in expectation w. One ``shift`` per (recipe, source) is
bisected on the documents' exact tokens, so the reached total meets the target to about one document. Everything hangs on document and
parameters only; reruns give the same copies.

Bounds: the driver and broadcasts hold one row per line of the recipe table (``MAX_LINES``); documents stay on the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm.common import cut, read
from grainmill.llm.encoding import DEFAULT_VOCABULARY, count_tokens

MAX_LINES = 100_000
SALT = "grainmill-mix-1"
PROBES = 16  #: shifts tried in one pass of the rounding
ROUNDING_PASSES = 5
MAX_STEPS = 200  #: Newton steps of a line, most take under ten
TOLERANCE = 1e-10  #: relative, of a line's tokens


@dataclass
class Line:
    """One source of one recipe: its target, cap and the multiplier of its documents' tilt."""

    number: int
    recipe: str
    source: str
    share: float
    target: float
    cap: float
    tokens: int = 0
    mean: float = 1.0
    multiplier: float = 0.0
    low: float = -math.inf
    high: float = math.inf
    solved: bool = True  # also where nothing is to be selected, or all is at the cap

    @property
    def exhausted(self) -> bool:
        return self.target >= self.cap * self.tokens

    def step(self, gradient: float, curvature: float) -> None:
        """One Newton step on log(tokens at the rates) = log(target), kept within the bracket."""
        if abs(gradient / self.target - 1) <= TOLERANCE:
            self.solved = True
            return
        if gradient < self.target:
            self.low = self.multiplier
        else:
            self.high = self.multiplier
        new = self.multiplier + gradient / curvature * math.log(self.target / gradient) if curvature > 0 and gradient > 0 else math.nan
        if not self.low < new < self.high:  # also where it isn't a number
            if math.isinf(self.low) or math.isinf(self.high):
                end = self.high if math.isinf(self.low) else self.low
                new = end + math.copysign(max(1.0, abs(end)), 1 if math.isinf(self.high) else -1)
            else:
                new = (self.low + self.high) / 2
        # neighbouring numbers: no multiplier comes closer
        self.solved = new in (self.low, self.high)
        self.multiplier = new


def balance(sizes: DataFrame, recipes: DataFrame) -> tuple[list[Line], int]:
    """Solved lines and the corpus' tokens. ``sizes``: source, t, n; only t > 0 takes part in the mix, NULL sources only in the budget.

    ``recipes``: recipe, budget_ratio, source, target_share, max_repeats; a NULL in any field, a share or ratio of 0 or less and a
    cap of 0 or less make a line that selects nothing. A source twice in a recipe is one line of the summed share and the greatest cap.
    """
    total = sizes.agg(F.coalesce(F.sum(F.col("t") * F.col("n")), F.lit(0)).alias("x")).first().x
    merged = recipes.groupBy("recipe", "source").agg(F.max("budget_ratio").alias("ratio"), F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap"))
    rows = sorted(merged.limit(MAX_LINES + 1).collect(), key=lambda r: (str(r.recipe), str(r.source)))
    if len(rows) > MAX_LINES:
        raise ValueError(f"more than {MAX_LINES} recipe lines")
    lines = [Line(i, r.recipe, r.source, r.share or 0.0, max(0.0, (r.share or 0.0) * (r.ratio or 0.0)) * total, float(max(0, r.cap or 0))) for i, r in enumerate(rows)]
    spark = sizes.sparkSession
    names = spark.createDataFrame([(x,) for x in sorted({x.source for x in lines if x.source is not None})], "source string")
    own = sizes.join(F.broadcast(names), "source").where("t > 0")
    have = {r.source: r for r in own.groupBy("source").agg(F.sum(F.col("t") * F.col("n")).alias("t"), F.sum("n").alias("n")).collect()}
    for x in lines:
        if x.source in have:
            x.tokens, x.mean = have[x.source].t, have[x.source].t / have[x.source].n
        x.solved = not (x.tokens and x.target > 0 and not x.exhausted)
    for _ in range(MAX_STEPS):
        open_ = [x for x in lines if not x.solved]
        if not open_:
            return lines, total
        probe = spark.createDataFrame([(x.number, x.source, x.multiplier / x.mean, x.cap) for x in open_], "line int, source string, m double, cap double")
        rate = tilt(F.col("m"), F.col("cap"), F.col("t"))
        tokens = F.col("n") * F.col("t")
        free = F.when(F.col("m") * F.col("t") < F.log("cap"), tokens * F.col("t") * rate).otherwise(0.0)
        got = own.join(F.broadcast(probe), "source").groupBy("line").agg(F.sum(tokens * rate).alias("g"), F.sum(free).alias("h")).collect()
        for r in got:
            lines[r.line].step(r.g, r.h / lines[r.line].mean)
    raise RuntimeError(f"entropy balancing did not converge for {[(x.recipe, x.source) for x in lines if not x.solved][:5]}")


def tilt(m: Column, cap: Column, t: Column) -> Column:
    """min(cap, exp(m * t)), without overflow."""
    return F.exp(F.least(m * t, F.log(cap)))


def select(documents: DataFrame, key: str, lines: list[Line]) -> tuple[DataFrame, DataFrame]:
    """(recipe, key, source, t, copies > 0) for documents (key, source, t), and the lines as a table with the chosen shift.

    Documents without tokens, of NULL or unwanted sources are in no selection.
    """
    spark = documents.sparkSession
    frame = spark.createDataFrame(
        [(x.number, x.recipe, x.source, x.share, x.target, x.multiplier / x.mean, x.cap, x.tokens, x.exhausted) for x in lines if x.source is not None],
        "line int, recipe string, source string, share double, target double, m double, cap double, tokens long, exhausted boolean",
    )
    unit = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(SALT), F.col(key).cast("string")), 256), 1, 12), 16, 10).cast("double") / float(16**12)
    wanted = frame.where("target > 0 AND cap > 0 AND tokens > 0").select("line", "recipe", "source", "cap", "m", "exhausted")
    rate = F.when(F.col("exhausted"), F.col("cap")).otherwise(tilt(F.col("m"), F.col("cap"), F.col("t")))
    # written once: the passes below read rates and hashes, they don't make them anew
    rated = cut(documents.where("t > 0").join(F.broadcast(wanted), "source").select("line", "recipe", key, "source", "t", "cap", rate.alias("w"), unit.alias("u")))
    shifts = {x.number: (-0.5, 0.5) for x in lines}
    copies = lambda s: F.greatest(F.lit(0.0), F.least(F.col("cap"), F.floor(F.col("w") + F.col("u") + s))).cast("long")
    goals = {x.number: min(x.target, x.cap * x.tokens) for x in lines}
    chosen: dict[int, float] = {}
    for _ in range(ROUNDING_PASSES):
        grid = {k: [lo + (hi - lo) * i / (PROBES - 1) for i in range(PROBES)] for k, (lo, hi) in shifts.items()}
        probe = spark.createDataFrame([(k, v) for k, v in grid.items()], "line int, grid array<double>")
        got = rated.join(F.broadcast(probe), "line").groupBy("line").agg(*[F.sum(F.col("t") * copies(F.col("grid")[i])).alias(f"s{i}") for i in range(PROBES)])
        for r in got.collect():
            sums, at = [r[f"s{i}"] for i in range(PROBES)], grid[r.line]
            best = min(range(PROBES), key=lambda i: (abs(sums[i] - goals[r.line]), i))
            chosen[r.line] = at[best]
            over = next((i for i in range(PROBES) if sums[i] >= goals[r.line]), PROBES - 1)
            shifts[r.line] = (at[max(0, over - 1)], at[over])
    final = spark.createDataFrame([(k, v) for k, v in chosen.items()], "line int, shift double") if chosen else spark.createDataFrame([], "line int, shift double")
    out = rated.join(F.broadcast(final), "line").withColumn("copies", copies(F.col("shift"))).where("copies > 0")
    return out.select("recipe", key, "source", "t", F.col("copies").cast("int").alias("copies")), frame


def token_sizes(spark: SparkSession, sf_dir: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id, source, t: tokens of every document; 0 for NULL and empty texts."""
    return count_tokens(read(spark, sf_dir, "documents", "doc_id", "source", "text"), "text", "t", vocabulary)


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    documents = cut(token_sizes(spark, sf_dir))
    sizes = cut(documents.groupBy("source", "t").agg(F.count("*").alias("n")))
    lines, total = balance(sizes, read(spark, sf_dir, "mix_targets"))
    chosen, frame = select(documents, "doc_id", lines)
    return chosen, frame, total


def p8_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, _, _ = _mixed(spark, sf_dir)
    return chosen.select("recipe", "doc_id", "source", F.col("t").alias("n_tokens"), "copies")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per recipe and source: target and reached tokens and shares; the reached share is of what the recipe selected in all."""
    chosen, frame, total = _mixed(spark, sf_dir)
    got = chosen.groupBy("recipe", "source").agg(F.sum(F.col("t") * F.col("copies")).alias("reached"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    whole = got.groupBy("recipe").agg(F.sum("reached").alias("recipe_tokens"))
    out = frame.join(got, ["recipe", "source"], "left").join(whole, "recipe", "left")
    reached = F.coalesce("reached", F.lit(0))
    return out.select(
        "recipe", "source", F.col("share").alias("target_share"), F.round("target").cast("long").alias("target_tokens"), reached.alias("reached_tokens"),
        F.round(F.coalesce(F.try_divide(reached, F.col("recipe_tokens")), F.lit(0.0)), 6).alias("reached_share"), F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"), (F.col("target") > F.col("cap") * F.col("tokens")).alias("source_exhausted"),
    )


ORACLE: dict[str, str] = {}
QUERIES = {"p8_selection": p8_selection, "p8_shares": p8_shares}
