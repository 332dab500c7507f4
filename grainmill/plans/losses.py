"""Loss models of recipes: joined and checked inputs, designs, fitted effects with intervals, models that use the domains' quality, and what they gain.

All models take any number of recipes. Kernel models are solved on the executors, from
``mixture.MAX_RECIPES`` recipes on by expansion. Training recipes and two held-out sets are told apart by their index; the held-out ones are never used for selection.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.operators import mixture
from grainmill.operators.identity import same_keys
from grainmill.operators.resample import mean_intervals
from grainmill.plans import parts
from grainmill.plans.mixtures import _D, _P, _R, _X, BETA, DELTA, QUALITY, _value, recipes
from grainmill.plans.quality import rounded
from grainmill.sources.shared import cut

KNOWN = np.array([1, 1, 1, 0, 0], bool)  #: domains whose quality is given
SETS = {"train": "pmod(index, 3) <> 0", "held_a": "pmod(index, 6) = 0", "held_b": "pmod(index, 6) = 3"}
THRESHOLD, FOLDS, SEED = 0.01, 5, 20260924
GAIN_REPEATS, PLACEBOS, EFFECT_REPEATS = 1000, 100, 200
LAMBDA, RATIO = 0.01, 10.0


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make():
        r, _ = recipes(spark, sf_dir)
        r = cut(r)
        return cut(mixture.validated_pairs(r.select("index", "p"), r.select("index", "y")))

    return parts.kept(spark, sf_dir, "pairs", make)


def mixture_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes joined with their losses one to one, checked, shares summing to 1."""
    return rounded(_pairs(spark, sf_dir).select("index", *[F.get("p", F.lit(i)).alias(f"p{i}") for i in range(_D)], *[F.get("y", F.lit(i)).alias(f"y{i}") for i in range(3)]), 8)


def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the domains of the recipe table and of the map are the same set, and how many are on one side only."""
    m = parts.table(spark, sf_dir, "mix_targets").select("source").distinct()
    return same_keys(m, parts.table(spark, sf_dir, "domain_map").select(F.col("mixture_domain").alias("source")), ["source"])


def pair_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes with a positive share of both domains, per pair of domains: one row of sums."""
    n = {(i, j): F.count_if((F.get("p", F.lit(i)) > 0) & (F.get("p", F.lit(j)) > 0)) for i in range(_D) for j in range(i + 1, _D)}
    one = _pairs(spark, sf_dir).agg(*[c.alias(f"{i}_{j}") for (i, j), c in n.items()]).first()
    return spark.createDataFrame([(i, j, one[f"{i}_{j}"]) for i, j in n], "domain_a int, domain_b int, recipes long")


def design_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank and condition of the training recipes' quadratic design, products that never occur, and quantiles of the distance to the nearest other recipe."""
    train = _pairs(spark, sf_dir).where(SETS["train"])
    rows = mixture.gram(train.select(mixture.features(F.col("p"), _D).alias("x")), "x").collect()  # features^2 numbers
    k = len(_X)
    g = np.zeros((k, k))
    for r in rows:
        g[r.i, r.j] = r.s
    e = np.maximum(np.linalg.eigvalsh(g)[::-1], 0)
    rank = int((e > e[0] * 1e-12).sum()) if e[0] > 0 else 0
    near = mixture.nearest(train, train, other=True).agg(F.percentile("l1", F.array(*[F.lit(x) for x in (0.0, 0.1, 0.5, 0.9, 1.0)])).alias("q"), F.count("*").alias("n")).first()
    row = (near.n, k, rank, float(np.sqrt(e[0] / e[-1])) if e[-1] > 0 else None, int((np.diag(g)[_D:] == 0).sum()), *(near.q or [None] * 5))
    return rounded(spark.createDataFrame([row], "recipes long, features int, rank int, condition double, zero_products int, nearest_min double, nearest_p10 double, nearest_median double, nearest_p90 double, nearest_max double"), 4)


def _gap(beta: np.ndarray):
    """H of each recipe of ``p`` with each of ``q``: the prediction at the midpoint less the mean of those at the ends."""

    def value(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        ends = mixture.expand(q, True) @ beta
        return np.array([mixture.expand((x + q) / 2, True) @ beta - (mixture.expand(x[None], True) @ beta + ends) / 2 for x in p])

    return value


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.kept(spark, sf_dir, "blocks", lambda: mixture.blocks(recipes(spark, sf_dir)[0].select("index", "p")))


_SUMMARY = "n_pairs long, mean_h double, p10_h double, median_h double, p90_h double, min_h double, max_h double"


def _gaps(betas: np.ndarray):
    """H as ``_gap`` for each column of coefficients: the linear terms cancel, so it is -1/4 of the product terms' form of the difference."""
    i, j = np.triu_indices(_D, 1)
    forms = np.zeros((betas.shape[1], _D, _D))
    forms[:, i, j] = forms[:, j, i] = betas[_D:].T / 2

    def of_rows(p: np.ndarray, q: np.ndarray, s: np.ndarray):
        own = lambda x: (x @ s * x).sum(1) * -0.25
        left = np.column_stack([p @ s * 0.5, own(p), np.ones(len(p))])
        right = np.ascontiguousarray(np.column_stack([q, np.ones(len(q)), own(q)]).T)
        return lambda rows: left[rows] @ right

    return lambda p, q: [of_rows(p, q, s) for s in forms]


def _summary_rows(table: DataFrame, betas: np.ndarray) -> list[tuple]:
    return [(s["pairs"], s["mean"], *s["q"], s["low"], s["high"]) for s in mixture.pair_summaries(table, _gaps(betas), [0.1, 0.5, 0.9])]


def combination_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, quantiles and range of H over all unordered pairs of recipes, under fixed coefficients."""
    return rounded(spark.createDataFrame(_summary_rows(_blocks(spark, sf_dir), np.array(BETA)[:, None]), _SUMMARY), 8)


def combination_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten lowest and the ten highest H of all unordered pairs of recipes, under fixed coefficients."""
    return rounded(mixture.pair_extremes(_blocks(spark, sf_dir), _gap(np.array(BETA)), 10).withColumnRenamed("value", "h"), 8)


def _ridge(spark: SparkSession, sf_dir: str) -> mixture.Ridge:
    return parts.kept(spark, sf_dir, "ridge", lambda: mixture.fit_distributed(_pairs(spark, sf_dir).where(SETS["train"]), _D, LAMBDA, RATIO, True))


def fitted_combination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of H over all pairs of recipes under the fitted quadratic ridge, per output and for their mean."""
    m = _ridge(spark, sf_dir)
    outputs = m.beta / m.scale[:, None]
    names = [*map(str, range(outputs.shape[1])), "macro_mean"]
    rows = _summary_rows(_blocks(spark, sf_dir), np.column_stack([outputs, outputs.mean(1)]))
    return rounded(spark.createDataFrame([(name, *row) for name, row in zip(names, rows)], "output string, " + _SUMMARY), 6)


def fitted_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean change of the fitted mean loss when a share of DELTA moves between two domains, over the recipes that have it, with its bootstrap interval and how many
    stay within the target domain's observed range."""
    m, r = _ridge(spark, sf_dir), _pairs(spark, sf_dir)
    beta = (m.beta / m.scale[:, None]).mean(1)
    top = r.agg(*[F.max(F.get("p", F.lit(i))).alias(f"m{i}") for i in range(_D)]).first()
    shift = lambda i, j: F.transform("p", lambda x, k: x + F.when(k == i, DELTA).when(k == j, -DELTA).otherwise(0.0))
    moves = F.array(*[F.struct(F.lit(j).alias("from"), F.lit(i).alias("to"), F.lit(float(top[f"m{i}"] or 0.0)).alias("largest"), F.get("p", F.lit(j)).alias("have"), F.get("p", F.lit(i)).alias("at"), shift(i, j).alias("q")) for i in range(_D) for j in range(_D) if i != j])
    e = r.select("index", "p", F.explode(moves).alias("v")).where(F.col("v.have") >= DELTA)
    value = lambda c: mixture.linear_prediction(mixture.features(c, _D), list(beta))
    e = cut(e.select("index", F.col("v.from").alias("from_domain"), F.col("v.to").alias("to_domain"), (value(F.col("v.q")) - value(F.col("p"))).alias("effect"), (F.col("v.at") + DELTA <= F.col("v.largest") + 1e-12).cast("double").alias("inside")))
    g = ["from_domain", "to_domain"]
    out = mean_intervals(e, g, "effect", "index", EFFECT_REPEATS, SEED).join(e.groupBy(*g).agg(F.avg("inside").alias("inside_share")), g)
    return rounded(out.withColumnRenamed("mean", "mean_change").withColumn("all_extrapolated", F.col("inside_share") == 0))


class Study:
    """Training and held-out recipes on the driver, eight bytes a number, and folds; selected parameters and the predictions of fitted variants once they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        pairs = _pairs(spark, sf_dir)
        self.sets = {n: mixture.collect(pairs.where(where).orderBy("index"), "p", "y") for n, where in SETS.items()}
        self.p, self.y = self.sets["train"]
        raw = np.array(QUALITY)
        self.q = (raw - raw.mean()) / raw.std()
        self.fold = mixture.folds(mixture.components(self.p, THRESHOLD), FOLDS, SEED)
        self.grid = [(v, x) for v in mixture.VARIANTS for x in mixture.parameters(v)]
        self.held = {n: s for n, s in self.sets.items() if n != "train" and len(s[0])}

    @cached_property
    def cv(self) -> np.ndarray:
        shapes = mixture.together([mixture.shape(*x) for x in self.grid])
        return mixture.fold_errors(self.spark, (self.grid, self.q), self.p, self.y, self.fold, shapes, _variants)

    @cached_property
    def best(self) -> dict[str, int]:
        return {v: min((i for i, (name, _) in enumerate(self.grid) if name == v), key=lambda i: (self.cv[i], i)) for v in mixture.VARIANTS}

    @cached_property
    def predicted(self) -> dict[tuple[str, str], np.ndarray]:
        got = self.refitted([(v, self.q) for v in mixture.VARIANTS])
        return {(n, v): got[i][n] for n in self.held for i, v in enumerate(mixture.VARIANTS)}

    def refitted(self, models: list[tuple[str, np.ndarray]]) -> list[dict[str, np.ndarray]]:
        """Predictions for the held-out sets of variants with these qualities at the selected parameters, each fitted in a task."""
        fits, sizes = [(v, q, self.grid[self.best[v]][1]) for v, q in models], [len(p) for p, _ in self.held.values()]
        held = np.concatenate([p for p, _ in self.held.values()]) if sizes else self.p[:0]
        k = self.y.shape[1]
        got = mixture.in_parallel(self.spark, (self.p, self.y, fits, held), len(fits), _refit, len(held) * k).reshape(len(fits), len(held), k)
        return [dict(zip(self.held, np.split(x, np.cumsum(sizes)[:-1]))) for x in got]


def _variants(value, points: list[int], p: np.ndarray, y: np.ndarray) -> list[mixture.Variant]:
    grid, q = value
    return mixture.variants(grid, points, p, y, q, KNOWN)


def _refit(shared, i: int) -> list[float]:
    p, y, fits, held = shared
    variant, q, params = fits[i]
    return mixture.Variant(variant, p, y, q, KNOWN, params).predict(held).ravel().tolist()


def _study(spark: SparkSession, sf_dir: str) -> Study:
    return parts.kept(spark, sf_dir, "study", lambda: Study(spark, sf_dir))


def variant_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validated error of every variant and parameter, near-duplicates kept in one fold, in order of variant and error; the best of each variant is marked."""
    s = _study(spark, sf_dir)
    order = sorted(range(len(s.grid)), key=lambda i: (s.grid[i][0], s.cv[i], i))
    return rounded(spark.createDataFrame([(s.grid[i][0], str(sorted(s.grid[i][1].items())), float(s.cv[i]), float(np.sqrt(s.cv[i])), i == s.best[s.grid[i][0]]) for i in order], "variant string, params string, cv_mse double, cv_rmse double, best boolean"))


_MEASURES = ("n", "rmse", "mae", "r2", "macro_rmse", "macro_mae", "macro_r2", "macro_spearman", "mean_output_spearman", "top1_overlap", "regret_at_1", "top5_overlap", "regret_at_5", "top10_overlap", "regret_at_10", "oracle_rank", "best_rank_of_ten")
_MEASURE_SCHEMA = ", ".join(f"{m} {'int' if m in ('n', 'oracle_rank', 'best_rank_of_ten') else 'double'}" for m in _MEASURES)


def variant_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors, rank correlations, overlaps and regrets of the selected variants on the held-out sets, and where the best recipe stands in their ranking."""
    s = _study(spark, sf_dir)
    got = [(n, v, mixture.measures(s.held[n][1], pred)) for (n, v), pred in s.predicted.items()]
    return rounded(spark.createDataFrame([(n, v, *[m[k] for k in _MEASURES]) for n, v, m in got], "dataset string, variant string, " + _MEASURE_SCHEMA))


def variant_output_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, rows = _study(spark, sf_dir), []
    for (n, v), pred in s.predicted.items():
        y = s.held[n][1]
        for k in range(y.shape[1]):
            e, spread = y[:, k] - pred[:, k], float(((y[:, k] - y[:, k].mean()) ** 2).sum())
            rows.append((n, v, k, float(np.sqrt((e**2).mean())), float(np.abs(e).mean()), 1 - float((e**2).sum()) / spread if spread > 1e-12 else None, mixture.rank_correlation(y[:, k], pred[:, k])))
    return rounded(spark.createDataFrame(rows, "dataset string, variant string, output int, rmse double, mae double, r2 double, spearman double"))


def ranking_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each variant ranks the held-out recipes as the one without quality does."""
    s, rows = _study(spark, sf_dir), []
    for n in s.held:
        base = s.predicted[n, "M1-RBF"].mean(1)
        for v in mixture.VARIANTS[1:]:
            other = s.predicted[n, v].mean(1)
            a, b = np.argsort(base, kind="stable"), np.argsort(other, kind="stable")
            rows.append((n, v, mixture.rank_correlation(base, other), *[len(set(a[: min(k, len(a))]) & set(b[: min(k, len(a))])) / min(k, len(a)) for k in (1, 5, 10)]))
    return rounded(spark.createDataFrame(rows, "dataset string, variant string, spearman double, top1_overlap double, top5_overlap double, top10_overlap double"))


def _gains(s: Study) -> list[tuple]:
    rng, out = np.random.default_rng(SEED), []
    for n, (_, y) in s.held.items():
        error = {v: ((y - s.predicted[n, v]) ** 2).mean(1) for v in mixture.VARIANTS}
        for v in mixture.VARIANTS[1:]:
            base = "M1-Scheffe" if v == "M3prior-Scheffe" else "M1-RBF"
            out.append((n, v, base, *mixture.paired_interval(error[base], error[v], rng, GAIN_REPEATS)))
    return out


def gain_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain in error of each variant over the one without quality, and its interval over resampled recipes."""
    return rounded(spark.createDataFrame(_gains(_study(spark, sf_dir)), "dataset string, variant string, baseline string, gain double, low double, high double"))


def gain_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a variant's gain is stable: the quality behind it is eligible, its interval on the first held-out set is above 0, and its rank correlation on the
    others isn't lower by more than 0.02."""
    from grainmill.plans.bridge import bridge_gate

    s = _study(spark, sf_dir)
    verdict = bridge_gate(spark, sf_dir).select("passes").first()
    eligible = bool(verdict and verdict.passes)
    first, *others = s.held or [None]
    rho = {(n, v): mixture.measures(s.held[n][1], s.predicted[n, v])["macro_spearman"] or 0.0 for n in s.held for v in mixture.VARIANTS}
    rows = []
    for n, v, base, gain, low, _ in _gains(s):
        if n == first and v not in ("M1-Scheffe",):
            kept_rank = all(rho[o, v] >= rho[o, base] - 0.02 for o in others)
            rows.append((v, base, eligible, gain > 0, low > 0, kept_rank, eligible and low > 0 and kept_rank))
    return spark.createDataFrame(rows, "variant string, baseline string, quality_eligible boolean, improved boolean, interval_positive boolean, rank_kept boolean, stable_gain boolean")


def _placebo(shared, i: int) -> list[float]:
    p, y, orders, fold, params, held = shared
    mixed = orders[i]
    cv = np.mean([((mixture.Variant("M3-RBF", p[fold != f], y[fold != f], mixed, KNOWN, params).predict(p[fold == f]) - y[fold == f]) ** 2).mean() for f in np.unique(fold)])
    m = mixture.Variant("M3-RBF", p, y, mixed, KNOWN, params)
    out = [float(np.sqrt(cv))]
    for hp, hy in held:
        got = mixture.measures(hy, m.predict(hp))
        out += [got["rmse"], got["macro_spearman"] if got["macro_spearman"] is not None else float("nan"), got["regret_at_10"]]
    return out


def placebo_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variant with quality by domain, with the domains' qualities shuffled: errors of every repeat, computed on the executors."""
    s = _study(spark, sf_dir)
    held = list(s.held.values())
    params = s.grid[s.best["M3-RBF"]][1]
    mixed = [np.random.default_rng(SEED + i).permutation(s.q) for i in range(PLACEBOS)]
    same = mixture.together([tuple(params["alpha"] * q) for q in mixed])  # orders that come again are fitted once
    once = mixture.in_parallel(spark, (s.p, s.y, [mixed[at[0]] for at in same], s.fold, params, held), len(same), _placebo, 1 + 3 * len(held))
    got = np.zeros((PLACEBOS, once.shape[1]))
    for at, x in zip(same, once):
        got[at] = x
    num = lambda x: None if x != x else float(x)
    rows = [(r, n, num(got[r, 0]), *map(num, got[r, 1 + 3 * k : 4 + 3 * k])) for r in range(PLACEBOS) for k, n in enumerate(s.held)]
    return rounded(spark.createDataFrame(rows, "repeat int, dataset string, cv_rmse double, rmse double, macro_spearman double, regret_at_10 double"))


def alternative_refits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants refitted with other qualities of the domains that aren't known, at the parameters selected before: those of the mean, reversed, and halved."""
    s, rows = _study(spark, sf_dir), []
    raw = np.array(QUALITY)
    other = {"unknown_at_mean": np.where(KNOWN, raw, raw[KNOWN].mean()), "unknown_swapped": np.where(KNOWN, raw, raw[::-1]), "unknown_halved": np.where(KNOWN, raw, raw / 2)}
    fits = []
    for name, alt in other.items():
        q = (alt - alt.mean()) / alt.std() if alt.std() > 1e-10 else np.zeros(len(alt))
        fits += [(name, int((alt != raw).sum()), v, q) for v in ("M2-RBF", "M3-RBF", "M3prior-Scheffe")]
    for (name, changed, v, _), predicted in zip(fits, s.refitted([(v, q) for *_, v, q in fits])):
        for n, (_, y) in s.held.items():
            got = mixture.measures(y, predicted[n])
            rows.append((name, changed, v, n, *[got[k] for k in _MEASURES]))
    return rounded(spark.createDataFrame(rows, "scenario string, changed int, variant string, dataset string, " + _MEASURE_SCHEMA))


def centred_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge variants around the mean loss: cross-validated and held-out errors per family at its best penalties."""
    s = _study(spark, sf_dir)

    def predict(fitted, p, quadratic):
        scale, beta, mean = fitted
        return mean + mixture.expand(p, quadratic) / scale @ beta

    rows = []
    for family, quadratic, ratios in (("linear", False, (1.0,)), ("quadratic", True, (1.0, 10.0, 100.0))):
        def error(lam, ratio, quadratic=quadratic):
            return float(np.mean([((predict(mixture.centred_ridge(s.p[s.fold != f], s.y[s.fold != f], lam, ratio, quadratic), s.p[s.fold == f], quadratic) - s.y[s.fold == f]) ** 2).mean() for f in np.unique(s.fold)]))

        cv, lam, ratio = min((error(a, r), a, r) for a in (1e-6, 1e-4, 1e-2, 1e-1) for r in ratios)
        m = mixture.centred_ridge(s.p, s.y, lam, ratio, quadratic)
        for n, (p, y) in s.held.items():
            got = mixture.measures(y, predict(m, p, quadratic))
            rows.append((family, lam, ratio, float(np.sqrt(cv)), n, got["rmse"], got["macro_spearman"], got["mean_output_spearman"], got["regret_at_1"]))
    return rounded(spark.createDataFrame(rows, "family string, lambda double, ratio double, cv_rmse double, dataset string, rmse double, macro_spearman double, mean_output_spearman double, regret double"))


def recipe_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, least and greatest share of a recipe in domains of known quality, per set."""
    known = sum((F.get("p", F.lit(int(i))) for i in np.flatnonzero(KNOWN)), F.lit(0.0))
    dataset = F.when(F.expr(SETS["train"]), "train").when(F.expr(SETS["held_a"]), "held_a").otherwise("held_b")
    return rounded(_pairs(spark, sf_dir).groupBy(dataset.alias("dataset")).agg(F.avg(known).alias("mean"), F.min(known).alias("least"), F.max(known).alias("greatest")))


def extrapolation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out losses as those of the nearest training recipe, scaled by one ratio per output or by one per recipe: exact matches and errors, per output."""
    pairs = _pairs(spark, sf_dir)
    train, held = pairs.where(SETS["train"]), pairs.where(f"NOT ({SETS['train']})")
    near = mixture.nearest(held, train).join(held.select("index", "y"), "index").join(train.select(F.col("index").alias("nearest"), F.col("y").alias("t")), "nearest")
    ratio = F.zip_with("y", "t", lambda a, b: F.when(F.abs(b) > 1e-12, a / b))
    rows = near.select("index", "exact", "y", "t", ratio.alias("r")).withColumn("own", F.expr("array_sort(filter(r, x -> x IS NOT NULL))"))
    rows = cut(rows.withColumn("own", F.when(F.size("own") > 0, F.expr("(own[cast(floor((size(own) - 1) / 2) as int)] + own[cast(floor(size(own) / 2) as int)]) / 2"))))
    x = rows.select("index", "exact", "own", F.posexplode(F.arrays_zip("y", "t", "r")).alias("output", "v")).select("index", "exact", "own", "output", "v.*")
    from grainmill.operators.order import quantiles

    med = quantiles(x, ["output"], "r", [0.1, 0.5, 0.9], "index").select("output", *[F.col("q")[i].alias(n) for i, n in enumerate(("ratio_p10", "median_ratio", "ratio_p90"))])
    j = x.join(med, "output")
    err = lambda scale: F.sqrt(F.avg(F.pow(F.col("y") - F.col("t") * scale, 2)))
    return rounded(j.groupBy("output", "ratio_p10", "median_ratio", "ratio_p90").agg(F.count("*").alias("rows"), F.count_if("exact").alias("exact_matches"), err(F.col("median_ratio")).alias("output_scaled_rmse"), err(F.col("own")).alias("recipe_scaled_rmse")))


_N = ", ".join(f"p{i} / ({' + '.join(_P)}) AS p{i}" for i in range(_D))
_PAIR_H = f"""{_R}, pr AS (SELECT least(a."index", b."index") AS index_a, greatest(a."index", b."index") AS index_b, ({_value([f'(a.p{i} + b.p{i}) / 2' for i in range(_D)])}) - (({_value([f'a.p{i}' for i in range(_D)])}) + ({_value([f'b.p{i}' for i in range(_D)])})) / 2 AS h FROM rc a JOIN rc b ON a."index" < b."index")"""
ORACLE = {
    "mixture_pairs": f'WITH {_R} SELECT "index", {", ".join(f"round(p{i} / ({" + ".join(_P)}), 8) AS p{i}" for i in range(_D))}, {", ".join(f"round(y{i}, 8) AS y{i}" for i in range(3))} FROM rc',
    "key_sets": "WITH a AS (SELECT DISTINCT source FROM mix_targets), b AS (SELECT DISTINCT mixture_domain AS source FROM domain_map), c AS (SELECT (SELECT count(*) FROM a WHERE source NOT IN (SELECT source FROM b)) AS only_left, (SELECT count(*) FROM b WHERE source NOT IN (SELECT source FROM a)) AS only_right) SELECT only_left, only_right, only_left = 0 AND only_right = 0 AS equal FROM c",
    "pair_support": f"WITH {_R} " + " UNION ALL ".join(f"SELECT {i} AS domain_a, {j} AS domain_b, count(*) FILTER (WHERE p{i} > 0 AND p{j} > 0) AS recipes FROM rc" for i in range(_D) for j in range(i + 1, _D)),
    "combination_effects": f"WITH {_PAIR_H} SELECT count(*) AS n_pairs, round(avg(h), 8) AS mean_h, round(quantile_cont(h, 0.1), 8) AS p10_h, round(quantile_cont(h, 0.5), 8) AS median_h, round(quantile_cont(h, 0.9), 8) AS p90_h, round(min(h), 8) AS min_h, round(max(h), 8) AS max_h FROM pr",
    "combination_extremes": f"WITH {_PAIR_H}, rk AS (SELECT *, row_number() OVER (ORDER BY round(h, 12), index_a, index_b) AS a, row_number() OVER (ORDER BY round(h, 12) DESC, index_a, index_b) AS b FROM pr) SELECT 'lowest' AS \"end\", index_a, index_b, round(h, 8) + 0 AS h FROM rk WHERE a <= 10 UNION ALL SELECT 'highest', index_a, index_b, round(h, 8) + 0 FROM rk WHERE b <= 10",
    "recipe_coverage": f"WITH {_R}, k AS (SELECT CASE WHEN \"index\" % 3 <> 0 THEN 'train' WHEN \"index\" % 6 = 0 THEN 'held_a' ELSE 'held_b' END AS dataset, (p0 + p1 + p2) / ({' + '.join(_P)}) AS m FROM rc) SELECT dataset, round(avg(m), 6) AS mean, round(min(m), 6) AS least, round(max(m), 6) AS greatest FROM k GROUP BY 1",
}
QUERIES = {f.__name__: f for f in (mixture_pairs, key_sets, pair_support, design_audit, combination_effects, combination_extremes, fitted_combination, fitted_replacement, variant_cv, variant_metrics, variant_output_metrics, ranking_stability, gain_intervals, gain_decision, placebo_quality, alternative_refits, centred_benchmark, recipe_coverage, extrapolation_errors)}
