"""Queries of mixtures and losses. Recipes are the users of ``events``: shares of the five event types, losses the mean values of three types."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.operators import mixture
from grainmill.operators.order import average_rank, pearson, quantiles
from grainmill.plans.quality import rounded
from grainmill.sources.shared import cut
from grainmill.sources.tables import table

# The coefficients that the effect queries use in place of a fitted model, so that SQL can follow.
BETA = (1.2, 0.8, 1.5, 1.1, 0.9, 0.3, -0.2, 0.1, 0.25, -0.15, 0.05, 0.2, -0.1, 0.15, -0.05)
DELTA = 0.05
MAX_DOMAINS = 100  #: columns of a recipe; more are an error
QUALITY = (0.2, 0.8, 0.5, 0.6, 0.4)


def recipes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """index, p (shares in order of the type's name), y (mean values of the first three types); users without all three are left out."""
    e = table(spark, sf_dir, "events", "user_id", "event_type", "value").where("user_id IS NOT NULL AND event_type IS NOT NULL")
    names = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").limit(MAX_DOMAINS + 1).collect()]
    if len(names) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains in the recipes")
    per = e.groupBy("user_id").agg(*[F.sum((F.col("event_type") == n).cast("double")).alias(f"n{i}") for i, n in enumerate(names)], *[F.avg(F.when(F.col("event_type") == n, F.col("value"))).alias(f"y{i}") for i, n in enumerate(names[:3])])
    total = sum((F.col(f"n{i}") for i in range(len(names))), F.lit(0.0))
    return per.dropna().select(F.col("user_id").alias("index"), F.array(*[F.col(f"n{i}") / total for i in range(len(names))]).alias("p"), F.array(*[F.col(f"y{i}") for i in range(3)]).alias("y")), names


def pair_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, _ = recipes(spark, sf_dir)
    s = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    dup = r.groupBy("p").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()[0]
    a = r.agg(F.count("*").alias("rows"), F.count_distinct("index").alias("distinct_index"), F.min(s).alias("sum_min"), F.max(s).alias("sum_max"), F.count_if(F.abs(s - 1) > 0.005).alias("out_of_tolerance"), F.count_if(F.exists("p", lambda x: x < 0)).alias("negative"), F.count_if(F.exists("y", lambda x: x <= 0)).alias("bad_losses"))
    return rounded(a.withColumn("exact_duplicates", F.lit(dup).cast("long")))


def domain_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, names = recipes(spark, sf_dir)
    n = F.array(*map(F.lit, names))
    x = r.select(F.posexplode("p").alias("i", "v"))
    return rounded(x.groupBy("i").agg(F.sum((F.col("v") > 0).cast("long")).alias("positive"), F.sum((F.col("v") == 0).cast("long")).alias("zero"), F.max("v").alias("largest"), F.avg("v").alias("mean")).select(F.element_at(n, F.col("i") + 1).alias("domain"), "positive", "zero", "largest", "mean"))


def scheffe_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, names = recipes(spark, sf_dir)
    return rounded(r.select("index", F.posexplode(mixture.features(F.col("p"), len(names))).alias("feature", "value")), 8)


def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, names = recipes(spark, sf_dir)
    return rounded(mixture.gram(r.select(mixture.features(F.col("p"), len(names)).alias("x"), "y"), "x", "y"), 5)


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r, _ = recipes(spark, sf_dir)
    r = cut(r)
    return r.where(F.col("index") % 3 != 0), r.where(F.col("index") % 3 == 0)


def l1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, held = _split(spark, sf_dir)
    return rounded(mixture.nearest(held, train), 8)


def extrapolation_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio of held-out losses to those of the nearest training recipe, per output."""
    train, held = _split(spark, sf_dir)
    j = mixture.nearest(held, train).join(held.select("index", "y"), "index").join(F.broadcast(train.select(F.col("index").alias("nearest"), F.col("y").alias("t"))), "nearest")
    x = j.select("index", F.posexplode(F.zip_with("y", "t", lambda a, b: F.when(F.abs(b) > 1e-12, a / b))).alias("output", "ratio"))
    q = quantiles(x, ["output"], "ratio", [0.1, 0.5, 0.9], "index")
    return rounded(q.select("output", "n", *[F.col("q")[i].alias(c) for i, c in enumerate(("p10", "median", "p90"))]))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group (least index) of each recipe, joined through steps of at most 0.03 in L1."""
    r = recipes(spark, sf_dir)[0]
    return mixture.groups(r.select("index", F.transform("p", lambda v: F.round(v, 12)).alias("p")), 0.03)


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """index, p, macro (mean loss), fixed-coefficient prediction."""
    r, names = recipes(spark, sf_dir)
    f = r.select("index", "p", "y", mixture.features(F.col("p"), len(names)).alias("x"))
    return f.select("index", "p", ((F.get("y", F.lit(0)) + F.get("y", F.lit(1)) + F.get("y", F.lit(2))) / 3).alias("macro"), mixture.linear_prediction(F.col("x"), list(BETA)).alias("predicted"))


def ranking_regret(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of predicted and actual macro loss, regret of the selected recipe and of the best of 5 and 10, overlap of the ten best."""
    s = cut(_predicted(spark, sf_dir).select("index", F.round("macro", 9).alias("macro"), F.round("predicted", 9).alias("predicted")))
    best = s.agg(F.min("macro").alias("best"))
    by_p, by_m = s.orderBy("predicted", "index").limit(10), s.orderBy("macro", "index").limit(10)  # a top-k report
    from pyspark.sql import Window

    t = by_p.withColumn("k", F.row_number().over(Window.orderBy("predicted", "index")))  # ten rows
    reg = t.agg(*[(F.min(F.when(F.col("k") <= k, F.col("macro")))).alias(f"m{k}") for k in (1, 5, 10)], F.min_by("index", "k").alias("selected"))
    over = by_p.join(F.broadcast(by_m.select("index")), "index").agg((F.count("*") / 10).alias("top10_overlap"))
    ranks = average_rank(average_rank(s, [], "macro", "index", "ra"), [], "predicted", "index", "rb").agg(pearson(F.col("ra"), F.col("rb")).alias("spearman"), F.count("*").alias("n"))
    one = reg.first().asDict() | best.first().asDict() | over.first().asDict() | ranks.first().asDict()  # one row each
    row = (one["n"], one["selected"], one["spearman"], one["top10_overlap"], *[one[f"m{k}"] - one["best"] if one["best"] is not None else None for k in (1, 5, 10)])
    return rounded(spark.createDataFrame([row], "n long, selected long, spearman double, top10_overlap double, regret_1 double, regret_5 double, regret_10 double"))


def replacement_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean change of the predicted loss when a share of DELTA moves from one domain to another, over the recipes that have it."""
    r, names = recipes(spark, sf_dir)
    d = len(names)
    top = r.agg(*[F.max(F.get("p", F.lit(i))).alias(f"m{i}") for i in range(d)]).first()
    shift = lambda i, j: F.transform("p", lambda x, k: x + F.when(k == i, DELTA).when(k == j, -DELTA).otherwise(0.0))
    moves = F.array(*[F.struct(F.lit(names[j]).alias("from_domain"), F.lit(names[i]).alias("to_domain"), F.lit(float(top[f"m{i}"])).alias("largest"), F.get("p", F.lit(j)).alias("have"), F.get("p", F.lit(i)).alias("at"), shift(i, j).alias("q")) for i in range(d) for j in range(d) if i != j])
    m = r.select("p", F.explode(moves).alias("v")).where(F.col("v.have") >= DELTA)
    value = lambda c: mixture.linear_prediction(mixture.features(c, d), list(BETA))
    e = m.select("v.from_domain", "v.to_domain", (value(F.col("v.q")) - value(F.col("p"))).alias("effect"), (F.col("v.at") + DELTA <= F.col("v.largest") + 1e-12).cast("double").alias("inside"))
    return rounded(e.groupBy("from_domain", "to_domain").agg(F.count("*").alias("n"), F.avg("effect").alias("mean_change"), F.avg("inside").alias("inside_share")))


def quality_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mass in known domains, mean quality, and the entropy of the shares, per recipe."""
    r, names = recipes(spark, sf_dir)
    q = F.array(*[F.lit(x) for x in QUALITY])
    dot = F.aggregate(F.zip_with("p", q, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    ent = F.aggregate("p", F.lit(0.0), lambda a, x: a - x * F.ln(F.greatest(x, F.lit(1e-12))))
    known = F.get("p", F.lit(0)) + F.get("p", F.lit(1)) + F.get("p", F.lit(2))
    return rounded(r.select("index", dot.alias("quality"), ent.alias("entropy"), known.alias("known_mass"), F.element_at(F.zip_with("p", q, lambda a, b: a * b), -1).alias("tail")))


def median_bandwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = mixture.pair_summary(mixture.blocks(recipes(spark, sf_dir)[0].select("index", "p")), mixture.squared_pairs, [0.5])
    return rounded(spark.createDataFrame([(s["pairs"], s["q"][0], s["high"]) if s else (0, None, None)], "pairs long, median double, largest double"))


def grid_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, y = mixture.collect(_split(spark, sf_dir)[0].orderBy("index"), "p", "y")
    mixture.validate_pair(p, y)
    return rounded(mixture.cross_validate(spark, p, y))


def model_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors on held-out recipes of ridge, quadratic ridge, kernel ridge and quadratic ridge with a quality prior, each output."""
    train, held = (x.orderBy("index") for x in _split(spark, sf_dir))
    (p, y), (hp, hy) = mixture.collect(train, "p", "y"), mixture.collect(held, "p", "y")
    prior = mixture.anchor_prior(np.array(QUALITY), np.array([1, 1, 1, 0, 0], bool), 0.1)
    models = {"linear_ridge": mixture.Ridge(p, y, 0.01), "quadratic_ridge": mixture.Ridge(p, y, 0.01, 10, True), "rbf_kernel_ridge": mixture.Kernel(p, y, 0.25, 1e-4), "prior_ridge": mixture.Ridge(p, y, 0.01, 10, True, prior)}
    rows = []
    for name, m in models.items():
        e = hy - m.predict(hp)
        for k in range(hy.shape[1]):
            spread = float(((hy[:, k] - hy[:, k].mean()) ** 2).sum())
            rows.append((name, k, float(np.sqrt((e[:, k] ** 2).mean())), float(np.abs(e[:, k]).mean()), 1 - float((e[:, k] ** 2).sum()) / spread if spread > 1e-12 else None))
    return rounded(spark.createDataFrame(rows, "family string, output int, rmse double, mae double, r2 double"))


def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the error difference between linear and kernel ridge, held-out recipes resampled in pairs."""
    train, held = (x.orderBy("index") for x in _split(spark, sf_dir))
    (p, y), (hp, hy) = mixture.collect(train, "p", "y"), mixture.collect(held, "p", "y")
    a, b = (((hy - m.predict(hp)) ** 2).mean(1) for m in (mixture.Ridge(p, y, 0.01), mixture.Kernel(p, y, 0.25, 1e-4)))
    rng = np.random.default_rng(20260924)
    d = [float(np.sqrt(a[i].mean()) - np.sqrt(b[i].mean())) for i in (rng.integers(0, len(a), len(a)) for _ in range(2000))]
    return rounded(spark.createDataFrame([(len(a), *map(float, np.quantile(d, [0.025, 0.5, 0.975])))], "n long, low double, median double, high double"))


_D = 5
_R = f"""ty AS (SELECT event_type AS t, row_number() OVER (ORDER BY event_type) - 1 AS k FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL)),
ev AS (SELECT user_id, k, value FROM events JOIN ty ON ty.t = event_type WHERE user_id IS NOT NULL),
c AS (SELECT user_id AS "index", {', '.join(f'count(*) FILTER (WHERE k = {i})::DOUBLE AS n{i}' for i in range(_D))}, {', '.join(f'avg(value) FILTER (WHERE k = {i}) AS y{i}' for i in range(3))}, count(*)::DOUBLE AS n FROM ev GROUP BY 1),
rc AS (SELECT "index", {', '.join(f'n{i} / n AS p{i}' for i in range(_D))}, y0, y1, y2 FROM c WHERE y0 IS NOT NULL AND y1 IS NOT NULL AND y2 IS NOT NULL)"""
_X = [f"p{i}" for i in range(_D)] + [f"p{i} * p{j}" for i in range(_D) for j in range(i + 1, _D)]


def _value(p: list[str]) -> str:
    x = p + [f"({p[i]}) * ({p[j]})" for i in range(_D) for j in range(i + 1, _D)]
    return " + ".join(f"({e}) * {b}::DOUBLE" for e, b in zip(x, BETA))


_P = [f"p{i}" for i in range(_D)]
_L1 = " + ".join(f"abs(h.p{i} - t.p{i})" for i in range(_D))
_NEAR = f"""{_R}, h AS (SELECT * FROM rc WHERE "index" % 3 = 0), t AS (SELECT * FROM rc WHERE "index" % 3 <> 0),
nn AS (SELECT h."index", t."index" AS nearest, round({_L1}, 12) AS l1, h.y0 / t.y0 AS r0, h.y1 / t.y1 AS r1, h.y2 / t.y2 AS r2 FROM h, t QUALIFY row_number() OVER (PARTITION BY h."index" ORDER BY round({_L1}, 12), t."index") = 1)"""
_PRED = f"{_R}, s AS (SELECT \"index\", round((y0 + y1 + y2) / 3, 9) AS macro, round({_value(_P)}, 9) AS predicted FROM rc)"
ORACLE = {
    "pair_audit": f"WITH {_R} SELECT count(*) AS rows, count(DISTINCT \"index\") AS distinct_index, round(min({' + '.join(_P)}), 6) AS sum_min, round(max({' + '.join(_P)}), 6) AS sum_max, count(*) FILTER (WHERE abs({' + '.join(_P)} - 1) > 0.005) AS out_of_tolerance, count(*) FILTER (WHERE least({', '.join(_P)}) < 0) AS negative, count(*) FILTER (WHERE least(y0, y1, y2) <= 0) AS bad_losses, count(*) - count(DISTINCT [{', '.join(_P)}]) AS exact_duplicates FROM rc",
    "domain_support": f"WITH {_R}, x AS (SELECT unnest(range({_D})) AS k, unnest([{', '.join(_P)}]) AS v FROM rc) SELECT ty.t AS domain, count(*) FILTER (WHERE v > 0) AS positive, count(*) FILTER (WHERE v = 0) AS zero, round(max(v), 6) AS largest, round(avg(v), 6) AS mean FROM x JOIN ty ON ty.k = x.k GROUP BY 1",
    "scheffe_features": f"WITH {_R} SELECT \"index\", unnest(range({len(_X)}))::INT AS feature, unnest([{', '.join(f'round({e}, 8)' for e in _X)}]) AS value FROM rc",
    "gram_matrix": f"WITH {_R}, x AS (SELECT \"index\", unnest(range({len(_X)})) AS i, unnest([{', '.join(_X)}]) AS v FROM rc), z AS (SELECT \"index\", i AS j, v FROM x UNION ALL SELECT \"index\", unnest([-1, -2, -3]), unnest([y0, y1, y2]) FROM rc) SELECT x.i::INT AS i, z.j::INT AS j, round(sum(x.v * z.v), 5) AS s FROM x JOIN z ON z.\"index\" = x.\"index\" GROUP BY 1, 2",
    "l1_nearest": f'WITH {_NEAR} SELECT "index", nearest, round(l1, 8) AS l1, l1 < 1e-12 AS exact FROM nn',
    "extrapolation_ratios": f"WITH {_NEAR}, x AS (SELECT unnest([0, 1, 2]) AS output, unnest([r0, r1, r2]) AS r FROM nn) SELECT output::INT AS output, count(r) AS n, round(quantile_cont(r, 0.1), 6) AS p10, round(quantile_cont(r, 0.5), 6) AS median, round(quantile_cont(r, 0.9), 6) AS p90 FROM x GROUP BY 1",
    "near_duplicates": f"""WITH RECURSIVE {_R}, ed AS (SELECT h."index" AS a, t."index" AS b FROM rc h JOIN rc t ON {' + '.join(f'abs(round(h.p{i}, 12) - round(t.p{i}, 12))' for i in range(_D))} <= 0.03), w AS (SELECT "index" AS a, "index" AS b FROM rc UNION SELECT w.a, ed.b FROM w JOIN ed ON ed.a = w.b) SELECT a AS "index", min(b) AS group_index FROM w GROUP BY 1""",
    "ranking_regret": f"""WITH {_PRED}, k AS (SELECT *, row_number() OVER (ORDER BY predicted, "index") AS kp, row_number() OVER (ORDER BY macro, "index") AS km, rank() OVER (ORDER BY macro) + (count(*) OVER (PARTITION BY macro) - 1) / 2 AS ra, rank() OVER (ORDER BY predicted) + (count(*) OVER (PARTITION BY predicted) - 1) / 2 AS rb FROM s)
SELECT count(*) AS n, max("index") FILTER (WHERE kp = 1) AS selected, round(corr(ra, rb), 6) AS spearman, round(count(*) FILTER (WHERE kp <= 10 AND km <= 10) / 10, 6) AS top10_overlap, {', '.join(f'round(min(macro) FILTER (WHERE kp <= {q}) - min(macro), 6) AS regret_{q}' for q in (1, 5, 10))} FROM k""",
    "replacement_effects": f"WITH {_R}, mx AS (SELECT {', '.join(f'max(p{i}) AS m{i}' for i in range(_D))} FROM rc), e AS (" + " UNION ALL ".join(
        f"SELECT {j} AS j, {i} AS i, ({_value([f'p{k} + {DELTA}' if k == i else f'p{k} - {DELTA}' if k == j else f'p{k}' for k in range(_D)])}) - ({_value(_P)}) AS e, (p{i} + {DELTA} <= m{i} + 1e-12)::INT AS o FROM rc, mx WHERE p{j} >= {DELTA}" for i in range(_D) for j in range(_D) if i != j
    ) + ") SELECT a.t AS from_domain, b.t AS to_domain, count(*) AS n, round(avg(e), 6) AS mean_change, round(avg(o), 6) AS inside_share FROM e JOIN ty a ON a.k = e.j JOIN ty b ON b.k = e.i GROUP BY 1, 2",
    "quality_geometry": f"WITH {_R} SELECT \"index\", round({' + '.join(f'p{i} * {q}' for i, q in enumerate(QUALITY))}, 6) AS quality, round({' '.join(f'- p{i} * ln(greatest(p{i}, 1e-12))' for i in range(_D))}, 6) AS entropy, round(p0 + p1 + p2, 6) AS known_mass, round(p4 * {QUALITY[4]}, 6) AS tail FROM rc",
    "median_bandwidth": f"WITH {_R}, d AS (SELECT {' + '.join(f'power(a.p{i} - b.p{i}, 2)' for i in range(_D))} AS d FROM rc a JOIN rc b ON a.\"index\" < b.\"index\") SELECT count(*) AS pairs, round(quantile_cont(d, 0.5), 6) AS median, round(max(d), 6) AS largest FROM d",
}
QUERIES = {f.__name__: f for f in (pair_audit, domain_support, scheffe_features, gram_matrix, l1_nearest, extrapolation_ratios, near_duplicates, ranking_regret, replacement_effects, quality_geometry, median_bandwidth, grid_cv, model_evaluation, paired_bootstrap)}
