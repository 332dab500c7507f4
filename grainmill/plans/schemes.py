"""Scoring schemes: three groupings of the atomic utilities into concepts, weighted by criterion weights, under two normalisations of the relevance values.

Concepts are linear in the 25 atomic utilities, so one moment pass a normalisation gives all criterion weights, and all scores are one projection. Both are
kept for the session. Comparisons go through ``compare``: ranks and top fractions of long (group, a, b) rows without a window over a whole group.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions.signals import ATOMIC, FIELDS, QURATER
from grainmill.operators import identity, scoring
from grainmill.operators.order import POSITIONS, in_top, ks_distance, pearson, positions, quantiles, tied_rank
from grainmill.operators.resample import stratified_moments
from grainmill.operators.utility import apply_utilities, balanced_weights, imputed, with_medians
from grainmill.plans import parts
from grainmill.plans.experiments import _PERCENTILE, BOOTSTRAPS, TOP, _rank_knots, _rank_map, percentile_of
from grainmill.plans.quality import rounded
from grainmill.sources.shared import cut

PROFILES = ("frozen_original", "dsir_reference_rank")
SCHEMES = ("A22", "B23_flat", "B20_hierarchical")
SHRINKAGE = (0.0, 0.25, 0.5, 0.75, 1.0)
EQUAL_INNER = "B20_equal_inner"  #: the hierarchical scheme with even weights within its group of four


def atomic_names(profile: str) -> list[str]:
    return [f"d_{c}" if profile == PROFILES[1] and c in scoring.DSIR else f"u_{c}" for c in ATOMIC]


def profiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with their utilities, and the relevance values as percentiles of the reference (d_*), missing ones imputed first."""

    def make():
        rows, fitted = parts.fitted_records(spark, sf_dir)
        wide = with_medians(rows, "domain", fitted)
        wide = wide.select(*rows.columns, *[imputed(c, fitted).alias(f"d_{c}") for c in scoring.DSIR])
        keep = ["row_key", "domain", "membership", "a1", *[f"d_{c}" for c in scoring.DSIR]]
        u = apply_utilities(wide, "domain", fitted, keep).select(*keep[:4], *[f"u_{c}" for c in ATOMIC], *keep[4:])
        u = u.withColumn("domain", F.coalesce("domain", F.lit("(none)")))
        return cut(percentile_of(u, [c for c in u.columns if not c.startswith("d_")], {f"d_{c}": _rank_map(rows, c) for c in scoring.DSIR}))

    return parts.kept(spark, sf_dir, "profiled", make)


def _mapping(scheme: dict[str, dict[str, float]]) -> np.ndarray:
    return np.array([[scheme[c].get(a, 0.0) for c in scheme] for a in ATOMIC])


def fitted(spark: SparkSession, sf_dir: str) -> dict[str, dict]:
    """profile -> inner weights and schemes: name -> (concepts, atomic x concept matrix, criterion weights)."""

    def make():
        out = {}
        ref = balanced_weights(profiled(spark, sf_dir).where("a1"), "domain")
        for profile in PROFILES:
            total, sums, gram = scoring.moments(ref, atomic_names(profile), "w")
            at = [ATOMIC.index(q) for q in QURATER]
            inner = scoring.critic_of(total, sums[at], gram[np.ix_(at, at)])
            schemes = scoring.schemes(inner) | {EQUAL_INNER: scoring.schemes(np.full(4, 0.25))["B20_hierarchical"]}
            models = {}
            for name, scheme in schemes.items():
                m = _mapping(scheme)
                models[name] = (list(scheme), m, scoring.critic_of(total, m.T @ sums, m.T @ gram @ m))
            out[profile] = {"inner": inner, "models": models}
        return out

    return parts.kept(spark, sf_dir, "schemes", make)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_key, domain, membership, a1, and of every profile p and scheme s: q_p_s, penalty_p_s, rule_p_s; high_low_p, intensity_p, qurater_spread_p, dsir_spread_p."""

    def make():
        cols = []
        for i, (profile, model) in enumerate(fitted(spark, sf_dir).items()):
            u = [F.col(c) for c in atomic_names(profile)]
            for j, (names, m, w) in enumerate(model["models"].values()):
                concepts = [scoring.dot([u[k] for k in np.flatnonzero(m[:, c])], m[m[:, c] != 0, c]) for c in range(len(names))]
                pairs = scoring.scheme_edges(names)
                q, pen = scoring.dot(u, m @ w), scoring.penalty(concepts, pairs, scoring.interaction(w, pairs, scoring.ETA))
                cols += [q.alias(f"q_{i}_{j}"), pen.alias(f"penalty_{i}_{j}"), (q - pen).alias(f"rule_{i}_{j}")]
            d = scoring.diagnostics(u, np.full(len(u), 1 / len(u)))
            family = lambda members, u=u: [u[ATOMIC.index(c)] for c in members]
            spread = lambda c: F.greatest(*c) - F.least(*c)
            cols += [d["has_high_low_difference"].cast("double").alias(f"high_low_{i}"), d["conflict_intensity"].alias(f"intensity_{i}"), spread(family(QURATER)).alias(f"qurater_spread_{i}"), spread(family(scoring.DSIR)).alias(f"dsir_spread_{i}")]
        return cut(profiled(spark, sf_dir).select("row_key", "domain", "membership", "a1", *cols))

    return parts.kept(spark, sf_dir, "scheme_scores", make)


def compare(long: DataFrame, group: list[str]) -> DataFrame:
    """group, n, spearman, overlap of the top fifths, mean difference b - a and mean absolute difference, from rows (row_key, group, a, b).

    One ordering of the rows by either score gives its ranks and its top fifth.
    """
    long = long.withColumns({c: F.round(c, 12) for c in ("a", "b")})  # equal scores tie whatever the order of their sums
    one = positions(long, group, "a", "row_key").withColumn("ra", tied_rank()).withColumn("ta", in_top(TOP)).drop(*POSITIONS)
    both = positions(one, group, "b", "row_key").withColumn("rb", tied_rank()).withColumn("tb", in_top(TOP))
    gap = F.col("b") - F.col("a")
    out = both.groupBy(*group).agg(F.count("*").alias("n"), pearson(F.col("ra"), F.col("rb")).alias("spearman"), (F.count_if(F.col("ta") & F.col("tb")) / F.count_if("ta")).alias("overlap"), F.avg(gap).alias("mean_difference"), F.avg(F.abs(gap)).alias("mean_abs_difference"))
    return rounded(out, 4)


def compare_items(df: DataFrame, ids: list[str], items: list[tuple[dict, object, object]]) -> DataFrame:
    """``compare`` for several pairs of columns of one table (labels, a, b): rows carry the number of their pair, the labels come back at the end."""
    pairs = F.array(*[F.struct(F.lit(i).alias("_item"), F.col(a).alias("a"), F.col(b).alias("b")) for i, (_, a, b) in enumerate(items)])
    out = compare(df.select("row_key", *ids, F.explode(pairs).alias("x")).select("row_key", *ids, "x.*"), ["_item", *ids])
    labels = list(items[0][0])
    return out.select(*[F.element_at(F.array(*[F.lit(x[0][k]) for x in items]), F.col("_item") + 1).alias(k) for k in labels], *[c for c in out.columns if c != "_item"])


def _exploded(df: DataFrame) -> DataFrame:
    return df.withColumn("dataset", F.explode(identity.masks(F.col("membership"))))


def scheme_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the concepts and, through them, of the atomic utilities, per profile and scheme."""
    rows = []
    for profile, model in fitted(spark, sf_dir).items():
        for name in SCHEMES:
            names, m, w = model["models"][name]
            rows += [(profile, name, "concept", c, float(x)) for c, x in zip(names, w)] + [(profile, name, "atomic", c, float(x)) for c, x in zip(ATOMIC, m @ w)]
    return rounded(spark.createDataFrame(rows, "profile string, scheme string, level string, name string, weight double"), 5)


def scheme_weight_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile intervals of the concepts' weights over resamples within domains; the concepts stay as fitted."""
    ref, rows = balanced_weights(profiled(spark, sf_dir).where("a1"), "domain"), []
    for k, (profile, model) in enumerate(fitted(spark, sf_dir).items()):
        resampled = stratified_moments(ref, atomic_names(profile), "domain", "w", "row_key", BOOTSTRAPS, 20260924 + k)
        for name in SCHEMES:
            names, m, w = model["models"][name]
            q = np.quantile([scoring.critic_of(t, m.T @ s, m.T @ g @ m) for t, s, g in zip(*resampled)], [0.025, 0.975], axis=0)
            rows += [(profile, name, c, float(w[i]), float(q[0, i]), float(q[1, i])) for i, c in enumerate(names)]
    return rounded(spark.createDataFrame(rows, "profile string, scheme string, concept string, weight double, low double, high double"), 5)


def scheme_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per profile, source set, domain and scheme: size, mean, deviation, quantiles, the rule's mean and penalty, conflicts and spreads of the families."""
    fields = ("q", "rule", "penalty")
    own = ("high_low", "intensity", "qurater_spread", "dsir_spread")
    items = [F.struct(F.lit(p).alias("profile"), F.lit(s).alias("scheme"), *[F.col(f"{f}_{i}_{j}").alias(f) for f in fields], *[F.col(f"{f}_{i}").alias(f) for f in own]) for i, p in enumerate(PROFILES) for j, s in enumerate(SCHEMES)]
    long = cut(_exploded(scores(spark, sf_dir)).select("row_key", "dataset", "domain", F.explode(F.array(*items)).alias("x")).select("row_key", "dataset", "domain", "x.*"))
    g = ["profile", "scheme", "dataset", "domain"]
    q = quantiles(long, g, "q", [0.1, 0.5, 0.9], "row_key").select(*g, *[F.col("q")[i].alias(n) for i, n in enumerate(("p10", "median", "p90"))])
    m = long.groupBy(*g).agg(F.count("*").alias("n_unique"), F.avg("q").alias("mean"), F.stddev_pop("q").alias("std"), F.avg("rule").alias("rule_mean"), F.avg("penalty").alias("penalty_mean"), *[F.avg(f).alias(f"{f}_mean") for f in own])
    return rounded(m.join(q, g), 5)


def scheme_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and rule score of every record in every profile and scheme."""
    names = {f"{f}_{i}_{j}": f"{f}_{s}_{p}" for f in ("q", "rule") for i, p in enumerate(PROFILES) for j, s in enumerate(SCHEMES)}
    return rounded(scores(spark, sf_dir).select("row_key", *[F.col(k).alias(v) for k, v in names.items()]), 5)


def scheme_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other schemes against the first, by score and by rule score, per profile, source set and domain."""
    items = [({"profile": p, "scheme": s, "kind": k}, f"{k}_{i}_0", f"{k}_{i}_{j}") for i, p in enumerate(PROFILES) for j, s in enumerate(SCHEMES) if j for k in ("q", "rule")]
    return compare_items(_exploded(scores(spark, sf_dir)), ["dataset", "domain"], items)


def scheme_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean shift and distribution distance of the extensions' new records against the reference, per profile and scheme."""
    labels = F.split("membership", ";")
    new = F.when(F.col("domain") == "arxiv", F.array_contains(labels, "A2")).when(F.col("domain") == "github", F.array_contains(labels, "A3"))
    items = [F.struct(F.lit(p).alias("profile"), F.lit(s).alias("scheme"), F.round(f"q_{i}_{j}", 9).alias("q")) for i, p in enumerate(PROFILES) for j, s in enumerate(SCHEMES)]
    s = cut(scores(spark, sf_dir).where(F.col("a1") | new).where(F.col("domain").isin("arxiv", "github")).select("row_key", "domain", "a1", F.explode(F.array(*items)).alias("x")).select("row_key", "domain", "a1", "x.*"))
    g = ["profile", "scheme", "domain"]
    shift = s.groupBy(*g).agg((F.avg(F.when(~F.col("a1"), F.col("q"))) - F.avg(F.when(F.col("a1"), F.col("q")))).alias("mean_shift"))
    return rounded(ks_distance(s, g, "q", F.col("a1"), "row_key").join(shift, g), 5)


def shrinkage_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's scores with criterion weights shrunk towards even ones, against those without, per profile, scheme, shrinkage and domain."""
    cols, items, shrunk = [], [], []
    for i, (profile, model) in enumerate(fitted(spark, sf_dir).items()):
        u = [F.col(c) for c in atomic_names(profile)]
        for j, name in enumerate(SCHEMES):
            names, m, w = model["models"][name]
            cols += [scoring.dot(u, m @ w).alias(f"q_{i}_{j}"), scoring.dot(u, m.mean(1)).alias(f"e_{i}_{j}")]
            items += [({"profile": profile, "scheme": name, "xi": xi}, f"q_{i}_{j}", f"s_{i}_{j}_{k}") for k, xi in enumerate(SHRINKAGE)]
            shrunk += [(F.col(f"q_{i}_{j}") * xi + F.col(f"e_{i}_{j}") * (1 - xi)).alias(f"s_{i}_{j}_{k}") for k, xi in enumerate(SHRINKAGE)]
    both = cut(profiled(spark, sf_dir).where("a1").select("row_key", "domain", *cols))  # fitted and even weights; all shrunk ones lie between
    return compare_items(both.select("*", *shrunk), ["domain"], items)


def inner_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hierarchical scheme with even inner weights against the fitted ones, per profile, source set and domain."""
    items = [({"profile": p}, f"q_{i}_2", f"q_{i}_3") for i, p in enumerate(PROFILES)]
    return compare_items(_exploded(scores(spark, sf_dir)), ["dataset", "domain"], items)


def normalisation_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores under the second normalisation against the first, per scheme, for the reference and the new records of the extensions."""
    items = [({"scheme": s}, f"q_0_{j}", f"q_1_{j}") for j, s in enumerate(SCHEMES)]
    return compare_items(_exploded(scores(spark, sf_dir)).where(F.col("dataset").isin("A1", "A2_new", "A3_new")), ["dataset", "domain"], items)


def equal_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scheme and profile against even weights of the 22 fields, by score and rule score; both tables must cover the same records, once each."""
    u, s = parts.utilities(spark, sf_dir), scores(spark, sf_dir)
    z, n = [F.col(f"z_{f}") for f in FIELDS], len(FIELDS)
    pairs = scoring.edges(list(scoring.PAIRS), list(FIELDS))
    even = np.full(n, 1 / n)
    equal = u.select("row_key", scoring.dot(z, even).alias("e_q"), (scoring.dot(z, even) - scoring.penalty(z, pairs, scoring.interaction(even, pairs, scoring.ETA))).alias("e_rule"))
    j = merge_one_to_one(s, equal, "row_key")
    items = [({"profile": p, "scheme": c, "kind": k}, f"e_{k}", f"{k}_{i}_{x}") for i, p in enumerate(PROFILES) for x, c in enumerate(SCHEMES) for k in ("q", "rule")]
    return compare_items(_exploded(j), ["dataset", "domain"], items)


def merge_one_to_one(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Inner join on a key that is unique, not NULL and covered the same by both sides; else an error that counts what differs."""
    sides = a.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(key, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    bad = sides.groupBy(key).agg(F.sum("_a").alias("a"), F.sum("_b").alias("b")).where(f"a <> 1 OR b <> 1 OR {key} IS NULL").agg(F.count_if(F.expr("a > 1 OR b > 1")).alias("repeated"), F.count_if(F.expr("a = 0 OR b = 0")).alias("unmatched"), F.count_if(F.col(key).isNull()).alias("missing")).first()
    if bad.repeated or bad.unmatched or bad.missing:
        raise ValueError(f"not one to one on {key}: {bad.repeated} repeated, {bad.unmatched} unmatched, {bad.missing} NULL keys")
    return a.join(b, key)


# SQL -------------------------------------------------------------------------------------------------------------------
def _lists() -> str:
    """Concept names and values of each scheme from the wide atomic columns and the inner weights i0..i3."""
    single = [c for f in FIELDS if f not in ("qurater", *scoring.DSIR) for c in [f]]
    group = lambda w: "(" + " + ".join(f"u_{q} * {x}" for q, x in zip(QURATER, w)) + ")"
    dsir = "(u_dsir_books + u_dsir_wiki + u_dsir_math) / 3"
    even = ["0.25::DOUBLE"] * 4
    of = {
        "A22": [(f, group(even) if f == "qurater" else f"u_{f}") for f in FIELDS],
        "B23_flat": [(c, f"u_{c}") for c in [*single, *QURATER]] + [("dsir_group", dsir)],
        "B20_hierarchical": [(c, f"u_{c}") for c in single] + [("qurater_group", group(["i0", "i1", "i2", "i3"])), ("dsir_group", dsir)],
        EQUAL_INNER: [(c, f"u_{c}") for c in single] + [("qurater_group", group(even)), ("dsir_group", dsir)],
    }
    return " UNION ALL ".join(f"SELECT profile, '{s}' AS scheme, row_key, a1, w, unnest([{', '.join(repr(n) for n, _ in c)}]) AS concept, unnest([{', '.join(e for _, e in c)}]) AS v FROM ui" for s, c in of.items())


def _critic_sql(source: str, name: str, keys: str) -> str:
    """{name}(keys, concept, weight): criterion weights of long rows (keys, row_key, concept, w, v)."""
    same = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return f"""{name}c AS (SELECT *, v - sum(w * v) OVER (PARTITION BY {keys}, concept) / sum(w) OVER (PARTITION BY {keys}, concept) AS d FROM {source}),
{name}v AS (SELECT {', '.join('a.' + k for k in keys.split(', '))}, a.concept AS ca, b.concept AS cb, sum(a.w * a.d * b.d) / sum(a.w) AS c FROM {name}c a JOIN {name}c b ON a.row_key = b.row_key AND {same} GROUP BY ALL),
{name}s AS (SELECT {keys}, ca AS concept, sqrt(greatest(c, 0)) AS s FROM {name}v WHERE ca = cb),
{name}i AS (SELECT {', '.join('x.' + k for k in keys.split(', '))}, x.ca AS concept, any_value(a.s) * sum(1 - CASE WHEN x.ca = x.cb THEN 1 WHEN a.s * b.s > 1e-14 THEN greatest(-1, least(1, x.c / (a.s * b.s))) ELSE 0 END) AS i
  FROM {name}v x JOIN {name}s a ON a.concept = x.ca AND {' AND '.join(f'a.{k} = x.{k}' for k in keys.split(', '))} JOIN {name}s b ON b.concept = x.cb AND {' AND '.join(f'b.{k} = x.{k}' for k in keys.split(', '))} GROUP BY ALL),
{name} AS (SELECT {keys}, concept, i / sum(i) OVER (PARTITION BY {keys}) AS weight FROM {name}i)"""


_U = [f"u_{c}" for c in ATOMIC]
_EDGES = []
for _s in (*SCHEMES, EQUAL_INNER):
    _names = list(scoring.schemes(np.full(4, 0.25))["B20_hierarchical" if _s == EQUAL_INNER else _s])
    _pairs = scoring.scheme_edges(_names)
    _EDGES += [(_s, _names[a], _names[b], sum(a in p for p in _pairs), sum(b in p for p in _pairs)) for a, b in _pairs]
_FIT = f"""{parts.UTILITIES}, {_rank_knots()},
dl AS (SELECT row_key, unnest([{', '.join(repr(c) for c in scoring.DSIR)}]) AS field, unnest([{', '.join(scoring.DSIR)}]) AS v FROM i),
dp AS (SELECT x.row_key, x.field, {_PERCENTILE} AS p FROM dl x JOIN ends ON ends.field = x.field LEFT JOIN kn ON kn.field = x.field AND x.v >= kn.v AND (x.v < kn.v2 OR kn.v2 IS NULL)),
dw AS (SELECT row_key, {', '.join(f"max(p) FILTER (WHERE field = '{c}') AS {c}" for c in scoring.DSIR)} FROM dp GROUP BY row_key),
up AS (SELECT '{PROFILES[0]}' AS profile, row_key, coalesce(domain, '(none)') AS domain, membership, a1, {', '.join(_U)} FROM u UNION ALL
  SELECT '{PROFILES[1]}', u.row_key, coalesce(domain, '(none)'), membership, a1, {', '.join(f'dw.{c}' if c in scoring.DSIR else f'u_{c}' for c in ATOMIC)} FROM u JOIN dw ON dw.row_key = u.row_key),
uw AS (SELECT *, CASE WHEN a1 THEN 1::DOUBLE / ((SELECT count(DISTINCT domain) FROM up WHERE a1) * count(*) FILTER (WHERE a1) OVER (PARTITION BY profile, domain)) END AS w FROM up),
il0 AS (SELECT profile, row_key, w, unnest([{', '.join(repr(q) for q in QURATER)}]) AS concept, unnest([{', '.join(f'u_{q}' for q in QURATER)}]) AS v FROM uw WHERE a1),
{_critic_sql('il0', 'inn', 'profile')},
ui AS (SELECT uw.*, {', '.join(f"(SELECT weight FROM inn WHERE inn.profile = uw.profile AND concept = '{q}') AS i{k}" for k, q in enumerate(QURATER))} FROM uw),
cl AS ({_lists()}), cr AS (SELECT * FROM cl WHERE a1), {_critic_sql('cr', 'ow', 'profile, scheme')}"""
_SCORES = f"""{_FIT}, ed(scheme, ca, cb, da, db) AS (VALUES {', '.join(map(str, _EDGES))}),
sq AS (SELECT cl.profile, cl.scheme, row_key, sum(v * weight) AS q FROM cl JOIN ow ON ow.profile = cl.profile AND ow.scheme = cl.scheme AND ow.concept = cl.concept GROUP BY ALL),
th AS (SELECT x.profile, ed.scheme, ca, cb, {scoring.ETA}::DOUBLE * least(x.weight / da, y.weight / db) AS theta FROM ed JOIN ow x ON x.scheme = ed.scheme AND x.concept = ca JOIN ow y ON y.scheme = ed.scheme AND y.concept = cb AND y.profile = x.profile),
sp AS (SELECT a.profile, a.scheme, a.row_key, sum(theta * abs(a.v - b.v)) AS penalty FROM th JOIN cl a ON a.profile = th.profile AND a.scheme = th.scheme AND a.concept = ca JOIN cl b ON b.profile = a.profile AND b.scheme = a.scheme AND b.row_key = a.row_key AND b.concept = cb GROUP BY ALL),
ss AS (SELECT sq.profile, sq.scheme, up.row_key, domain, membership, a1, q, penalty, q - penalty AS rule FROM sq JOIN sp ON sp.profile = sq.profile AND sp.scheme = sq.scheme AND sp.row_key = sq.row_key JOIN up ON up.profile = sq.profile AND up.row_key = sq.row_key)"""


def _compare_sql(source: str, g: str) -> str:
    """What ``compare`` gives, of rows (row_key, g, a, b)."""
    rank = lambda c: f"(rank() OVER (PARTITION BY {g} ORDER BY {c}) + (count(*) OVER (PARTITION BY {g}, {c}) - 1) / 2)::DOUBLE"
    top = lambda c: f"row_number() OVER (PARTITION BY {g} ORDER BY {c} DESC, row_key) <= greatest(1, ceil(round(count(*) OVER (PARTITION BY {g}) * {TOP}::DOUBLE, 9)))"
    return f"""WITH {_SCORES}, lr AS (SELECT row_key, {g}, round(a, 12) AS a, round(b, 12) AS b FROM ({source})), lk AS (SELECT *, {rank('a')} AS ra, {rank('b')} AS rb, {top('a')} AS ta, {top('b')} AS tb FROM lr)
SELECT {g}, count(*) AS n, round(CASE WHEN stddev_pop(ra) > 1e-12 AND stddev_pop(rb) > 1e-12 THEN corr(ra, rb) END, 4) AS spearman, round(count(*) FILTER (WHERE ta AND tb) / count(*) FILTER (WHERE ta), 4) AS overlap,
round(avg(b - a), 4) + 0 AS mean_difference, round(avg(abs(b - a)), 4) AS mean_abs_difference FROM lk GROUP BY {g}"""


_OWN = " UNION ALL ".join("SELECT '" + p + "' AS profile, row_key, " + f"""(({' + '.join(f'greatest({c} - 0.75, 0)' for c in _U)}) > 0 AND ({' + '.join(f'greatest(0.25 - {c}, 0)' for c in _U)}) > 0)::INT AS high_low,
(({' + '.join(f'greatest({c} - 0.75, 0)' for c in _U)}) / 0.25) * (({' + '.join(f'greatest(0.25 - {c}, 0)' for c in _U)}) / 0.25) / 300 AS intensity,
greatest({', '.join(f'u_{q}' for q in QURATER)}) - least({', '.join(f'u_{q}' for q in QURATER)}) AS qurater_spread, greatest({', '.join(f'u_{q}' for q in scoring.DSIR)}) - least({', '.join(f'u_{q}' for q in scoring.DSIR)}) AS dsir_spread FROM up WHERE profile = '{p}'""" for p in PROFILES)
_KINDS = "(SELECT *, 'q' AS kind, q AS x FROM ss UNION ALL SELECT *, 'rule', rule FROM ss)"
_EVEN = scoring.edges(list(scoring.PAIRS), list(FIELDS))
_EVEN_PENALTY = " + ".join(f"{scoring.ETA / 22 * min(1 / sum(a in p for p in _EVEN), 1 / sum(b in p for p in _EVEN))!r}::DOUBLE * abs(z_{FIELDS[a]} - z_{FIELDS[b]})" for a, b in _EVEN)
_MEAN22 = "(" + " + ".join(f"z_{f}" for f in FIELDS) + ") / 22"
ORACLE = {
    "scheme_weights": f"""WITH {_FIT}, cu AS (SELECT profile, scheme, concept, weight FROM ow WHERE scheme <> '{EQUAL_INNER}')
SELECT profile, scheme, 'concept' AS level, concept AS name, round(weight, 5) AS weight FROM cu UNION ALL
SELECT cu.profile, cu.scheme, 'atomic', a.name, round(sum(weight * CASE WHEN concept = a.name THEN 1 WHEN concept = 'qurater' AND a.name LIKE 'qurater_%' THEN 0.25 WHEN concept = 'dsir_group' AND a.name LIKE 'dsir_%' THEN 1 / 3::DOUBLE
  WHEN concept = 'qurater_group' THEN coalesce((SELECT inn.weight FROM inn WHERE inn.profile = cu.profile AND inn.concept = a.name), 0) ELSE 0 END), 5) FROM cu, (SELECT unnest([{', '.join(repr(c) for c in ATOMIC)}]) AS name) a GROUP BY ALL""",
    "scheme_scores": f"WITH {_SCORES} SELECT row_key, " + ", ".join(f"round(max({f}) FILTER (WHERE profile = '{p}' AND scheme = '{s}'), 5) AS {f}_{s}_{p}" for f in ("q", "rule") for p in PROFILES for s in SCHEMES) + " FROM ss GROUP BY row_key",
    "scheme_summary": f"""WITH {_SCORES}, own AS ({_OWN}) SELECT ss.profile, ss.scheme, dataset, domain, count(*) AS n_unique, round(avg(q), 5) AS mean, round(stddev_pop(q), 5) AS std, round(avg(rule), 5) AS rule_mean, round(avg(penalty), 5) AS penalty_mean,
round(avg(high_low), 5) AS high_low_mean, round(avg(intensity), 5) AS intensity_mean, round(avg(qurater_spread), 5) AS qurater_spread_mean, round(avg(dsir_spread), 5) AS dsir_spread_mean, round(quantile_cont(q, 0.1), 5) AS p10, round(quantile_cont(q, 0.5), 5) AS median, round(quantile_cont(q, 0.9), 5) AS p90
FROM (SELECT ss.*, m.dataset FROM ss, {parts.MASKS}) ss JOIN own ON own.profile = ss.profile AND own.row_key = ss.row_key WHERE scheme <> '{EQUAL_INNER}' GROUP BY 1, 2, 3, 4""",
    "scheme_comparison": _compare_sql(f"SELECT b.row_key, b.profile, b.scheme, b.kind, b.dataset, b.domain, a.x AS a, b.x AS b FROM (SELECT k.*, m.dataset FROM {_KINDS} k, {parts.MASKS}) b JOIN {_KINDS} a ON a.row_key = b.row_key AND a.profile = b.profile AND a.kind = b.kind AND a.scheme = 'A22' WHERE b.scheme IN ('B23_flat', 'B20_hierarchical')", "profile, scheme, kind, dataset, domain"),
    "scheme_extension": f"""WITH {_SCORES}, e AS (SELECT profile, scheme, domain, a1, round(q, 9) AS x FROM ss WHERE scheme <> '{EQUAL_INNER}' AND ((domain = 'arxiv' AND (a1 OR contains(membership, 'A2'))) OR (domain = 'github' AND (a1 OR contains(membership, 'A3'))))),
eg AS (SELECT DISTINCT profile, scheme, domain, x, sum(a1::INT) OVER (PARTITION BY profile, scheme, domain ORDER BY x) AS ca, sum((NOT a1)::INT) OVER (PARTITION BY profile, scheme, domain ORDER BY x) AS cb, sum(a1::INT) OVER (PARTITION BY profile, scheme, domain) AS na, sum((NOT a1)::INT) OVER (PARTITION BY profile, scheme, domain) AS nb FROM e),
em AS (SELECT profile, scheme, domain, avg(x) FILTER (WHERE NOT a1) - avg(x) FILTER (WHERE a1) AS s FROM e GROUP BY 1, 2, 3)
SELECT eg.profile, eg.scheme, eg.domain, na::BIGINT AS n_a, nb::BIGINT AS n_b, round(max(abs(ca / na::DOUBLE - cb / nb::DOUBLE)), 5) AS ks, round(any_value(s), 5) AS mean_shift FROM eg JOIN em ON em.profile = eg.profile AND em.scheme = eg.scheme AND em.domain = eg.domain GROUP BY 1, 2, 3, na, nb""",
    "shrinkage_sensitivity": _compare_sql(f"SELECT t.row_key, t.profile, t.scheme, t.xi, up.domain, t.q AS a, t.xi * t.q + (1 - t.xi) * t.e AS b FROM (SELECT sq.*, e, xi FROM sq JOIN (SELECT profile, scheme, row_key, avg(v) AS e FROM cr GROUP BY ALL) ev ON ev.profile = sq.profile AND ev.scheme = sq.scheme AND ev.row_key = sq.row_key, (SELECT unnest({list(SHRINKAGE)})::DOUBLE AS xi) WHERE sq.scheme <> '{EQUAL_INNER}') t JOIN up ON up.profile = t.profile AND up.row_key = t.row_key", "profile, scheme, xi, domain"),
    "inner_sensitivity": _compare_sql(f"SELECT a.row_key, a.profile, a.dataset, a.domain, a.q AS a, b.q AS b FROM (SELECT ss.*, m.dataset FROM ss, {parts.MASKS}) a JOIN ss b ON b.profile = a.profile AND b.row_key = a.row_key AND b.scheme = '{EQUAL_INNER}' WHERE a.scheme = 'B20_hierarchical'", "profile, dataset, domain"),
    "normalisation_sensitivity": _compare_sql(f"SELECT a.row_key, a.scheme, a.dataset, a.domain, a.q AS a, b.q AS b FROM (SELECT ss.*, m.dataset FROM ss, {parts.MASKS}) a JOIN ss b ON b.scheme = a.scheme AND b.row_key = a.row_key AND b.profile = '{PROFILES[1]}' WHERE a.profile = '{PROFILES[0]}' AND a.scheme <> '{EQUAL_INNER}' AND a.dataset IN ('A1', 'A2_new', 'A3_new')", "scheme, dataset, domain"),
    "equal_baseline": _compare_sql(f"SELECT b.row_key, b.profile, b.scheme, b.kind, b.dataset, b.domain, CASE WHEN b.kind = 'q' THEN {_MEAN22} ELSE {_MEAN22} - ({_EVEN_PENALTY}) END AS a, b.x AS b FROM (SELECT k.*, m.dataset FROM {_KINDS} k, {parts.MASKS}) b JOIN z ON z.row_key = b.row_key WHERE b.scheme <> '{EQUAL_INNER}'", "profile, scheme, kind, dataset, domain"),
}
QUERIES = {f.__name__: f for f in (scheme_weights, scheme_weight_intervals, scheme_scores, scheme_summary, scheme_comparison, scheme_extension, shrinkage_sensitivity, inner_sensitivity, normalisation_sensitivity, equal_baseline)}
