"""Queries of records, utilities, scores and domain summaries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainmill.functions.signals import ATOMIC, FIELDS, ORDINAL, SQL_ORDINALS, decode
from grainmill.operators import identity, scoring
from grainmill.operators.order import quantiles
from grainmill.operators.utility import balanced_weights, dictionary, fit, unpivot
from grainmill.plans import parts
from grainmill.sources.shared import cut

UNIFORM = np.full(len(FIELDS), 1 / len(FIELDS))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded; -0.0 becomes 0.0."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def decode_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = parts.table(spark, sf_dir, "q1", "row_key", *FIELDS)
    return rounded(decode(q, ["row_key"], with_ordinal=True))


def decode_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = parts.table(spark, sf_dir, "q1", "row_key", "id", "source_label", *FIELDS)
    return decode(q, ["row_key", "id", "source_label"], with_issues=True).select("source_label", "row_key", "id", F.explode("issues").alias("issue"))


def dedup_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = identity.first_seen(parts.q1(spark, sf_dir).select("uid", "row_key", "source_label", "domain", "id"))
    return one.select("row_key", "source_label", "domain", "id", "membership")


def source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = parts.q1(spark, sf_dir)
    bad = F.size(F.array_compact(F.array(*[identity_issue for identity_issue in _issues()]))) > 0
    return identity.source_audit(q.withColumn("_bad", bad), F.col("_bad"))


def _issues():
    from grainmill.functions.signals import issue

    return [issue(f) for f in FIELDS]


def identity_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.conflicts(parts.q1(spark, sf_dir).select("domain", "id", "uid"))


def membership_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = identity.first_seen(parts.q1(spark, sf_dir).select("uid", "row_key", "source_label", "domain"))
    return one.select("domain", F.explode(identity.masks(F.col("membership"))).alias("dataset")).groupBy("dataset", "domain").agg(F.count("*").alias("n"))


def balanced_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = balanced_weights(parts.records(spark, sf_dir).where("a1").select("domain", "row_key"), "domain")
    per = w.groupBy("domain").agg(F.count("*").alias("n"), F.sum("w").alias("total"), F.max("w").alias("w"), F.sum(F.col("w") * F.col("w")).alias("w2"))
    per = per.withColumn("effective_n", 1 / F.sum("w2").over(Window.partitionBy()))  # one row per domain
    return rounded(per.drop("w2"), 9)


def weighted_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted medians and bounds of the 25 columns."""
    rows, fitted = parts.fitted_records(spark, sf_dir)
    out = [(r["column"], r["kind"], r["direction"], r["log1p"], float(fitted.medians[r["column"]]), r["lower"], r["upper"]) for r in dictionary(fitted)]
    return rounded(spark.createDataFrame(out, "column string, kind string, direction string, log1p boolean, median double, lower double, upper double"))


def domain_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, fitted = parts.fitted_records(spark, sf_dir)
    out = [(d or None, c, float(v)) for d, m in fitted.domain_medians.items() for c, v in m.items()]
    return rounded(spark.createDataFrame(out, "domain string, column string, median double"))


def utility_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(parts.utilities(spark, sf_dir).select("row_key", *[f"z_{f}" for f in FIELDS], "valid_coverage"))


def utility_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = parts.utilities(spark, sf_dir)
    long = unpivot(u, ["row_key"], [f"u_{c}" for c in ATOMIC], "column", "u")
    return rounded(long.groupBy(F.substring("column", 3, 100).alias("column")).agg(F.avg("u").alias("mean"), F.stddev_pop("u").alias("sd"), F.avg((F.col("u") == 0).cast("double")).alias("at_zero"), F.avg((F.col("u") == 1).cast("double")).alias("at_one")), 5)


def critic_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = parts.utilities(spark, sf_dir).where("a1")
    w = scoring.critic(balanced_weights(u, "domain"), [f"z_{f}" for f in FIELDS], "w")
    return rounded(spark.createDataFrame([(f, float(x), float(y)) for f, x, y in zip(FIELDS, w, scoring.shrink(w, 0.5))], "field string, weight double, half_shrunk double"))


def _scored(spark: SparkSession, sf_dir: str, keep: list[str]) -> DataFrame:
    u = parts.utilities(spark, sf_dir)
    critic = scoring.critic(balanced_weights(u.where("a1"), "domain"), [f"z_{f}" for f in FIELDS], "w")
    return cut(scoring.scores(u, scoring.shrink(critic, 0.0), critic, keep))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scores and scenario scores of every record, its diagnostics, and whether its dispersion stands out in its domain."""
    s = cut(_scored(spark, sf_dir, ["row_key", "valid_coverage", "domain", "a1"]))
    return rounded(scoring.outliers(s, "domain", "dispersion", F.col("a1"), "row_key").drop("domain", "a1"), 5)


def huber_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robust centre of each record's utilities; a fixed number of steps, the SQL takes as many."""
    u = parts.utilities(spark, sf_dir)
    return rounded(scoring.with_huber(u.select("row_key", *Z), Z, "q_huber"), 5)


def mad_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = cut(_scored(spark, sf_dir, ["row_key", "domain", "a1"]).select("row_key", "domain", "a1", "dispersion"))
    out = scoring.outliers(s, "domain", "dispersion", F.col("a1"), "row_key")
    return rounded(out.select("row_key", "within_domain_r", "within_domain_outlier"), 4)


def domain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source set and domain: sizes, means, quantiles, the trimmed and the word-weighted mean."""
    s = _scored(spark, sf_dir, ["row_key", "domain", "membership", "valid_coverage", "rps_doc_word_count"])
    rows = cut(s.select("row_key", "domain", F.explode(identity.masks(F.col("membership"))).alias("dataset"), "q_base", "q_rule", "q_primary", "penalty", "conflict_intensity", F.col("has_high_low_difference").cast("double").alias("conflict"), "valid_coverage", F.when(F.col("rps_doc_word_count") > 0, F.col("rps_doc_word_count")).alias("words")))
    rows = rows.withColumn("domain", F.coalesce("domain", F.lit("(none)")))
    g = ["dataset", "domain"]
    q = quantiles(rows, g, "q_primary", [0.05, 0.1, 0.5, 0.9, 0.95], "row_key").withColumnRenamed("n", "n_unique")
    j = rows.join(q, g)
    inside = F.col("q_primary").between(F.col("q")[0], F.col("q")[4])
    out = j.groupBy(*g).agg(
        F.count("*").alias("n_unique"), F.avg("q_base").alias("q_base_mean"), F.avg("q_rule").alias("q_rule_mean"), F.avg("q_primary").alias("q_primary_mean"),
        F.first(F.col("q")[2]).alias("median"), F.first(F.col("q")[1]).alias("p10"), F.first(F.col("q")[3]).alias("p90"), F.avg(F.when(inside, F.col("q_primary"))).alias("trimmed_mean"),
        F.try_divide(F.sum(F.when(F.col("words").isNotNull(), F.col("q_primary") * F.col("words"))), F.sum("words")).alias("word_weighted"), F.avg(F.col("words").isNotNull().cast("double")).alias("words_valid"),
        F.avg("conflict").alias("conflict_rate"), F.avg("conflict_intensity").alias("conflict_intensity"), F.avg("penalty").alias("mean_penalty"), F.avg("valid_coverage").alias("mean_valid_coverage"),
    )
    return rounded(out, 5)


def scenario_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir, ["row_key", "domain", "membership"])
    names = [c for c in s.columns if c.startswith("q_")]
    one = s.select(F.coalesce("domain", F.lit("(none)")).alias("domain"), F.explode(identity.masks(F.col("membership"))).alias("dataset"), *names)
    wide = one.groupBy("dataset", "domain").agg(*[F.avg(c).alias(c) for c in names])  # wide first: the rows aren't multiplied
    return rounded(unpivot(wide, ["dataset", "domain"], names, "scenario", "mean"), 5)


def extension_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of the extensions and their new parts to the reference, for the two extended domains."""
    s = domain_summary(spark, sf_dir).where(F.col("domain").isin("arxiv", "github"))
    a = s.where("dataset = 'A1'").select("domain", F.col("q_primary_mean").alias("q"), F.col("conflict_rate").alias("c"), F.col("mean_penalty").alias("p"))
    b = s.where("(domain = 'arxiv' AND dataset IN ('A2', 'A2_new', 'union')) OR (domain = 'github' AND dataset IN ('A3', 'A3_new', 'union'))")
    return rounded(b.join(a, "domain").select("domain", "dataset", (F.col("q_primary_mean") - F.col("q")).alias("delta_q"), (F.col("conflict_rate") - F.col("c")).alias("delta_conflict"), (F.col("mean_penalty") - F.col("p")).alias("delta_penalty")), 4)


Z = [f"z_{f}" for f in FIELDS]
_MEAN = "(" + " + ".join(Z) + ") / 22"
_PAIRS = scoring.edges(list(scoring.PAIRS), list(FIELDS))


_ALT = [f"coalesce(o_{f}, z_{f})" if f in ORDINAL else f"z_{f}" for f in FIELDS]
_WEAK = scoring.downweighted(UNIFORM)


def _penalty_sql(eta: float, z: list[str] = Z, weights: np.ndarray = UNIFORM) -> str:
    """Reference formula: for each pair eta times the lesser of its two weights, each divided among the pairs of its field, times the difference."""
    degree = [sum(i in p for p in _PAIRS) for i in range(len(FIELDS))]
    return " + ".join(f"{eta * min(float(weights[a]) / degree[a], float(weights[b]) / degree[b])!r}::DOUBLE * abs({z[a]} - {z[b]})" for a, b in _PAIRS)


_CRITIC = f"""ref2 AS (SELECT *, 1::DOUBLE / ((SELECT count(DISTINCT coalesce(domain, '')) FROM z WHERE a1) * count(*) OVER (PARTITION BY domain)) AS w FROM z WHERE a1),
zl AS (SELECT row_key, w, unnest([{', '.join(repr(f) for f in FIELDS)}]) AS field, unnest([{', '.join(Z)}]) AS v FROM ref2),
mu AS (SELECT field, sum(w * v) / sum(w) AS m FROM zl GROUP BY field),
cn AS (SELECT zl.row_key, zl.w, zl.field, zl.v - mu.m AS v FROM zl JOIN mu ON mu.field = zl.field),
cv AS (SELECT a.field AS fa, b.field AS fb, sum(a.w * a.v * b.v) / sum(a.w) AS c FROM cn a JOIN cn b ON a.row_key = b.row_key GROUP BY 1, 2),
sd AS (SELECT fa AS field, sqrt(greatest(c, 0)) AS s FROM cv WHERE fa = fb),
inf AS (SELECT cv.fa AS field, any_value(x.s) * sum(1 - CASE WHEN cv.fa = cv.fb THEN 1 WHEN x.s * y.s > 1e-14 THEN greatest(-1, least(1, c / (x.s * y.s))) ELSE 0 END) AS i
        FROM cv JOIN sd x ON x.field = cv.fa JOIN sd y ON y.field = cv.fb GROUP BY 1),
cw2 AS (SELECT field, i / sum(i) OVER () AS weight FROM inf)"""
_QC = " + ".join(f"z_{f} * (SELECT weight FROM cw2 WHERE field = '{f}')" for f in FIELDS)
_H = " + ".join(f"greatest({c} - 0.75, 0)" for c in Z)
_L = " + ".join(f"greatest(0.25 - {c}, 0)" for c in Z)
_HUBER = f"""hv AS (SELECT row_key, [{', '.join(Z)}] AS v FROM z),
hs AS (SELECT row_key, v, list_aggregate(v, 'median') AS m, 0 AS k FROM hv UNION ALL
  SELECT row_key, v, list_sum(list_transform(v, lambda x: x * least(1, 0.15::DOUBLE / greatest(abs(x - m), 1e-12)))) / list_sum(list_transform(v, lambda x: least(1, 0.15::DOUBLE / greatest(abs(x - m), 1e-12)))), k + 1 FROM hs WHERE k < 30),
hb AS (SELECT row_key, m AS q_huber FROM hs WHERE k = 30)"""
_SCORED = f"""s AS (SELECT z.row_key, domain, membership, a1, words, valid_coverage, {_MEAN} AS q_base, {_penalty_sql(0.25)} AS penalty,
  sqrt(greatest(({' + '.join(f'{c} * {c}' for c in Z)}) / 22 - power({_MEAN}, 2), 0)) AS dispersion, (({_H}) / 0.25) * (({_L}) / 0.25) / 231 AS conflict_intensity,
  ({_H}) > 0 AND ({_L}) > 0 AS has_high_low_difference, {_QC} AS q_critic, q_huber, ({' + '.join(f'{c} * {float(w)!r}::DOUBLE' for c, w in zip(Z, _WEAK))}) - ({_penalty_sql(0.25, weights=_WEAK)}) AS q_relevance_downweighted,
  ({' + '.join(_ALT)}) / 22 - ({_penalty_sql(0.25, _ALT)}) AS q_argmax, {', '.join(f'{_MEAN} - ({_penalty_sql(e)}) AS q_eta_{e:g}'.replace('q_eta_0.', 'q_eta_0_') for e in scoring.ETAS)} FROM z JOIN hb ON hb.row_key = z.row_key),
sc AS (SELECT *, q_base - penalty AS q_rule, q_base AS q_equal, q_base AS q_primary FROM s)"""
_ALL = f"WITH RECURSIVE {parts.UTILITIES}, {_CRITIC}, {_HUBER}, {_SCORED}"
_SCORE_NAMES = ["q_base", "q_rule", "penalty", "dispersion", "conflict_intensity", "q_equal", "q_critic", "q_huber", "q_relevance_downweighted", "q_argmax", "q_eta_0", "q_eta_0_25", "q_eta_0_5", "q_eta_1", "q_primary", "valid_coverage"]
_Q_NAMES = [c for c in _SCORE_NAMES if c.startswith("q_")]
_SUMMARY = f"""{_ALL}, d AS (SELECT m.dataset, coalesce(domain, '(none)') AS dom, sc.*, CASE WHEN words > 0 THEN words END AS wd FROM sc, {parts.MASKS}),
qq AS (SELECT dataset, dom, quantile_cont(q_primary, 0.05) AS a, quantile_cont(q_primary, 0.95) AS b FROM d GROUP BY 1, 2),
sm AS (SELECT d.dataset, d.dom AS domain, count(*) AS n_unique, round(avg(q_base), 5) AS q_base_mean, round(avg(q_rule), 5) AS q_rule_mean, round(avg(q_primary), 5) AS q_primary_mean, round(quantile_cont(q_primary, 0.5), 5) AS median,
  round(quantile_cont(q_primary, 0.1), 5) AS p10, round(quantile_cont(q_primary, 0.9), 5) AS p90, round(avg(q_primary) FILTER (WHERE q_primary BETWEEN a AND b), 5) AS trimmed_mean,
  round(sum(q_primary * wd) / sum(wd), 5) AS word_weighted, round(avg((wd IS NOT NULL)::INT), 5) AS words_valid, round(avg(has_high_low_difference::INT), 5) AS conflict_rate,
  round(avg(conflict_intensity), 5) AS conflict_intensity, round(avg(penalty), 5) AS mean_penalty, round(avg(valid_coverage), 5) AS mean_valid_coverage
  FROM d JOIN qq ON qq.dataset = d.dataset AND qq.dom = d.dom GROUP BY 1, 2)"""


_MAD = """md AS (SELECT domain, quantile_cont(dispersion, 0.5) AS m FROM sc WHERE a1 GROUP BY domain),
ma AS (SELECT md.domain, any_value(m) AS m, greatest(1.4826 * quantile_cont(abs(dispersion - m), 0.5), 0.005) AS s FROM sc JOIN md ON md.domain IS NOT DISTINCT FROM sc.domain WHERE a1 GROUP BY md.domain)"""
_ISSUE_SQL = []
for _f in FIELDS:
    from grainmill.functions.signals import LENGTHS, PERCENT

    if _n := LENGTHS.get(_f):
        _ISSUE_SQL.append(f"CASE WHEN {_f} IS NULL OR len({_f}) <> {_n} THEN '{_f}:shape' WHEN len(list_filter({_f}, lambda x: isfinite(x))) < {_n} THEN '{_f}:nonfinite' END")
    else:
        _extra = f"WHEN {_f} NOT BETWEEN 0 AND 100 THEN '{_f}:percent_range'" if _f in PERCENT else f"WHEN {_f} < 0 THEN '{_f}:negative_statistic'" if _f.startswith("rps_") else ""
        _ISSUE_SQL.append(f"CASE WHEN {_f} IS NULL THEN '{_f}:type' WHEN NOT isfinite({_f}) THEN '{_f}:nonfinite' {_extra} END")
_ISSUES = "list_filter([" + ", ".join(_ISSUE_SQL) + "], lambda x: x IS NOT NULL)"
ORACLE = {
    "decode_signals": f"WITH d AS (SELECT row_key, {parts.SQL_SCALARS} FROM q1), o AS (SELECT row_key, {SQL_ORDINALS} FROM q1) SELECT d.row_key, {', '.join(f'round({c}, 6) + 0 AS {c}' for c in ATOMIC)}, {', '.join(f'round({o}, 6) AS {o}' for o in parts.ORDINALS)} FROM d JOIN o ON o.row_key = d.row_key",
    "decode_issues": f"SELECT source_label, row_key, id, unnest({_ISSUES}) AS issue FROM q1",
    "dedup_first_seen": f"WITH {parts.RECORDS} SELECT r.row_key, one.source_label, r.domain, r.id, r.membership FROM r JOIN one ON one.row_key = r.row_key",
    "source_audit": f"""WITH {parts.Q1}, p AS (SELECT source_label, rec, count(*) AS n, sum((len({_ISSUES}) > 0)::INT) AS bad FROM q1x GROUP BY 1, 2), f AS (SELECT rec, min(source_label) AS fl FROM q1x GROUP BY 1)
SELECT source_label, sum(n)::BIGINT AS records, sum(bad)::BIGINT AS records_with_issues, sum(n - 1)::BIGINT AS internal_duplicates, sum((fl < source_label)::INT)::BIGINT AS seen_before, count(*) AS distinct_records FROM p JOIN f ON f.rec = p.rec GROUP BY 1""",
    "identity_conflicts": f"WITH {parts.Q1} SELECT domain, id, count(DISTINCT rec) AS keys, count(DISTINCT rec) - 1 AS conflicts FROM q1x GROUP BY domain, id HAVING count(DISTINCT rec) > 1",
    "membership_masks": f"WITH {parts.RECORDS} SELECT m.dataset, domain, count(*) AS n FROM r, {parts.MASKS} GROUP BY 1, 2",
    "balanced_reference": f"""WITH {parts.RECORDS}, s AS (SELECT domain, count(*) AS n FROM r WHERE a1 GROUP BY domain), w AS (SELECT *, 1::DOUBLE / (n * count(*) OVER ()) AS w FROM s)
SELECT domain, n, round(n * w, 9) AS total, round(w, 9) AS w, round(1 / sum(n * w * w) OVER (), 9) AS effective_n FROM w""",
    "weighted_bounds": f"WITH {parts.RECORDS}, {parts.FIT}, b AS (SELECT {parts._BOUNDS}) " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{parts.spec_of(c)['kind']}' AS kind, '{ {'identity': 'higher', 'fixed_positive': 'higher', 'reference_positive': 'higher', 'reference_negative': 'lower', 'reference_interval': 'typical_interval', 'upper_tolerance': 'below_tolerance'}[parts.spec_of(c)['kind']]}' AS direction, {bool(parts.spec_of(c).get('log1p'))} AS log1p, round({parts._get(c, 0.5)}, 6) AS median, "
        + (f"{parts.spec_of(c)['bounds'][0]}::DOUBLE AS lower, {parts.spec_of(c)['bounds'][1]}::DOUBLE AS upper" if "bounds" in parts.spec_of(c) else f"round({parts._get(c if not parts.spec_of(c).get('log1p') else 'log1p_' + c, parts.spec_of(c).get('quantiles', (0.01, 0.99))[0])}, 6) AS lower, round({parts._get(c if not parts.spec_of(c).get('log1p') else 'log1p_' + c, parts.spec_of(c).get('quantiles', (0.01, 0.99))[1])}, 6) AS upper")
        for c in ATOMIC
    ),
    "domain_medians": f"WITH {parts.RECORDS}, {parts.FIT} SELECT domain, col AS \"column\", round(m, 6) AS median FROM dm WHERE col NOT LIKE 'log1p%'",
    "utility_apply": f"WITH {parts.UTILITIES} SELECT row_key, {', '.join(f'round({c}, 6) AS {c}' for c in Z)}, round(valid_coverage, 6) AS valid_coverage FROM z",
    "utility_audit": f"WITH {parts.UTILITIES}, l2 AS (SELECT unnest([{', '.join(repr(c) for c in ATOMIC)}]) AS c, unnest([{', '.join('u_' + c for c in ATOMIC)}]) AS v FROM u) SELECT c AS \"column\", round(avg(v), 5) AS mean, round(stddev_pop(v), 5) AS sd, round(avg((v = 0)::INT), 5) AS at_zero, round(avg((v = 1)::INT), 5) AS at_one FROM l2 GROUP BY c",
    "critic_weights": f"WITH {parts.UTILITIES}, {_CRITIC} SELECT field, round(weight, 6) AS weight, round(0.5 / 22 + 0.5 * weight, 6) AS half_shrunk FROM cw2",
    "quality_scores": f"""{_ALL}, {_MAD} SELECT row_key, {', '.join(f'round({c}, 5) AS {c}' for c in _SCORE_NAMES)}, has_high_low_difference,
round((dispersion - m) / s, 5) AS within_domain_r, coalesce((dispersion - m) / s > 3, false) AS within_domain_outlier FROM sc LEFT JOIN ma ON ma.domain IS NOT DISTINCT FROM sc.domain""",
    "huber_scores": f"WITH RECURSIVE {parts.UTILITIES}, {_HUBER} SELECT row_key, round(q_huber, 5) AS q_huber FROM hb",
    "mad_outliers": f"""{_ALL}, {_MAD}
SELECT row_key, round((dispersion - m) / s, 4) AS within_domain_r, coalesce((dispersion - m) / s > 3, false) AS within_domain_outlier FROM sc LEFT JOIN ma ON ma.domain IS NOT DISTINCT FROM sc.domain""",
    "domain_summary": f"{_SUMMARY} SELECT * FROM sm",
    "scenario_means": f"{_ALL}, d AS (SELECT m.dataset, coalesce(domain, '(none)') AS domain, unnest([{', '.join(repr(c) for c in _Q_NAMES)}]) AS scenario, unnest([{', '.join(_Q_NAMES)}]) AS v FROM sc, {parts.MASKS}) SELECT dataset, domain, scenario, round(avg(v), 5) AS mean FROM d GROUP BY 1, 2, 3",
    "extension_comparison": f"""{_SUMMARY}, a AS (SELECT * FROM sm WHERE dataset = 'A1') SELECT sm.domain, sm.dataset, round(sm.q_primary_mean - a.q_primary_mean, 4) AS delta_q, round(sm.conflict_rate - a.conflict_rate, 4) AS delta_conflict, round(sm.mean_penalty - a.mean_penalty, 4) AS delta_penalty
FROM sm JOIN a ON a.domain = sm.domain WHERE (sm.domain = 'arxiv' AND sm.dataset IN ('A2', 'A2_new', 'union')) OR (sm.domain = 'github' AND sm.dataset IN ('A3', 'A3_new', 'union'))""",
}
QUERIES = {n: f for n, f in globals().items() if n in ORACLE and callable(f)}
