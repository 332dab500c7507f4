"""Queries that compare scoring schemes and normalisations, and of conflicts between utilities."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions.signals import FIELDS, QURATER
from grainmill.operators import conflict, identity, scoring
from grainmill.operators.order import bh_adjust, ks_distance, pearson, quantiles, spearman, top_fraction, weighted_quantiles
from grainmill.operators.resample import mean_intervals, stratified_moments
from grainmill.operators.utility import balanced_weights
from grainmill.plans import parts
from grainmill.plans.quality import _ALL, Z, _scored, rounded
from grainmill.sources.shared import cut

KNOTS = 501
BOOTSTRAPS = 100
TOP = 0.2


def spearman_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = parts.table(spark, sf_dir, "sample_scores", "uid", "domain", "q_base", "q_rule", "scored_at")
    one = _latest(s)
    return rounded(spearman(one, ["domain"], "q_base", "q_rule", "uid"), 6)


def _latest(s: DataFrame) -> DataFrame:
    """One row per uid of sample_scores: the latest scoring, cleaned domains, missing scores NULL."""
    d = F.lower(F.trim("domain"))
    cols = [c for c in s.columns if c not in ("uid", "domain", "scored_at")]
    row = F.struct("scored_at", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in cols], F.coalesce(F.when(d != "", d), F.lit("(none)")).alias("domain"))
    return s.groupBy("uid").agg(F.max(row).alias("r")).select("uid", *[f"r.{c}" for c in [*cols, "domain"]])


def top_fraction_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the top fifth by one score that is in the top fifth by the other, per domain."""
    s = _latest(parts.table(spark, sf_dir, "sample_scores", "uid", "domain", "q_base", "q_critic", "scored_at")).where("q_base IS NOT NULL AND q_critic IS NOT NULL")
    both = top_fraction(top_fraction(s, ["domain"], "q_base", "uid", TOP, "a"), ["domain"], "q_critic", "uid", TOP, "b")
    return rounded(both.groupBy("domain").agg(F.count("*").alias("n"), F.sum(F.col("a").cast("long")).alias("top"), F.sum((F.col("a") & F.col("b")).cast("long")).alias("shared")).withColumn("overlap", F.col("shared") / F.col("top")))


def ks_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of the score distributions of reference and other records, per domain."""
    s = _latest(parts.table(spark, sf_dir, "sample_scores", "uid", "domain", "q_base", "is_a1_reference", "scored_at").withColumn("is_a1_reference", F.col("is_a1_reference").cast("double")))
    return rounded(ks_distance(s, ["domain"], "q_base", F.coalesce(F.col("is_a1_reference"), F.lit(0.0)) == 1, "uid"))


def score_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _latest(parts.table(spark, sf_dir, "sample_scores", "uid", "domain", "q_equal", "scored_at"))
    q = quantiles(s, ["domain"], "q_equal", [0.05, 0.1, 0.5, 0.9, 0.95], "uid")
    return rounded(q.select("domain", "n", *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate((5, 10, 50, 90, 95))]))


def _rank_map(rows: DataFrame, column: str) -> list[tuple[float, float]]:
    """Knots (value, percentile) of a monotone map fitted on reference records with equal domain mass; equal knots share their mean percentile."""
    w = balanced_weights(rows.where("a1").select("row_key", "domain", column), "domain")
    grid = [i / (KNOTS - 1) for i in range(KNOTS)]
    q = weighted_quantiles(w, [], column, "w", "row_key", grid)
    knots = q.groupBy("value").agg(F.avg("p").alias("p")).orderBy("value").collect()
    if len(knots) < 2:
        raise ValueError(f"{column} is constant")
    return [(r.value, r.p) for r in knots]


def percentile_of(df: DataFrame, keys: list[str], maps: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """``keys`` and the percentile of each mapped column: piecewise linear between its knots, 0 below the first and 1 above the last, NULL for NULL."""
    table = {c: tuple(map(np.array, zip(*knots))) for c, knots in maps.items()}
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = []
            for i, (x, p) in enumerate(table.values()):
                v = b.column(n + i).to_numpy(zero_copy_only=False)
                cols.append(pa.array(np.interp(v, x, p, 0.0, 1.0), pa.float64(), mask=np.isnan(v)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), *cols], [*keys, *table])

    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), *(f"`{c}` double" for c in table)])
    return df.select(*keys, *table).mapInArrow(run, schema)


def rank_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile of the three relevance values in the reference, for every record that has the value."""
    rows, _ = parts.fitted_records(spark, sf_dir)
    got = percentile_of(rows, ["row_key"], {c: _rank_map(rows, c) for c in scoring.DSIR})
    return rounded(got.unpivot("row_key", list(scoring.DSIR), "field", "percentile").where("percentile IS NOT NULL"), 5)


def extension_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean shift and distribution distance of the new records of the extensions against the reference."""
    labels = F.split("membership", ";")
    s = _scored(spark, sf_dir, ["row_key", "domain", "membership", "a1"]).where(F.col("domain").isin("arxiv", "github") & (F.col("a1") | F.array_contains(labels, "A2") | F.array_contains(labels, "A3")))
    s = cut(s.select("row_key", "domain", "a1", F.col("q_primary").alias("q")))
    ks = ks_distance(s.withColumn("q", F.round("q", 9)), ["domain"], "q", F.col("a1"), "row_key")
    m = s.groupBy("domain").agg((F.avg(F.when(~F.col("a1"), F.col("q"))) - F.avg(F.when(F.col("a1"), F.col("q")))).alias("mean_shift"))
    return rounded(ks.join(m, "domain"), 5)


def group_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rank correlation of each pair within a family, over the records that have both."""
    ab = parts.table(spark, sf_dir, "ab_experiment")
    families = (("qurater_writing_style", "qurater_required_expertise", "qurater_facts_trivia", "qurater_educational_value"), ("dsir_books", "dsir_wiki", "dsir_math"))
    fin = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
    one = ab.where("uid IS NOT NULL").groupBy("uid").agg(*[F.max(fin(c)).alias(c) for f in families for c in f])
    pairs = [(a, b) for f in families for i, a in enumerate(f) for b in f[i + 1 :]]
    long = cut(one.select("uid", F.explode(F.array(*[F.struct(F.lit(a).alias("field_a"), F.lit(b).alias("field_b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs])).alias("p")).select("uid", "p.*"))
    return rounded(spearman(long, ["field_a", "field_b"], "x", "y", "uid"))


def baseline_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal weights against the criterion weights of sample_scores, per domain: means, mean absolute difference, correlation."""
    s = _latest(parts.table(spark, sf_dir, "sample_scores", "uid", "domain", "q_equal", "q_critic", "scored_at")).where("q_equal IS NOT NULL AND q_critic IS NOT NULL")
    return rounded(s.groupBy("domain").agg(F.count("*").alias("n"), F.avg("q_equal").alias("equal_mean"), F.avg("q_critic").alias("critic_mean"), F.avg(F.abs(F.col("q_equal") - F.col("q_critic"))).alias("mean_abs_difference"), pearson(F.col("q_equal"), F.col("q_critic")).alias("pearson")))


def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = parts.utilities(spark, sf_dir)
    words = F.greatest(F.coalesce("rps_doc_word_count", F.lit(0.0)), F.lit(0.0))
    b = quantiles(u.where("a1").select("row_key", F.log1p(words).alias("x")), [], "x", [0.2, 0.4, 0.6, 0.8], "row_key").first().q
    return u.withColumn("stratum", F.concat_ws(":", F.coalesce("domain", F.lit("(none)")), conflict.length_bin(F.col("rps_doc_word_count"), b).cast("string")))


def length_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strata(spark, sf_dir).groupBy("stratum").agg(F.count("*").alias("n"), F.sum(F.col("a1").cast("long")).alias("reference"))


def conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(conflict.pair_table(_strata(spark, sf_dir).where("a1"), Z, "stratum"), 5)


def conflict_pairs_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair table of A1, A2, A3 and their union, in the strata of A1's length bounds."""
    each = identity.masks(F.col("membership"))
    u = cut(_strata(spark, sf_dir).select("stratum", *Z, F.explode(each).alias("dataset")).where(F.col("dataset").isin(*identity.LABELS, "union")))
    tables = [conflict.pair_table(u.where(F.col("dataset") == d), Z, "stratum").withColumn("dataset", F.lit(d)) for d in (*identity.LABELS, "union")]
    return rounded(reduce(DataFrame.unionByName, tables), 5)


def bh_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step-up values of all conflict pairs of the reference: p bounded by expectation over squared deviation, as the count's variance is at most its expectation."""
    t = conflict.pair_table(_strata(spark, sf_dir).where("a1"), Z, "stratum").withColumn("pair", F.concat_ws("|", "high_field", "low_field"))
    gap = F.col("count") - F.col("expected")
    t = t.select("pair", F.round(F.when(gap == 0, 1.0).otherwise(F.least(F.lit(1.0), F.try_divide("expected", gap * gap))), 9).alias("p"))
    return rounded(bh_adjust(t, [], "p", "pair", "q"), 6)


def permutation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _strata(spark, sf_dir).where("a1").withColumn("domain", F.coalesce("domain", F.lit("(none)")))
    return rounded(conflict.permutation_test(u, Z, "domain", "stratum", "row_key"))


def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    total, sums, gram = scoring.moments(parts.utilities(spark, sf_dir).where("a1"), Z)
    _, r = scoring.correlation(total, sums, gram)
    return rounded(spark.createDataFrame([(a, b, float(r[i, j])) for i, a in enumerate(FIELDS) for j, b in enumerate(FIELDS) if i < j], "field_a string, field_b string, r double"), 5)


FACTOR_ROWS = 250  #: records per domain, the same for every domain
MAX_FACTOR_DOMAINS = 200


def factor_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oblique factor pattern of the reference utilities, on the same number of records of each domain, those of the least hash.

    The sample is the method's own: at most FACTOR_ROWS a domain, which the driver holds for the shuffles of the parallel analysis.
    """
    u = parts.utilities(spark, sf_dir).where("a1").withColumn("domain", F.coalesce("domain", F.lit("(none)")))
    sizes = u.groupBy("domain").agg(F.count("*").alias("n")).limit(MAX_FACTOR_DOMAINS + 1).collect()
    if len(sizes) > MAX_FACTOR_DOMAINS:
        raise ValueError(f"more than {MAX_FACTOR_DOMAINS} domains")
    per = min([FACTOR_ROWS, *(r.n for r in sizes)])
    x = conflict.least_hash(u, "domain", F.col("row_key").cast("string"), per, "row_key").select("row_key", *Z).orderBy("row_key").toPandas()[Z].to_numpy(float) if sizes else np.zeros((0, len(Z)))
    live = np.flatnonzero(x.std(0) > 1e-10) if len(x) > 2 else np.zeros(0, int)
    rows = []
    if len(live) > 1:
        count, _, _ = conflict.parallel_count(x[:, live], 100, 8, 20260923)
        if count:
            pattern, _ = conflict.promax(conflict.principal_axes(np.corrcoef(x[:, live], rowvar=False), count)[0])
            rows = [(FIELDS[i], f, float(pattern[k, f - 1])) for k, i in enumerate(live) for f in range(1, count + 1)]
    return rounded(spark.createDataFrame(rows, "field string, factor int, loading double"), 4)


def critic_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile intervals of the criterion weights over BOOTSTRAPS resamples within domains, all from one moment pass."""
    u = balanced_weights(parts.utilities(spark, sf_dir).where("a1").select("row_key", "domain", *Z), "domain")
    total, sums, gram = stratified_moments(u, Z, "domain", "w", "row_key", BOOTSTRAPS, 20260923)
    q = np.quantile([scoring.critic_of(t, s, g) for t, s, g in zip(total, sums, gram)], [0.025, 0.5, 0.975], axis=0)
    return rounded(spark.createDataFrame([(f, *map(float, q[:, i])) for i, f in enumerate(FIELDS)], "field string, low double, median double, high double"))


def domain_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap interval of the mean primary score per source set and domain, 200 resamples."""
    s = _scored(spark, sf_dir, ["row_key", "domain", "membership"])
    rows = s.select("row_key", F.coalesce("domain", F.lit("(none)")).alias("domain"), F.explode(identity.masks(F.col("membership"))).alias("dataset"), "q_primary")
    return rounded(mean_intervals(rows, ["dataset", "domain"], "q_primary", "row_key", 200, 20260923), 5)


_LATEST = """lt AS (SELECT uid, lower(trim(domain)) AS d0, * EXCLUDE (uid, domain) FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY scored_at DESC) AS rn FROM sample_scores) WHERE rn = 1),
s AS (SELECT uid, coalesce(nullif(d0, ''), '(none)') AS domain, CASE WHEN NOT isnan(q_base) THEN q_base END AS q_base, CASE WHEN NOT isnan(q_rule) THEN q_rule END AS q_rule, CASE WHEN NOT isnan(q_equal) THEN q_equal END AS q_equal,
  CASE WHEN NOT isnan(q_critic) THEN q_critic END AS q_critic, is_a1_reference AS a1 FROM lt)"""


def _rank_sql(src: str, g: str, a: str, b: str, cols: str) -> str:
    """Spearman per group of ``src``."""
    r = lambda c: f"(rank() OVER (PARTITION BY {g} ORDER BY {c}) + (count(*) OVER (PARTITION BY {g}, {c}) - 1) / 2)::DOUBLE"
    return f"SELECT {cols}, count(*) AS n, CASE WHEN stddev_pop(ra) > 1e-12 AND stddev_pop(rb) > 1e-12 THEN corr(ra, rb) END AS rho FROM (SELECT *, {r(a)} AS ra, {r(b)} AS rb FROM {src}) GROUP BY {cols}"


def _rank_knots() -> str:
    """kn(field, v, p, v2, p2): the knots of the three maps with the next ones; ends(field, lo, hi)."""
    long = " UNION ALL ".join(f"SELECT row_key, domain, '{c}' AS field, {c} AS x FROM r WHERE a1" for c in scoring.DSIR)
    return f"""ra AS (SELECT row_key, field, x, 1::DOUBLE / ((SELECT count(DISTINCT coalesce(domain, '')) FROM r WHERE a1) * count(*) OVER (PARTITION BY field, domain)) AS w FROM ({long})),
rc AS (SELECT field, x, (sum(w) OVER (PARTITION BY field ORDER BY x, row_key ROWS UNBOUNDED PRECEDING) - w / 2) / sum(w) OVER (PARTITION BY field) AS pos, row_number() OVER (PARTITION BY field ORDER BY x, row_key) AS k FROM ra WHERE x IS NOT NULL),
rn AS (SELECT *, lead(pos) OVER (PARTITION BY field ORDER BY k) AS pos2, lead(x) OVER (PARTITION BY field ORDER BY k) AS x2 FROM rc), rg AS (SELECT unnest(range(0, {KNOTS})) / {KNOTS - 1}::DOUBLE AS p),
rq AS (SELECT field, p, CASE WHEN k = 1 AND pos > p THEN x WHEN pos2 IS NULL THEN x ELSE x + (x2 - x) * (p - pos) / (pos2 - pos) END AS v FROM rn JOIN rg ON (pos <= p AND (pos2 > p OR pos2 IS NULL)) OR (k = 1 AND pos > p)),
kn AS (SELECT field, v, avg(p) AS p, lead(v) OVER (PARTITION BY field ORDER BY v) AS v2, lead(avg(p)) OVER (PARTITION BY field ORDER BY v) AS p2 FROM rq GROUP BY field, v), ends AS (SELECT field, min(v) AS lo, max(v) AS hi FROM kn GROUP BY 1)"""


_PERCENTILE = "CASE WHEN x.v < ends.lo THEN 0 WHEN x.v > ends.hi THEN 1 ELSE coalesce(kn.p + (kn.p2 - kn.p) * (x.v - kn.v) / (kn.v2 - kn.v), kn.p) END"
_STRATA = f"""lb AS (SELECT quantile_cont(ln(1 + greatest(coalesce(words, 0), 0)), [0.2, 0.4, 0.6, 0.8]) AS b FROM z WHERE a1),
st AS (SELECT z.*, coalesce(domain, '(none)') || ':' || len(list_filter(b, lambda x: x <= ln(1 + greatest(coalesce(words, 0), 0)))) AS stratum FROM z, lb)"""
_PAIR_TABLE = f"""pl AS (SELECT row_key, stratum, unnest([{', '.join(repr(f) for f in FIELDS)}]) AS f, unnest([{', '.join(Z)}]) AS v FROM st WHERE a1),
ns AS (SELECT stratum, count(*) AS n FROM st WHERE a1 GROUP BY 1), hs AS (SELECT stratum, f, sum((v > 0.75)::INT) AS h, sum((v < 0.25)::INT) AS l FROM pl GROUP BY 1, 2),
ex AS (SELECT a.f AS high_field, b.f AS low_field, sum(a.h * b.l / ns.n::DOUBLE) AS e, sum(ns.n) AS n, sum(a.h) AS hn, sum(b.l) AS ln FROM hs a JOIN hs b ON a.stratum = b.stratum AND a.f <> b.f JOIN ns ON ns.stratum = a.stratum GROUP BY 1, 2),
ob AS (SELECT a.f AS high_field, b.f AS low_field, count(*) AS c FROM pl a JOIN pl b ON a.row_key = b.row_key AND a.v > 0.75 AND b.v < 0.25 GROUP BY 1, 2),
t AS (SELECT ex.*, coalesce(c, 0) AS count FROM ex LEFT JOIN ob ON ob.high_field = ex.high_field AND ob.low_field = ex.low_field)"""
ORACLE = {
    "spearman_by_domain": f"WITH {_LATEST}, b AS (SELECT * FROM s WHERE q_base IS NOT NULL AND q_rule IS NOT NULL), r AS ({_rank_sql('b', 'domain', 'q_base', 'q_rule', 'domain')}) SELECT domain, n, round(rho, 6) AS rho FROM r",
    "top_fraction_overlap": f"""WITH {_LATEST}, b AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY q_base DESC, uid) <= greatest(1, ceil(round(count(*) OVER (PARTITION BY domain) * 0.2::DOUBLE, 9))) AS a,
row_number() OVER (PARTITION BY domain ORDER BY q_critic DESC, uid) <= greatest(1, ceil(round(count(*) OVER (PARTITION BY domain) * 0.2::DOUBLE, 9))) AS b FROM s WHERE q_base IS NOT NULL AND q_critic IS NOT NULL)
SELECT domain, count(*) AS n, sum(a::INT)::BIGINT AS top, sum((a AND b)::INT)::BIGINT AS shared, round(sum((a AND b)::INT) / sum(a::INT), 6) AS overlap FROM b GROUP BY domain""",
    "ks_by_domain": f"""WITH {_LATEST}, v AS (SELECT domain, q_base AS x, coalesce(a1, false) AS a FROM s WHERE q_base IS NOT NULL), g AS (SELECT DISTINCT domain, x,
sum(a::INT) OVER (PARTITION BY domain ORDER BY x) AS ca, sum((NOT a)::INT) OVER (PARTITION BY domain ORDER BY x) AS cb, sum(a::INT) OVER (PARTITION BY domain) AS na, sum((NOT a)::INT) OVER (PARTITION BY domain) AS nb FROM v)
SELECT domain, na::BIGINT AS n_a, nb::BIGINT AS n_b, round(max(abs(ca / nullif(na, 0)::DOUBLE - cb / nullif(nb, 0)::DOUBLE)), 6) AS ks FROM g GROUP BY domain, na, nb""",
    "score_quantiles": f"WITH {_LATEST} SELECT domain, count(q_equal) AS n, {', '.join(f'round(quantile_cont(q_equal, {p / 100}), 6) AS p{p}' for p in (5, 10, 50, 90, 95))} FROM s WHERE q_equal IS NOT NULL GROUP BY domain",
    "rank_map": f"WITH {parts.RECORDS}, {_rank_knots()}, x AS (" + " UNION ALL ".join(f"SELECT row_key, '{c}' AS field, {c} AS v FROM r WHERE {c} IS NOT NULL" for c in scoring.DSIR) + f") SELECT row_key, x.field, round({_PERCENTILE}, 5) AS percentile FROM x JOIN ends ON ends.field = x.field LEFT JOIN kn ON kn.field = x.field AND x.v >= kn.v AND (x.v < kn.v2 OR kn.v2 IS NULL)",
    "extension_stability": f"""{_ALL}, e AS (SELECT domain, a1, round(q_primary, 9) AS x, q_primary AS q FROM sc WHERE domain IN ('arxiv', 'github') AND (a1 OR contains(membership, 'A2') OR contains(membership, 'A3'))),
g AS (SELECT DISTINCT domain, x, sum(a1::INT) OVER (PARTITION BY domain ORDER BY x) AS ca, sum((NOT a1)::INT) OVER (PARTITION BY domain ORDER BY x) AS cb, sum(a1::INT) OVER (PARTITION BY domain) AS na, sum((NOT a1)::INT) OVER (PARTITION BY domain) AS nb FROM e),
k AS (SELECT domain, na, nb, max(abs(ca / na::DOUBLE - cb / nb::DOUBLE)) AS ks FROM g GROUP BY 1, 2, 3), m AS (SELECT domain, avg(q) FILTER (WHERE NOT a1) - avg(q) FILTER (WHERE a1) AS s FROM e GROUP BY 1)
SELECT k.domain, na::BIGINT AS n_a, nb::BIGINT AS n_b, round(ks, 5) AS ks, round(s, 5) AS mean_shift FROM k JOIN m ON m.domain = k.domain""",
    "group_redundancy": "WITH o AS (SELECT uid, " + ", ".join(f"max(CASE WHEN isfinite({c}) THEN {c} END) AS {c}" for c in ("qurater_writing_style", "qurater_required_expertise", "qurater_facts_trivia", "qurater_educational_value", "dsir_books", "dsir_wiki", "dsir_math")) + " FROM ab_experiment WHERE uid IS NOT NULL GROUP BY uid), p AS (" + " UNION ALL ".join(
        f"SELECT '{a}' AS field_a, '{b}' AS field_b, {a} AS x, {b} AS y FROM o WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for f in (("qurater_writing_style", "qurater_required_expertise", "qurater_facts_trivia", "qurater_educational_value"), ("dsir_books", "dsir_wiki", "dsir_math")) for i, a in enumerate(f) for b in f[i + 1 :]
    ) + f"), r AS ({_rank_sql('p', 'field_a, field_b', 'x', 'y', 'field_a, field_b')}) SELECT field_a, field_b, n, round(rho, 6) AS rho FROM r",
    "baseline_comparison": f"WITH {_LATEST} SELECT domain, count(*) AS n, round(avg(q_equal), 6) AS equal_mean, round(avg(q_critic), 6) AS critic_mean, round(avg(abs(q_equal - q_critic)), 6) AS mean_abs_difference, round(CASE WHEN stddev_pop(q_equal) > 1e-12 AND stddev_pop(q_critic) > 1e-12 THEN corr(q_equal, q_critic) END, 6) AS pearson FROM s WHERE q_equal IS NOT NULL AND q_critic IS NOT NULL GROUP BY domain",
    "length_strata": f"WITH {parts.UTILITIES}, {_STRATA} SELECT stratum, count(*) AS n, sum(a1::INT)::BIGINT AS reference FROM st GROUP BY stratum",
    "conflict_pairs": f"""WITH {parts.UTILITIES}, {_STRATA}, {_PAIR_TABLE}
SELECT high_field, low_field, n::BIGINT AS n, count, round(count / n, 5) AS rate, round(e, 5) AS expected, round(count / CASE WHEN e > 0 THEN e END, 5) AS conditional_lift, round(count * n / nullif(hn * ln, 0)::DOUBLE, 5) AS unconditional_lift, round((count - e) / n, 5) + 0 AS excess_rate, e >= 5 AS adequate FROM t""",
    "bh_values": f"WITH {parts.UTILITIES}, {_STRATA}, {_PAIR_TABLE}, pb AS (SELECT high_field || '|' || low_field AS pair, round(CASE WHEN count = e THEN 1 ELSE least(1, e / power(count - e, 2)) END, 9) AS p FROM t), rb AS (SELECT *, row_number() OVER (ORDER BY p, pair) AS k, count(*) OVER () AS m FROM pb) SELECT pair, round(p, 6) AS p, round(least(1, min(p * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM rb",
    "correlation_matrix": f"""WITH {parts.UTILITIES}, l3 AS (SELECT row_key, unnest(range(22)) AS k, unnest([{', '.join(repr(f) for f in FIELDS)}]) AS f, unnest([{', '.join(Z)}]) AS v FROM z WHERE a1)
SELECT a.f AS field_a, b.f AS field_b, round(CASE WHEN stddev_pop(a.v) > 1e-9 AND stddev_pop(b.v) > 1e-9 THEN covar_pop(a.v, b.v) / (stddev_pop(a.v) * stddev_pop(b.v)) ELSE 0 END, 5) AS r FROM l3 a JOIN l3 b ON a.row_key = b.row_key AND a.k < b.k GROUP BY 1, 2""",
}
_PAIR_COLUMNS = ORACLE["conflict_pairs"][ORACLE["conflict_pairs"].rindex("SELECT high_field") :]
ORACLE["conflict_pairs_datasets"] = f"WITH {parts.UTILITIES}, {_STRATA} " + " UNION ALL ".join(
    f"SELECT *, '{d}' AS dataset FROM (WITH {_PAIR_TABLE.replace('WHERE a1', 'WHERE ' + ('true' if d == 'union' else f'contains(membership, {d!r})'))} {_PAIR_COLUMNS})" for d in (*identity.LABELS, "union")
)
QUERIES = {f.__name__: f for f in (spearman_by_domain, top_fraction_overlap, ks_by_domain, score_quantiles, rank_map, extension_stability, group_redundancy, baseline_comparison, length_strata, conflict_pairs, conflict_pairs_datasets, bh_values, permutation_pairs, correlation_matrix, factor_analysis, critic_bootstrap, domain_intervals)}
