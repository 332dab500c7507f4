"""Queries of texts, samples, profiles and transfer between corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions import text
from grainmill.operators import transfer
from grainmill.operators.conflict import least_hash
from grainmill.operators.order import quantiles
from grainmill.plans import parts
from grainmill.plans.quality import rounded
from grainmill.sources.shared import cut
from grainmill.sources.tables import domain_of, table

PER_DOMAIN = 64
LIGHT = list(text.SQL_LIGHT)


def text_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eleven statistics of every document."""
    return rounded(text.add_statistics(table(spark, sf_dir, "documents", "doc_id", "text"), "text"))


def text_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return rounded(d.select("doc_id", *[c.alias(n) for n, c in text.light(F.col("text")).items()]))


def text_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: rows, lengths, empty texts, replacement and NUL characters, exact duplicates, paths, and whether declared lengths agree."""
    d = table(spark, sf_dir, "documents", "doc_id", "source", "text", "n_chars", "_source_path").withColumn("source", F.coalesce("source", F.lit("(none)")))
    digests = d.where("text IS NOT NULL").groupBy("source", F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n"))
    dup = digests.groupBy("source").agg(F.sum(F.col("n") - 1).alias("exact_duplicates"))
    paths = d.select("source", "_source_path").distinct().groupBy("source").agg(F.count("_source_path").alias("paths"))
    c = F.length("text")
    a = d.groupBy("source").agg(
        F.count("*").alias("rows"), F.avg(c).alias("mean_chars"), F.count_if(F.trim("text") == "").alias("blank"), F.count_if(F.col("text").isNull()).alias("missing"),
        F.count_if(F.contains("text", F.lit("�"))).alias("replacement"), F.count_if(F.contains("text", F.lit("\x00"))).alias("nul"), F.every(F.coalesce(c == F.col("n_chars"), F.col("text").isNull())).alias("lengths_agree"),
        F.coalesce(F.every(F.col("_source_path").startswith("valid/")), F.lit(False)).alias("all_valid_paths"),
    )
    med = quantiles(d.select("source", "doc_id", c.alias("c")), ["source"], "c", [0.5], "doc_id").select("source", F.col("q")[0].alias("median_chars"))
    return rounded(a.join(dup, "source", "left").join(paths, "source").join(med, "source", "left").withColumn("exact_duplicates", F.coalesce("exact_duplicates", F.lit(0))))


def stable_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "source").where("source IS NOT NULL")
    return least_hash(d, "source", F.col("doc_id").cast("string"), PER_DOMAIN, "doc_id").select("source", "doc_id")


def sample_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Available, selected, target and shortfall of the sample, for every expected domain, also those without documents."""
    got = stable_hash_sample(spark, sf_dir).groupBy("source").agg(F.count("*").alias("selected"))
    have = table(spark, sf_dir, "documents", "source").groupBy("source").agg(F.count("*").alias("available"))
    m = table(spark, sf_dir, "domain_map", "mixture_domain").withColumnRenamed("mixture_domain", "source")
    j = m.join(have, "source", "left").join(got, "source", "left").na.fill(0, ["available", "selected"])
    return j.select("source", "available", "selected", F.lit(PER_DOMAIN).alias("target"), (F.lit(PER_DOMAIN) - F.col("selected")).alias("shortfall"), F.when(F.col("selected") < PER_DOMAIN, "all").otherwise("hash").alias("mode"))


def proxy_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line from the equal-weight to the criterion-weight score per domain, as between a rebuilt and an official signal."""
    from grainmill.plans.experiments import _latest

    s = _latest(table(spark, sf_dir, "sample_scores", "uid", "domain", "q_equal", "q_critic", "scored_at"))
    return rounded(transfer.calibration(s, ["domain"], "q_equal", "q_critic"), 5)


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, dict[str, float]]:
    """Profiles of the A1 texts by quality domain and of the documents by mixture domain, and the scales of A1."""
    q = table(spark, sf_dir, "quality_reconstruction", "record_key", "corpus", "_source_domain", "_source_path", "content").where("corpus = 'A1'")
    a = q.select(domain_of(F.col("_source_domain"), F.col("_source_path")).alias("domain"), *[c.alias(n) for n, c in text.light(F.col("content")).items()]).where("log_chars IS NOT NULL AND domain IS NOT NULL")
    d = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    b = d.select(F.col("source").alias("domain"), *[c.alias(n) for n, c in text.light(F.col("text")).items()]).where("log_chars IS NOT NULL AND domain IS NOT NULL")
    sd = a.agg(*[F.stddev_pop(f).alias(f) for f in LIGHT]).first()
    return transfer.profiles(a, "domain", LIGHT), transfer.profiles(b, "domain", LIGHT), {f: (sd[f] or 0.0) if (sd[f] or 0.0) >= 1e-8 else 1.0 for f in LIGHT}


def domain_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, _ = _sides(spark, sf_dir)
    return rounded(a.withColumn("corpus", F.lit("A1")).unionByName(b.withColumn("corpus", F.lit("documents"))))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, scales = _sides(spark, sf_dir)
    return cut(transfer.distances(a, b, scales))


def similarity_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = transfer.soft_weights(_pairs(spark, sf_dir), ["domain"])
    return rounded(w.select("domain", "quality_domain", "distance", "weight", "rank"), 5)


def similarity_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest quality domain in every variant that leaves a field out, at three temperatures."""
    v = transfer.variants(_pairs(spark, sf_dir), LIGHT, [0.5, 1.0, 2.0])
    return rounded(v.where("rank = 1").select("domain", "omitted", "temperature", F.col("quality_domain").alias("nearest"), F.col("weight").alias("probability")), 5)


def completed_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _pairs(spark, sf_dir)
    main = transfer.soft_weights(pairs, ["domain"])
    v = transfer.variants(pairs, LIGHT, [1.0]).where("rank = 1").select("domain", F.col("quality_domain").alias("v"))
    first = main.where("rank = 1").select("domain", F.col("quality_domain").alias("m"))
    stability = v.join(F.broadcast(first), "domain").groupBy("domain").agg(F.avg((F.col("v") == F.col("m")).cast("double")).alias("stability"))
    return rounded(transfer.complete_map(main, stability, table(spark, sf_dir, "domain_map")), 5)


def anchor_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transfer's gate: rank of the known quality domain among the distances, over the directly mapped domains."""
    main = transfer.soft_weights(_pairs(spark, sf_dir), ["domain"])
    k = table(spark, sf_dir, "domain_map").where("mapping_type IN ('direct', 'near_direct') AND quality_domain <> '(none)'").select(F.col("mixture_domain").alias("domain"), "quality_domain", "mapping_type")
    r = main.join(F.broadcast(k), ["domain", "quality_domain"])
    out = r.agg(F.count("*").alias("n_known"), F.avg((F.col("rank") == 1).cast("double")).alias("top1"), F.avg((F.col("rank") <= 3).cast("double")).alias("top3"), F.avg(F.when(F.col("mapping_type") == "near_direct", (F.col("rank") == 1).cast("double"))).alias("near_direct_top1"))
    return rounded(out.withColumn("passes", (F.col("top1") >= 5 / 6) & (F.col("top3") == 1) & (F.coalesce("near_direct_top1", F.lit(0.0)) >= 2 / 3)), 5)


def quality_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each recipe of mix_targets by the mean scores of the quality domains that its sources map to."""
    from grainmill.plans.experiments import _latest

    s = _latest(table(spark, sf_dir, "sample_scores", "uid", "domain", "q_equal", "is_a1_reference", "scored_at").withColumn("is_a1_reference", F.col("is_a1_reference").cast("double")))
    ref = s.where("is_a1_reference = 1").groupBy(F.col("domain").alias("quality_domain")).agg(F.avg("q_equal").alias("q"), (F.avg("q_equal") - 1.96 * F.stddev_pop("q_equal") / F.sqrt(F.count("q_equal"))).alias("low"), (F.avg("q_equal") + 1.96 * F.stddev_pop("q_equal") / F.sqrt(F.count("q_equal"))).alias("high"))
    ext = s.where("is_a1_reference = 0").groupBy(F.col("domain").alias("quality_domain")).agg(F.avg("q_equal").alias("q_ext"))
    m = table(spark, sf_dir, "mix_targets", "recipe", "source", "target_share")
    total = m.groupBy("recipe").agg(F.sum("target_share").alias("t"))
    p = m.join(total, "recipe").select(F.col("recipe").alias("index"), F.col("source").alias("domain"), (F.col("target_share") / F.col("t")).alias("p"))
    known = table(spark, sf_dir, "domain_map").select(F.col("mixture_domain").alias("domain"), "quality_domain")
    return rounded(transfer.bridge(p, known, ref, ext), 5)


_L = ", ".join(f"{e} AS {n}" for n, e in text.SQL_LIGHT.items())
_AVG = ", ".join(f"avg({f}) AS {f}_mean, stddev_pop({f}) AS {f}_sd" for f in LIGHT)
_SIDES = f"""a0 AS (SELECT {parts.DOMAIN} AS domain, content AS t FROM quality_reconstruction WHERE corpus = 'A1'), aa AS (SELECT domain, {_L} FROM a0 WHERE length(t) > 0 AND domain IS NOT NULL),
bb AS (SELECT domain, {_L} FROM (SELECT source AS domain, text AS t FROM documents) WHERE length(t) > 0 AND domain IS NOT NULL),
pa AS (SELECT domain, count(*) AS n, {_AVG} FROM aa GROUP BY 1), pb AS (SELECT domain, count(*) AS n, {_AVG} FROM bb GROUP BY 1), sc AS (SELECT {', '.join(f'CASE WHEN stddev_pop({f}) < 1e-8 THEN 1 ELSE stddev_pop({f}) END AS {f}' for f in LIGHT)} FROM aa),
pr AS (SELECT pb.domain, pa.domain AS quality_domain, [{', '.join(f'power((pb.{f}_mean - pa.{f}_mean) / sc.{f}, 2) + 0.25::DOUBLE * power((pb.{f}_sd - pa.{f}_sd) / sc.{f}, 2)' for f in LIGHT)}] AS parts FROM pb, pa, sc)"""
_MAIN = f"""{_SIDES}, dd AS (SELECT domain, quality_domain, sqrt(list_sum(parts)) AS distance FROM pr), ee AS (SELECT *, exp(-(distance - min(distance) OVER (PARTITION BY domain))) AS e FROM dd),
ww AS (SELECT domain, quality_domain, distance, e / sum(e) OVER (PARTITION BY domain) AS weight, row_number() OVER (PARTITION BY domain ORDER BY distance, quality_domain) AS rank FROM ee)"""
_VAR = f"""v0 AS (SELECT domain, quality_domain, unnest(range(0, {len(LIGHT) + 1})) AS k, parts FROM pr), v1 AS (SELECT domain, quality_domain, ['none', {', '.join(repr(f) for f in LIGHT)}][k + 1] AS omitted, sqrt(greatest(0, list_sum(parts) - CASE WHEN k = 0 THEN 0 ELSE parts[k] END)) AS distance FROM v0),
v2 AS (SELECT v1.*, t.temperature FROM v1, (SELECT unnest([0.5, 1, 2])::DOUBLE AS temperature) t), v3 AS (SELECT *, exp(-(distance - min(distance) OVER w) / temperature) AS e, row_number() OVER (PARTITION BY domain, omitted, temperature ORDER BY distance, quality_domain) AS rank FROM v2 WINDOW w AS (PARTITION BY domain, omitted, temperature)),
v4 AS (SELECT *, e / sum(e) OVER (PARTITION BY domain, omitted, temperature) AS weight FROM v3)"""
ORACLE = {
    "text_light": f"SELECT doc_id, {', '.join(f'CASE WHEN length(t) > 0 THEN round({e}, 6) END AS {n}' for n, e in text.SQL_LIGHT.items())} FROM (SELECT doc_id, text AS t FROM documents)",
    "text_coverage": """WITH d AS (SELECT *, coalesce(source, '(none)') AS src FROM documents)
SELECT src AS source, count(*) AS rows, round(avg(length(text)), 6) AS mean_chars, count(*) FILTER (WHERE trim(text, ' ') = '') AS blank, count(*) FILTER (WHERE text IS NULL) AS missing, count(*) FILTER (WHERE contains(text, chr(65533))) AS replacement,
count(*) FILTER (WHERE contains(text, chr(0))) AS nul, bool_and(coalesce(length(text) = n_chars, text IS NULL)) AS lengths_agree, coalesce(bool_and(starts_with(_source_path, 'valid/')), false) AS all_valid_paths, (count(text) - count(DISTINCT text)) AS exact_duplicates,
count(DISTINCT _source_path) AS paths, round(quantile_cont(length(text), 0.5), 6) AS median_chars FROM d GROUP BY 1""",
    "stable_hash_sample": f"SELECT source, doc_id FROM documents WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY substr(sha256(source || chr(0) || doc_id::VARCHAR), 1, 16), doc_id) <= {PER_DOMAIN}",
    "sample_coverage": f"WITH n AS (SELECT source, count(*) AS c FROM documents GROUP BY 1) SELECT mixture_domain AS source, coalesce(c, 0) AS available, least(coalesce(c, 0), {PER_DOMAIN}) AS selected, {PER_DOMAIN} AS target, {PER_DOMAIN} - least(coalesce(c, 0), {PER_DOMAIN}) AS shortfall, CASE WHEN coalesce(c, 0) < {PER_DOMAIN} THEN 'all' ELSE 'hash' END AS mode FROM domain_map LEFT JOIN n ON n.source = mixture_domain",
    "domain_profiles": f"WITH {_SIDES}, x AS (SELECT *, 'A1' AS corpus FROM pa UNION ALL SELECT *, 'documents' FROM pb) SELECT corpus, domain, n, {', '.join(f'round({f}_{k}, 6) AS {f}_{k}' for f in LIGHT for k in ('mean', 'sd'))} FROM x",
    "similarity_weights": f"WITH {_MAIN} SELECT domain, quality_domain, round(distance, 5) AS distance, round(weight, 5) AS weight, rank FROM ww",
    "similarity_sensitivity": f"WITH {_MAIN}, {_VAR} SELECT domain, omitted, temperature, quality_domain AS nearest, round(weight, 5) AS probability FROM v4 WHERE rank = 1",
    "completed_map": f"""WITH {_MAIN}, {_VAR}, t AS (SELECT a.domain, a.quality_domain AS nearest, a.weight AS probability, b.distance - a.distance AS margin FROM ww a LEFT JOIN ww b ON b.domain = a.domain AND b.rank = 2 WHERE a.rank = 1),
st AS (SELECT v4.domain, avg((v4.quality_domain = t.nearest)::INT) AS stability FROM v4 JOIN t ON t.domain = v4.domain WHERE v4.rank = 1 AND temperature = 1 GROUP BY 1),
k AS (SELECT mixture_domain AS domain, CASE WHEN mapping_type IN ('direct', 'near_direct') AND quality_domain <> '(none)' THEN quality_domain END AS given FROM domain_map)
SELECT t.domain, coalesce(given, nearest) AS quality_domain, given IS NOT NULL AS fixed, nearest, round(probability, 5) AS probability, round(margin, 5) AS margin, round(stability, 5) AS stability,
CASE WHEN given IS NOT NULL THEN 'teacher_provided' WHEN probability < 0.35 OR coalesce(margin, 0) < 0.25 OR coalesce(stability, 0) < 0.75 THEN 'limited' ELSE 'moderate' END AS confidence FROM t LEFT JOIN st ON st.domain = t.domain LEFT JOIN k ON k.domain = t.domain""",
    "anchor_validation": f"""WITH {_MAIN}, k AS (SELECT ww.rank, mapping_type FROM ww JOIN domain_map m ON m.mixture_domain = ww.domain AND m.quality_domain = ww.quality_domain WHERE mapping_type IN ('direct', 'near_direct')),
g AS (SELECT count(*) AS n_known, avg((rank = 1)::INT) AS top1, avg((rank <= 3)::INT) AS top3, avg((rank = 1)::INT) FILTER (WHERE mapping_type = 'near_direct') AS near_direct_top1 FROM k)
SELECT n_known, round(top1, 5) AS top1, round(top3, 5) AS top3, round(near_direct_top1, 5) AS near_direct_top1, top1 >= 5 / 6::DOUBLE AND top3 = 1 AND coalesce(near_direct_top1, 0) >= 2 / 3::DOUBLE AS passes FROM g""",
}
from grainmill.plans.experiments import _LATEST  # noqa: E402

ORACLE["proxy_calibration"] = f"""WITH {_LATEST}, m AS (SELECT domain, count(*) AS n, CASE WHEN var_pop(q_equal) > 1e-12 THEN greatest(0, covar_pop(q_equal, q_critic) / var_pop(q_equal)) ELSE 0 END AS slope, avg(q_equal) AS mx, avg(q_critic) AS my
FROM s WHERE q_equal IS NOT NULL AND q_critic IS NOT NULL GROUP BY 1) SELECT domain, n, round(slope, 5) AS slope, round(my - slope * mx, 5) AS intercept, 0::DOUBLE AS low, 1::DOUBLE AS high FROM m WHERE n >= 20"""
ORACLE["quality_bridge"] = f"""WITH {_LATEST}, rf AS (SELECT domain, avg(q_equal) AS q, avg(q_equal) - 1.96 * stddev_pop(q_equal) / sqrt(count(q_equal)) AS low, avg(q_equal) + 1.96 * stddev_pop(q_equal) / sqrt(count(q_equal)) AS high FROM s WHERE a1 GROUP BY 1),
ex AS (SELECT domain, avg(q_equal) AS q_ext FROM s WHERE NOT a1 GROUP BY 1), m AS (SELECT mixture_domain AS domain, q, low, high, q_ext, avg(q) OVER () AS q_mean FROM domain_map d LEFT JOIN rf ON rf.domain = d.quality_domain LEFT JOIN ex ON ex.domain = d.quality_domain),
p AS (SELECT recipe, source, target_share / sum(target_share) OVER (PARTITION BY recipe) AS p FROM mix_targets), j AS (SELECT p.recipe, p.p, m.*, coalesce(m.q_mean, NULL) AS qm FROM p LEFT JOIN m ON m.domain = p.source)
SELECT recipe AS "index", round(sum(p * coalesce(q, 0)), 5) AS known_contribution, round(sum(CASE WHEN q IS NOT NULL THEN p ELSE 0 END), 5) AS mapped_mass, round(sum(p * coalesce(q, 0)) / nullif(sum(CASE WHEN q IS NOT NULL THEN p ELSE 0 END), 0), 5) AS on_mapped_mass,
round(sum(p * coalesce(q, qm)), 5) AS filled, round(sum(p * coalesce(q_ext, q, qm)), 5) AS extension_filled, round(sum(p * coalesce(q, 0)), 5) AS lower, round(sum(p * coalesce(q, 0)) + 1 - sum(CASE WHEN q IS NOT NULL THEN p ELSE 0 END), 5) AS upper,
round(sum(p * coalesce(low, 0)), 5) AS lower_ci, round(sum(p * coalesce(high, 0)) + 1 - sum(CASE WHEN q IS NOT NULL THEN p ELSE 0 END), 5) AS upper_ci FROM j GROUP BY 1"""
QUERIES = {f.__name__: f for f in (text_signals, text_light, text_coverage, stable_hash_sample, sample_coverage, proxy_calibration, domain_profiles, similarity_weights, similarity_sensitivity, completed_map, anchor_validation, quality_bridge)}
