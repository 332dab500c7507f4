"""Smaller reports: coverage of utilities, percent ranks, rank correlations of fields, contents that conflict, declared lengths, positions in a fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions.signals import FIELDS
from grainmill.operators import scoring
from grainmill.operators.identity import content_conflicts, uid
from grainmill.operators.order import average_rank
from grainmill.operators.utility import SPECS, apply_utilities, unpivot
from grainmill.plans import parts
from grainmill.plans.quality import Z, rounded
from grainmill.sources.tables import domain_of, table

TOLERANCE = 0.011  #: of declared mean lengths


def utility_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean shares of fields that are valid and that apply, per domain."""
    rows, fitted = parts.fitted_records(spark, sf_dir)
    u = apply_utilities(rows, "domain", fitted, ["row_key", "domain"])
    return rounded(u.groupBy("domain").agg(F.count("*").alias("n"), F.avg("valid_coverage").alias("valid"), F.avg("applicable_coverage").alias("applicable")))


def percent_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean rank over number of rows, of three utilities of the reference records."""
    u = parts.utilities(spark, sf_dir).where("a1").select("row_key", *[F.round(z, 12).alias(z) for z in Z[:3]])
    n = u.count()
    ranks = average_rank(unpivot(u, ["row_key"], Z[:3], "field", "x"), ["field"], "x", "row_key", "r")
    return rounded(ranks.select("row_key", F.substring("field", 3, 100).alias("field"), (F.col("r") / max(n, 1)).alias("percent_rank")))


def spearman_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of every pair of utilities over the reference: ranks of all fields, then one moment pass over them."""
    u = parts.utilities(spark, sf_dir).where("a1").select("row_key", *[F.round(z, 12).alias(z) for z in Z])
    ranks = average_rank(unpivot(u, ["row_key"], Z, "field", "x"), ["field"], "x", "row_key", "r")
    wide = ranks.groupBy("row_key").pivot("field", Z).agg(F.first("r"))
    _, r = scoring.correlation(*scoring.moments(wide, Z))
    return rounded(spark.createDataFrame([(a, b, float(r[i, j])) for i, a in enumerate(FIELDS) for j, b in enumerate(FIELDS) if i < j], "field_a string, field_b string, rho double"), 5)


def text_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 texts of one domain and id that come with different contents."""
    q = table(spark, sf_dir, "quality_reconstruction", "corpus", "id", "_source_domain", "_source_path", "content").where("corpus = 'A1' AND id IS NOT NULL")
    d = domain_of(F.col("_source_domain"), F.col("_source_path"))
    rows = q.select(d.alias("domain"), "id", uid(d, F.col("id"), F.lit("")).alias("uid"), F.sha2("content", 256).alias("h"))
    bad = content_conflicts(rows, "h")
    return rows.join(bad.select("uid"), "uid").groupBy("domain", "id").agg(F.count("*").alias("rows"), F.count_distinct("h").alias("contents"))


def coverage_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted rows, mean lengths and paths of the documents against what the table declares of them, per source, and whether all agree."""
    d = table(spark, sf_dir, "documents", "source", "text", "n_chars", "_source_path").where("source IS NOT NULL")
    c = d.groupBy("source").agg(F.count("*").alias("rows"), F.avg(F.length("text")).alias("mean_chars"), F.avg("n_chars").alias("declared_chars"), F.count("n_chars").alias("declared_rows"), F.count("text").alias("texts"), F.count_distinct("_source_path").alias("paths"))
    ok = (F.abs(F.col("mean_chars") - F.col("declared_chars")) <= TOLERANCE) & (F.col("texts") == F.col("declared_rows"))
    return rounded(c.withColumn("reconciled", F.coalesce(ok, F.lit(False))), 4)


def recipe_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of every recipe in the fixed order of the domains (that of the map's names), 0 where a recipe has none: recipe, position, source, share."""
    order = table(spark, sf_dir, "domain_map", "mixture_domain").selectExpr("mixture_domain AS source", "row_number() OVER (ORDER BY mixture_domain) - 1 AS position")  # a row per domain
    m = table(spark, sf_dir, "mix_targets", "recipe", "source", "target_share").groupBy("recipe", "source").agg(F.sum("target_share").alias("share"))
    full = m.groupBy("recipe").agg(F.map_from_entries(F.collect_list(F.struct("source", "share"))).alias("of"))  # an entry per domain
    listed = order.agg(F.sort_array(F.collect_list(F.struct("position", "source"))).alias("order")).first().order
    items = F.array(*[F.struct(F.lit(x.position).cast("int").alias("position"), F.lit(x.source).alias("source")) for x in listed])
    out = full.select("recipe", "of", F.explode(items).alias("x"))
    return rounded(out.select("recipe", "x.position", "x.source", F.coalesce(F.try_element_at("of", F.col("x.source")), F.lit(0.0)).alias("share")))


_NEUTRAL = " + ".join("(domain IS NULL OR domain NOT IN (" + ", ".join(map(repr, SPECS[f]["neutral"])) + "))::INT" if SPECS[f].get("neutral") else "1" for f in FIELDS)
_L = ", ".join(f"round({z}, 12)" for z in Z)
_RANK = "(rank() OVER (PARTITION BY field ORDER BY v) + (count(*) OVER (PARTITION BY field, v) - 1) / 2)::DOUBLE"
ORACLE = {
    "utility_coverage": f"WITH {parts.UTILITIES} SELECT domain, count(*) AS n, round(avg(valid_coverage), 6) AS valid, round(avg(({_NEUTRAL}) / 22::DOUBLE), 6) AS applicable FROM z GROUP BY domain",
    "percent_ranks": f"WITH {parts.UTILITIES}, l4 AS (SELECT row_key, unnest([{', '.join(repr(f) for f in FIELDS[:3])}]) AS field, unnest([{', '.join(f'round({z}, 12)' for z in Z[:3])}]) AS v FROM z WHERE a1) SELECT row_key, field, round({_RANK} / count(*) OVER (PARTITION BY field), 6) AS percent_rank FROM l4",
    "spearman_matrix": f"""WITH {parts.UTILITIES}, l4 AS (SELECT row_key, unnest(range(22)) AS k, unnest([{', '.join(repr(f) for f in FIELDS)}]) AS field, unnest([{_L}]) AS v FROM z WHERE a1), rk AS (SELECT row_key, k, field, {_RANK} AS r FROM l4)
SELECT a.field AS field_a, b.field AS field_b, round(CASE WHEN stddev_pop(a.r) > 1e-9 AND stddev_pop(b.r) > 1e-9 THEN corr(a.r, b.r) ELSE 0 END, 5) AS rho FROM rk a JOIN rk b ON a.row_key = b.row_key AND a.k < b.k GROUP BY 1, 2""",
    "text_conflicts": f"WITH t AS (SELECT {parts.DOMAIN} AS domain, id, content FROM quality_reconstruction WHERE corpus = 'A1' AND id IS NOT NULL) SELECT domain, id, count(*) AS rows, count(DISTINCT content) AS contents FROM t GROUP BY 1, 2 HAVING count(DISTINCT content) > 1",
    "coverage_reconciliation": f"""SELECT source, count(*) AS rows, round(avg(length(text)), 4) AS mean_chars, round(avg(n_chars), 4) AS declared_chars, count(n_chars) AS declared_rows, count(text) AS texts, count(DISTINCT _source_path) AS paths,
coalesce(abs(avg(length(text)) - avg(n_chars)) <= {TOLERANCE} AND count(text) = count(n_chars), false) AS reconciled FROM documents WHERE source IS NOT NULL GROUP BY 1""",
    "recipe_order": """WITH o AS (SELECT mixture_domain AS source, row_number() OVER (ORDER BY mixture_domain) - 1 AS position FROM domain_map), r AS (SELECT DISTINCT recipe FROM mix_targets)
SELECT r.recipe, o.position::INT AS position, o.source, round(coalesce(sum(m.target_share), 0), 6) AS share FROM r CROSS JOIN o LEFT JOIN mix_targets m ON m.recipe = r.recipe AND m.source = o.source GROUP BY 1, 2, 3""",
}
QUERIES = {n: f for n, f in globals().items() if n in ORACLE and callable(f)}
