"""Queries that refit the scoring on parts of the reference: transfer to domains left out, and correlation given domain and length."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions.signals import ATOMIC, FIELDS, QURATER
from grainmill.functions.text import STATISTICS
from grainmill.operators import scoring
from grainmill.operators.order import average_rank
from grainmill.operators.utility import apply_utilities, balanced_weights, fit, unpivot
from grainmill.plans import parts
from grainmill.plans.quality import Z, rounded
from grainmill.sources.shared import cut

MAX_FOLDS = 50


def _scheme_score(u: DataFrame, train) -> tuple[list[str], np.ndarray, dict]:
    """Hierarchical concepts and their weights, fitted on the rows of ``train``."""
    ref = balanced_weights(u.where(train), "domain")
    scheme = scoring.schemes(scoring.critic(ref, [f"u_{q}" for q in QURATER], "w"))["B20_hierarchical"]
    concepts = ref.select("w", *scoring.concept_columns(scheme))
    names = [f"c_{n}" for n in scheme]
    return names, scoring.critic(concepts, names, "w"), scheme


def lodo_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of scores by text statistics alone, each domain held out in turn."""
    return rounded(parts.kept(spark, sf_dir, "lodo", lambda: cut(_held_out(spark, sf_dir))))


def _held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reference domain held out in turn: everything is refitted on the others, then the held-out records are scored with all signals, with the
    text statistics only, and by the mean of the other domains' means. One refit per domain, at most MAX_FOLDS."""
    rows = parts.fitted_records(spark, sf_dir)[0].where("a1 AND domain IS NOT NULL")
    domains = [r[0] for r in rows.select("domain").distinct().orderBy("domain").limit(MAX_FOLDS + 1).collect()]
    if len(domains) > MAX_FOLDS:
        raise ValueError(f"more than {MAX_FOLDS} domains")
    out = None
    for held in domains:
        fitted = fit(rows.where(F.col("domain") != held), "domain", "row_key")
        u = cut(apply_utilities(rows, "domain", fitted, ["row_key", "domain"]))
        _, w, scheme = _scheme_score(u, F.col("domain") != held)
        score = lambda d, w=w, scheme=scheme: d.select("row_key", "domain", scoring.dot(scoring.concept_columns(scheme), w).alias("q"))
        full = score(u)
        blind = rows.where(F.col("domain") == held).select("row_key", "domain", *[F.col(c) if c in STATISTICS else F.lit(None).cast("double").alias(c) for c in ATOMIC])
        part = score(apply_utilities(blind, "domain", fitted, ["row_key", "domain"])).select("row_key", F.col("q").alias("p"))
        mean = full.where(F.col("domain") != held).groupBy("domain").agg(F.avg("q").alias("m")).agg(F.avg("m")).first()[0]
        j = full.where(F.col("domain") == held).join(part, "row_key").withColumn("constant", F.lit(mean).cast("double"))
        err, base = F.col("q") - F.col("p"), F.col("q") - F.col("constant")
        one = j.groupBy("domain").agg(F.count("*").alias("n"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(base * base)).alias("constant_rmse"), F.avg(F.abs(base)).alias("constant_mae"), F.avg("q").alias("actual_mean"), F.avg("p").alias("predicted_mean"), F.first("constant").alias("constant"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "domain string, n long, rmse double, mae double, constant_rmse double, constant_mae double, actual_mean double, predicted_mean double, constant double")
    return out


def transfer_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether text statistics alone score held-out domains better than the mean of the others: errors of records and of domain means, and the worst domain."""
    rows = lodo_transfer(spark, sf_dir).collect()  # a row per domain
    schema = "domains int, rmse double, constant_rmse double, domain_mae double, constant_domain_mae double, worst_domain_error double, passes boolean"
    if not rows:
        return spark.createDataFrame([], schema)
    off = np.array([abs(r.actual_mean - r.predicted_mean) for r in rows])
    base = np.array([abs(r.actual_mean - r.constant) for r in rows])
    rmse, constant = float(np.mean([r.rmse for r in rows])), float(np.mean([r.constant_rmse for r in rows]))
    ok = rmse < constant and off.mean() <= 0.8 * base.mean() and off.max() <= 0.08
    return rounded(spark.createDataFrame([(len(rows), rmse, constant, float(off.mean()), float(base.mean()), float(off.max()), bool(ok))], schema))


def adjusted_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of percent ranks given domain, log length and its square: residual moments by the normal equations of one Gram matrix."""
    u = cut(parts.utilities(spark, sf_dir).where("a1").select("row_key", F.coalesce("domain", F.lit("(none)")).alias("domain"), F.log1p(F.greatest(F.coalesce("rps_doc_word_count", F.lit(0.0)), F.lit(0.0))).alias("length"), *[F.round(z, 12).alias(z) for z in Z]))
    n = u.count()
    ranks = average_rank(unpivot(u, ["row_key"], Z, "column", "x"), ["column"], "x", "row_key", "r")
    wide = ranks.groupBy("row_key").pivot("column", Z).agg(F.first(F.col("r") / max(n, 1)))
    m = u.agg(F.avg("length").alias("m"), F.stddev_pop("length").alias("s")).first()
    centred = (F.col("length") - (m.m or 0.0)) / max(m.s or 0.0, 1e-12)
    domains = [r[0] for r in u.select("domain").distinct().orderBy("domain").limit(MAX_FOLDS + 1).collect()]
    if len(domains) > MAX_FOLDS:
        raise ValueError(f"more than {MAX_FOLDS} domains")
    design = u.select("row_key", centred.alias("l"), (centred * centred).alias("l2"), *[(F.col("domain") == d).cast("double").alias(f"d{i}") for i, d in enumerate(domains[1:])])
    names = [c for c in design.columns if c != "row_key"]
    total, sums, gram = scoring.moments(wide.join(design, "row_key"), [*Z, *names])
    k = len(Z)
    a = np.vstack([np.append(total, sums[k:]), np.column_stack([sums[k:], gram[k:, k:]])]) if total else np.zeros((1, 1))
    b = np.vstack([sums[:k], gram[k:, :k]]) if total else np.zeros((1, k))
    left = gram[:k, :k] - b.T @ np.linalg.pinv(a) @ b
    sd = np.sqrt(np.maximum(np.diag(left), 0))
    d = np.outer(sd, sd)
    r = np.divide(left, d, out=np.zeros_like(left), where=d > 1e-10)
    return rounded(spark.createDataFrame([(FIELDS[i], FIELDS[j], float(np.clip(r[i, j], -1, 1))) for i in range(k) for j in range(i + 1, k)], "field_a string, field_b string, r double"), 5)


ORACLE: dict[str, str] = {}
QUERIES = {"lodo_transfer": lodo_transfer, "transfer_gate": transfer_gate, "adjusted_correlation": adjusted_correlation}
