"""Transfer of quality from the scored corpus (A1) to the domains of the mixture (A18) by rebuilt signals, and what it is worth.

The signals are the text statistics of whole bodies; signals of models enter where a scorer is registered (``functions/scorers``). Families of fields weigh
the same in distances. Everything but the passes over the texts works on tables of one row per domain.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions import text
from grainmill.functions.signals import ATOMIC, QURATER
from grainmill.operators import scoring, transfer
from grainmill.operators.identity import join_unique
from grainmill.operators.order import quantiles
from grainmill.operators.resample import group_moments, mean_intervals
from grainmill.operators.utility import Fitted, apply_utilities, balanced_weights, fit
from grainmill.plans import parts, schemes
from grainmill.plans.quality import rounded
from grainmill.sources.shared import cut
from grainmill.sources.tables import domain_of, table

# The fields that distances use, by family, those that are logged, temperatures and limits.
FAMILIES = {
    "length": ("rps_doc_word_count", "rps_doc_num_sentences", "rps_doc_mean_word_length"),
    "lexical": ("rps_doc_unigram_entropy", "rps_doc_frac_unique_words"),
    "surface_repetition": ("rps_doc_frac_no_alph_words", "rps_doc_frac_chars_top_2gram", "rps_doc_frac_chars_top_3gram", "rps_lines_numerical_chars_fraction"),
}
LOGGED = FAMILIES["length"]
FIELDS = tuple(f for members in FAMILIES.values() for f in members)
TEMPERATURES = (1.0, 0.5, 2.0)
REPEATS, ANCHOR_DRAWS, SEED = 300, 10_000, 20260925
LEAST_ACCEPTED = 3
MAX_FOLDS = 50


def validate_families(fields: tuple[str, ...], families: dict[str, tuple[str, ...]]) -> np.ndarray:
    """Weights of the fields: every family the same, evenly within it. Families must partition the fields."""
    if sorted(f for m in families.values() for f in m) != sorted(fields):
        raise ValueError("families must partition the fields")
    of = {f: 1 / (len(families) * len(m)) for m in families.values() for f in m}
    return np.array([of[f] for f in fields])


def rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_key, side (A1, A18), domain, id and the eleven statistics of the body, shares as fractions; NULL where a body has none."""

    def make():
        q = table(spark, sf_dir, "quality_reconstruction", "record_key", "corpus", "id", "_source_domain", "_source_path", "content", "text")
        body = F.when(F.col("corpus") == "A18", F.col("text")).otherwise(F.col("content"))
        q = q.select("record_key", F.col("corpus").alias("side"), domain_of(F.col("_source_domain"), F.col("_source_path")).alias("domain"), "id", body.alias("body")).where("body IS NOT NULL AND domain IS NOT NULL")
        s = text.add_statistics(q, "body")
        return cut(s.select("record_key", "side", "domain", "id", *[(F.col(c) / 100 if "frac" in c or "ending" in c else F.col(c)).alias(c) for c in text.STATISTICS]))

    return parts.kept(spark, sf_dir, "rebuilt", make)


def _joined(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A1 texts with the scalars of their one scored record, and how the join went."""
    left = rebuilt(spark, sf_dir).where("side = 'A1'").select("record_key", "domain", "id", *[F.col(c).alias(f"r_{c}") for c in text.STATISTICS])
    rows, _ = parts.fitted_records(spark, sf_dir)
    return join_unique(left, rows.where("a1").select("domain", "id", *ATOMIC), ["domain", "id"])


def signal_join_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts meet one, several or no scored record by domain and id."""
    return _joined(spark, sf_dir)[1]


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that meet exactly one record: record_key, domain, official scalars, rebuilt r_*."""
    return parts.kept(spark, sf_dir, "paired", lambda: cut(_joined(spark, sf_dir)[0]))


def _audit(spark: SparkSession, sf_dir: str, group: list[str]) -> DataFrame:
    items = [F.struct(F.lit(c).alias("field"), F.col(c).alias("official"), F.col(f"r_{c}").alias("rebuilt")) for c in text.STATISTICS]
    long = cut(paired(spark, sf_dir).select("record_key", "domain", F.explode(F.array(*items)).alias("x")).select("record_key", "domain", "x.*"))
    return transfer.audit(long, group, "official", "rebuilt", "record_key")


def signal_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rebuilt text statistics against the signals of their records, per field; texts of ambiguous or missing records are in ``signal_join_audit``."""
    return rounded(_audit(spark, sf_dir, ["field"]), 5)


def signal_audit_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_audit(spark, sf_dir, ["domain", "field"]), 5)


def accepted(audit: DataFrame, both: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """field, passed, complete (every A1 value there), present (any A18 value there), accepted."""
    one = both.agg(*[F.every((F.col("side") != "A1") | F.col(f).isNotNull()).alias(f"c_{f}") for f in fields], *[F.some((F.col("side") == "A18") & F.col(f).isNotNull()).alias(f"p_{f}") for f in fields]).first()
    rows = both.sparkSession.createDataFrame([(f, bool(one[f"c_{f}"]), bool(one[f"p_{f}"])) for f in fields], "field string, complete boolean, present boolean")
    j = rows.join(F.broadcast(audit.select("field", "passed")), "field", "left").withColumn("passed", F.coalesce("passed", F.lit(False)))
    return j.withColumn("accepted", F.col("passed") & F.col("complete") & F.col("present"))


def require_accepted(table_: DataFrame, least: int = LEAST_ACCEPTED) -> list[str]:
    """The accepted fields; fewer than ``least`` are an error, as nothing can be told from them."""
    names = [r.field for r in table_.where("accepted").orderBy("field").collect()]  # a row per field
    if len(names) < least:
        raise ValueError(f"only {len(names)} of at least {least} fields are accepted")
    return names


def accepted_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which statistics pass the audit and are there on both sides. Transfer with a fixed list of fields doesn't ask; ``require_accepted`` does."""
    return accepted(_audit(spark, sf_dir, ["field"]), rebuilt(spark, sf_dir), text.STATISTICS)


def profile_missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing statistics of A18, which the profiles fill with the median of A1."""
    b = rebuilt(spark, sf_dir).where("side = 'A18'").agg(F.count("*").alias("n"), *[F.count_if(F.col(f).isNull()).alias(f) for f in FIELDS])
    long = b.unpivot("n", list(FIELDS), "field", "missing")
    return rounded(long.select("field", "missing", F.try_divide("missing", "n").alias("fraction"), F.lit("A1 median").alias("imputation")))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_key, side, domain and the fields: missing values as A1's median, lengths logged."""

    def make():
        both = rebuilt(spark, sf_dir)
        a1 = both.where("side = 'A1'").unpivot(["record_key"], list(FIELDS), "field", "x")
        med = {r.field: r.q[0] for r in quantiles(a1, ["field"], "x", [0.5], "record_key").collect()}
        value = lambda f: F.coalesce(F.col(f), F.lit(float(med.get(f, 0.0))))
        return cut(both.select("record_key", "side", "domain", *[(F.log1p(F.greatest(value(f), F.lit(0.0))) if f in LOGGED else value(f)).alias(f) for f in FIELDS]))

    return parts.kept(spark, sf_dir, "prepared", make)


def bridge_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation and outer deciles of each field per side and domain."""
    p = prepared(spark, sf_dir).unpivot(["record_key", "side", "domain"], list(FIELDS), "field", "x")
    g = ["side", "domain", "field"]
    q = quantiles(p, g, "x", [0.1, 0.5, 0.9], "record_key").select(*g, *[F.col("q")[i].alias(n) for i, n in enumerate(("p10", "median", "p90"))])
    return rounded(p.groupBy(*g).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd")).join(q, g), 5)


class Profiles:
    """Means and deviations of the domains of one side, of the rows as they are (repeat 0) and of resamples."""

    def __init__(self, sums: dict[str, np.ndarray]):
        self.domains = list(sums)
        m = np.array([sums[d] for d in self.domains])  # domain, repeat, 1 + 2k
        k = (m.shape[2] - 1) // 2
        n = np.maximum(m[:, :, :1], 1e-12)
        self.n, self.mean = m[:, 0, 0], m[:, :, 1 : 1 + k] / n
        self.sd = np.sqrt(np.maximum(m[:, :, 1 + k :] / n - self.mean**2, 0))
        whole = m[:, 0].sum(0)
        self.scale = np.sqrt(np.maximum(whole[1 + k :] / whole[0] - (whole[1 : 1 + k] / whole[0]) ** 2, 0))


def components(a: Profiles, b: Profiles, repeat: int = 0) -> np.ndarray:
    """Squared differences of means and a quarter of those of deviations, in A1's deviations: (domain of b, domain of a, field)."""
    scale = np.maximum(a.scale, 1e-8)
    return ((b.mean[:, None, repeat] - a.mean[None, :, repeat]) / scale) ** 2 + 0.25 * ((b.sd[:, None, repeat] - a.sd[None, :, repeat]) / scale) ** 2


def soft(parts_: np.ndarray, weights: np.ndarray, temperature: float) -> tuple[np.ndarray, np.ndarray]:
    """Distances, and weights that fall with them and sum to 1 over the last axis."""
    if temperature <= 0:
        raise ValueError("temperatures must be positive")
    d = np.sqrt(np.maximum(parts_ @ weights, 0))
    e = np.exp(-(d - d.min(-1, keepdims=True)) / temperature)
    return d, e / e.sum(-1, keepdims=True)


class Bridge:
    """All that the reports of the bridge share; held on the driver, bounded by the number of domains."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        p = prepared(spark, sf_dir)
        self.a, self.b = (Profiles(group_moments(p.where(F.col("side") == s), "domain", list(FIELDS), "record_key", REPEATS, SEED)) for s in ("A1", "A18"))
        self.weights = validate_families(FIELDS, FAMILIES)
        s = schemes.scheme_summary(spark, sf_dir).select("profile", "scheme", "dataset", "domain", "mean", "std", "n_unique").collect()  # a row per group
        self.summary = {(r.profile, r.scheme, r.dataset, r.domain): r for r in s}
        self.q = self.reference("frozen_original", "B20_hierarchical", "union")
        known = {r.mixture_domain: r for r in table(spark, sf_dir, "domain_map").limit(transfer.MAX_DOMAINS).collect()}
        self.kind = [known[d].mapping_type if d in known else None for d in self.b.domains]
        self.target = [self.a.domains.index(known[d].quality_domain) if k in ("direct", "near_direct") and known[d].quality_domain in self.a.domains else -1 for d, k in zip(self.b.domains, self.kind)]
        self.fixed = np.array(self.target) >= 0
        self.parts = components(self.a, self.b)
        self.distance, self.soft = soft(self.parts, self.weights, TEMPERATURES[0])
        self.final = self.pinned(self.soft)

    def reference(self, profile: str, scheme: str, dataset: str) -> np.ndarray:
        """Mean score of each quality domain; the mean of the others where a domain has none."""
        v = np.array([self.summary[profile, scheme, dataset, d].mean if (profile, scheme, dataset, d) in self.summary else np.nan for d in self.a.domains], float)
        return np.where(np.isnan(v), np.nanmean(v) if np.isfinite(v).any() else 0.0, v)

    def pinned(self, weights: np.ndarray) -> np.ndarray:
        """Known domains take their own quality domain alone."""
        out = weights.copy()
        for i in np.flatnonzero(self.fixed):
            out[i] = np.eye(out.shape[1])[self.target[i]]
        return out

    def rank(self, i: int) -> int:
        return int((self.distance[i] < self.distance[i, self.target[i]]).sum()) + 1

    def scenarios(self) -> list[tuple[str, np.ndarray]]:
        """Field weights of the main case, of each field left out and of each family left out, summing to 1 again."""
        out = [("main", self.weights)]
        out += [(f"omit_field:{f}", np.where(np.arange(len(FIELDS)) == i, 0, self.weights)) for i, f in enumerate(FIELDS)]
        out += [(f"omit_family:{n}", np.array([0 if f in m else w for f, w in zip(FIELDS, self.weights)])) for n, m in FAMILIES.items()]
        return [(n, w / w.sum()) for n, w in out]


def _bridge(spark: SparkSession, sf_dir: str) -> Bridge:
    return parts.kept(spark, sf_dir, "bridge", lambda: Bridge(spark, sf_dir))


def bridge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of domains: distance, soft weight and final weight, in which known domains take their own quality domain alone."""
    b = _bridge(spark, sf_dir)
    rows = [(d, q, float(b.distance[i, j]), float(b.soft[i, j]), float(b.final[i, j]), bool(b.fixed[i])) for i, d in enumerate(b.b.domains) for j, q in enumerate(b.a.domains)]
    return rounded(spark.createDataFrame(rows, "domain string, quality_domain string, distance double, soft_weight double, final_weight double, fixed boolean"), 5)


def bridge_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest domain and bridged quality with each field and each family left out, at three temperatures."""
    b, rows = _bridge(spark, sf_dir), []
    for name, w in b.scenarios():
        for t in TEMPERATURES:
            d, s = soft(b.parts, w, t)
            q = b.pinned(s) @ b.q
            rows += [(dom, name, t, b.a.domains[int(d[i].argmin())], float(q[i]), bool(b.fixed[i])) for i, dom in enumerate(b.b.domains)]
    return rounded(spark.createDataFrame(rows, "domain string, scenario string, temperature double, nearest string, q_bridge double, fixed boolean"), 5)


def bridge_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known domains: rank of their own quality domain among the distances, and the error of the unpinned bridge."""
    b = _bridge(spark, sf_dir)
    rows = [(b.b.domains[i], b.kind[i], b.a.domains[b.target[i]], b.rank(i), float(b.q[b.target[i]]), float(b.soft[i] @ b.q), float(abs(b.soft[i] @ b.q - b.q[b.target[i]]))) for i in np.flatnonzero(b.fixed)]
    return rounded(spark.createDataFrame(rows, "domain string, mapping_type string, quality_domain string, rank int, q_reference double, q_soft double, q_abs_error double"), 5)


def bridge_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the bridge is good enough for use: hits among the known domains, error against that of the mean, with intervals over resampled known domains."""
    b = _bridge(spark, sf_dir)
    at = np.flatnonzero(b.fixed)
    rank, near = np.array([b.rank(i) for i in at]), np.array([b.kind[i] == "near_direct" for i in at], bool)
    error = np.array([abs(b.soft[i] @ b.q - b.q[b.target[i]]) for i in at])
    if not len(at):
        return spark.createDataFrame([], "n_known int, top1 int, top3 int, near_top1 int, q_mae double, constant_mae double, mae_low double, mae_high double, top1_low double, top1_high double, passes boolean")
    constant = float(np.abs(np.array([b.q[b.target[i]] for i in at]) - b.q.mean()).mean())
    pick = np.random.default_rng(SEED + 1).integers(0, len(at), (ANCHOR_DRAWS, len(at)))
    mae, hits = np.quantile(error[pick].mean(1), [0.025, 0.975]), np.quantile((rank[pick] == 1).mean(1), [0.025, 0.975])
    top1, top3, near1 = int((rank == 1).sum()), int((rank <= 3).sum()), int((rank[near] == 1).sum())
    ok = top1 * 6 >= 5 * len(at) and top3 == len(at) and near1 * 3 >= 2 * near.sum() and error.mean() < constant
    row = (len(at), top1, top3, near1, float(error.mean()), constant, *map(float, mae), *map(float, hits), bool(ok))
    return rounded(spark.createDataFrame([row], "n_known int, top1 int, top3 int, near_top1 int, q_mae double, constant_mae double, mae_low double, mae_high double, top1_low double, top1_high double, passes boolean"), 5)


# The other sources of the quality of domains that the bridge is compared under.
SOURCES = {"A22_union": ("frozen_original", "A22", "union"), "B23_union": ("frozen_original", "B23_flat", "union"), "B20_rank_union": ("dsir_reference_rank", "B20_hierarchical", "union"), "B20_A1": ("frozen_original", "B20_hierarchical", "A1")}


def bridge_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per mixture domain: bridged quality, its range over the sensitivity cases, its interval over resampled corpora and perturbed references, how often
    the nearest domain stays the same, and the quality under other sources of the reference."""
    b = _bridge(spark, sf_dir)
    rng = np.random.default_rng(SEED)
    se = np.array([(r.std or 0.0) / np.sqrt(r.n_unique) if (r := b.summary.get(("frozen_original", "B20_hierarchical", "union", d))) else 0.0 for d in b.a.domains])
    cases = {n: [(soft(b.parts, w, t)) for t in TEMPERATURES] for n, w in b.scenarios()}
    over = np.array([b.pinned(s) @ b.q for found in cases.values() for _, s in found])
    first = b.distance.argmin(1)
    stays = lambda kind: np.mean([found[0][0].argmin(1) == first for n, found in cases.items() if n.startswith(kind)], 0)
    drawn, same = [], []
    for r in range(1, REPEATS + 1):
        d, s = soft(components(b.a, b.b, r), b.weights, TEMPERATURES[0])
        drawn.append(b.pinned(s) @ np.clip(b.q + rng.normal(0, se), 0, 1))
        same.append(d.argmin(1) == first)
    low, high = np.quantile(drawn, [0.025, 0.975], axis=0)
    by_field, by_family, again = stays("omit_field"), stays("omit_family"), np.mean(same, 0)
    other = {n: b.final @ b.reference(*of) for n, of in SOURCES.items()}
    order = np.sort(b.distance, 1)
    entropy = -(b.soft * np.log(np.maximum(b.soft, 1e-12))).sum(1)
    rows = [(d, bool(b.fixed[i]), b.a.domains[first[i]], float(order[i, 1] - order[i, 0]) if order.shape[1] > 1 else None, float(entropy[i]), float(b.soft[i] @ b.q), float(b.final[i] @ b.q), float(over[:, i].min()), float(over[:, i].max()), float(low[i]), float(high[i]), float(by_field[i]), float(by_family[i]), float(again[i]), *[float(v[i]) for v in other.values()]) for i, d in enumerate(b.b.domains)]
    return rounded(spark.createDataFrame(rows, "domain string, fixed boolean, nearest string, margin double, entropy double, q_soft double, q_final double, q_least double, q_most double, q_low double, q_high double, field_stability double, family_stability double, resample_stability double, " + ", ".join(f"q_{n} double" for n in SOURCES)), 5)


# Direct scores by rebuilt signals ------------------------------------------------------------------------------------------
def accepted_only(df: DataFrame, names: tuple[str, ...], prefix: str = "") -> list:
    """The 25 scalars as columns: those of ``names`` (read with ``prefix``), all others NULL."""
    return [F.col(prefix + c).cast("double").alias(c) if c in names else F.lit(None).cast("double").alias(c) for c in ATOMIC]


class Scorer:
    """The hierarchical scheme fitted on some records: utilities, concepts and weights, all frozen."""

    def __init__(self, reference: DataFrame, unique: str):
        self.fitted: Fitted = fit(reference, "domain", unique)
        u = balanced_weights(apply_utilities(reference, "domain", self.fitted, ["domain"]), "domain")
        total, sums, gram = scoring.moments(u, [f"u_{c}" for c in ATOMIC], "w")
        at = [ATOMIC.index(q) for q in QURATER]
        m = schemes._mapping(scoring.schemes(scoring.critic_of(total, sums[at], gram[np.ix_(at, at)]))["B20_hierarchical"])
        self.weights = m @ scoring.critic_of(total, m.T @ sums, m.T @ gram @ m)

    def score(self, df: DataFrame, keep: list[str], global_only: bool = False) -> DataFrame:
        """``keep`` and q. ``global_only``: another corpus doesn't borrow the domains' medians, only their allowances."""
        u = apply_utilities(df, "domain", self.fitted, keep, global_only=global_only)
        return u.select(*keep, scoring.dot([F.col(f"u_{c}") for c in ATOMIC], self.weights).alias("q"))


def calibration_lines(df: DataFrame, names: tuple[str, ...]) -> dict[str, tuple[float, float]]:
    """Slope (at least 0, 0 if nothing varies) and intercept from rebuilt to official values, per field with at least 20 pairs; one row of sums."""
    both = lambda f: F.col(f).isNotNull() & F.col(f"r_{f}").isNotNull()
    one = df.agg(*[a for f in names for a in (F.count_if(both(f)).alias(f"n_{f}"), F.avg(F.when(both(f), F.col(f"r_{f}"))).alias(f"x_{f}"), F.avg(F.when(both(f), F.col(f))).alias(f"y_{f}"), F.var_pop(F.when(both(f), F.col(f"r_{f}"))).alias(f"v_{f}"), F.covar_pop(F.when(both(f), F.col(f"r_{f}")), F.when(both(f), F.col(f))).alias(f"c_{f}"))]).first()
    out = {}
    for f in names:
        if one[f"n_{f}"] >= 20:
            slope = max(0.0, one[f"c_{f}"] / one[f"v_{f}"]) if one[f"v_{f}"] > 1e-12 else 0.0
            out[f] = (slope, one[f"y_{f}"] - slope * one[f"x_{f}"])
    return out


def calibrated(lines: dict[str, tuple[float, float]], f: str):
    """A rebuilt value through its line, not below 0, shares not above 1."""
    x = F.col(f"r_{f}")
    if f in lines:
        x = F.greatest(x * lines[f][0] + lines[f][1], F.lit(0.0))
        x = F.least(x, F.lit(1.0)) if "frac" in f else x
    return x


def direct_lodo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each domain held out: the scorer and the calibration are fitted on the others; errors of four ways to score the held-out texts against their official
    signals: the official ones of the transfer's fields alone, rebuilt, rebuilt and calibrated, and the mean of the other domains' means. One fit per domain."""

    def make():
        t = paired(spark, sf_dir)
        domains = [r[0] for r in t.select("domain").distinct().orderBy("domain").limit(MAX_FOLDS + 1).collect()]
        if len(domains) > MAX_FOLDS:
            raise ValueError(f"more than {MAX_FOLDS} domains")
        out = []
        for held in domains if len(domains) > 1 else ():
            train, test = t.where(F.col("domain") != held), t.where(F.col("domain") == held)
            scorer, lines = Scorer(train, "record_key"), calibration_lines(train, FIELDS)
            constant = scorer.score(train, ["domain"]).groupBy("domain").agg(F.avg("q").alias("m")).agg(F.avg("m")).first()[0]
            cases = {"official": [F.col(c) for c in ATOMIC], "official_partial": accepted_only(test, FIELDS), "rebuilt_raw": accepted_only(test, FIELDS, "r_"), "rebuilt_calibrated": [calibrated(lines, c).alias(c) if c in FIELDS else F.lit(None).cast("double").alias(c) for c in ATOMIC]}
            frames = [test.select("record_key", "domain", F.lit(n).alias("case"), *cols) for n, cols in cases.items()]
            q = scorer.score(reduce(DataFrame.unionByName, frames), ["record_key", "domain", "case"])
            wide = q.groupBy("record_key", "domain").pivot("case", list(cases)).agg(F.first("q")).withColumn("constant", F.lit(constant))
            for name in (*list(cases)[1:], "constant"):
                e = F.col("official") - F.col(name)
                out.append(wide.groupBy("domain").agg(F.lit(name).alias("scenario"), F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg("official").alias("official_mean"), F.avg(name).alias("predicted_mean")))
        schema = "domain string, scenario string, n long, rmse double, mae double, official_mean double, predicted_mean double"
        return cut(reduce(DataFrame.unionByName, out)) if out else spark.createDataFrame([], schema)

    return rounded(parts.kept(spark, sf_dir, "direct_lodo", make).withColumn("domain_mean_abs_error", F.abs(F.col("official_mean") - F.col("predicted_mean"))), 5)


def direct_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether calibrated rebuilt signals score held-out domains better than a constant: errors of records and of domain means, the worst domain, rank correlation."""
    rows = direct_lodo(spark, sf_dir).where("scenario IN ('rebuilt_calibrated', 'constant')").orderBy("domain").collect()  # two rows per domain
    main, base = ([r for r in rows if r.scenario == s] for s in ("rebuilt_calibrated", "constant"))
    schema = "lodo_rmse double, constant_rmse double, domain_mae double, constant_domain_mae double, worst_domain_error double, domain_spearman double, passes boolean"
    if not main:
        return spark.createDataFrame([], schema)
    mean = lambda x, f: float(np.mean([r[f] for r in x]))
    rank = lambda v: np.argsort(np.argsort(v))
    a, b = rank([r.official_mean for r in main]), rank([r.predicted_mean for r in main])
    rho = float(np.corrcoef(a, b)[0, 1]) if len(main) > 1 else None
    row = (mean(main, "rmse"), mean(base, "rmse"), mean(main, "domain_mean_abs_error"), mean(base, "domain_mean_abs_error"), max(r.domain_mean_abs_error for r in main), rho)
    ok = row[0] < row[1] and row[2] <= 0.8 * row[3] and row[4] <= 0.08
    return rounded(spark.createDataFrame([(*row, bool(ok))], schema), 5)


def direct_domain_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct scores of the mixture's texts by rebuilt signals, raw and calibrated: mean, deviation, standard error, outer deciles and bootstrap interval per domain.

    Missing signals take A1's global medians; the real domains keep their allowances.
    """
    rows, fitted = parts.fitted_records(spark, sf_dir)
    scorer = parts.kept(spark, sf_dir, "b20", lambda: Scorer(rows.where("a1"), "row_key"))
    lines = calibration_lines(paired(spark, sf_dir), FIELDS)
    a18 = rebuilt(spark, sf_dir).where("side = 'A18'").select("record_key", "domain", *[F.col(c).alias(f"r_{c}") for c in FIELDS])
    cases = {"rebuilt_raw": accepted_only(a18, FIELDS, "r_"), "rebuilt_calibrated": [calibrated(lines, c).alias(c) if c in FIELDS else F.lit(None).cast("double").alias(c) for c in ATOMIC]}
    q = cut(reduce(DataFrame.unionByName, [scorer.score(a18.select("record_key", "domain", F.lit(n).alias("scenario"), *cols), ["record_key", "domain", "scenario"], global_only=True) for n, cols in cases.items()]))
    g = ["scenario", "domain"]
    d = quantiles(q, g, "q", [0.1, 0.9], "record_key").select(*g, F.col("q")[0].alias("p10"), F.col("q")[1].alias("p90"))
    m = q.groupBy(*g).agg(F.count("*").alias("n"), F.avg("q").alias("mean"), F.stddev_pop("q").alias("sd")).withColumn("se", F.col("sd") / F.sqrt("n"))
    return rounded(m.join(d, g).join(mean_intervals(q, g, "q", "record_key", REPEATS, SEED).select(*g, "low", "high"), g), 5)


def quality_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of the mixture's domains that loss models may use: each route's standardised values, only if its gate is passed."""
    out = [quality_route(spark, "bridge", bridge_domains(spark, sf_dir).select("domain", F.col("q_final").alias("q")), bridge_gate(spark, sf_dir))]
    direct = direct_domain_stats(spark, sf_dir).where("scenario = 'rebuilt_calibrated'").select("domain", F.col("mean").alias("q"))
    out.append(quality_route(spark, "direct", direct, direct_gate(spark, sf_dir)))
    return rounded(reduce(DataFrame.unionByName, out), 5)


def quality_route(spark: SparkSession, name: str, quality: DataFrame, gate: DataFrame) -> DataFrame:
    """route, domain, q, standardised, eligible: the gate's verdict holds for all domains; without a verdict none is eligible."""
    verdict = gate.select("passes").first()
    s = transfer.standardised(quality, "q", "z")
    ok = bool(verdict and verdict.passes)
    return s.select(F.lit(name).alias("route"), "domain", "q", F.when(F.lit(ok), F.col("z")).alias("standardised"), F.lit(ok).alias("eligible"))


_SIDE = f"a0 AS (SELECT record_key, {parts.DOMAIN} AS domain, id FROM quality_reconstruction WHERE corpus = 'A1' AND content IS NOT NULL), a AS (SELECT * FROM a0 WHERE domain IS NOT NULL)"
ORACLE = {
    "signal_join_audit": f"""WITH {parts.RECORDS}, {_SIDE}, k AS (SELECT domain, id, count(*) AS c FROM r WHERE a1 AND domain IS NOT NULL AND id IS NOT NULL GROUP BY 1, 2), j AS (SELECT a.record_key, coalesce(c, 0) AS c FROM a LEFT JOIN k ON k.domain = a.domain AND k.id = a.id)
SELECT count(*) AS rows, count(*) FILTER (WHERE c = 1) AS matched, count(*) FILTER (WHERE c > 1) AS ambiguous, count(*) FILTER (WHERE c = 0) AS missing FROM j""",
}
QUERIES = {f.__name__: f for f in (signal_join_audit, signal_audit, signal_audit_by_domain, accepted_signals, profile_missingness, bridge_profiles, bridge_weights, bridge_sensitivity, bridge_anchors, bridge_gate, bridge_domains, direct_lodo, direct_gate, direct_domain_stats, quality_routes)}
