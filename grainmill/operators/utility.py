"""Utilities of signals: fit once on reference records, apply unchanged to any source.

``fit`` is the only action; it returns plain numbers (a few hundred), which ``apply_utilities`` puts into a projection as literals. Applying
reads no data but the row, so it is also safe on streams.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainmill.functions.signals import ATOMIC, FIELDS, QURATER
from grainmill.operators.brackets import search

# The kind of utility of each field and its parameters.
SPECS: dict[str, dict] = {
    "fineweb_edu": {"kind": "fixed_positive", "bounds": (0.0, 5.0)},
    "fluency_en": {"kind": "identity"},
    "modernbert_cleanliness": {"kind": "identity"},
    "modernbert_readability": {"kind": "identity"},
    "modernbert_reasoning": {"kind": "identity"},
    "modernbert_professionalism": {"kind": "identity"},
    "qurater": {"kind": "reference_positive"},
    "ad_en": {"kind": "identity"},
    "dsir_books": {"kind": "reference_positive"},
    "dsir_wiki": {"kind": "reference_positive"},
    "dsir_math": {"kind": "reference_positive"},
    "rps_doc_word_count": {"kind": "reference_interval", "log1p": True, "quantiles": (0.05, 0.95)},
    "rps_doc_num_sentences": {"kind": "reference_interval", "log1p": True, "quantiles": (0.05, 0.95)},
    "rps_doc_unigram_entropy": {"kind": "reference_interval", "quantiles": (0.01, 0.99)},
    "rps_doc_frac_unique_words": {"kind": "reference_positive"},
    "rps_doc_frac_no_alph_words": {"kind": "upper_tolerance", "tolerance": 0.2, "by_domain": {"arxiv": 0.45, "github": 0.8}},
    "rps_doc_frac_chars_top_2gram": {"kind": "reference_negative"},
    "rps_doc_frac_chars_top_3gram": {"kind": "reference_negative"},
    "rps_lines_uppercase_letter_fraction": {"kind": "upper_tolerance", "tolerance": 0.15, "by_domain": {"arxiv": 0.3, "github": 0.3}},
    "rps_lines_ending_with_terminal_punctution_mark": {"kind": "fixed_positive", "bounds": (0.0, 0.3), "neutral": ("github",)},
    "rps_lines_numerical_chars_fraction": {"kind": "upper_tolerance", "tolerance": 0.2, "by_domain": {"arxiv": 0.5, "github": 0.5}},
    "rps_doc_mean_word_length": {"kind": "reference_interval", "quantiles": (0.01, 0.99)},
}
REFERENCE_QUANTILES = (0.01, 0.99)
QURATER_WEIGHTS = (0.25, 0.25, 0.25, 0.25)
DIRECTIONS = {"identity": "higher", "fixed_positive": "higher", "reference_positive": "higher", "reference_negative": "lower", "reference_interval": "typical_interval", "upper_tolerance": "below_tolerance"}


def spec_of(column: str, specs: dict[str, dict] | None = None) -> dict:
    return (specs or SPECS)["qurater" if column in QURATER else column]


def validate(specs: dict[str, dict], qurater_weights: tuple[float, ...] = QURATER_WEIGHTS, high: float = 0.75, low: float = 0.25, eta: float = 0.25) -> None:
    """Configuration errors: fields not covered exactly, unknown kinds, thresholds or weights out of range."""
    if set(specs) != set(FIELDS):
        raise ValueError("utilities must cover the 22 fields exactly")
    if unknown := {s["kind"] for s in specs.values()} - set(DIRECTIONS):
        raise ValueError(f"unknown kinds of utility: {sorted(unknown)}")
    if not 0 < low < high < 1:
        raise ValueError("thresholds must satisfy 0 < low < high < 1")
    if not 0 <= eta <= 1:
        raise ValueError("eta must be between 0 and 1")
    if len(qurater_weights) != 4 or min(qurater_weights) < 0 or abs(sum(qurater_weights) - 1) > 1e-9:
        raise ValueError("four weights, none negative, must sum to 1")


def validate_experiment(config: dict) -> None:
    """Errors of a comparison of schemes: profiles, knots, shares and repeats out of range."""
    if not config.get("profiles") or len(set(config["profiles"])) < len(config["profiles"]):
        raise ValueError("profiles must be named, each once")
    if config.get("knots", 2) < 2:
        raise ValueError("a percentile map needs at least two knots")
    if any(not 0 <= x <= 1 for x in (config.get("shrinkage", 1.0), *config.get("shrinkage_grid", ()))):
        raise ValueError("shrinkage must be between 0 and 1")
    if not 0 < config.get("fraction", 0.2) < 1:
        raise ValueError("the selected fraction must lie between 0 and 1")
    if not 0 <= config.get("repeats", 0) <= 1000:
        raise ValueError("repeats must be between 0 and 1000")


def balanced_weights(df: DataFrame, domain: str, name: str = "w") -> DataFrame:
    """Adds 1 / (number of domains * rows of the domain): every domain has the same total. NULL is a domain of its own."""
    sizes = df.groupBy(F.col(domain).alias("_d")).agg(F.count("*").alias("_n"))
    per = sizes.withColumn("_g", F.count("*").over(Window.partitionBy()))  # one row per domain
    return df.join(F.broadcast(per), F.col(domain).eqNullSafe(F.col("_d"))).withColumn(name, 1 / (F.col("_g") * F.col("_n").cast("double"))).drop("_d", "_n", "_g")


def unpivot(df: DataFrame, ids: list[str], columns: list[str], key: str = "column", value: str = "x") -> DataFrame:
    return df.unpivot(ids, list(columns), key, value)


@dataclass
class Fitted:
    """What ``fit`` learnt from the reference records."""

    medians: dict[str, float]
    domain_medians: dict[str, dict[str, float]]
    bounds: dict[str, tuple[float, float]]
    unavailable: set[str] = field(default_factory=set)


MAX_DOMAINS = 2000  #: domains of the reference; each has a median per column on the driver


def fit(reference: DataFrame, domain: str, unique: str, specs: dict[str, dict] | None = None) -> Fitted:
    """Global (domain-balanced) and per-domain medians, and the empirical bounds, from weighted quantiles of all columns by bisection over the wide rows.

    Columns without any value get median 0, bounds (0, 0) and are unavailable. Driver-held: 25 columns times the domains, which are at most MAX_DOMAINS.
    """
    sizes = sorted(((r.d or "", r.n) for r in reference.groupBy(F.coalesce(F.col(domain), F.lit("")).alias("d")).agg(F.count("*").alias("n")).limit(MAX_DOMAINS + 1).collect()))
    if len(sizes) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    spark = reference.sparkSession
    table = spark.createDataFrame([(d, i, 1 / (len(sizes) * float(n))) for i, (d, n) in enumerate(sizes)], "_d string, g int, w double")
    rows = reference.join(F.broadcast(table), F.coalesce(F.col(domain), F.lit("")) == F.col("_d")).select("g", F.col(unique).alias("k"), "w", *ATOMIC)
    probs = {c: (0.5,) if "bounds" in spec_of(c, specs) else (0.5, *spec_of(c, specs).get("quantiles", REFERENCE_QUANTILES)) for c in ATOMIC}
    wanted = [(-1, i, p) for i, c in enumerate(ATOMIC) for p in probs[c]] + [(g, i, 0.5) for g in range(len(sizes)) for i in range(len(ATOMIC))]
    found = search(rows, list(ATOMIC), wanted)
    medians, bounds, by = {}, {}, {}
    for i, c in enumerate(ATOMIC):
        spec = spec_of(c, specs)
        scale = (lambda x: float(np.log1p(max(x, 0.0)))) if spec.get("log1p") else lambda x: x
        at = lambda p, scale=lambda x: x, i=i: found[-1, i, p].value(scale) if (-1, i, p) in found else 0.0
        medians[c] = at(0.5)
        bounds[c] = spec.get("bounds") or tuple(at(p, scale) for p in spec.get("quantiles", REFERENCE_QUANTILES))
        for g, (d, _) in enumerate(sizes):
            if (g, i, 0.5) in found:
                by.setdefault(d, {})[c] = found[g, i, 0.5].value()
    return Fitted(medians, by, bounds, {c for i, c in enumerate(ATOMIC) if (-1, i, 0.5) not in found})


def save(fitted: Fitted, spark: SparkSession, path: str) -> None:
    """Writes what was fitted as JSON, on any file system that the session knows; an existing path is an error."""
    text = json.dumps(asdict(fitted) | {"unavailable": sorted(fitted.unavailable)}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def load(spark: SparkSession, path: str) -> Fitted:
    d = json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    missing = set(ATOMIC) - set(d["medians"]) | set(ATOMIC) - set(d["bounds"])
    if missing:
        raise ValueError(f"no fit of {sorted(missing)}")
    return Fitted(d["medians"], d["domain_medians"], {c: tuple(b) for c, b in d["bounds"].items()}, set(d["unavailable"]))


def with_medians(df: DataFrame, domain: str, fitted: Fitted) -> DataFrame:
    """Adds m_*, the medians of the row's domain (NULL for unknown domains), from a table of one row per reference domain."""
    rows = [(d, *[float(m[c]) if c in m else None for c in ATOMIC]) for d, m in sorted(fitted.domain_medians.items())]
    table = df.sparkSession.createDataFrame(rows, "_d string, " + ", ".join(f"m_{c} double" for c in ATOMIC))
    return df.join(F.broadcast(table), F.coalesce(F.col(domain), F.lit("")) == F.col("_d"), "left").drop("_d")


def imputed(c: str, fitted: Fitted, global_only: bool = False) -> Column:
    """The value, else the median of its domain, else the global one."""
    return F.expr(f"coalesce({c}, {float(fitted.medians[c])!r}D)" if global_only else f"coalesce({c}, m_{c}, {float(fitted.medians[c])!r}D)")


@dataclass(frozen=True)
class Case:
    """What a kind of utility may need: the value, the field's bounds, its specification and the row's domain."""

    x: Column
    low: float
    high: float
    spec: dict
    domain: Column
    allowance: bool

    def scaled(self) -> Column:
        """0 at the lower and 1 at the upper bound, clipped; one half where they coincide."""
        return F.lit(0.5) if self.high - self.low < 1e-12 else unit((self.x - self.low) / (self.high - self.low))

    def beyond_interval(self) -> Column:
        """Distance to the interval in its half-widths."""
        outside = F.greatest(self.low - self.x, self.x - self.high, F.lit(0.0))
        return outside / max((self.high - self.low) / 2, 1e-6)

    def beyond_tolerance(self) -> Column:
        """Distance above the domain's tolerance, in halves of what is left to 1."""
        by = self.spec.get("by_domain", {}) if self.allowance else {}
        limit = F.coalesce(*[F.when(self.domain == d, F.lit(v)) for d, v in by.items()], F.lit(self.spec["tolerance"]))
        return F.greatest(self.x - limit, F.lit(0.0)) / F.greatest((1 - limit) / 2, F.lit(1e-6))


def unit(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def fading(distance: Column) -> Column:
    return F.exp(-distance * distance)


#: The column of each kind of utility. A new kind is one more entry here and in DIRECTIONS.
KINDS: dict[str, Callable[[Case], Column]] = {
    "identity": lambda c: unit(c.x),
    "fixed_positive": Case.scaled,
    "reference_positive": Case.scaled,
    "reference_negative": lambda c: 1 - c.scaled(),
    "reference_interval": lambda c: fading(c.beyond_interval()),
    "upper_tolerance": lambda c: fading(c.beyond_tolerance()),
}


def utility(c: str, x: Column, domain: Column, fitted: Fitted, specs: dict[str, dict] | None = None, allowance: bool = True) -> Column:
    """Utility in [0, 1] of one column's imputed value; one half for unavailable columns and in the field's neutral domains."""
    spec = spec_of(c, specs)
    if spec["kind"] not in KINDS:
        raise ValueError(f"unknown kind of utility: {spec['kind']}")
    if c in fitted.unavailable:
        return F.lit(0.5)
    value = F.log1p(F.greatest(x, F.lit(0.0))) if spec.get("log1p") else x
    z = KINDS[spec["kind"]](Case(value, *fitted.bounds[c], spec, domain, allowance))
    neutral = spec.get("neutral", ()) if allowance else ()
    return F.when(domain.isin(*neutral), 0.5).otherwise(z) if neutral else z


def apply_utilities(df: DataFrame, domain: str, fitted: Fitted, keep: list[str], specs: dict[str, dict] | None = None, allowance: bool = True, global_only: bool = False) -> DataFrame:
    """``keep``, the 25 atomic utilities u_*, the 22 rolled-up z_*, and the shares of fields that were valid and applicable. A projection after a broadcast of the medians."""
    d = F.col(domain)
    df = df if global_only else with_medians(df, domain, fitted)
    u = df.select(*keep, *[utility(c, imputed(c, fitted, global_only), d, fitted, specs, allowance).alias(f"u_{c}") for c in ATOMIC], *[F.col(c).isNotNull().alias(f"v_{c}") for c in ATOMIC], d.alias("_domain"))
    d = F.col("_domain")
    z = [sum((F.col(f"u_{q}") * w for q, w in zip(QURATER, QURATER_WEIGHTS)), F.lit(0.0)).alias("z_qurater") if f == "qurater" else F.col(f"u_{f}").alias(f"z_{f}") for f in FIELDS]
    valid = [F.col("v_qurater_0") & F.col("v_qurater_1") & F.col("v_qurater_2") & F.col("v_qurater_3") if f == "qurater" else F.col(f"v_{f}") for f in FIELDS]
    neutral = [F.when(d.isin(*spec_of(f, specs)["neutral"]), 0.0).otherwise(1.0) if allowance and spec_of(f, specs).get("neutral") else F.lit(1.0) for f in FIELDS]
    n = float(len(FIELDS))
    return u.select(*keep, *[f"u_{c}" for c in ATOMIC], *z, (sum((v.cast("double") for v in valid), F.lit(0.0)) / n).alias("valid_coverage"), (sum(neutral, F.lit(0.0)) / n).alias("applicable_coverage"))


def dictionary(fitted: Fitted, specs: dict[str, dict] | None = None) -> list[dict]:
    """Description of the 25 utilities, as rows."""
    out = []
    for c in ATOMIC:
        s = spec_of(c, specs)
        out.append({"column": c, "kind": s["kind"], "direction": DIRECTIONS[s["kind"]], "log1p": bool(s.get("log1p")), "lower": float(fitted.bounds[c][0]), "upper": float(fitted.bounds[c][1])})
    return out
