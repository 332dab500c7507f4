"""Transfer of quality between corpora: domain profiles, distances, soft assignments, completed maps, calibrations and gates.

Profiles are one row per domain; the number of domains is bounded by ``MAX_DOMAINS``, checked before two profile tables are paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.operators.order import pearson, quantiles

MAX_DOMAINS = 2000


def profiles(df: DataFrame, domain: str, fields: list[str]) -> DataFrame:
    """domain, n, and mean and population sd of each field."""
    return df.groupBy(F.col(domain).alias("domain")).agg(F.count("*").alias("n"), *[x for f in fields for x in (F.avg(f).alias(f"{f}_mean"), F.stddev_pop(f).alias(f"{f}_sd"))])


def distances(source: DataFrame, target: DataFrame, scales: dict[str, float], weights: dict[str, float] | None = None) -> DataFrame:
    """domain (of the target), quality_domain (of the source), parts and distance.

    Per field the squared difference of means plus a quarter of that of deviations, in units of the reference sd; the distance is
    the root of their weighted sum. ``parts`` keeps the components, so variants that leave fields out need no second pairing.
    """
    for side in (source, target):
        if side.limit(MAX_DOMAINS + 1).count() > MAX_DOMAINS:
            raise ValueError(f"more than {MAX_DOMAINS} domains")
    fields = list(scales)
    w = weights or dict.fromkeys(fields, 1.0)
    s = F.broadcast(source.select(F.col("domain").alias("quality_domain"), *[F.col(f"{f}_{k}").alias(f"s_{f}_{k}") for f in fields for k in ("mean", "sd")]))
    j = target.join(s, F.col("quality_domain").isNotNull())  # a bounded table of profiles on either side
    part = lambda f: (F.pow((F.col(f"{f}_mean") - F.col(f"s_{f}_mean")) / max(scales[f], 1e-8), 2) + 0.25 * F.pow((F.col(f"{f}_sd") - F.col(f"s_{f}_sd")) / max(scales[f], 1e-8), 2)) * w[f]
    return j.select("domain", "quality_domain", F.array(*[part(f) for f in fields]).alias("parts")).withColumn("distance", F.sqrt(F.aggregate("parts", F.lit(0.0), lambda a, x: a + x)))


def soft_weights(d: DataFrame, group: list[str], temperature: float | Column = 1.0) -> DataFrame:
    """Adds weight exp(-(d - min d) / temperature), normalised within the group, and the rank of the distance."""
    w = Window.partitionBy(*group)
    t = F.lit(float(temperature)) if isinstance(temperature, (int, float)) else temperature
    e = F.exp(-(F.col("distance") - F.min("distance").over(w)) / t)
    return d.withColumn("_e", e).withColumn("weight", F.col("_e") / F.sum("_e").over(w)).drop("_e").withColumn("rank", F.row_number().over(w.orderBy("distance", "quality_domain")))


def variants(d: DataFrame, fields: list[str], temperatures: list[float]) -> DataFrame:
    """Every pair with each field left out in turn (and none), at each temperature: distance, weight and rank of each variant."""
    omit = F.explode(F.array(*[F.struct(F.lit(f).alias("omitted"), F.lit(i).alias("_i")) for i, f in [(-1, "none"), *enumerate(fields)]])).alias("v")
    x = d.select("domain", "quality_domain", "parts", omit, F.explode(F.array(*[F.lit(float(t)) for t in temperatures])).alias("temperature"))
    x = x.select("domain", "quality_domain", "v.omitted", "temperature", F.sqrt(F.greatest(F.lit(0.0), F.aggregate("parts", F.lit(0.0), lambda a, p: a + p) - F.when(F.col("v._i") < 0, 0.0).otherwise(F.get("parts", F.col("v._i"))))).alias("distance"))
    return soft_weights(x, ["domain", "omitted", "temperature"], F.col("temperature"))


def complete_map(main: DataFrame, stability: DataFrame, known: DataFrame) -> DataFrame:
    """One quality domain per domain: the known one where it is given directly, else the nearest, with its confidence."""
    w = Window.partitionBy("domain").orderBy("rank")
    top = main.withColumn("margin", F.lead("distance").over(w) - F.col("distance")).where("rank = 1").select("domain", F.col("quality_domain").alias("nearest"), F.col("weight").alias("probability"), "margin")
    k = known.select(F.col("mixture_domain").alias("domain"), F.when(F.col("mapping_type").isin("direct", "near_direct") & (F.col("quality_domain") != "(none)"), F.col("quality_domain")).alias("given"))
    j = top.join(F.broadcast(stability), "domain", "left").join(F.broadcast(k), "domain", "left")
    weak = (F.col("probability") < 0.35) | (F.coalesce("margin", F.lit(0.0)) < 0.25) | (F.coalesce("stability", F.lit(0.0)) < 0.75)
    return j.select("domain", F.coalesce("given", "nearest").alias("quality_domain"), F.col("given").isNotNull().alias("fixed"), "nearest", "probability", "margin", "stability", F.when(F.col("given").isNotNull(), "teacher_provided").when(weak, "limited").otherwise("moderate").alias("confidence"))


def audit(df: DataFrame, group: list[str], official: str, rebuilt: str, unique: str, least_r: float = 0.95, most_error: float | None = 0.10) -> DataFrame:
    """Agreement of rebuilt with official values: n, pearson, mae, mae over the interquartile range, exact share, passed (at least 10 pairs)."""
    both = df.where(F.col(official).isNotNull() & F.col(rebuilt).isNotNull()).select(*group, unique, F.col(official).alias("a"), F.col(rebuilt).alias("b"))
    q = quantiles(both, group, "a", [0.25, 0.75], unique).select(*group, (F.col("q")[1] - F.col("q")[0]).alias("iqr"))
    err = F.abs(F.col("a") - F.col("b"))
    m = both.groupBy(*group).agg(F.count("*").alias("n"), pearson(F.col("a"), F.col("b")).alias("pearson"), F.avg(err).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg((err <= 1e-6).cast("double")).alias("exact_rate"))
    j = m.join(q, group).withColumn("mae_over_iqr", F.try_divide(F.col("mae"), F.when(F.col("iqr") > 0, F.col("iqr"))))
    ok = (F.col("n") >= 10) & (F.coalesce("pearson", F.lit(0.0)) >= least_r)
    if most_error is not None:
        ok = ok & (F.coalesce("mae_over_iqr", F.lit(1e9)) <= most_error)
    return j.withColumn("passed", ok)


def calibration(df: DataFrame, group: list[str], rebuilt: str, official: str, low: float = 0.0, high: float = 1.0, least: int = 20) -> DataFrame:
    """Least-squares line from rebuilt to official, slope at least 0 (0 if nothing varies), clip bounds; groups of fewer than ``least`` pairs give no row."""
    both = df.where(F.col(official).isNotNull() & F.col(rebuilt).isNotNull())
    m = both.groupBy(*group).agg(F.count("*").alias("n"), F.var_pop(rebuilt).alias("v"), F.covar_pop(rebuilt, official).alias("c"), F.avg(rebuilt).alias("mx"), F.avg(official).alias("my"))
    slope = F.when(F.col("v") > 1e-12, F.greatest(F.lit(0.0), F.col("c") / F.col("v"))).otherwise(0.0)
    return m.where(F.col("n") >= least).withColumn("slope", slope).select(*group, "n", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), F.lit(low).alias("low"), F.lit(high).alias("high"))


def standardised(df: DataFrame, value: str, name: str) -> DataFrame:
    """Adds (value - mean) / population sd over all rows, 0 where the sd is at most 1e-10; NULL and NaN values are an error. One row of sums."""
    s = df.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.count_if(F.col(value).isNull() | F.isnan(value)).alias("bad")).first()
    if s.bad:
        raise ValueError(f"{s.bad} values of {value} are missing")
    return df.withColumn(name, (F.col(value) - F.lit(s.m)) / F.lit(s.s) if (s.s or 0.0) > 1e-10 else F.lit(0.0))


def bridge(recipes: DataFrame, known: DataFrame, scores: DataFrame, extension: DataFrame) -> DataFrame:
    """Per recipe: quality by mapped domains, and its bounds if unmapped domains were worst or best.

    recipes: index, domain, p. known: domain, quality_domain. scores: quality_domain, q, low, high. extension: quality_domain, q_ext. Missing
    scores are filled with the mean of the mapped ones where a sensitivity needs a value.
    """
    m = known.join(F.broadcast(scores), "quality_domain", "left").join(F.broadcast(extension), "quality_domain", "left").select("domain", "q", "low", "high", "q_ext")
    m = m.withColumn("q_mean", F.avg("q").over(Window.partitionBy()))  # one row per mapped domain
    j = recipes.join(F.broadcast(m), "domain", "left")
    p, z = F.col("p"), F.lit(0.0)
    mass = F.sum(F.when(F.col("q").isNotNull(), p).otherwise(z))
    part = F.sum(p * F.coalesce("q", z))
    return j.groupBy("index").agg(
        part.alias("known_contribution"), mass.alias("mapped_mass"), F.when(mass > 0, part / mass).alias("on_mapped_mass"), F.sum(p * F.coalesce("q", "q_mean")).alias("filled"),
        F.sum(p * F.coalesce("q_ext", "q", "q_mean")).alias("extension_filled"), part.alias("lower"), (part + 1 - mass).alias("upper"),
        F.sum(p * F.coalesce("low", z)).alias("lower_ci"), (F.sum(p * F.coalesce("high", z)) + 1 - mass).alias("upper_ci"),
    )
