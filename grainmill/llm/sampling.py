"""Problem 6: a reproducible sample that keeps its members as data grows, by hashing stable keys to the unit interval.

A record is in the sample iff hash(salt, identity) < rate of its stratum. That depends on nothing but the record, so it is the same in
every run and partitioning, records never leave when others arrive, and a lower rate selects a subset. Of the repeated rows
of a record, the one of the earliest batch represents it, so the row stays the same as well.

The rows outside the sample are dropped in the scan's own stage; only the sampled ones are shuffled, by identity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm.common import PATH_DOMAIN, clean_domain, path_domain, read

SALT = "grainmill-sample-1"
RATE = 0.2
#: Small strata are kept at higher rates. A rate that later rises only adds records; it must not fall.
RATES = {"book": 0.5, "arxiv": 0.5, "ubuntu_irc": 0.5, "philpapers": 0.5}
MAX_BATCHES = 10_000
_HEX = 13  #: hexadecimal digits of the hash that make the unit interval, 52 bits


def unit_hash(identity: Column, salt: str = SALT) -> Column:
    """The first 52 bits of sha-256 as 13 hexadecimal digits, which order as the numbers do."""
    return F.substring(F.sha2(F.concat(F.lit(salt + "|"), identity), 256), 1, _HEX)


def threshold(rate: float) -> str:
    """Hashes below this are below ``rate``; for rate 1, above every hash."""
    if not 0 <= rate <= 1:
        raise ValueError("rates must be between 0 and 1")
    return "g" if rate == 1 else format(int(rate * 16**_HEX), f"0{_HEX}x")


def identity_of(stratum: Column, id_: Column, path: Column, body: Column) -> Column:
    """One string per record: stratum and id, or stratum, path and body where there is no id (NULL or blank). NULLs are distinct from texts."""
    part = lambda c: F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    has = F.coalesce(F.trim(id_) != "", F.lit(False))
    return F.when(has, F.concat(F.lit("i|"), part(stratum), part(id_))).otherwise(F.concat(F.lit("p|"), part(stratum), part(path), F.coalesce(F.sha2(body, 256), F.lit("-"))))


def stable_sample(df: DataFrame, stratum: str, identity: str, order: list[str], rate: float = RATE, rates: dict[str, float] | None = None, salt: str = SALT, every: bool = False) -> DataFrame:
    """The rows of ``df`` whose record is sampled, one per identity: the first by ``order``, which should be unique.

    ``rates`` holds by stratum; other strata, NULL among them, have ``rate``. NULL identities are never sampled. Adds ``unit``.
    ``every``: all rows of the sampled records.
    """
    limit = F.lit(threshold(rate))
    for name, r in (rates or {}).items():
        limit = F.when(F.col(stratum).eqNullSafe(name), F.lit(threshold(r))).otherwise(limit)
    unit = "unit" if "unit" not in df.columns else "unit_hash"
    inside = df.withColumn(unit, unit_hash(F.col(identity), salt)).where(F.col(unit) < limit)
    if every:
        return inside
    # a record that is repeated very often is reduced map-side
    first = inside.groupBy(identity).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in inside.columns if c != identity]), F.struct(*order)).alias("row"))
    return first.select(identity, "row.*")


def text_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of quality_reconstruction with their stratum (NULL domains from the path) and identity."""
    q = read(spark, sf_dir, "quality_reconstruction", "record_key", "id", "_source_domain", "_source_path", "corpus", "content", "text", "load_batch")
    stratum = F.coalesce(clean_domain(F.col("_source_domain")), path_domain(F.col("_source_path")))
    body = F.when(F.col("corpus") == "A18", F.col("text")).otherwise(F.col("content"))
    q = q.withColumn("domain", stratum).withColumn("identity", identity_of(F.concat_ws("/", F.col("corpus"), stratum), F.col("id"), F.col("_source_path"), body))
    return q.select("record_key", "domain", "corpus", "load_batch", "identity")


def p6_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stable_sample(text_records(spark, sf_dir), "domain", "identity", ["load_batch", "record_key"], RATE, RATES)
    return out.select("domain", F.sha2("identity", 256).alias("identity_hash"), "record_key", "load_batch", "unit")


def growth(rows: DataFrame, batch: str, stratum: str, identity: str, order: list[str], rate: float = RATE, rates: dict[str, float] | None = None) -> DataFrame:
    """batch, members, lost, replaced: the sample of the rows up to each batch, drawn from those rows alone, against the sample of all rows.

    ``lost`` members are missing from the sample of all rows, ``replaced`` ones have another row there; both must be 0 where ``order`` begins with
    the batch. Rows of a NULL batch belong to no prefix. Only sampled rows are repeated, once per later batch.
    """
    batches = rows.where(F.col(batch).isNotNull()).select(F.col(batch).alias("upto")).distinct()
    known = [r.upto for r in batches.limit(MAX_BATCHES + 1).collect()]
    if len(known) > MAX_BATCHES:
        raise ValueError(f"more than {MAX_BATCHES} batches")
    later = F.explode(F.filter(F.array(*map(F.lit, sorted(known))).cast(f"array<{rows.schema[batch].dataType.simpleString()}>"), lambda b: b >= F.col(batch)))
    inside = stable_sample(rows.withColumn("_key", F.col(identity)), stratum, "_key", order, rate, rates, every=True)
    each = inside.select("*", later.alias("upto"))
    drawn = each.groupBy("upto", "_key").agg(F.min(F.struct(*order)).alias("_then"))
    final = stable_sample(rows, stratum, identity, order, rate, rates).select(F.col(identity).alias("_key"), F.struct(*order).alias("_final"))
    j = drawn.join(final, "_key", "left")
    n = j.groupBy("upto").agg(F.count("*").alias("members"), F.count_if(F.col("_final").isNull()).alias("lost"), F.count_if(F.col("_final") != F.col("_then")).alias("replaced"))
    out = batches.join(n, "upto", "left").na.fill(0, ["members", "lost", "replaced"])
    return out.withColumnRenamed("upto", batch)


def p6_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per load batch: the sample of the batches up to it, and how many of its members the sample of all batches lost or replaced."""
    return growth(text_records(spark, sf_dir), "load_batch", "domain", "identity", ["load_batch", "record_key"], RATE, RATES)


_THRESHOLDS = " ".join(f"WHEN '{k}' THEN '{threshold(v)}'" for k, v in RATES.items())
_SQL = f"""
WITH r AS (SELECT record_key, load_batch, corpus, id, _source_path, CASE WHEN corpus = 'A18' THEN text ELSE content END AS body,
                  coalesce(nullif(lower(trim(_source_domain)), ''), nullif(lower(regexp_extract(_source_path, '{PATH_DOMAIN}', 1)), '')) AS domain
           FROM quality_reconstruction),
k AS (SELECT *, concat_ws('/', corpus, domain) AS stratum FROM r),
i AS (SELECT *, CASE WHEN trim(coalesce(id, '')) <> '' THEN 'i|' || length(stratum) || ':' || stratum || length(id) || ':' || id
                ELSE 'p|' || length(stratum) || ':' || stratum || coalesce(length(_source_path) || ':' || _source_path, '-') || coalesce(sha256(body), '-') END AS identity FROM k),
u AS (SELECT *, substr(sha256('{SALT}|' || identity), 1, {_HEX}) AS unit FROM i),
s AS (SELECT * FROM u WHERE unit < CASE domain {_THRESHOLDS} ELSE '{threshold(RATE)}' END
      QUALIFY row_number() OVER (PARTITION BY identity ORDER BY load_batch, record_key) = 1)
"""
ORACLE = {
    "p6_sample": _SQL + "SELECT domain, sha256(identity) AS identity_hash, record_key, load_batch, unit FROM s",
    "p6_growth": _SQL.rstrip() + f""",
pre AS (SELECT b.load_batch AS upto, u.* FROM u JOIN (SELECT DISTINCT load_batch FROM r WHERE load_batch IS NOT NULL) b ON u.load_batch <= b.load_batch),
ps AS (SELECT * FROM pre WHERE unit < CASE domain {_THRESHOLDS} ELSE '{threshold(RATE)}' END QUALIFY row_number() OVER (PARTITION BY upto, identity ORDER BY load_batch, record_key) = 1)
SELECT ps.upto AS load_batch, count(*) AS members, count(*) FILTER (WHERE s.identity IS NULL) AS lost, count(*) FILTER (WHERE s.record_key <> ps.record_key) AS replaced FROM ps LEFT JOIN s ON s.identity = ps.identity GROUP BY 1""",
}
QUERIES = {"p6_sample": p6_sample, "p6_growth": p6_growth}
