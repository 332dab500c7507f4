"""Record identity: signatures, first-seen deduplication, source masks, conflicts and the audit of files.

A record is known by (domain, id, signature), the signature being a digest of its 22 signals. Rows come in source order: by source label,
then by row key. NULL domains, ids and signals compare as equal to NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions.signals import FIELDS

LABELS = ("A1", "A2", "A3")


def signature() -> Column:
    """Digest of the signals; equal exactly where all 22 fields are equal."""
    return F.sha2(F.to_json(F.struct(*sorted(FIELDS)), {"ignoreNullFields": "false"}), 256)


def uid(domain: Column, id_: Column, sig: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.coalesce(domain, F.lit("")), F.coalesce(id_, F.lit("")), sig), 256), 1, 24)


def with_identity(q1: DataFrame, domain: Column) -> DataFrame:
    """``q1`` with domain, signature and uid."""
    d = q1.withColumn("domain", domain).withColumn("signature", signature())
    return d.withColumn("uid", uid(F.col("domain"), F.col("id"), F.col("signature")))


def first_seen(df: DataFrame) -> DataFrame:
    """One row per uid, the first in source order, with the sorted ``membership`` of all its rows joined by semicolons.

    A record that is delivered very often is reduced map-side, never gathered.
    """
    kept = [c for c in df.columns if c not in ("uid", "source_label", "row_key")]
    order = F.struct("source_label", "row_key")
    labels = [F.max((F.col("source_label") == x).cast("int")).alias(f"_{x}") for x in LABELS]
    one = df.groupBy("uid").agg(F.min_by(F.struct("source_label", "row_key", *kept), order).alias("r"), *labels)
    member = F.concat_ws(";", *[F.when(F.col(f"_{x}") == 1, F.lit(x)) for x in LABELS])
    return one.select("uid", "r.*", member.alias("membership"))


def masks(membership: Column) -> Column:
    """The source sets a record counts in: its labels, the new parts of A2 and A3, and the union of all."""
    has = {x: F.array_contains(F.split(membership, ";"), x) for x in LABELS}
    named = [F.when(has[x], F.lit(x)) for x in LABELS]
    named += [F.when(has[x] & ~has["A1"], F.lit(f"{x}_new")) for x in LABELS[1:]]
    return F.array_compact(F.array(*named, F.lit("union")))


def conflicts(df: DataFrame) -> DataFrame:
    """domain, id, keys, conflicts = keys - 1 for ids that carry several signatures, all of them kept as records."""
    per = df.groupBy("domain", "id").agg(F.count_distinct("uid").alias("keys"))
    return per.where("keys > 1").withColumn("conflicts", F.col("keys") - 1)


def source_audit(df: DataFrame, invalid: Column) -> DataFrame:
    """Per source label: rows, rows that don't decode fully, repeats within the source, records already seen in an earlier source."""
    per = df.groupBy("source_label", "uid").agg(F.count("*").alias("rows"), F.sum(invalid.cast("long")).alias("bad"))
    first = df.groupBy("uid").agg(F.min("source_label").alias("first_label"))
    j = per.join(first, "uid")
    return j.groupBy("source_label").agg(
        F.sum("rows").alias("records"), F.sum("bad").alias("records_with_issues"), F.sum(F.col("rows") - 1).alias("internal_duplicates"),
        F.sum((F.col("first_label") < F.col("source_label")).cast("long")).alias("seen_before"), F.count("*").alias("distinct_records"),
    )


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows of ``left`` with the one row of ``right`` that has their keys, and a row that counts matched, ambiguous and missing ones.

    Keys of several right rows are ambiguous, their left rows stay out, as do those without any; ``strict`` makes either an error. NULL keys match nothing.
    """
    tag = "_several"
    per = right.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias(tag), F.first(F.struct(*[c for c in right.columns if c not in keys])).alias("_row"))
    j = left.join(per, keys, "left").withColumn(tag, F.coalesce(tag, F.lit(0)))
    audit = j.agg(F.count("*").alias("rows"), F.count_if(F.col(tag) == 1).alias("matched"), F.count_if(F.col(tag) > 1).alias("ambiguous"), F.count_if(F.col(tag) == 0).alias("missing"))
    if strict and (bad := audit.first()).matched < bad.rows:
        raise ValueError(f"{bad.ambiguous} ambiguous and {bad.missing} missing rows")
    return j.where(F.col(tag) == 1).select(*left.columns, "_row.*"), audit


def content_conflicts(df: DataFrame, content_hash: str, strict: bool = False) -> DataFrame:
    """uid, hashes: records whose rows carry several different non-empty contents. ``strict``: any of them is an error."""
    h = F.when(F.col(content_hash) != "", F.col(content_hash))
    bad = df.groupBy("uid").agg(F.min(h).alias("_a"), F.max(h).alias("_b")).where("_a <> _b").select("uid", F.array("_a", "_b").alias("hashes"))
    if strict and (first := bad.first()):
        raise ValueError(f"record {first.uid} has different contents")
    return bad


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: distinct keys of either side only, and whether both sets are equal. NULLs equal NULLs."""
    both = a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    per = both.groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    n = per.agg(F.count_if(F.expr("_b = 0")).alias("only_left"), F.count_if(F.expr("_a = 0")).alias("only_right"))
    return n.withColumn("equal", F.expr("only_left = 0 AND only_right = 0"))
