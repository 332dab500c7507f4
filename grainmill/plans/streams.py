"""Queries that run as streams over the files of a table, and audits of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.plans import parts
from grainmill.plans.quality import rounded
from grainmill.sources.tables import domain_of
from grainmill.streaming.apply import domain_counts, read_stream, run_available, score_stream


def stream_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q1 as a stream, scored by parameters fitted before: unique records and their valid coverage per domain."""
    _, fitted = parts.fitted_records(spark, sf_dir)
    scored = score_stream(read_stream(spark, sf_dir, "q1"), domain_of(F.col("_source_domain"), F.col("_source_path")), fitted)
    return rounded(domain_counts(run_available(scored, "quality")))


ORACLE = {
    "stream_quality_counts": f"WITH {parts.RECORDS} SELECT domain, count(*) AS n, round(avg(({' + '.join('(qurater_0 IS NOT NULL)::INT' if f == 'qurater' else f'({f} IS NOT NULL)::INT' for f in parts.FIELDS)}) / 22::DOUBLE), 6) AS mean_valid_coverage FROM r GROUP BY domain"
}
QUERIES = {"stream_quality_counts": stream_quality_counts}
