"""Frozen scoring of a stream: first-seen records only, utilities by parameters that were fitted on reference data before.

Applying is a projection, so it needs no state; the only state is the set of identities seen, which a watermark bounds where rows carry
a time and late repeats beyond it don't occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from grainmill.functions.signals import FIELDS, decode
from grainmill.operators.identity import with_identity
from grainmill.operators.utility import Fitted, apply_utilities
from grainmill.sources.shared import shared_dir


def read_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A table of a scale directory as a stream of its files; ``files_per_batch`` limits what a batch takes in."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def score_stream(stream: DataFrame, domain: Column, fitted: Fitted, event_time: str | None = None, delay: str = "30 days") -> DataFrame:
    """Rows of records not seen before, with their utilities. ``event_time``: forget identities ``delay`` behind it."""
    rows = with_identity(stream, domain)
    rows = rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["uid"]) if event_time else rows.dropDuplicates(["uid"])
    return apply_utilities(decode(rows.select("row_key", "uid", "domain", *FIELDS), ["row_key", "uid", "domain"]), "domain", fitted, ["row_key", "uid", "domain"])


def start(stream: DataFrame, path: str, checkpoint: str, every: str = "1 minute") -> StreamingQuery:
    """A stream that goes on, a batch ``every`` interval, exactly once into a Parquet table; the checkpoint lets it resume."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=every).start()


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what is there now, exactly once, into a Parquet table of the shared folder, and returns the table."""
    spark = stream.sparkSession
    import uuid

    base = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def domain_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("domain").agg(F.count("*").alias("n"), F.avg("valid_coverage").alias("mean_valid_coverage"))
