"""Shared plumbing of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.sources.package import ship
from grainmill.sources.shared import cut, shared_dir  # noqa: F401  one place for tables in the shared folder

#: Where a domain stands in a source path; the same pattern serves the SQL.
PATH_DOMAIN = r"(?:train|valid)/([A-Za-z0-9_]+?)(?:_shard|[-/.]|$)"


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """Read one table of a scale directory, pruned to ``columns`` at the scan."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def slices(batch: pa.RecordBatch, column: int, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of at most ``rows`` rows, whose texts have at most ``size`` bytes together; a longer text is a run of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and (i - start >= rows or held + n > size):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < len(lengths):
        yield batch.slice(start)


def clean_domain(c: Column) -> Column:
    """Trimmed, lower-case domain; NULL where nothing is left."""
    d = F.lower(F.trim(c))
    return F.when(d != "", d)


def path_domain(path: Column) -> Column:
    """The domain that begins the path segment after ``train/`` or ``valid/``, up to ``_shard``, ``-``, ``/`` or ``.``."""
    d = F.regexp_extract(path, PATH_DOMAIN, 1)
    return F.when(d != "", F.lower(d))


def finite(c: Column) -> Column:
    """``c`` as double where it is a finite number, else NULL."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)
