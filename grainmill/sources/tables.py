"""Readers and sinks: tables of a scale directory, line-numbered xz JSON lines, CSV, arrays as Parquet, digests of files."""

from __future__ import annotations

import io
import lzma
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.sources.package import ship


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table of a scale directory; ``columns`` prune the scan."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def labelled_files(spark: SparkSession, path: str, patterns: dict[str, str]) -> list[tuple[str, str]]:
    """(label, file) in order of the labels and then of the files' names; a label without a file is an error."""
    jvm = spark.sparkContext._jvm
    out = []
    for label, pattern in patterns.items():
        p = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{pattern}")
        found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
        names = sorted(str(f.getPath()) for f in found or [])
        if not names:
            raise FileNotFoundError(f"no file for {label}: {path}/{pattern}")
        out += [(label, n) for n in names]
    return out


def read_labelled(spark: SparkSession, path: str, patterns: dict[str, str], schema: T.StructType) -> DataFrame:
    """JSON lines of the labelled files, with ``source_label`` and ``source_order`` (place of the file in the order of all), ``file`` and ``line``."""
    files = labelled_files(spark, path, patterns)
    order = spark.createDataFrame([(label, i, name) for i, (label, name) in enumerate(files)], "source_label string, source_order int, _file string")
    rows = read_jsonl(spark, [n for _, n in files], schema)
    plain = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/*", "/")  # noqa: E731  file names come with and without their scheme
    return rows.join(F.broadcast(order), plain(F.col("file")) == plain(F.col("_file"))).drop("_file")


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType, pattern: str = "*.jsonl*") -> DataFrame:
    """JSON lines, xz-compressed or plain, with ``file`` and ``line`` (from 1), blank lines skipped.

    Spark's JSON reader doesn't know xz, so a task gets a file's bytes and decompresses them line by line. A missing path or
    a line that isn't valid JSON is an error.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    lines = files.mapInPandas(_lines, "file string, line bigint, raw string")
    parsed = lines.select("file", "line", F.from_json("raw", schema).alias("r"), F.try_parse_json("raw").isNull().alias("bad"))
    checked = parsed.where(~F.col("bad") | F.raise_error(F.concat(F.lit("invalid JSON in "), "file", F.lit(" line "), F.col("line").cast("string"))).isNotNull())
    return checked.select("file", "line", "r.*")


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path, content in zip(b.path, b.content):
            raw = lzma.open(io.BytesIO(content)) if path.endswith(".xz") else io.BytesIO(content)
            numbered = ((path, i, x.decode("utf-8").removesuffix("\n")) for i, x in enumerate(raw, 1) if x.strip())
            while rows := list(islice(numbered, 20_000)):
                yield pd.DataFrame(rows, columns=["file", "line", "raw"])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header (a byte order mark is ignored) and an explicit schema; malformed rows are an error."""
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", enforceSchema=False)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_arrays(df: DataFrame, path: str) -> None:
    """Array columns need no container of their own: Parquet holds them."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """file, bytes and sha256 of every file below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def strip_names(df: DataFrame, prefix: str = "", suffix: str = "") -> DataFrame:
    """Columns without ``prefix`` and ``suffix``; a clash of the new names is an error."""
    new = {c: c.removeprefix(prefix).removesuffix(suffix) for c in df.columns}
    if len(set(new.values())) < len(new):
        raise ValueError("column names clash after stripping")
    return df.withColumnsRenamed(new)


def domain_of(domain: Column, path: Column) -> Column:
    """Cleaned domain, else the name that begins the path segment after ``train/`` or ``valid/``; NULL where neither is there."""
    named = F.lower(F.trim(domain))
    found = F.lower(F.regexp_extract(path, PATH_DOMAIN, 1))
    return F.coalesce(F.when(named != "", named), F.when(found != "", found))


#: Where a domain stands in a source path; the same pattern serves the SQL.
PATH_DOMAIN = r"(?:train|valid)/([A-Za-z0-9_]+?)(?:_shard|[-/.]|$)"
