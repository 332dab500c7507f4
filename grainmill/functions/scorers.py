"""Model scorers as a plug-in: register a function from texts to lists of numbers; results are kept by text, so a rerun scores only new texts.

No model weights come with this package; a scorer is any callable that the executors can import or unpickle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

Scorer = Callable[[list[str]], list[list[float]]]
_registry: dict[str, tuple[Scorer, str]] = {}


def register(name: str, scorer: Scorer, revision: str = "1") -> None:
    """``revision`` is part of the key of kept results: a new one scores everything anew."""
    _registry[name] = (scorer, revision)


def score_texts(df: DataFrame, key: str, text: str, name: str, cache: str, batch: int = 32, max_chars: int | None = None) -> DataFrame:
    """key, scores. ``max_chars``: scorers that take no longer input get the text's first characters, which then are what is kept by. NULL texts have NULL scores; equal texts are scored once. ``cache`` is a Parquet table that grows by the new texts."""
    if name not in _registry:
        raise KeyError(f"no scorer named {name}")
    scorer, revision = _registry[name]
    spark = df.sparkSession
    given = F.substring(F.col(text), 1, max_chars) if max_chars else F.col(text)
    digest = F.sha2(F.concat_ws("|", F.lit(name), F.lit(revision), given), 256)
    rows = df.select(key, F.when(F.col(text).isNotNull(), digest).alias("h"), given.alias("t"))
    new = rows.where("h IS NOT NULL").groupBy("h").agg(F.min("t").alias("t"))
    try:
        new = new.join(spark.read.parquet(cache).select("h"), "h", "left_anti")
    except AnalysisException:  # the first run
        pass

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = b.column(1).to_pylist(), []
            for i in range(0, len(texts), batch):
                out += scorer(texts[i : i + batch])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], ["h", "scores"])

    new.select("h", "t").mapInArrow(run, "h string, scores array<double>").write.mode("append").parquet(cache)
    return rows.select(key, "h").join(spark.read.schema("h string, scores array<double>").parquet(cache), "h", "left").select(key, "scores")
