"""Cleaning a stream: every pass works on one document, so the same plan serves tables that grow.

Nothing is kept between batches: a run of lines or frames is collapsed within its document only, as in a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from corpusmill.operators import clean as C


def read(spark: SparkSession, path: str, files_at_a_time: int | None = None) -> DataFrame:
    """A folder of Parquet documents as a stream; its schema is that of the files already there."""
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_at_a_time:
        source = source.option("maxFilesPerTrigger", files_at_a_time)
    return source.parquet(path)


def clean(docs: DataFrame, options: C.CleanOptions = C.CleanOptions(), text: str = "text", source: str | None = None) -> DataFrame:
    """Cleaned documents of a stream, with the columns that ``operators.clean`` gives."""
    if not docs.isStreaming:
        raise ValueError("docs is no stream")
    return C.clean(docs, options, text, source)


def write(results: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append results as Parquet, each document exactly once; ``once``: what is there now, then stop."""
    out = results.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()
