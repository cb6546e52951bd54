"""Corpora as documents: tables and folders of texts in the formats that Spark reads in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "json", "csv", "text")


def read(spark: SparkSession, path: str, fmt: str = "parquet", text: str = "text", schema: str | None = None) -> DataFrame:
    """Documents of a corpus; ``text``: each file is one document, with its path as ``source``.

    A schema spares the pass over JSON and CSV that finds it out; only the columns that a query uses are read.
    """
    if fmt not in FORMATS:
        raise ValueError(f"fmt is one of {FORMATS}")
    if fmt == "text":
        whole = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
        return whole.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias(text))
    reader = spark.read.schema(schema) if schema else spark.read
    if fmt == "csv":
        reader = reader.options(header="true", multiLine="true", escape='"')
    out = reader.format(fmt).load(path)
    if text not in out.columns:
        raise ValueError(f"{path} has no column {text}")
    return out
