"""Cleaning single texts and inputs from Python: thin calls over the DataFrame operators."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators import clean as C
from corpusmill.operators import render as R
from corpusmill.sources import files


def session() -> SparkSession:
    """The active session, or a small local one."""
    if active := SparkSession.getActiveSession():
        return active
    made = SparkSession.builder.master("local[2]").appName("corpusmill").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.ui.showConsoleProgress", "false")
    spark = made.config("spark.sql.session.timeZone", "UTC").config("spark.log.level", "ERROR").getOrCreate()
    return spark


def cleaned(source: tuple[str | None, str, list], options: C.CleanOptions, spark: SparkSession | None = None) -> DataFrame:
    """One result row of a source (name, text, warnings)."""
    docs = (spark or session()).createDataFrame([source], files.SOURCE)
    return C.clean(docs, options, text="text", source="source").select("result")


def rendered(source: tuple[str | None, str, list], options: C.CleanOptions, spark: SparkSession | None = None) -> tuple[str, Any]:
    """A source cleaned and rendered, and its result row."""
    row = R.render(cleaned(source, options, spark), options.format, options.limit).first()
    return row["rendered"], row["result"]


def reported(source: tuple[str | None, str, list], options: C.CleanOptions, include_sensitive: bool = False, spark: SparkSession | None = None) -> tuple[str, Any]:
    """The rendered report on a source, and its result row."""
    made = C.report(cleaned(source, options, spark), options, include_sensitive)
    row = R.render_report(made, options.format).first()
    return row["rendered"], row["result"]


def parsed(out: str, output_format: str) -> str | dict[str, Any]:
    return json.loads(out) if output_format == "json" else out


def clean_text(text: str, *, output_format: str = "markdown", spark: SparkSession | None = None, **options: Any) -> str | dict[str, Any]:
    """A cleaned text; options are those of CleanOptions."""
    return parsed(rendered(("stdin", text, []), C.CleanOptions(format=output_format, **options), spark)[0], output_format)


def clean_file(path: str | os.PathLike, *, output_format: str = "markdown", include_sensitive: bool = False, spark: SparkSession | None = None, **options: Any) -> str | dict[str, Any]:
    """A cleaned file or directory."""
    source = files.read_input(path, include_sensitive)
    return parsed(rendered(source, C.CleanOptions(format=output_format, **options), spark)[0], output_format)


def clean_actions_log(path: str | os.PathLike, *, output_format: str = "markdown", max_tokens: int | None = 8000, **options: Any) -> str | dict[str, Any]:
    """A cleaned log of a CI run."""
    return clean_file(path, output_format=output_format, max_tokens=max_tokens, mode="aggressive", **options)


def report(path: str | os.PathLike, *, output_format: str = "json", include_sensitive: bool = False, spark: SparkSession | None = None, **options: Any) -> str | dict[str, Any]:
    """What cleaning a path saves and removes."""
    source = files.read_input(path, include_sensitive)
    own = C.CleanOptions(format=output_format, **options)
    return parsed(reported(source, own, include_sensitive, spark)[0], output_format)


def output_text(result: str | Mapping[str, Any]) -> str:
    """The content of a result, rendered or parsed."""
    if isinstance(result, str):
        return result
    content = (result.get("output") or {}).get("content") if isinstance(result.get("output"), Mapping) else None
    if not isinstance(content, str):
        raise ValueError("result does not contain output.content")
    return content


def passages(results: DataFrame) -> DataFrame:
    """Results as text with metadata, the form that retrieval pipelines load."""
    about = F.struct("result.source", "result.metrics.input_tokens", "result.metrics.output_tokens", "result.metrics.tokens_saved", "result.warnings")
    return results.select(*[X.named(c) for c in results.columns if c != "result"], F.col("result.output.content").alias("text"), about.alias("metadata"))


def text_for_retrieval(path: str | os.PathLike, max_tokens: int = 8000, **options: Any) -> str:
    return output_text(clean_file(path, max_tokens=max_tokens, **options))


def record_for_retrieval(path: str | os.PathLike, max_tokens: int = 8000, spark: SparkSession | None = None, **options: Any) -> dict[str, Any]:
    """One input as text and metadata."""
    source = files.read_input(path)
    return passages(cleaned(source, C.CleanOptions(max_tokens=max_tokens, **options), spark)).first().asDict(recursive=True)
