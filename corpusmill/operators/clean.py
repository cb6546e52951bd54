"""The whole cleaning of a document, as one DataFrame transformation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill import __version__
from corpusmill.functions import markup, tokens
from corpusmill.functions import patterns as P
from corpusmill.functions import text as X
from corpusmill.operators import passes as O

MODES = ("light", "standard", "aggressive")
FORMATS = ("text", "markdown", "json")


@dataclass(frozen=True)
class CleanOptions:
    """What to clean and how; unless not ``bounded``, ``max_tokens`` may not exceed the preset named by ``fit``."""

    mode: str = "standard"
    format: str = "markdown"
    max_tokens: int | None = None
    fit: str | None = None
    strip_comments: bool = False
    redact_secrets: bool = True
    bounded: bool = True

    def __post_init__(self):
        if self.mode not in MODES or self.format not in FORMATS:
            raise ValueError(f"mode is one of {MODES}, format one of {FORMATS}")
        if self.fit is not None and self.fit not in P.PRESETS:
            raise ValueError(f"fit is one of {tuple(P.PRESETS)}")
        if self.max_tokens is not None and self.max_tokens < 0:
            raise ValueError("max_tokens is negative")
        if self.bounded and self.fit and self.max_tokens and self.max_tokens > P.PRESETS[self.fit][1]:
            raise ValueError(f"max_tokens is beyond what {self.fit} takes")

    @property
    def limit(self) -> int | None:
        return self.max_tokens if self.max_tokens is not None else P.PRESETS[self.fit][1] if self.fit else None

    @property
    def limit_source(self) -> str:
        if not self.fit:
            return "none" if self.max_tokens is None else "max_tokens"
        return "fit" if self.limit == P.PRESETS[self.fit][1] else "fit_and_max_tokens"

    @property
    def reason(self) -> str:
        return {"fit": f"fit {self.fit} budget", "fit_and_max_tokens": f"fit {self.fit} and max_tokens budget"}.get(self.limit_source, "max_tokens budget")


# A type object: a DDL string would need a session when the module is imported.
@F.pandas_udf(T.LongType())
def count_tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.fillna("").map(tokens.count)


@F.pandas_udf(T.StructType([T.StructField("content", T.StringType()), T.StructField("gone", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("tokens", T.LongType()), T.StructField("count", T.LongType())])))]))
def noise_blocks(texts: pd.Series) -> pd.DataFrame:
    made = [markup.noise_blocks(t or "") for t in texts]
    return pd.DataFrame({"content": [m[0] for m in made], "gone": [[{"label": a, "tokens": b, "count": c} for a, b, c in m[1]] for m in made]})


def markdown_udf(mode: str):
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: markup.markdown(t or "", mode))

    return run


def pack_udf(limit: int | None):
    """A text within its budget, what that removed, and the tokens of the text as it is given out."""

    @F.pandas_udf("content string, removed bigint, applied boolean, tokens bigint")
    def run(texts: pd.Series) -> pd.DataFrame:
        made = [tokens.pack(t or "", limit) if limit is not None else (t or "", 0, False) for t in texts]
        return pd.DataFrame([(m[0], m[1], m[2], tokens.count(markup.BLANK_LINES.sub("\n\n", m[0]).strip())) for m in made], columns=["content", "removed", "applied", "tokens"])

    return run


def remove_noise_blocks(df: DataFrame, aggressive: bool) -> DataFrame:
    """Elements named like noise, frames of trackers and, if asked, promoted blocks; only in what looks like a page."""
    df = df.withColumn("__page", F.col("content").rlike(P.HTML_HINT)).withColumn("__made", noise_blocks("content"))
    entry = F.transform("__made.gone", lambda g: F.struct(F.lit("html_boilerplate").alias("kind"), g["label"].alias("label"), g["tokens"].alias("tokens_removed"), g["count"].alias("count"), F.lit("html_boilerplate").alias("noise"), g["label"].alias("noise_label")))
    df = O.add_entries(df, entry).withColumn("content", F.col("__made.content")).drop("__made")
    df = O.remove_pattern(df, P.NOISE_IFRAME, "html_boilerplate", "HTML boilerplate block: iframe noise", F.col("__page"))
    if aggressive:
        df = O.remove_pattern(df, P.AGGRESSIVE_BLOCK, "html_boilerplate", "aggressive promotional/tracking HTML blocks", F.col("__page"))
    return df.drop("__page")


def pack(df: DataFrame, options: CleanOptions) -> DataFrame:
    """The content within its budget and trimmed, with its tokens: the last Python step of a cleaning."""
    df = df.withColumn("__packed", pack_udf(options.limit)("content"))
    df = df.withColumns({"__applied": F.col("__packed.applied"), "__removed": F.col("__packed.removed"), "__tokens": F.col("__packed.tokens"), "content": X.trim(X.collapse_blank_lines(F.col("__packed.content")))}).drop("__packed")
    return O.account(df, "truncated", "token budget truncation", F.col("__removed"), F.col("__applied").cast("long"), "truncation")


def passes(df: DataFrame, options: CleanOptions) -> DataFrame:
    """All passes before packing, in their order."""
    strong = options.mode == "aggressive"
    df = O.held(O.remove_executed(df.withColumn("content", X.normalized(F.col("content")))))
    if options.mode != "light":
        df = O.held(O.remove_comments(O.remove_furniture(df)))
        df = O.held(O.drop_boilerplate(remove_noise_blocks(df, strong), strong))
        df = O.held(O.crush_logs(df.withColumn("content", markdown_udf(options.mode)("content")), strong))
    if options.strip_comments:
        df = O.strip_code_comments(df)
    if options.redact_secrets:
        df = O.redact(df)
    if strong:
        df = O.drop_decoration(df).withColumn("content", X.collapse_blank_lines(F.col("content")))
    return O.held(df)


def budget(options: CleanOptions) -> Column:
    """The token budget that the options set, and where it comes from."""
    model, most, answer = P.PRESETS.get(options.fit or "", (None, None, None))
    lit = lambda v, kind: F.lit(v).cast(kind)
    return F.struct(
        lit(options.fit, "string").alias("fit"), lit(model, "string").alias("model_id"), F.lit("byte_bpe_50k").alias("tokenizer"), F.lit(True).alias("token_count_is_exact"), lit(most, "long").alias("preset_limit_tokens"),
        lit(options.limit, "long").alias("effective_limit_tokens"), lit(answer, "long").alias("model_max_output_tokens"), F.lit(options.limit_source).alias("limit_source"),
    )


def clean(docs: DataFrame, options: CleanOptions = CleanOptions(), text: str = "text", source: str | None = None) -> DataFrame:
    """``docs`` (without the text) with ``result``: content, statistics, accounts and warnings of each document.

    A null text is cleaned like an empty one. Columns named result or content give way.

    Warnings that a source gave (a column ``source_warnings`` of ``docs``) come after those of the cleaning.
    """
    given = "source_warnings" in docs.columns
    keep = [c for c in docs.columns if c not in (text, "result", "content", "source_warnings")]
    own = (X.named(source).cast("string") if source else F.lit(None).cast("string")).alias("__source")
    df = docs.select(*map(X.named, keep), *(["source_warnings"] if given else []), own, F.coalesce(X.named(text), F.lit("")).alias("content"))
    stats = lambda n: F.struct(F.octet_length("content").cast("long").alias("bytes"), F.length("content").cast("long").alias("chars"), n.alias("tokens"))
    df = passes(O.with_accounts(df.withColumn("__input", stats(count_tokens("content")))), options)
    df = O.closed(pack(df, options)).withColumn("__output", stats(F.col("__tokens")))
    lit = lambda v, kind: F.lit(v).cast(kind)
    truncation = F.struct(F.col("__applied").alias("applied"), lit(options.limit, "long").alias("limit_tokens"), F.col("__removed").alias("tokens_removed"), F.when(F.col("__applied"), F.lit(options.reason)).alias("reason"))
    result = F.struct(
        F.lit(__version__).alias("version"), F.lit(options.mode).alias("mode"), F.lit(options.format).alias("format"), F.col("__source").alias("source"),
        F.col("__input").alias("input"), F.struct("__output.*", "content").alias("output"), X.metrics(F.col("__input.tokens"), F.col("__output.tokens")).alias("metrics"),
        budget(options).alias("budget"), truncation.alias("truncation"), "removed_sections", "noise_sources", (F.concat("warnings", "source_warnings") if given else F.col("warnings")).alias("warnings"),
    )
    return df.select(*map(X.named, keep), result.alias("result"))


def command(options: CleanOptions, source: Column, include_sensitive: bool = False) -> Column:
    """The command line that cleans the same source in the same way."""
    words = [] if options.mode == "standard" else ["--mode", options.mode]
    words += ["--fit", options.fit] if options.fit else []
    words += ["--max-tokens", str(options.max_tokens)] if options.max_tokens is not None else []
    words += ["--strip-comments"] if options.strip_comments else []
    words += ["--include-sensitive"] if include_sensitive else []
    return F.concat_ws(" ", F.lit("corpusmill"), F.coalesce(source, F.lit("-")), *map(F.lit, [*words, "--format", "markdown"]))


def report(results: DataFrame, options: CleanOptions = CleanOptions(), include_sensitive: bool = False) -> DataFrame:
    """Tokens, the five biggest noise sources, removed sections by kind and the recommended command, of each result."""
    ranked = F.array_sort(F.transform("result.noise_sources", lambda x, i: F.struct((-x["tokens_removed"]).alias("o"), i.alias("i"), x.alias("x"))))
    biggest = F.transform(F.slice(ranked, 1, 5), lambda r: r["x"])
    kinds = F.array_sort(F.array_distinct(F.transform("result.removed_sections", lambda s: s["kind"])))
    total = lambda k, f: F.aggregate(F.filter("result.removed_sections", lambda s: s["kind"] == k), F.lit(0).cast("long"), lambda a, s: a + s[f])
    summary = F.transform(kinds, lambda k: F.struct(k.alias("kind"), total(k, "count").alias("count"), total(k, "tokens_removed").alias("tokens_removed")))
    return results.withColumn("report", F.struct("result.source", "result.mode", F.col("result.metrics").alias("tokens"), biggest.alias("biggest_noise_sources"), summary.alias("removed_section_summary"), "result.warnings", command(options, F.col("result.source"), include_sensitive).alias("recommended_command")))
