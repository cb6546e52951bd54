"""Results and reports as text, Markdown or JSON."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import tokens

#: Own name; everything else in the frames below and in the renderers is fixed by the layout to be matched.
NAME, TITLE = "corpusmill", "Context Report"
#: For results beyond their limit: what stands before and after the content.
FRAMES = {
    "text": ("", "\n\n---\n" + NAME + " truncation={applied} output_tokens={n}\n"),
    "markdown": ("# Cleaned Context\n\n", "\n\n---\n\n_" + NAME + ": truncation={applied}, output_tokens={n}_\n"),
}


def percent(c: Column) -> Column:
    """One digit behind the point, halves to the even digit."""
    return F.format_string("%.1f", F.bround(c, 1))


def titled(c: Column) -> Column:
    """A snake_case name with capitals instead of underscores."""
    return F.replace(F.initcap(F.replace(c, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))


def as_text() -> Column:
    m = "result.metrics."
    warnings = F.array_join(F.transform("result.warnings", lambda w: F.concat(F.lit("- "), w["code"], F.lit(": "), w["message"], F.lit("\n"))), "")
    return F.concat(
        F.col("result.output.content"), F.lit(f"\n\n---\n{NAME} v"), F.col("result.version"), F.lit("\nmode: "), titled(F.col("result.mode")), F.lit("\nformat: "), titled(F.col("result.format")),
        F.lit("\ninput_tokens: "), F.col(m + "input_tokens"), F.lit("\noutput_tokens: "), F.col(m + "output_tokens"), F.lit("\ntokens_saved: "), F.col(m + "tokens_saved"),
        F.lit("\nreduction_percent: "), percent(F.col(m + "reduction_percent")), F.lit("%\ntruncation: "), F.col("result.truncation.applied").cast("string"), F.lit("\n"),
        F.when(F.size("result.warnings") > 0, F.concat(F.lit("warnings:\n"), warnings)).otherwise(""),
    )


def as_markdown() -> Column:
    row = lambda k, v: F.concat(F.lit(f"| {k} | "), v.cast("string"), F.lit(" |\n"))
    m = "result.metrics."
    cells = lambda *c: F.concat(F.lit("| "), F.concat_ws(" | ", *[x.cast("string") for x in c]), F.lit(" |\n"))
    removed = F.array_join(F.transform("result.removed_sections", lambda s: cells(titled(s["kind"]), s["label"], s["tokens_removed"], s["count"])), "")
    warned = F.array_join(F.transform("result.warnings", lambda w: cells(titled(w["severity"]), w["code"], w["message"])), "")
    return F.concat(
        F.lit("# Cleaned Context\n\n"), F.col("result.output.content"), F.lit("\n\n---\n\n## Metrics\n\n| Field | Value |\n|---|---:|\n"),
        row("Mode", titled(F.col("result.mode"))), row("Format", titled(F.col("result.format"))), row("Input tokens", F.col(m + "input_tokens")), row("Output tokens", F.col(m + "output_tokens")),
        row("Tokens saved", F.col(m + "tokens_saved")), row("Reduction", F.concat(percent(F.col(m + "reduction_percent")), F.lit("%"))), row("Truncation applied", F.col("result.truncation.applied")),
        F.when(F.size("result.removed_sections") > 0, F.concat(F.lit("\n## Removed Sections\n\n| Kind | Label | Tokens removed | Count |\n|---|---|---:|---:|\n"), removed)).otherwise(""),
        F.when(F.size("result.warnings") > 0, F.concat(F.lit("\n## Warnings\n\n| Severity | Code | Message |\n|---|---|---|\n"), warned)).otherwise(""),
    )


def as_json() -> Column:
    return F.to_json("result", {"ignoreNullFields": "false", "pretty": "true"})


RENDERERS = {"text": as_text, "markdown": as_markdown, "json": as_json}


def capped_udf(limit: int, fmt: str):
    """A rendered result within ``limit`` tokens: bare content if that was cut to fit, else less of it in a shorter frame."""

    @F.pandas_udf("string")
    def run(rendered: pd.Series, content: pd.Series, applied: pd.Series, output_tokens: pd.Series) -> pd.Series:
        out = []
        for whole, body, cut, n in zip(rendered, content, applied, output_tokens, strict=True):
            if tokens.count(whole) <= limit:
                out.append(whole)
            elif cut and tokens.count(body) <= limit:
                out.append(body)
            else:
                prefix, footer = FRAMES[fmt]
                out.append(tokens.body_within(prefix, body, footer.format(applied=str(bool(cut)).lower(), n=n), limit))
        return pd.Series(out, dtype="object")

    return run


def render(results: DataFrame, fmt: str = "markdown", limit: int | None = None) -> DataFrame:
    """``results`` with the column ``rendered``; text and Markdown keep within ``limit`` tokens, JSON is never cut."""
    whole = RENDERERS[fmt]()
    if limit is not None and fmt in FRAMES:
        whole = capped_udf(limit, fmt)(whole, F.col("result.output.content"), F.col("result.truncation.applied"), F.col("result.output.tokens"))
    return results.withColumn("rendered", whole)


def report_text() -> Column:
    """The report's figures as plain lines; never the content."""
    r = "report."
    noise = F.array_join(F.transform(r + "biggest_noise_sources", lambda s: F.concat(F.lit("- "), s["kind"], F.lit(": "), s["tokens_removed"].cast("string"), F.lit(" tokens ("), s["label"], F.lit(")\n"))), "")
    removed = F.array_join(F.transform(r + "removed_section_summary", lambda s: F.concat(F.lit("- "), s["kind"], F.lit(": "), s["tokens_removed"].cast("string"), F.lit(" tokens removed across "), s["count"].cast("string"), F.lit(" item(s)\n"))), "")
    warnings = F.array_join(F.transform(r + "warnings", lambda w: F.concat(F.lit("- "), w["code"], F.lit(": "), w["message"], F.lit("\n"))), "")
    return F.concat(
        F.lit(f"{TITLE}\nsource: "), F.coalesce(r + "source", F.lit("stdin")), F.lit("\ninput_tokens: "), F.col(r + "tokens.input_tokens"), F.lit("\noutput_tokens: "), F.col(r + "tokens.output_tokens"),
        F.lit("\ntokens_saved: "), F.col(r + "tokens.tokens_saved"), F.lit("\ncompression_ratio: "), F.format_string("%.3f", F.bround(F.col(r + "tokens.compression_ratio"), 3)),
        F.lit("\nreduction_percent: "), percent(F.col(r + "tokens.reduction_percent")), F.lit("%\nbiggest_noise_sources:\n"), noise, F.lit("removed_section_summary:\n"), removed,
        F.when(F.size(r + "warnings") > 0, F.concat(F.lit("warnings:\n"), warnings)).otherwise(""), F.lit("recommended_command: "), F.col(r + "recommended_command"), F.lit("\n"),
    )


def report_markdown() -> Column:
    r = "report."
    row = lambda k, v: F.concat(F.lit(f"| {k} | "), v.cast("string"), F.lit(" |\n"))
    cells = lambda *c: F.concat(F.lit("| "), F.concat_ws(" | ", *[x.cast("string") for x in c]), F.lit(" |\n"))
    noise = F.array_join(F.transform(r + "biggest_noise_sources", lambda s: cells(s["kind"], s["label"], s["tokens_removed"])), "")
    removed = F.array_join(F.transform(r + "removed_section_summary", lambda s: cells(s["kind"], s["count"], s["tokens_removed"])), "")
    warned = F.array_join(F.transform(r + "warnings", lambda w: cells(w["code"], w["message"])), "")
    return F.concat(
        F.lit(f"# {TITLE}\n\n## Token Summary\n\n| Field | Value |\n|---|---:|\n"), row("Input tokens", F.col(r + "tokens.input_tokens")), row("Output tokens", F.col(r + "tokens.output_tokens")),
        row("Tokens saved", F.col(r + "tokens.tokens_saved")), row("Compression ratio", F.format_string("%.3f", F.bround(F.col(r + "tokens.compression_ratio"), 3))),
        row("Reduction", F.concat(percent(F.col(r + "tokens.reduction_percent")), F.lit("%"))),
        F.lit("\n## Biggest Noise Sources\n\n| Kind | Label | Tokens removed |\n|---|---|---:|\n"), noise,
        F.lit("\n## Removed Section Summary\n\n| Kind | Count | Tokens removed |\n|---|---:|---:|\n"), removed,
        F.lit("\n## Recommended Command\n\n```bash\n"), F.col(r + "recommended_command"), F.lit("\n```\n"),
        F.when(F.size(r + "warnings") > 0, F.concat(F.lit("\n## Warnings\n\n| Code | Message |\n|---|---|\n"), warned)).otherwise(""),
    )


def report_json() -> Column:
    return F.to_json("report", {"ignoreNullFields": "false", "pretty": "true"})


REPORTS = {"text": report_text, "markdown": report_markdown, "json": report_json}


def render_report(reports: DataFrame, fmt: str = "markdown") -> DataFrame:
    """``reports`` with the column ``rendered``."""
    return reports.withColumn("rendered", REPORTS[fmt]())
