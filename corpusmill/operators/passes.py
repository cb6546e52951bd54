"""Cleaning passes: DataFrame to DataFrame, each rewriting ``content`` and adding what it removed to the accounts.

Everything here stays in Spark's expressions and needs no shuffle: a line pass works on the array of a document's lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import patterns as P
from corpusmill.functions import text as X

SECTION = "struct<kind:string,label:string,tokens_removed:bigint,count:bigint>"
NOISE = "struct<kind:string,label:string,tokens_removed:bigint>"
WARNING = "struct<code:string,message:string,severity:string>"


ENTRY = "array<struct<kind:string,label:string,tokens_removed:bigint,count:bigint,noise:string,noise_label:string>>"


def held(df: DataFrame) -> DataFrame:
    """The same rows, with all columns made here.

    The optimizer puts a column's expression in the place of its use. Through a chain of passes, each of which uses the
    content several times, expressions would grow without bound; they do not grow beyond a generator.
    """
    return df.select(F.explode(F.array(F.struct(*map(X.named, df.columns)))).alias("__held")).select("__held.*")


def with_accounts(df: DataFrame) -> DataFrame:
    return df.withColumn("warnings", F.array().cast(f"array<{WARNING}>"))


def add_entries(df: DataFrame, entries: Column) -> DataFrame:
    """A column of entries for each pass; ``closed`` puts them together, so that no pass repeats those before it."""
    n = sum(c.startswith("__account_") for c in df.columns)
    return df.withColumn(f"__account_{n:02}", entries.cast(ENTRY))


def account(df: DataFrame, kind: str, label: str, tokens: Column, count: Column, noise: str | None, noise_label: str | None = None) -> DataFrame:
    """Note what a pass removed; ``noise``: the kind of its noise source."""
    own = F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), tokens.cast("long").alias("tokens_removed"), count.cast("long").alias("count"), F.lit(noise).alias("noise"), F.lit(noise_label or label).alias("noise_label"))
    return add_entries(df, F.array(own))


def closed(df: DataFrame) -> DataFrame:
    """removed_sections and noise_sources, in the order of the passes, of those that removed something."""
    names = sorted(c for c in df.columns if c.startswith("__account_"))
    every = F.flatten(F.array(*map(F.col, names))) if names else F.array().cast(ENTRY)
    df = df.withColumn("__entries", F.filter(every, lambda e: e["count"] > 0))
    section = F.transform("__entries", lambda e: F.struct(*[e[k].alias(k) for k in ("kind", "label", "tokens_removed", "count")]))
    noise = F.transform(F.filter("__entries", lambda e: e["noise"].isNotNull()), lambda e: F.struct(e["noise"].alias("kind"), e["noise_label"].alias("label"), e["tokens_removed"].alias("tokens_removed")))
    return df.withColumns({"removed_sections": section, "noise_sources": noise}).drop("__entries", *names)


def remove_pattern(df: DataFrame, pattern: str, kind: str, label: str, gate: Column | None = None) -> DataFrame:
    """Replace every match by a line end."""
    found = F.regexp_extract_all("content", F.lit(pattern), F.lit(0))
    found = found if gate is None else F.when(gate, found).otherwise(F.array().cast("array<string>"))
    df = account(df.withColumn("__found", found), kind, label, X.estimates(F.col("__found")), F.size("__found"), "html_boilerplate").drop("__found")
    new = F.regexp_replace("content", pattern, "\n")
    return df.withColumn("content", new if gate is None else F.when(gate, new).otherwise(F.col("content")))


def remove_tags(df: DataFrame, tags: tuple[str, ...], kind: str, label: str) -> DataFrame:
    for tag in tags:
        df = remove_pattern(df, P.block(tag), kind, f"{label}: {tag}")
    return df


def remove_executed(df: DataFrame) -> DataFrame:
    return remove_tags(df, P.EXECUTED_TAGS, "html_execution_block", "HTML execution/style block")


def remove_furniture(df: DataFrame) -> DataFrame:
    return remove_tags(df, P.FURNITURE_TAGS, "html_boilerplate", "HTML boilerplate block")


def remove_comments(df: DataFrame) -> DataFrame:
    return remove_pattern(df, P.HTML_COMMENT, "html_comment", "HTML comments")


def drop_lines(df: DataFrame, unwanted, kind: str, label: str, noise: str | None) -> DataFrame:
    """Drop the lines for which ``unwanted(line)`` holds; each line is judged once."""
    df = df.withColumn("__lines", X.lines(F.col("content"))).withColumn("__off", F.transform("__lines", unwanted))
    df = df.withColumn("__gone", F.filter("__lines", lambda _, i: F.get("__off", i)))
    df = account(df, kind, label, X.estimates(F.col("__gone")), F.size("__gone"), noise)
    kept = F.array_join(F.filter("__lines", lambda _, i: ~F.get("__off", i)), "\n")
    return df.withColumn("content", F.when(F.size("__gone") == 0, F.array_join("__lines", "\n")).otherwise(kept)).drop("__lines", "__off", "__gone")


def is_boilerplate(line: Column, aggressive: bool) -> Column:
    own = X.trim(line)
    low = X.ascii_lower(own)
    equal = P.BOILERPLATE_EQUAL + (P.AGGRESSIVE_EQUAL if aggressive else ())
    part = P.BOILERPLATE_PART + (P.AGGRESSIVE_PART if aggressive else ())
    markup = F.contains(own, F.lit("<")) & F.contains(own, F.lit(">"))
    alone = X.any_of(low, ("cookie", "newsletter", "advertisement")) & ~X.any_of(low, ("<main", "<article"))
    return (own != "") & (F.octet_length(own) <= 220) & ~X.any_of(low, P.WEB_SIGNALS) & (~markup | alone) & (low.isin(*equal) | X.any_of(low, part))


def drop_boilerplate(df: DataFrame, aggressive: bool = False) -> DataFrame:
    return drop_lines(df, lambda x: is_boilerplate(x, aggressive), "html_boilerplate", "boilerplate lines", "html_boilerplate")


def noise_candidate(line: Column) -> Column:
    low = X.ascii_lower(X.trim(line))
    no_time = X.trim(F.regexp_replace(low, P.TIMESTAMP, ""))
    return X.trim(F.regexp_replace(X.trim(F.regexp_replace(no_time, P.BRACKET, "")), P.LEVEL, ""))


def is_install_noise(line: Column, aggressive: bool = False) -> Column:
    own, low = noise_candidate(line), X.ascii_lower(X.trim(line))
    known = P.LOG_NOISE + (P.LOG_NOISE_AGGRESSIVE if aggressive else ())
    return (own != "") & X.matches(own, known) & ~(X.any_of(low, P.LOG_SIGNALS) | low.rlike(P.LOG_SIGNAL_START))


def remove_install_noise(df: DataFrame, aggressive: bool = False) -> DataFrame:
    return drop_lines(df, lambda x: is_install_noise(x, aggressive), "log_noise", "install/build noise", "log_noise")


def is_frame(line: Column) -> Column:
    return X.matches(line, P.FRAMES)


def collapse_frames(df: DataFrame) -> DataFrame:
    """In each stretch of stack frames keep the first of equal ones, and say at its end how many went."""
    df = df.withColumn("__lines", X.lines(F.col("content"))).withColumn("__frame", F.transform("__lines", is_frame))
    df = df.withColumn("__key", F.transform("__lines", lambda x: X.ascii_lower(X.trim(F.regexp_replace(x, r"(?U)\s+", " ")))))
    n = F.size("__lines")
    flag = lambda i: F.element_at("__frame", i)
    df = df.withColumn("__start", F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get("__frame", i - 1) != F.get("__frame", i - 2))))
    df = df.withColumn("__part", F.transform("__start", lambda s, k: F.struct(s.alias("s"), (F.coalesce(F.get("__start", k + 1), n + 1) - s).alias("n"))))

    def kept(p: Column) -> Column:
        own = F.slice("__lines", p["s"], p["n"])
        keys = F.slice("__key", p["s"], p["n"])
        return F.when(~flag(p["s"]), own).otherwise(F.filter(own, lambda _, i: F.array_position(keys, F.get(keys, i)) == i + 1))

    df = df.withColumn("__kept", F.transform("__part", lambda p: F.struct(p["n"].alias("n"), kept(p).alias("lines"))))
    gone = lambda k: k["n"] - F.size(k["lines"])
    mark = lambda k: F.concat(F.lit("[Collapsed stack frames: "), gone(k).cast("string"), F.lit(" duplicate frames removed]"))
    new = F.flatten(F.transform("__kept", lambda k: F.when(gone(k) > 0, F.concat(k["lines"], F.array(mark(k)))).otherwise(k["lines"])))
    left = F.aggregate("__kept", F.lit(0).cast("long"), lambda a, k: a + X.estimates(k["lines"]))
    count = F.aggregate("__kept", F.lit(0), lambda a, k: a + gone(k))
    df = account(df, "stack_frame", "duplicate stack frames", X.estimates(F.col("__lines")) - left, count, "stack_trace")
    return df.withColumn("content", F.array_join(new, "\n")).drop("__lines", "__frame", "__key", "__start", "__part", "__kept")


def repetition_key(line: Column) -> Column:
    """What makes lines repeats of each other: null for blank lines and collapse marks."""
    own = X.trim(line)
    plain = X.trim(F.regexp_replace(F.regexp_replace(own, P.TIMESTAMP, ""), r"(?U)\s+", " "))
    return F.when((plain != "") & ~F.startswith(own, F.lit("[Collapsed stack frames:")), X.ascii_lower(plain))


def tail(line: Column) -> Column:
    """The last four characters of a line, if they tell lines with different keys apart: visible ASCII ones; else null."""
    own = F.right(line, F.lit(4))
    return F.when(own.rlike(r"^[!-~]{4}\z"), X.ascii_lower(own))


def neighbours_keys(lines: Column, tails: Column) -> Column:
    """repetition_key of the lines that may be repeats of a neighbour; null for all others, which saves most of the work."""
    same = lambda a, b: F.coalesce(a == b, F.lit(True))
    last = F.size(lines) - 1
    near = lambda i: ((i > 0) & same(F.get(tails, i), F.get(tails, i - 1))) | ((i < last) & same(F.get(tails, i), F.get(tails, i + 1)))
    return F.transform(lines, lambda x, i: F.when(near(i), repetition_key(x)))


def summary_of(first: Column, last: Column, n: Column) -> Column:
    start, end = F.regexp_extract(first, P.TIMESTAMP, 1), F.regexp_extract(last, P.TIMESTAMP, 1)
    plain = X.trim(F.regexp_replace(X.trim(F.regexp_replace(first, P.TIMESTAMP, "")), P.LEVEL, ""))
    plain = X.trim(F.regexp_replace(plain, r"(?U)\s+", " "))
    span = F.when((start != "") & (end != "") & (start != end), F.concat(F.lit(" from "), start, F.lit(" to "), end)).otherwise(F.lit(""))
    return F.concat(F.lit("[Repeated "), n.cast("string"), F.lit(" times"), span, F.lit("] "), plain)


def collapse_repeats(df: DataFrame) -> DataFrame:
    """A run of adjacent lines with the same key becomes one line that says how often."""
    df = df.withColumn("__lines", X.lines(F.col("content"))).withColumn("__tail", F.transform("__lines", tail))
    df = df.withColumn("__key", neighbours_keys(F.col("__lines"), F.col("__tail"))).drop("__tail")
    n = F.size("__lines")
    start = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | ~F.coalesce(F.get("__key", i - 1) == F.get("__key", i - 2), F.lit(False)))
    df = df.withColumn("__start", start)
    df = df.withColumn("__run", F.transform("__start", lambda s, k: F.struct(s.alias("s"), (F.coalesce(F.get("__start", k + 1), n + 1) - s).alias("n"))))
    line = lambda i: F.get("__lines", i)
    new = F.transform("__run", lambda r: F.when(r["n"] > 1, summary_of(line(r["s"] - 1), line(r["s"] + r["n"] - 2), r["n"])).otherwise(line(r["s"] - 1)))
    first = F.transform("__run", lambda r: line(r["s"] - 1))
    count = F.size(F.filter("__run", lambda r: r["n"] > 1))
    df = account(df, "duplicate_line", "repeated log lines", X.estimates(F.col("__lines")) - X.estimates(first), count, "repetition")
    return df.withColumn("content", F.array_join(new, "\n")).drop("__lines", "__key", "__start", "__run")


def crush_logs(df: DataFrame, aggressive: bool = False) -> DataFrame:
    return collapse_repeats(collapse_frames(remove_install_noise(df, aggressive)))


def strip_code_comments(df: DataFrame) -> DataFrame:
    return drop_lines(df, lambda x: x.rlike(r"(?U)^\s*(//|/\*|\*)"), "code_comment", "code comment lines", "code_comments")


def is_decoration(line: Column) -> Column:
    own = X.trim(line)
    return F.startswith(own, F.lit("[![")) | F.contains(own, F.lit("shields.io")) | ((F.octet_length(own) > 8) & own.rlike(r"^[-=*_ #]+\z"))


def drop_decoration(df: DataFrame) -> DataFrame:
    return drop_lines(df, is_decoration, "other", "aggressive low-signal formatting", None)


def may_hold_secret(k: int, content: Column) -> Column:
    """A test without patterns that lets every text through in which secret pattern k matches."""
    low = F.lower(content)
    some = X.any_of(content, P.SECRET_SIGNS[k]) if k in P.SECRET_SIGNS_CASED else X.any_of(low, P.SECRET_SIGNS[k])
    return some & X.any_of(content, P.SECRET_JOINS[k]) if P.SECRET_JOINS[k] else some


def redact(df: DataFrame) -> DataFrame:
    """Replace secrets; the patterns apply to the whole text, in order, and only to texts that may hold such a secret."""
    counts = []
    for k, pattern in enumerate(P.SECRETS):
        df = df.withColumn("__may", may_hold_secret(k, F.col("content")))
        df = df.withColumn(f"__n{k}", F.when(F.col("__may"), F.regexp_count("content", F.lit(pattern))).otherwise(0))
        df = df.withColumn("content", F.when(F.col(f"__n{k}") > 0, F.regexp_replace("content", pattern, P.REDACTED)).otherwise(F.col("content")))
        counts.append(F.col(f"__n{k}"))
    df = df.withColumn("__redacted", reduce(lambda a, b: a + b, counts).cast("long")).drop("__may", *[f"__n{k}" for k in range(len(P.SECRETS))])
    df = account(df, "secret", "secret-like values", F.lit(0), F.col("__redacted"), "secret", "secret-like values redacted")
    warning = F.struct(F.lit("secrets_redacted").alias("code"), F.concat(F.lit("redacted "), F.col("__redacted").cast("string"), F.lit(" secret-like value(s)")).alias("message"), F.lit("warning").alias("severity")).cast(WARNING)
    return df.withColumn("warnings", F.when(F.col("__redacted") > 0, F.array(warning)).otherwise(F.array().cast(f"array<{WARNING}>"))).drop("__redacted")
