"""Column functions on one text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions import patterns as P

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def named(name: str) -> Column:
    """The column of exactly that name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def trim(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def normalize_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def remove_control_chars(c: Column) -> Column:
    return F.regexp_replace(c, r"[\p{Cc}&&[^\n\t]]", "")


def decode_entities(c: Column) -> Column:
    """In this order, so that what the first makes is decoded by the later ones."""
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), P.ENTITIES, c)


def collapse_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, P.BLANK_LINES, "\n\n")


def normalized(c: Column) -> Column:
    return collapse_blank_lines(decode_entities(remove_control_chars(normalize_newlines(c))))


def estimate(c: Column) -> Column:
    """Estimated tokens: a quarter of the characters, rounded up."""
    return F.ceil(F.length(c) / 4).cast("long")


def estimates(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, x: a + estimate(x))


def lines(c: Column) -> Column:
    """Lines; a final line end begins no further one."""
    return F.split(F.regexp_replace(c, r"\n\z", ""), "\n", -1)


def any_of(c: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for p in parts])


def matches(c: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike(p) for p in patterns])


def metrics(before: Column, after: Column) -> Column:
    """Token accounting of a text before and after cleaning."""
    saved = before - after
    return F.struct(
        before.alias("input_tokens"),
        after.alias("output_tokens"),
        saved.alias("tokens_saved"),
        F.when(before == 0, 0.0).otherwise(after / before).alias("compression_ratio"),
        F.when(before == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - after / before) * 100.0).alias("reduction_percent"),
    )
