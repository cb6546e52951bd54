"""Quality rules by weak supervision.

Every rule votes good (1), bad (-1) or abstains (0) on a text. Expectation-maximisation over the counts of distinct
vote patterns estimates how often each rule votes what on good and on bad texts, without labels; a text is kept if the
posterior probability that it is good, given its pattern, reaches a threshold. There are at most 3 ** rules patterns
whatever the size of the corpus, so the counts are a bounded table; they cover all documents.

A null text has no words and fails the base rules like an empty one. Texts of any length are read whole. Repeated rows
are judged alike; ties in the posterior at the threshold are kept. With an empty table there is nothing to estimate and
nothing to return. Columns that are not asked to be kept are dropped; a kept one named like a result gives way to it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import append_columns, beside, checkpoint, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
STOPS = frozenset("the of and to in is that a was for with on at from der die und den das ein ist von le la les de des et est en un une el los que y del con por".split())

#: Rules: name, and votes of a feature row as (bad if, good if). The rest abstains.
RULES = (
    ("length", lambda f: f["n_words"] < 60, lambda f: f["n_words"] > 120),
    ("word_length", lambda f: (f["mean_chars"] < 3.5) | (f["mean_chars"] > 7.5), lambda f: (f["mean_chars"] > 4.5) & (f["mean_chars"] < 6.5)),
    ("symbols", lambda f: f["symbol_rate"] > 0.02, lambda f: f["symbol_rate"] < 0.005),
    ("repeated_words", lambda f: f["repeat_rate"] > 0.35, lambda f: f["repeat_rate"] < 0.1),
    ("repeated_lines", lambda f: f["dup_rate"] > 0.5, lambda f: f["dup_rate"] < 0.2),
    # Stop words of a few languages only: their absence tells nothing about texts in others.
    ("stop_words", lambda f: np.zeros(len(f["stop_rate"]), dtype=bool), lambda f: f["stop_rate"] > 0.08),
    ("sentences", lambda f: f["stop_marks"] < 0.02, lambda f: (f["stop_marks"] > 0.04) & (f["stop_marks"] < 0.3)),
    ("variety", lambda f: f["variety"] < 1.0, lambda f: f["variety"] > 1.4),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(found: list[str]) -> tuple[int, int]:
    """Words in three-word windows that occur twice or more, and the number of distinct words."""
    ids: dict[str, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in found), dtype=np.int64, count=len(found))
    if len(seq) < 3:
        return 0, len(ids)
    pair = np.unique(seq[:-1] * len(ids) + seq[1:], return_inverse=True)[1]
    _, inverse, count = np.unique(pair[:-1] * len(ids) + seq[2:], return_inverse=True, return_counts=True)
    twice = count[inverse] > 1
    hit = np.zeros(len(seq), dtype=bool)
    for k in range(3):
        hit[k : len(seq) - 2 + k] |= twice
    return int(hit.sum()), len(ids)


def measure(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """COUNTS of a text, and what the rules need beyond them."""
    text = text or ""
    found = WORD.findall(text)
    n = len(found)
    chars = sum(map(len, found))
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeat, distinct = repeated_words(found)
    symbols = len(SYMBOL.findall(text))
    each = max(n, 1)
    marks = sum(w[-1] in ".!?" for w in found)
    stops = sum(map(STOPS.__contains__, map(str.lower, found)))
    return (n, chars, symbols, dup, repeat), (chars / each, symbols / max(chars, 1), repeat / each, dup / max(lines, 1), stops / each, marks / each, distinct / each ** 0.85)


def measured(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with COUNTS, base_failed and ``votes``: the pattern as a number in base 3, a digit for each rule."""
    fields = [*(T.StructField(c, T.LongType(), False) for c in COUNTS), T.StructField("base_failed", T.BooleanType(), False), T.StructField("votes", T.LongType(), False)]

    def rows():
        def each(batch: pa.RecordBatch):
            column = batch.column(batch.schema.get_field_index(text))
            got = [measure(x.as_py()) for x in column]
            counts = np.array([g[0] for g in got], dtype=np.int64).reshape(-1, len(COUNTS))
            rates = np.array([g[1] for g in got], dtype=float).reshape(-1, 7)
            f = dict(zip(("mean_chars", "symbol_rate", "repeat_rate", "dup_rate", "stop_rate", "stop_marks", "variety"), rates.T, strict=True)) | {"n_words": counts[:, 0]}
            votes = np.zeros(len(got), dtype=np.int64)
            for _, bad, good in RULES:
                votes = votes * 3 + 1 - bad(f).astype(int) + (good(f) & ~bad(f)).astype(int)
            failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
            return [*(pa.array(c) for c in counts.T), pa.array(failed), pa.array(votes)]

        return each

    return append_columns(docs, fields, rows, keep=keep, inputs=[text])


def digits(pattern: np.ndarray) -> np.ndarray:
    """Votes (0 bad, 1 abstains, 2 good) of each pattern, a column for each rule."""
    return np.stack([pattern // 3**k % 3 for k in reversed(range(len(RULES)))], axis=1)


def estimate(pattern: np.ndarray, count: np.ndarray, prior: float = 0.8, rounds: int = 200) -> np.ndarray:
    """Posterior probability of good for each pattern, by expectation-maximisation.

    Starts from rules that are right four times in five when they vote; Dirichlet pseudo-counts hold that start for
    rules that hardly ever vote and keep the two classes from changing places.
    """
    votes = digits(pattern)
    n_rules = len(RULES)
    start = np.array([[[0.1, 0.3, 0.6]] * n_rules, [[0.6, 0.3, 0.1]] * n_rules])
    chance, good = start.copy(), prior
    pseudo = 0.01 * count.sum() + 1
    for _ in range(rounds):
        like = [np.log(chance[c][np.arange(n_rules), votes]).sum(axis=1) for c in (0, 1)]
        gap = np.clip(like[1] + np.log1p(-good) - like[0] - np.log(good), -500, 500)
        post = 1 / (1 + np.exp(gap))
        was = chance.copy()
        for c, weight in enumerate((post * count, (1 - post) * count)):
            for v in range(3):
                chance[c, :, v] = ((votes == v) * weight[:, None]).sum(axis=0) + pseudo * start[c, :, v]
            chance[c] /= chance[c].sum(axis=1, keepdims=True)
        good = float(np.clip((post * count).sum() / count.sum(), 0.01, 0.99))
        if np.abs(was - chance).max() < 1e-7:
            break
    return post


def judge(docs: DataFrame, text: str = "text", keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """``docs`` with COUNTS, base_failed, quality (posterior probability) and kept."""
    keep = beside(docs.columns if keep is None else keep, ("quality", "kept"))
    found = checkpoint(measured(docs, text, keep))
    patterns = found.groupBy("votes").agg(F.count("*").alias("n")).collect()  # at most 3 ** rules rows
    if patterns:
        pattern = np.array([r["votes"] for r in patterns])
        post = estimate(pattern, np.array([r["n"] for r in patterns], dtype=float))
    else:
        pattern, post = np.zeros(0, dtype=int), np.zeros(0)
    known = docs.sparkSession.createDataFrame(
        [(int(p), float(q)) for p, q in zip(pattern, post, strict=True)], "votes long, quality double"
    )
    out = found.join(F.broadcast(known), "votes", "left")
    kept = ~F.col("base_failed") & (F.col("quality") >= threshold)
    return out.withColumn("kept", F.coalesce(kept, F.lit(False))).drop("votes")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", *COUNTS, "base_failed", "kept", "quality")
