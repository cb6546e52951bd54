"""Substring dedup by sliding sentence spans.

Every run of ``span`` consecutive sentences is hashed (128 bits) and the hashes are joined over all documents; sentences
in a span that is not the first of its kind (by document id, then place) are removed.

A sentence ends after a word with a full stop, exclamation or question mark, or at a line end; one that goes on counts as
several, cut after each 16th word. So a passage of 50 words that begins with a sentence has a span whatever its sentences
are like, while ``3.14`` is no two sentences. White space is space, tab and the characters up to carriage return.

A task first compares the spans of its own batch and sends on only the earliest of each kind, so a passage that a third
of all rows share reaches the shuffle once for each batch, and its group has as many rows as there are batches. What is
already known to be later goes along under its document's own key.

Null texts stay null; texts of fewer sentences than a span stay as they are. Rows with the same id and text are one
document; with the same id and another text, the text's hash decides which is earlier; null ids come first. Ids may be of
any type that has an order. Texts are read whole. Columns of ``docs`` stay; ones named like a result give way to it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import append_columns, beside, checkpoint, few_files, named, settled, table, unused

SPAN = 3
SENTENCE_WORDS = 16
#: A sentence with the white space after it: words without an end mark on one line, and a last one of any kind.
SENTENCE = rf"(?:[^\x20\x09-\x0D]*[^\x20\x09-\x0D.!?][\x20\x09\x0B-\x0D]+){{0,{SENTENCE_WORDS - 1}}}[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
CUT = re.compile(SENTENCE)
BLANK = " \t\n\x0b\x0c\r"
BASE = np.uint64(0x9E3779B97F4A7C15)


def sentences(text: str | None) -> tuple[str, list[str]]:
    """What stands before the first sentence, and the sentences; together they are the text."""
    text = text or ""
    cut = CUT.findall(text)
    return text[: len(text) - sum(map(len, cut))], cut


def spans(cut: list[str], span: int) -> np.ndarray:
    """128-bit hashes of all runs of so many sentences, as two columns."""
    n = len(cut) - span + 1
    if n < 1:
        return np.zeros((0, 2), dtype=np.int64)
    digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(s.rstrip(BLANK).encode("utf-8", "replace")) for s in cut]), dtype="<u8").reshape(-1, 2)
    out = np.full((n, 2), span, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(span):
            out = (out ^ (out >> np.uint64(29))) * BASE + digest[k : k + n]
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def earlier_first(ids: list, keys: list[int]) -> np.ndarray:
    """Each row's rank by id and key, nulls first; equal rows have equal ranks."""
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k], keys[k]) if ids[k] is not None else (False, 0, keys[k]))
    rank, last = np.zeros(len(ids), dtype=np.int64), None
    at = -1
    for k in order:
        own = (ids[k], keys[k])
        at, last = at + (own != last), own
        rank[k] = at
    return rank


def task_spans(span: int):
    """Spans of each batch: the earliest of each kind by its hash, later ones under their document's key."""

    def run(batches):
        for batch in batches:
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            rank = earlier_first(batch.column(0).to_pylist(), keys.tolist())
            owner, hashes = [], []
            for k, t in enumerate(batch.column(2)):
                own = spans(sentences(t.as_py())[1], span)
                if len(own):
                    owner.append(np.full(len(own), k))
                    hashes.append(own)
            if not owner:
                continue
            place = np.concatenate([np.arange(len(h)) for h in hashes])
            owner, hashes = np.concatenate(owner), np.concatenate(hashes)
            order = np.lexsort((place, rank[owner], hashes[:, 1], hashes[:, 0]))
            h0, h1, owner, place = hashes[order, 0], hashes[order, 1], owner[order], place[order]
            lead = np.concatenate([[True], (h0[1:] != h0[:-1]) | (h1[1:] != h1[:-1])])
            head = np.maximum.accumulate(np.where(lead, np.arange(len(lead)), 0))
            late = ~((rank[owner] == rank[owner][head]) & (place == place[head]))
            keep = lead | late  # the same place of a repeated row is not later
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(late, keys[owner], h0)[keep]), pa.array(np.where(late, 0, h1)[keep]), batch.column(0).take(pa.array(owner[keep])), pa.array(keys[owner][keep]), pa.array(place[keep].astype(np.int32)), pa.array(late[keep])],
                names=["h0", "h1", "id", "key", "place", "late"],
            )

    return run


def marked(docs: DataFrame, text: str, row_id: str, span: int) -> DataFrame:
    """Document (id, key) and the first sentences of its later spans, each once."""
    source = docs.select(named(row_id).alias("id"), F.xxhash64(named(text)).alias("key"), named(text).alias("text")).filter(F.length("text") > 0)
    kind = T.StructType([T.StructField("h0", T.LongType()), T.StructField("h1", T.LongType()), source.schema["id"], T.StructField("key", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("late", T.BooleanType())])
    # One shuffle serves both the aggregation and the join with its result, as they have the same key. The little that
    # comes of it is written here: within a larger plan the optimizer would not see that both sides are the same.
    found = source.select("id", "key", "text").mapInArrow(settled(task_spans(span)), kind).repartition("h0", "h1")
    here = F.struct("id", "key", "place")
    kinds = found.groupBy("h0", "h1").agg(F.min(F.when(~F.col("late"), here)).alias("first"))
    later = found.join(kinds, ["h0", "h1"]).filter(F.col("late") | ~here.eqNullSafe(F.col("first")))
    return checkpoint(few_files(later.groupBy("id", "key").agg(F.collect_set("place").alias("later")), docs.count()))


def dedup_spans(docs: DataFrame, text: str = "text", row_id: str = "doc_id", span: int = SPAN) -> DataFrame:
    """``docs`` with later spans removed from the text, n_sentences of the old text and n_removed."""
    new = ("n_sentences", "n_removed")
    columns = beside(docs.columns, new)
    own_id, own_key, own_later = unused(docs, "__id", "__key", "__later")
    later = marked(docs, text, row_id, span).select(F.col("id").alias(own_id), F.col("key").alias(own_key), F.col("later").alias(own_later)).hint("shuffle_hash")
    keyed = docs.select(*map(named, columns)).withColumns({own_id: named(row_id), own_key: F.xxhash64(named(text))})
    same = keyed[own_id].eqNullSafe(later[own_id]) & (keyed[own_key] == later[own_key])
    out = keyed.join(later, same, "left").drop(later[own_id], later[own_key])
    fields = [T.StructField(text, T.StringType()), *(T.StructField(c, T.LongType(), False) for c in new)]

    def rows():
        def each(batch: pa.RecordBatch):
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            texts, total, removed = [], [], []
            for t, places in zip(column(text).to_pylist(), column(own_later).to_pylist(), strict=True):
                before, cut = sentences(t)
                gone = {k + j for k in places or () for j in range(span)}
                texts.append("".join([before, *[s for k, s in enumerate(cut) if k not in gone]]) if gone else t)
                total.append(len(cut))
                removed.append(len(gone))
            return [pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())]

        return each

    made = append_columns(out, fields, rows, keep=[c for c in columns if c != text], inputs=[text, own_later])
    return made.select(*map(named, columns), *new)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_spans(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_sentences", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLE = rf"""
WITH cut AS (SELECT doc_id, text, regexp_extract_all(text, '{SENTENCE}') AS s FROM documents WHERE text IS NOT NULL),
flat AS (SELECT doc_id, generate_subscripts(s, 1) AS k, unnest(s) AS piece FROM cut),
runs AS (
  SELECT doc_id, k, {" || chr(0) || ".join(f"rtrim(s[k + {j}], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))" for j in range(SPAN))} AS run
  FROM (SELECT doc_id, s, unnest(range(1, len(s) - {SPAN - 2})) AS k FROM cut WHERE len(s) >= {SPAN})),
later AS (SELECT doc_id, k FROM (SELECT *, row_number() OVER (PARTITION BY md5(run) ORDER BY doc_id, k) AS nth FROM runs) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + {SPAN})) AS k FROM later),
kept AS (
  SELECT f.doc_id, string_agg(f.piece, '' ORDER BY f.k) FILTER (g.k IS NULL) AS text, count(g.k) AS n
  FROM flat f LEFT JOIN gone g ON g.doc_id = f.doc_id AND g.k = f.k GROUP BY f.doc_id)
SELECT d.doc_id, CAST(coalesce(len(c.s), 0) AS BIGINT) AS n_sentences, CAST(coalesce(t.n, 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN t.n > 0 THEN regexp_extract(d.text, '^[\x20\x09-\x0D]*') || coalesce(t.text, '') ELSE coalesce(d.text, '') END) AS text_sha256
FROM documents d LEFT JOIN cut c USING (doc_id) LEFT JOIN kept t USING (doc_id)
"""
