"""Language identification by nearest centroids.

A text becomes a normalised TF-IDF vector of hashed character n-grams. In a bounded sample of labelled texts, each
language's vectors are grouped by spherical k-means; a text gets the language of the centroid with the highest cosine.
A text whose best cosine is below what nearly all texts of that language reach is marked as rejected.

A text that is null or has no letter is ``und`` with score 0. Repeated rows are judged alike; between equal cosines the
first language in alphabetical order wins. With no labelled rows every text is ``und``. Texts are read whole. Columns
that are not asked to be kept are dropped; a kept one named like a result gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import append_columns, checkpoint, crc_bucket, named, table

BUCKETS = 4096
#: The classifier is fitted on about so many labelled rows of each language at most.
SAMPLE = 1000
#: Partitions of that sample.
FILES = 24
CLUSTERS = 4
#: The share of a language's sample whose cosine lies below its rejection distance.
REJECTED = 0.002


def counts(text: str) -> np.ndarray:
    """Hashed counts of the 1-, 2- and 3-grams of characters; runs of what is no letter count as one space."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    code = np.where(raw < 65, np.uint32(32), raw)
    if len(code) > 1:
        code = code[np.concatenate([[True], (code[1:] != 32) | (code[:-1] != 32)])]
    a = code * np.uint32(2654435761)
    out = np.bincount(a >> np.uint32(20), minlength=BUCKETS)
    if len(code) > 1:
        b = (a[:-1] ^ (a[:-1] >> np.uint32(13))) * np.uint32(31) + a[1:]
        out += np.bincount((b * np.uint32(2246822519)) >> np.uint32(20), minlength=BUCKETS)
        if len(code) > 2:
            c = (b[:-1] ^ (b[:-1] >> np.uint32(15))) * np.uint32(131) + a[2:]
            out += np.bincount((c * np.uint32(3266489917)) >> np.uint32(20), minlength=BUCKETS)
    return out


def weighted(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors, with sublinear counts."""
    x = np.log1p(rows).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def clustered(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means; starts from rows far from each other, so that it is the same each time."""
    centres = [x.mean(axis=0)]
    while len(centres) < min(k, len(x)):
        c = np.array(centres) / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        centres.append(x[int(np.argmin((x @ c.T).max(axis=1)))])
    c = np.array(centres)
    for _ in range(rounds):
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        near = np.argmax(x @ c.T, axis=1)
        c = np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def rows_of(places: Iterable[list[int]], numbers: Iterable[list[int]]) -> np.ndarray:
    """Dense rows of counts from the places that are not zero and their numbers."""
    places = list(places)
    out = np.zeros((len(places), BUCKETS), dtype=np.int32)
    for row, at, n in zip(out, places, numbers, strict=True):
        row[np.asarray(at, dtype=np.int64)] = n
    return out


def centroids_of(rows: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, float]:
    """One language's centroids, and the cosine that nearly all its texts reach."""
    x = weighted(rows[np.lexsort(rows.T)], idf)  # in an order of its own, so that the result is the same each time
    centres = clustered(x, CLUSTERS).astype(np.float32)
    return centres, float(np.quantile((x @ centres.T).max(axis=1), REJECTED))


class Model:
    """Centroids, the language of each, and each language's rejection distance."""

    def __init__(self, idf: np.ndarray, found: list[tuple[str, np.ndarray, float]]):
        found = sorted(found, key=lambda f: f[0])
        self.idf, self.langs = idf, [lang for lang, _, _ in found]
        self.centroids = np.concatenate([c for _, c, _ in found]).astype(np.float32)
        self.owner = np.repeat(np.arange(len(found)), [len(c) for _, c, _ in found])
        self.least = np.array([least for _, _, least in found])

    def predict(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language numbers, scores and whether the text is too far from all centroids."""
        cosine = weighted(rows, self.idf) @ self.centroids.T
        best = np.stack([cosine[:, self.owner == k].max(axis=1) for k in range(len(self.langs))], axis=1)
        top = np.argmax(best, axis=1)
        at = best[np.arange(len(top)), top]
        share = np.exp(20 * (best - at[:, None]))
        return top, 1 / share.sum(axis=1), at < self.least[top]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", row_id: str = "doc_id", sample: int = SAMPLE) -> Model | None:
    """From about ``sample`` rows of each language at most, chosen by a hash of the id among those that ``learn`` allows.

    Counts stay on the executors: the texts that hold each n-gram are summed there, and each language's rows are clustered
    in a task. The driver gets the sums and CLUSTERS centroids for each language.
    """
    own = docs.filter(learn).select(named(row_id).alias("id"), named(text).alias("text"), named(lang).alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = own.groupBy("lang").agg(F.count("*").alias("n"))
    # Each language once: its share of rows is joined, however many languages there are.
    share = F.greatest(F.lit(1), (F.least(F.lit(1.0), sample / F.col("n")) * 1_000_000).cast("long"))
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    chosen = own.join(F.broadcast(sizes.select("lang", share.alias("share"))), "lang").filter(draw < F.col("share"))

    def each_task():
        def each(batch: pa.RecordBatch):
            made = [counts(t) if has_letter(t) else np.zeros(0, dtype=np.int64) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            places = [np.flatnonzero(m) for m in made]
            return [pa.array(places, pa.list_(pa.int32())), pa.array([m[p] for m, p in zip(made, places, strict=True)], pa.list_(pa.int32()))]

        return each

    kind = T.ArrayType(T.IntegerType(), False)
    got = checkpoint(append_columns(chosen, [T.StructField("at", kind), T.StructField("n", kind)], each_task, keep=["lang"], inputs=["text"]).filter(F.size("at") > 0).coalesce(FILES))
    rows = got.count()
    if not rows:
        return None
    held = np.zeros(BUCKETS)
    for place, n in got.select(F.explode("at").alias("at")).groupBy("at").count().collect():  # BUCKETS rows at most
        held[place] = n
    idf = np.log((1 + rows) / (1 + held)).astype(np.float32) + 1

    def cluster(key: tuple, part: pa.Table) -> pa.Table:
        centres, least = centroids_of(rows_of(part.column("at").to_pylist(), part.column("n").to_pylist()), idf)
        return pa.table({"lang": [key[0].as_py()], "centres": pa.array([centres.tobytes()], pa.binary()), "least": [least]})

    found = got.groupBy("lang").applyInArrow(cluster, "lang string, centres binary, least double").collect()
    return Model(idf, [(r["lang"], np.frombuffer(r["centres"], dtype=np.float32).reshape(-1, BUCKETS), r["least"]) for r in found])


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with lang_pred, score and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False), T.StructField("rejected", T.BooleanType(), False)]

    def rows():
        def each(batch: pa.RecordBatch):
            own, column = shared.value, batch.column(batch.schema.get_field_index(text))
            n = len(column)
            pred, score, far = ["und"] * n, np.zeros(n), np.ones(n, dtype=bool)
            for start in range(0, n if own else 0, 512):
                texts = [x.as_py() for x in column[start : start + 512]]
                fit_for = [k for k, t in enumerate(texts) if has_letter(t)]
                if not fit_for:
                    continue
                top, s, r = own.predict(np.array([counts(texts[k]) for k in fit_for]))
                for k, t, x, y in zip(fit_for, top, s, r, strict=True):
                    pred[start + k], score[start + k], far[start + k] = own.langs[t], x, y
            return [pa.array(pred, pa.string()), pa.array(score), pa.array(far)]

        return each

    return append_columns(docs, fields, rows, keep=keep, inputs=[text])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False))
    model = fit(docs, crc_bucket("doc_id", 5) != 0)
    out = identify(docs, model, keep=["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
