"""Toxicity by maximum-scoring segments.

Every word has a log-odds score between toxic and clean texts, from the numbers of texts that hold it, with an informative
Dirichlet prior: the share of toxic texts among those of its six-byte beginning, which has that of its five-byte one as
prior, and so on up to that of all words. A score is that of the end nearest 0 of the share's interval of two standard
errors, so that thin evidence counts little; a word seen too seldom has the score of its longest known beginning. A drift
makes the expected exponential of a score 1 at most under clean text, and the mean score of nearly every clean text, in
whatever language, negative: then the best segment of a clean text follows an extreme-value law with decay 1. A linear scan
finds all maximal scoring segments of a text; each is a passage, significant if its score stands out from what the law
allows for a text of that length. The best passage and the sum of the significant ones, both in extreme-value units, give
the document's probability through a logistic fit on the training rows.

Null and empty texts have no passages and get the score of a text without any, as do texts of unknown words. Texts of
any length take linear time. Repeated rows are judged alike; passages of equal score keep the order of the text. Without
both labels in the training rows all scores are 0. Columns that are not asked to be kept are dropped; a kept one named
like a result gives way to it.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import append_columns, as_bytes, checkpoint, crc_bucket, named, settled, table, words

#: The model is fitted on about so many labelled rows at most; its lexicon is bounded by the words of so many texts.
SAMPLE = 20_000
#: Partitions of that sample.
FILES = 12
#: Texts that the prior of a word or a beginning counts for.
PRIOR_TEXTS = 20.0
#: Standard errors of the interval of a share, whose end nearest the overall share gives the score.
ERRORS = 2.0
#: A word or a beginning has a score of its own from so many texts on, and from one text in so many of the sample. The
#: second bounds the lexicon by the words of so many texts, whatever the sample.
LEAST_TEXTS, ONE_IN = 4, 2_000
MOST_SCORE = 8.0
#: Share of the words of clean texts that may lie in texts of a positive mean score.
LEFT = 0.01
#: Words that a clean text counts for there at most.
MOST_WORDS = 1_000
#: Bytes of the word beginnings that are scored too, and the mark that tells them from words.
BEGINNINGS = (6, 5, 4)
MARK = b"\x00"
#: Words whose score a worker keeps.
CACHE = 150_000
#: Passages whose chance of arising in a clean text of that length is below this are significant.
SIGNIFICANT = 0.05


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [start, end) of a sequence, by a scan over cumulative sums that takes linear time.

    Runs between positive scores are taken in one step, as no segment begins or ends inside them. Each open segment knows
    the nearest earlier one with a smaller left sum: a search follows these links, and a segment that a search has passed
    lies behind a link from then on, so that it is never passed again.
    """
    up = np.flatnonzero(score > 0)
    if not len(up):
        return []
    total = np.concatenate([[0.0], np.cumsum(score)])
    starts, ends, lefts, rights = up.tolist(), (up + 1).tolist(), total[up].tolist(), total[up + 1].tolist()
    open_: list[tuple[float, float, int, int, int]] = []  # left sum, right sum, start, end, link
    for start, end, left, right in zip(starts, ends, lefts, rights, strict=True):
        j = len(open_) - 1
        while j >= 0 and open_[j][0] >= left:
            j = open_[j][4]
        while j >= 0 and open_[j][1] < right:
            left, _, start, _, link = open_[j]
            del open_[j:]
            j = link
        open_.append((left, right, start, end, j))
    return [(a, b, right - left) for left, right, a, b, _ in open_]


class Scores(dict):
    """Score of each word, looked up once: its own, else that of its longest known beginning, else that of no evidence."""

    def __init__(self, lexicon: dict[bytes, float], drift: float):
        super().__init__()
        self.lexicon, self.drift = lexicon, drift

    def __missing__(self, word: bytes) -> float:
        own = self.lexicon.get(word)
        for k in BEGINNINGS:
            if own is None and len(word) > k:
                own = self.lexicon.get(MARK + word[:k])
        own = (0.0 if own is None else own) + self.drift
        if len(self) >= CACHE:
            self.clear()
        if len(word) <= 64:
            self[word] = own
        return own


class Model:
    """Word scores and the calibration of passages and documents."""

    def __init__(self, lexicon: dict[bytes, float], drift: float):
        self.scores = Scores(lexicon, drift)
        self.log_k = 0.0
        self.coefficients = np.array([-30.0, 0.0, 0.0])

    def passages(self, text: bytes | None) -> tuple[int, list[tuple[int, int, float]]]:
        found = words(text)
        score = np.fromiter(map(self.scores.__getitem__, found), dtype=float, count=len(found))
        return len(found), segments(score)

    def features(self, n: int, found: list[tuple[int, int, float]]) -> tuple[float, float, int]:
        """Best passage and sum of the significant ones in extreme-value units, and how many these are."""
        base = self.log_k + np.log(max(n, 1))
        unit = [s - base for _, _, s in found]
        least = -np.log(-np.log1p(-SIGNIFICANT))
        strong = [u for u in unit if u >= least]
        return max([-5.0, *unit]), sum(strong), len(strong)

    @staticmethod
    def vector(best: float, total: float) -> list[float]:
        return [1.0, np.log1p(best + 5.0), np.log1p(total)]

    def calibrate(self, feats: list[tuple[float, float]], labels: np.ndarray) -> None:
        """Logistic regression of the label on the two features: Newton steps, halved until the loss falls."""
        x = np.array([self.vector(a, b) for a, b in feats])
        sign = 2 * labels - 1

        def loss(w):
            return np.logaddexp(0, -sign * (x @ w)).sum() + 0.005 * (w[1:] ** 2).sum()

        w = np.zeros(3)
        ridge = np.diag([1e-6, 0.01, 0.01])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + ridge
            step, size = np.linalg.solve(h, x.T @ (labels - p) - ridge @ w), 1.0
            while size > 1e-6 and loss(w + size * step) > loss(w):
                size /= 2
            w = w + size * step
            if np.abs(size * step).max() < 1e-8:
                break
        self.coefficients = w

    def score(self, n: int, found: list[tuple[int, int, float]]) -> tuple[float, int]:
        best, total, strong = self.features(n, found)
        z = float(self.coefficients @ np.array(self.vector(best, total)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), strong


def sampled(labels: DataFrame, learn: Column, row_id: str, label: str, sample: int) -> DataFrame:
    """About ``sample`` labelled ids at most, chosen by hash; an id labelled twice counts by its larger label."""
    rows = labels.filter(learn).select(named(row_id).alias("__id"), named(label).alias("__label")).filter("__id IS NOT NULL AND __label IS NOT NULL")
    n = rows.count()
    share = max(1, int(1_000_000 * min(1.0, sample / max(n, 1))))
    draw = F.pmod(F.xxhash64("__id"), F.lit(1_000_000))
    return rows.filter(draw < share).groupBy("__id").agg(F.max("__label").cast("int").alias("__label"))


def word_counts(rows: DataFrame) -> DataFrame:
    """Word and the toxic and clean texts that hold it; counted inside each task first."""
    names = ("toxic", "clean")

    def run(batches):
        counts = tuple(Counter() for _ in names)

        def flush():
            every = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.binary()), *(pa.array([c[w] for w in every], pa.int64()) for c in counts)], names=["word", *names])
            for c in counts:
                c.clear()

        for batch in batches:
            for t, y in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                counts[0 if y > 0 else 1].update(set(words(t)))
            if len(counts[0]) + len(counts[1]) > 500_000:
                yield from flush()
        yield from flush()

    counted = rows.mapInArrow(settled(run), "word binary, toxic long, clean long")
    return counted.groupBy("word").agg(*[F.sum(c).alias(c) for c in names])


def shares(counts: DataFrame, overall: float) -> DataFrame:
    """Words and marked beginnings: the texts that hold them (by word) and the share of toxic ones, smoothed by the prior."""
    smooth = lambda prior: (F.col("toxic") + PRIOR_TEXTS * prior) / (F.col("toxic") + F.col("clean") + PRIOR_TEXTS)
    texts = (F.col("toxic") + F.col("clean")).alias("texts")
    levels: list[DataFrame] = []
    for k in sorted(BEGINNINGS):
        level = counts.filter(F.length("word") > k).groupBy(F.substring("word", 1, k).alias("start")).agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        prior = F.lit(overall)
        if levels:
            above = levels[-1].select(F.col("start").alias("above"), F.col("share").alias("prior"))
            level, prior = level.join(above, F.substring("start", 1, k - 1) == F.col("above")), F.col("prior")
        levels.append(level.select("start", texts, smooth(prior).alias("share")))
    begun = reduce(DataFrame.unionByName, levels)
    above = begun.select(F.col("start").alias("above"), F.col("share").alias("prior"))
    longest = F.substring("word", F.lit(1), F.least(F.lit(max(BEGINNINGS)), F.length("word") - 1))
    own = counts.join(above, longest == F.col("above"), "left").select("word", texts, smooth(F.coalesce("prior", F.lit(overall))).alias("share"))
    return own.unionByName(begun.select(F.concat(F.lit(MARK), "start").alias("word"), "texts", "share"))


def lexicon_of(counts: DataFrame, n_texts: int) -> dict[bytes, float]:
    """Scores of the words and beginnings that enough texts hold; their number is bounded by the words of ONE_IN texts."""
    toxic, clean = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    overall = toxic / (toxic + clean)
    known = shares(counts, overall).filter(F.col("texts") >= max(LEAST_TEXTS, n_texts // ONE_IN))
    share, n = F.col("share"), F.col("texts") + PRIOR_TEXTS
    # Wilson's bounds: the error of log-odds has no limit for shares near 0 and 1, which would take the surest words away.
    half, wide = ERRORS**2 / (2 * n), ERRORS * F.sqrt(share * (1 - share) / n + ERRORS**2 / (4 * n * n))
    low, high = (share + half - wide) / (1 + 2 * half), (share + half + wide) / (1 + 2 * half)
    bound = F.greatest(low, F.least(high, F.lit(overall)))
    score = F.least(F.log(bound / (1 - bound)) - float(np.log(overall / (1 - overall))), F.lit(MOST_SCORE))
    got = known.select("word", score.alias("score")).toArrow()
    return dict(zip(got.column("word").to_pylist(), got.column("score").to_pylist(), strict=True))


def drift_for(rows: DataFrame, lexicon: dict[bytes, float]) -> float:
    """What to add to each score: exp(score) has the mean 1 at most over the words of clean texts, and texts with all but
    ``LEFT`` of these words have a mean score below 0, so that length alone makes no passage; never above -0.02. A text
    counts as ``MOST_WORDS`` at most: no long text of one word decides for all others."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        scores = Scores(shared.value, 0.0)
        for batch in batches:
            out = []
            for t, y in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                if y <= 0 and (found := words(t)):
                    s = np.fromiter(map(scores.__getitem__, found), dtype=float, count=len(found))
                    out.append((float(min(len(s), MOST_WORDS)), float(s.mean()), float(np.exp(s).mean())))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.float64()) for k in range(3)], names=["n", "mean", "lifted"])

    got = rows.mapInArrow(settled(run), "n double, mean double, lifted double").toArrow()  # bounded by the sample
    if not got.num_rows:
        return -0.02
    n, mean, lifted = (np.array(got.column(c)) for c in ("n", "mean", "lifted"))
    by = np.lexsort((n, mean))
    most = mean[by][np.searchsorted(np.cumsum(n[by]), (1 - LEFT) * n.sum())]
    return float(min(-np.log(np.sort(n * lifted).sum() / n.sum()), -most - 0.02, -0.02))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", row_id: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> Model | None:
    """Lexicon, extreme-value law and calibration from a bounded sample of the labelled rows that ``learn`` allows."""
    chosen = sampled(labels, learn, row_id, label, sample)
    # The sample is bounded by its parameter, so its ids may be broadcast, and its texts and their words take few files.
    rows = checkpoint(docs.select(named(row_id).alias("__id"), named(text).alias("__text")).join(F.broadcast(chosen), "__id").select("__text", "__label").repartition(FILES))
    counts = checkpoint(word_counts(rows).coalesce(FILES))
    toxic, clean = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    if not toxic or not clean:
        return None
    lexicon = lexicon_of(counts, rows.count())
    model = Model(lexicon, drift_for(rows, lexicon))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            out = [shared.value.passages(t) for t in as_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([[s for _, _, s in o[1]] for o in out], pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], names=["n", "found", "label"])

    got = rows.mapInArrow(settled(run), "n long, found array<double>, label int").collect()  # bounded by the sample
    got.sort(key=lambda r: (r["n"], r["label"], r["found"]))
    clean = [(r["n"], max(r["found"])) for r in got if not r["label"] and r["found"]]
    clear = sum(r["n"] for r in got if not r["label"] and not r["found"])
    # The most likely factor of the law, for decay 1; texts without any passage count with their length.
    model.log_k = float(np.log((len(clean) + 1) / (sum(n * np.exp(-s) for n, s in clean) + clear + 1)))
    feats = [model.features(r["n"], [(0, 0, s) for s in r["found"]])[:2] for r in got]
    model.calibrate(feats, np.array([float(r["label"] > 0) for r in got]))
    return model


def score(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None, passages: bool = False) -> DataFrame:
    """``docs`` with score and n_passages (significant ones), and if asked all passages as word positions and scores."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False), T.StructField("score", T.DoubleType(), False)]), False)
    fields = [T.StructField("score", T.DoubleType(), False), T.StructField("n_passages", T.LongType(), False), *([T.StructField("passages", kind, False)] if passages else [])]

    def rows():
        def each(batch: pa.RecordBatch):
            own, scores, strong, spans = shared.value, [], [], []
            for t in as_bytes(batch.column(batch.schema.get_field_index(text))):
                n, found = own.passages(t) if own else (0, [])
                s, k = own.score(n, found) if own else (0.0, 0)
                scores.append(s)
                strong.append(k)
                spans.append([{"start": a, "end": b, "score": x} for a, b, x in found])
            out = [pa.array(scores, pa.float64()), pa.array(strong, pa.int64())]
            return [*out, pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))] if passages else out

        return each

    return append_columns(docs, fields, rows, keep=keep, inputs=[text])


THRESHOLD = 0.3


def reject(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows():
        def each(batch: pa.RecordBatch):
            own, texts = shared.value, as_bytes(batch.column(batch.schema.get_field_index(text)))
            return [], pa.array([own is None or own.score(*own.passages(t))[0] < threshold for t in texts], pa.bool_())

        return each

    return append_columns(docs, [], rows)


def learnable() -> Column:
    return crc_bucket("doc_id", 4) != 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), learnable())
    out = score(docs, model, keep=["doc_id"])
    held = F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages")
