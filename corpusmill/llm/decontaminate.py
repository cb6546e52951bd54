"""Benchmark decontamination with an FM-index for each training shard.

A shard is one Arrow batch of documents. Benchmark words get ids; a document word outside that vocabulary can be in no
occurrence and therefore only separates. What lies between separators, if it is as long as some test phrase, is the
shard's text. Over it stand a suffix array (prefix doubling), its Burrows-Wheeler transform in a wavelet tree, and
sampled suffix positions. All test phrases are searched backwards at once, a word a step, by ranks in the tree; the
occurrences are located by walking to the nearest sampled position, and the spans found are merged.

A test phrase is a window of ``window`` consecutive words of a benchmark item, or the whole item if it is shorter.

The benchmark is read in blocks of about ``block_bytes`` bytes of text, whatever its size; a block is what is broadcast. With
its words and windows in arrays it takes some 20 bytes of a worker's memory for each byte of text. Blocks beyond the first
are further passes over the rows, which carry the spans found so far, without a shuffle; rows are written between passes, so
that a worker holds one block at a time. An item longer than a block is cut into overlapping parts, so no window is lost.

Null or empty texts have no words and no hits; an item without words matches nothing; items that share a window are
all reported; repeated rows are each judged alike. Input columns beside the kept ones are dropped, and a kept one that
is named like a result gives way to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import WORD_TABLE, append_columns, as_bytes, beside, checkpoint, named, table, unused, words

WINDOW = 10
BLOCK_BYTES = 2_000_000
SAMPLE = 8
WORD = re.compile(rb"[^ ]+")


class WaveletTree:
    """Ranks over an integer sequence, as a wavelet matrix: one bit vector with running counts for each bit."""

    def __init__(self, sequence: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        for b in reversed(range(self.bits)):
            bit = (sequence >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(len(bit) - int(bit.sum()))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its end."""
        start = np.zeros_like(end)
        for level, b in enumerate(reversed(range(self.bits))):
            ones, zeros = self.ones[level], self.zeros[level]
            one = ((symbol >> b) & 1).astype(bool)
            start = np.where(one, zeros + ones[start], start - ones[start])
            end = np.where(one, zeros + ones[end], end - ones[end])
        return end - start

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            one = ones[at + 1] - ones[at]
            at = np.where(one == 1, zeros + ones[at], at - ones[at])
            out = (out << 1) | one
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; every separator in ``text`` differs, so ranks soon do."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step, n = 1, len(text)
    while True:
        later = np.full(n, -1, dtype=np.int64)
        later[: n - step] = rank[step:]
        key = rank * (n + 1) + later + 1
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Backward search over word ids from 1 on; 0 separates and ends the text."""

    def __init__(self, text: np.ndarray, top: int):
        # Separators count as different, in the order of the text, while suffixes are sorted.
        gap = text == 0
        distinct = np.where(gap, np.cumsum(gap) - gap.sum() - 1, text)
        order = suffix_array(distinct)
        self.n = len(text)
        self.last = text[order - 1]
        self.tree = WaveletTree(self.last, top)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        # Also sampled: what follows a separator, so that no walk has to cross one.
        sampled = (order % SAMPLE == 0) | (self.last == 0)
        self.sampled_at = np.concatenate([[0], np.cumsum(sampled)])
        self.position = order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each phrase; phrases are right-aligned in the matrix."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.n, dtype=np.int64)
        width = phrases.shape[1]
        for back in range(width):
            live = np.flatnonzero((lengths > back) & (high > low))
            if not len(live):
                break
            symbol = phrases[live, width - 1 - back]
            low[live] = self.before[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.tree.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        rows, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        out = np.full(len(rows), -1, dtype=np.int64)
        live = np.arange(len(rows))
        while len(live):
            at = rows[live]
            found = self.sampled_at[at + 1] > self.sampled_at[at]
            done = live[found]
            out[done] = self.position[self.sampled_at[at[found]]] + steps[done]
            live = live[~found]
            at = rows[live]
            symbol = self.last[at]
            rows[live] = self.before[symbol] + self.tree.rank(symbol, at)
            steps[live] += 1
        return out


class Phrases:
    """Windows of one block of benchmark items: rows of word ids, right-aligned, and the items of each, in flat arrays."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.ids: dict[bytes, int] = {}
        self.names = list(dict.fromkeys(item for item, _ in items))
        number = {name: k for k, name in enumerate(self.names)}
        rows, owner = [np.zeros((0, window), dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
        for item, text in items:
            row = np.fromiter((self.ids.setdefault(w, len(self.ids) + 1) for w in text), dtype=np.int32, count=len(text))
            size = min(window, len(row))
            if size:
                part = np.zeros((len(row) - size + 1, window), dtype=np.int32)
                part[:, window - size :] = np.lib.stride_tricks.sliding_window_view(row, size)
                rows.append(part)
                owner.append(np.full(len(part), number[item]))
        every = np.concatenate(rows)
        self.matrix, which = np.unique(every, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.reshape(-1).astype(np.int64), np.concatenate(owner)], axis=1), axis=0)
        self.begin = np.searchsorted(pairs[:, 0], np.arange(len(self.matrix) + 1))
        self.item = pairs[:, 1].astype(np.int32)
        self.lengths = (self.matrix > 0).sum(axis=1)
        self.shortest = int(self.lengths.min()) if len(self.matrix) else 0

    def items_of(self, phrase: int) -> list[str]:
        return [self.names[k] for k in self.item[self.begin[phrase] : self.begin[phrase + 1]].tolist()]


def find(phrases: Phrases, texts: list[bytes | None]) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
    """Word counts, merged spans of hit words [start, end) and items found, for each text of a shard."""
    counts, spans, items = [], [[] for _ in texts], [set() for _ in texts]
    pieces, owner, offset = [], [], []
    get = phrases.ids.get
    for k, text in enumerate(texts):
        found = words(text)
        counts.append(len(found))
        if not found or not phrases.shortest:
            continue
        ids = np.fromiter((get(w, 0) for w in found), dtype=np.int64, count=len(found))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ids != 0, [0]])))
        start, end = edge[::2], edge[1::2]
        for a, b in zip(start[long := end - start >= phrases.shortest], end[long], strict=True):
            pieces.append(np.concatenate([ids[a:b], [0]]))
            owner.append(k)
            offset.append(a)
    if not pieces:
        return counts, spans, items
    sizes = np.array([len(p) for p in pieces])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    index = FMIndex(np.concatenate(pieces), len(phrases.ids))
    low, high = index.search(phrases.matrix, phrases.lengths)
    hit = np.flatnonzero(high > low)
    many = (high - low)[hit]
    which = np.repeat(hit, many)
    rows = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    place = index.locate(rows)
    piece = np.searchsorted(begin, place, side="right") - 1
    for phrase, at, p in zip(which.tolist(), (place - begin[piece]).tolist(), piece.tolist(), strict=True):
        first = int(offset[p]) + at
        spans[owner[p]].append((first, first + int(phrases.lengths[phrase])))
        items[owner[p]].update(phrases.items_of(phrase))
    return counts, [merged(s) for s in spans], items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, item_id: str, text: str, most: int, window: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The benchmark's items, so many bytes at a time."""
    block, size = [], 0
    source = benchmark.select(named(item_id).cast("string").alias("item"), named(text).alias("text"))
    for item, content in source.filter("item IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        found = words(content.encode("utf-8", "replace"))
        part = max(window, most // 8)
        for k in range(0, max(1, len(found) - window + 1), part):
            own = found[k : k + part + window - 1]
            n = sum(map(len, own)) + len(own)
            if block and size + n > most:
                yield block
                block, size = [], 0
            block.append((item, own))
            size += n
    yield block


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False)]), False)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None, cut: bool = False,
) -> DataFrame:
    """``docs`` with n_words, hit_spans (word positions, merged) and hit_items (ids as text, sorted).

    ``cut``: hit words are also cut out of the text, in the last pass; n_words and hit_spans are those of the old one.
    """
    new = ("n_words", "hit_spans", "hit_items")
    keep = beside(docs.columns if keep is None else keep, new)
    was_spans, was_items = unused(docs, "__was_spans", "__was_items")
    fields = [
        T.StructField("n_words", T.LongType(), False),
        T.StructField("hit_spans", SPANS, False),
        T.StructField("hit_items", T.ArrayType(T.StringType(), False), False),
    ]
    made_text = T.StructField(text, T.StringType())
    out, first = docs, True
    every = blocks(benchmark, item_id, item_text, block_bytes, window)
    block, later = next(every), next(every, None)
    while block is not None:
        shared = docs.sparkSession.sparkContext.broadcast(Phrases(block, window))
        cutting = cut and later is None

        def rows(shared=shared, first=first, cutting=cutting):
            def each(batch: pa.RecordBatch):
                column = lambda c: batch.column(batch.schema.get_field_index(c))
                texts = as_bytes(column(text))
                counts, spans, items = find(shared.value, texts)
                if not first:
                    for s, i, had, ids in zip(spans, items, column(was_spans).to_pylist(), column(was_items).to_pylist(), strict=True):
                        s[:] = merged([*s, *((x["start"], x["end"]) for x in had)])
                        i.update(ids)
                made = [[{"start": a, "end": b} for a, b in s] for s in spans]
                left = [pa.array([without(t, s) if s else t for t, s in zip(texts, spans, strict=True)], pa.binary()).cast(pa.string())] if cutting else []
                return [
                    *left,
                    pa.array(counts, pa.int64()),
                    pa.array(made, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array([sorted(i) for i in items], pa.list_(pa.string())),
                ]

            return each

        if not first:  # also ends the earlier pass, whose workers let its block go
            out = checkpoint(out).withColumnsRenamed({"hit_spans": was_spans, "hit_items": was_items})
        stay = [c for c in dict.fromkeys([*keep, text]) if not (cutting and c == text)]
        out = append_columns(out, [*([made_text] if cutting else []), *fields], rows, keep=stay, inputs=[text] if first else [text, was_spans, was_items])
        block, later, first = later, next(every, None) if later is not None else None, False
    return out.select(*map(named, keep), *new)


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without the words of the spans and what stands between them."""
    at = [m.span() for m in WORD.finditer(text.translate(WORD_TABLE))]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, text[last:]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("hit_items") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
bench AS (
  SELECT item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM bench WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
spots AS (
  SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM docs, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, k, s.n, item_id FROM spots s JOIN win USING (n, phrase)),
words_hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words_hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""
