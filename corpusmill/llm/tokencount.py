"""Token counts by dynamic programming shared in a trie.

Under a unigram model a pre-token is cut into the pieces with the highest sum of scores. The best score of a prefix does
not depend on what follows it, so the distinct pre-tokens of a batch form a trie whose nodes hold the best score of their
prefix and how many tokens reach it: it is computed once for all pre-tokens that share the prefix, and a terminal node's
number of tokens is stored as its pre-token's count. The trie is walked depth first, over the sorted pre-tokens, so that a
node is held only while pre-tokens below it follow. Stored counts serve later batches; when there are too many they are
emptied, which changes no result.

The vocabulary is a piece file of the sentencepiece library. Scores follow Zipf's law over the piece numbers, as the
public file is not a unigram one and tokenizers are not trained here: log probability -log(number + 1). The counts are
those of this model, for budgets and comparisons, and not of that library's BPE. Pre-tokens are the stretches between
spaces, with the word-start mark in front. A character that begins no known piece is spelled by its UTF-8 bytes, a token
each. Among equal scores the cut with fewer tokens wins.

Null and empty texts, and texts of spaces only, have no tokens. Texts are read whole; a pre-token of any length takes
linear time. Repeated rows are counted alike. Columns that are not asked to be kept are dropped; a kept one named like
a result gives way to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from corpusmill.llm.common import append_columns, table

MARK = "▁"
#: Pre-tokens whose count a worker keeps from batch to batch, and new ones that it gathers for one walk.
KNOWN, TOGETHER = 600_000, 300_000
#: Longest pre-token whose count is kept.
LONGEST = 128


class Counter:
    """Counts of one vocabulary, given as piece -> log probability."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.byte_score = min(pieces.values(), default=0.0) - 1.0
        self.known: dict[str, int] = {}
        ends: dict[str, set[int]] = {}
        for p in pieces:
            if len(p) > 1:
                ends.setdefault(p[-2:], set()).add(len(p))
        #: Lengths of the pieces that end in two characters.
        self.lengths = {c: tuple(sorted(s)) for c, s in ends.items()}

    def walk(self, words: Iterable[str]) -> None:
        """Store the counts of distinct pre-tokens, given in sorted order: neighbours share a path in the trie."""
        pieces, lengths, byte_score, known = self.pieces.get, self.lengths.get, self.byte_score, self.known
        score, count, last = [0.0], [0], ""
        for own in words:
            word = MARK + own
            size, k, most = len(word), 0, min(len(word), len(last))
            while k < most and word[k] == last[k]:
                k += 1
            del score[k + 1 :], count[k + 1 :]
            for end in range(k + 1, size + 1):
                c = word[end - 1]
                single = pieces(c)
                if single is None:
                    spelled = len(c.encode("utf-8", "replace"))
                    best, tokens = score[-1] + spelled * byte_score, count[-1] + spelled
                else:
                    best, tokens = score[-1] + single, count[-1] + 1
                for n in lengths(word[end - 2 : end] if end > 1 else "", ()):
                    if n > end:
                        break
                    piece = pieces(word[end - n : end])
                    if piece is not None:
                        s = score[end - n] + piece
                        if s > best or (s == best and count[end - n] + 1 < tokens):
                            best, tokens = s, count[end - n] + 1
                score.append(best)
                count.append(tokens)
            known[own] = count[-1]
            last = word

    def texts(self, texts: Iterable[str | None]) -> list[int]:
        """Tokens of each text."""
        out: list[int] = []
        held: list[str] = []
        fresh: set[str] = set()
        for text in texts:
            held.append(text or "")
            fresh |= set(held[-1].split()).difference(self.known)
            if len(fresh) >= TOGETHER:
                out += self._counted(held, fresh)
                held, fresh = [], set()
        return out + self._counted(held, fresh)

    def _counted(self, held: list[str], fresh: set[str]) -> list[int]:
        self.walk(sorted(fresh))
        own = self.known.__getitem__
        out = [sum(map(own, text.split())) for text in held]
        for word in fresh:
            if len(word) > LONGEST:
                del self.known[word]
        if len(self.known) > KNOWN:
            self.known.clear()
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {
        model.id_to_piece(k): -math.log(k + 1)
        for k in range(model.get_piece_size())
        if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))
    }
    return Counter(pieces)


def count_tokens(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_tokens."""

    def rows():
        own = counter(path)

        def each(batch: pa.RecordBatch):
            column = batch.column(batch.schema.get_field_index(text))
            return [pa.array(own.texts(x.as_py() for x in column), pa.int64())]

        return each

    return append_columns(docs, [T.StructField("n_tokens", T.LongType(), False)], rows, keep=keep, inputs=[text])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
