"""BPE encoding and decoding by forced-boundary splitting.

Two neighbouring symbols that stand side by side inside no vocabulary token can never be joined by a merge, nor can
anything to the left of them be joined to anything on their right. Every such place is a certain cut: the fragments
between cuts are encoded independently (each by the tokenizers library's merge procedure) and their ids concatenated.
Fragments are short and repeat, so their ids are kept; texts are never searched for merges as a whole.

Results equal those of the tokenizers library for the same file with ``add_special_tokens=False``.

Null and empty texts give no ids and decode to the empty text. Texts of any length are handled in one linear pass;
repeated rows and ties have no influence. Columns that are not asked to be kept are dropped; a kept one named like a
result gives way to it.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from tokenizers.models import BPE

from corpusmill.llm.common import append_columns, table

#: Entries kept by a worker for chunks, pre-tokens and fragments; each is emptied when full.
CACHE = 100_000


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Codec:
    """Encoder and decoder of one byte-level BPE file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        # Each base symbol is one character here: a byte's, or beyond those the same byte's at a word end.
        self.symbol = byte_symbols()
        self.ended = {c: chr(0xE000 + k) if self.suffix else c for k, c in enumerate(self.symbol)}
        self.vocab = {self._spelled(t): i for t, i in model["vocab"].items()}
        self.inside = {t[k : k + 2] for t in self.vocab for k in range(len(t) - 1)}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.model = BPE(self.vocab, [(self._spelled(x), self._spelled(y)) for x, y in pairs], cache_capacity=0)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        names = sorted(self.special, key=len, reverse=True)
        self.split_special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pretoken = regex.compile(pattern)
        self.text_of = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.fragment_ids: dict[str, bytes] = {}
        self.word_ids: dict[str, bytes] = {}
        self.chunk_ids: dict[str, bytes] = {}

    def _spelled(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            body = token[: -len(self.suffix)]
            return body[:-1] + self.ended[body[-1]] if body[-1] in self.ended else token
        return token

    def symbols(self, pretoken: str) -> str:
        """The pre-token's bytes as base symbols."""
        out = pretoken if pretoken.isascii() else "".join([self.symbol[b] for b in pretoken.encode()])
        if not pretoken.isprintable() and pretoken.isascii():
            out = "".join([self.symbol[b] for b in pretoken.encode()])
        return out[:-1] + self.ended[out[-1]]

    def fragments(self, pretoken: str) -> list[str]:
        """The pre-token's base symbols, cut wherever no token can reach across."""
        units, inside = self.symbols(pretoken), self.inside
        cuts = [k for k in range(1, len(units)) if units[k - 1 : k + 1] not in inside]
        return [units[i:j] for i, j in zip([0, *cuts], [*cuts, len(units)], strict=True)]

    def encode_pretoken(self, pretoken: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if (known := self.word_ids.get(pretoken)) is not None:
            return known
        parts = []
        for fragment in self.fragments(pretoken):
            if (part := self.fragment_ids.get(fragment)) is None:
                ids = [t.id for t in self.model.tokenize(fragment)]
                part = pack(f"<{len(ids)}I", *ids)
                if len(self.fragment_ids) >= CACHE:
                    self.fragment_ids.clear()
                if len(fragment) <= 64:
                    self.fragment_ids[fragment] = part
            parts.append(part)
        packed = b"".join(parts)
        if len(self.word_ids) >= CACHE:
            self.word_ids.clear()
        if len(pretoken) <= 256:
            self.word_ids[pretoken] = packed
        return packed

    def encode_chunk(self, chunk: str) -> bytes:
        """A stretch without spaces: its pre-tokens' ids, kept for the next time."""
        packed = b"".join([self.encode_pretoken(w) for w in self.pretoken.findall(chunk)])
        if len(self.chunk_ids) >= CACHE:
            self.chunk_ids.clear()
        if len(chunk) <= 256:
            self.chunk_ids[chunk] = packed
        return packed

    def _encode_plain(self, text: str) -> bytes:
        # No pre-token holds white space, so a space or line end always separates two of them.
        text = lower(unicodedata.normalize("NFC", text)).replace("\n", " ")
        get, put = self.chunk_ids.get, self.encode_chunk
        return b"".join([put(c) if (known := get(c)) is None else known for c in text.split(" ")])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.split_special is None or "<|" not in text:
            return self._encode_plain(text)
        return b"".join(
            np.array([self.special[p]], dtype="<u4").tobytes() if p in self.special else self._encode_plain(p)
            for p in self.split_special.split(text)
            if p
        )

    def decode(self, packed: bytes) -> str:
        """As a tokenizer file without a decoder does: the tokens' own spellings, joined by spaces."""
        text = self.text_of
        return " ".join([text[i] for i in np.frombuffer(packed, dtype="<u4").tolist()])


def lower(text: str) -> str:
    """Lower-case each character by itself: without the rule for a final sigma, which a tokenizer doesn't know."""
    return "σ".join(part.lower() for part in text.split("Σ")) if "Σ" in text else text.lower()


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(
    docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, ids: bool = True
) -> DataFrame:
    """Columns ``keep`` of ``docs`` (None: all) with n_tokens, ids_sha256, decoded_sha256 and, if asked, the ids."""
    fields = [
        T.StructField("n_tokens", T.LongType(), False),
        T.StructField("ids_sha256", T.StringType(), False),
        T.StructField("decoded_sha256", T.StringType(), False),
        *([T.StructField("token_ids", T.ArrayType(T.IntegerType(), False), False)] if ids else []),
    ]

    def rows():
        own = codec(path)

        def each(batch: pa.RecordBatch):
            count, digest, decoded, lists = [], [], [], []
            for item in batch.column(batch.schema.get_field_index(text)):
                packed = own.encode(item.as_py())
                count.append(len(packed) // 4)
                digest.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(own.decode(packed).encode("utf-8", "replace")).hexdigest())
                if ids:
                    lists.append(packed)
            out = [pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(decoded, pa.string())]
            if ids:
                ends = np.concatenate([[0], np.cumsum(np.array(count, dtype=np.int64))]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(lists), dtype="<u4").astype(np.int32))
                out.append(pa.ListArray.from_arrays(pa.array(ends), values))
            return out

        return each

    return append_columns(docs, fields, rows, keep=keep, inputs=[text])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"], ids=False)
