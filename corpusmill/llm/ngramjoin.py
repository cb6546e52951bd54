"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles; two are linked if the Jaccard similarity of their sets is 0.8 or more.

1. Identical texts form a class (128-bit digest); everything below works on classes.
2. Each class has 200 MinHash values, in 40 bands of 5. Classes that share a band are candidates; a pair at similarity
   0.8 shares none with probability 1.3e-7.
3. Candidates of one bucket are compared 40 values at a time. With a uniform prior the similarity's posterior after m of
   n equal values is Beta(m + 1, n - m + 1); a pair is dropped as soon as P(similarity >= 0.8) is below 1e-6.
4. Pairs that are left are verified on the shingle sets themselves.
5. Links are counted, and connected components give the classes of near-duplicates.

Pairs are never rows. Of buckets with the same members only that of the first band is used. Large buckets are dealt in
blocks; a task compares two blocks and returns, for each class in them, how many links it has and a spanning forest of the
links. A member is dealt once for each block of its bucket, so a group of m different texts makes m * m / BLOCK rows in its
buckets: the comparisons themselves, which counting every link needs, grow with the square, in blocks of BLOCK * BLOCK.
A pair that shares several bands counts only in the first of them.

To drop near-duplicates links need no counts: each bucket's members are compared with its least one first, and then only
with members of other components, so that a tight group makes rows in proportion to its members.

Results, one row per document: ``class_id``, the least id of all documents connected with it by links or copies;
``n_links``, the number of other documents that it is linked with (its copies included); ``n_linked_texts``, that of
other texts; ``n_copies``, that of documents with exactly its text. Texts of one to four words have one shingle. Null
texts and texts without words are linked with none, but identical texts without words are copies. Null ids are passed
over for class_id, which is null if all are. Ids may be of any type that has an order. Repeated rows count as copies. All
texts are read whole.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import checkpoint, few_files, join_by_key, named, settled, table, unused, words

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
STEP = 40
TOLERANCE = 1e-6
#: Members of a block; a task holds two blocks.
BLOCK = 1024
#: Pairs that are verified at a time.
PAIRS = 250_000
#: Shingles of a pair of blocks that are counted at a time.
TOGETHER = 500_000
#: Edges of one file of a checkpoint.
EDGES = 400_000
#: Up to so many digests (16 bytes each) are broadcast to pick the texts to verify; beyond, they are joined by shuffle.
BROADCAST_ROWS = 200_000
_RNG = np.random.default_rng(20240229)
MULTIPLY = _RNG.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
ADD = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles."""
    found = words(text)
    if not found:
        return np.zeros(0, dtype=np.uint64)
    own: dict[bytes, int] = {}
    number = np.fromiter((own.setdefault(w, len(own)) for w in found), dtype=np.int64, count=len(found))
    value = np.array([xxhash.xxh3_64_intdigest(w) for w in own], dtype=np.uint64)[number]
    size = min(size, len(value))
    n = len(value) - size + 1
    out = np.full(n, size, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + value[k : k + n]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(found: np.ndarray) -> np.ndarray:
    """MinHash values of a shingle set."""
    low = found.astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for k in range(0, len(low), 512):
            part = low[k : k + 512]
            best = np.minimum(best, (MULTIPLY[:, None] * part[None, :] + ADD[:, None]).min(axis=1))
    return best


@lru_cache
def fewest_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For each number of compared values, how many must be equal for the pair to stay."""
    x = (np.arange(20_000) + 0.5) / 20_000
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(x) + (n - m) * np.log1p(-x)
        weight = np.exp(log - log.max(axis=1, keepdims=True))
        chance = weight[:, x >= threshold].sum(axis=1) / weight.sum(axis=1)
        out[n] = int(np.argmax(chance >= tolerance))
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit value for each band of each row, a row for each band."""
    part = sig.reshape(-1, BANDS, ROWS).astype(np.uint64)
    out = np.zeros(part.shape[:2], dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + part[:, :, k]
    return np.ascontiguousarray(out.T)


def survivors(sig: np.ndarray, i: np.ndarray, j: np.ndarray, fewest: dict[int, int]) -> np.ndarray:
    """Which pairs (i, j) stay possible as their MinHash values are compared, some more at each step."""
    stay, same = np.arange(len(i)), np.zeros(len(i), dtype=np.int64)
    for n in range(STEP, HASHES + 1, STEP):
        same = same + (sig[i[stay], n - STEP : n] == sig[j[stay], n - STEP : n]).sum(axis=1)
        ok = same >= fewest[n]
        stay, same = stay[ok], same[ok]
        if not len(stay):
            break
    return stay


def pairs_left(sig: np.ndarray, size: np.ndarray, block: np.ndarray, bucket: int, lo: int, hi: int, fewest: dict[int, int], threshold: float):
    """Pairs (i, j) between the two blocks, or within one, that pruning leaves and whose first shared band is this one.

    Pairs of an earlier band and of too different sizes go first, for some rows of one block against the whole other.
    """
    band, keys = bucket & 63, band_keys(sig)
    left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    step = max(1, 20_000 // max(1, len(right)))
    for k in range(0, len(left), step):
        rows = left[k : k + step]
        a, b = size[rows][:, None], size[right][None, :]
        open_ = np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9
        if lo == hi:
            open_ &= rows[:, None] < right[None, :]
        for earlier in range(band):
            open_ &= keys[earlier, rows][:, None] != keys[earlier, right][None, :]
            if earlier % 8 == 7 and not open_.any():
                break
        i, j = np.nonzero(open_)
        if len(i):
            i, j = rows[i], right[j]
            ok = survivors(sig, i, j, fewest)
            if len(ok):
                yield i[ok], j[ok]


def runs(batches, columns: list[str]):
    """Groups of consecutive rows that are alike in the first three columns, across batches; as (band, lo, hi, table)."""
    rest = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        part = pa.concat_tables([rest, part]).combine_chunks() if rest is not None else part
        if not part.num_rows:
            continue
        key = np.stack([part.column(c).to_numpy() for c in columns[:3]], axis=1)
        edge = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        for a, b in zip(edge[:-2], edge[1:-1], strict=True):
            yield *key[a].tolist(), part.slice(a, b - a)
        rest = part.slice(edge[-2])
    if rest is not None and rest.num_rows:
        yield *(rest.column(c)[0].as_py() for c in columns[:3]), rest


def fixed(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4").reshape(-1, width)


def classes_of(docs: DataFrame, text: str, row_id: str) -> DataFrame:
    """A row for each distinct text: digest k, number of documents, least id, shingles and MinHash values."""

    def run(batches):
        for batch in batches:
            seen: dict[bytes, int] = {}
            count, least, first = [], [], []
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k, (own, key) in enumerate(zip(ids, keys, strict=True)):
                at = seen.setdefault(key, len(seen))
                if at == len(count):
                    count.append(0)
                    least.append(None)
                    first.append(k)
                count[at] += 1
                if own is not None and (least[at] is None or own < least[at]):
                    least[at] = own
            size, sig = [], []
            for k in first:
                found = shingles(batch.column(2)[k].as_py().encode("utf-8", "replace"))
                size.append(len(found))
                sig.append(signature(found).astype("<u4").tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(count, pa.int64()), pa.array(least, batch.schema.field(0).type), pa.array(size, pa.int32()), pa.array(sig, pa.binary())], names=["k", "n", "least", "size", "sig"])

    source = docs.select(named(row_id).alias("least"), F.unhex(F.md5(named(text))).alias("k"), named(text).alias("text")).filter("text IS NOT NULL")
    kind = T.StructType([T.StructField("k", T.BinaryType()), T.StructField("n", T.LongType()), source.schema["least"], T.StructField("size", T.IntegerType()), T.StructField("sig", T.BinaryType())])
    each = source.mapInArrow(settled(run), kind)
    return each.groupBy("k").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.first("size").alias("size"), F.first("sig").alias("sig"))


def banded(classes: DataFrame) -> DataFrame:
    """Bucket and class of each band of each class, shuffled by bucket."""
    key = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.shiftleft(F.xxhash64(F.substring("sig", b * (4 * ROWS) + 1, F.lit(4 * ROWS)), b), 6).bitwiseOR(b.cast("long")))
    return classes.filter(F.col("sig").isNotNull()).select("k", F.explode(key).alias("bucket")).repartition("bucket")


def unlike(members: DataFrame, *more) -> DataFrame:
    """Buckets with two classes or more (and what ``more`` aggregates); of those with the same members that of the first band.

    A pair's first shared band is never left out: an equal bucket before it would hold the pair too.
    """
    full = members.groupBy("bucket").agg(F.count("*").alias("members"), F.sum(F.xxhash64("k").cast("decimal(20,0)")).alias("sum"), F.bit_xor(F.xxhash64("k", F.lit(1))).alias("xor"), *more).filter("members > 1")
    alike = F.struct(F.col("bucket").bitwiseAND(63).alias("band"), *[c for c in full.columns if c not in ("members", "sum", "xor")])
    return full.groupBy("members", "sum", "xor").agg(F.min(alike).alias("b")).select("members", "b.*").drop("band")


def blocks_of(count: Column) -> Column:
    return F.ceil(count / BLOCK).cast("int")


def dealt(members: DataFrame, classes: DataFrame, blocks: Column, block: Column, others: Column) -> DataFrame:
    """Members of buckets, dealt to pairs of blocks: bucket, lo, hi, block, k, n, size, sig."""
    own = members.withColumn("blocks", blocks).withColumn("block", block)
    each = own.select("bucket", "k", "block", F.explode(others).alias("other"))
    each = each.select("bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "k")
    return each.join(classes.select("k", "n", "size", "sig"), "k")


def candidates(classes: DataFrame) -> DataFrame:
    """All members of buckets with two classes or more, dealt to all pairs of their blocks."""
    each = banded(classes)
    members = each.join(unlike(each), "bucket")
    return dealt(members, classes, blocks_of(F.col("members")), F.pmod(F.hash("k"), F.col("blocks")), F.sequence(F.lit(0), F.col("blocks") - 1))


def unresolved(shared: DataFrame, classes: DataFrame, label: DataFrame, n: int) -> DataFrame:
    """Members (bucket, k) of buckets that hold classes of several components, dealt so that only pairs with one outside the
    bucket's main component meet. A tight group has few outside, so its rows grow with the group and not with its square.
    """
    each = shared.join(label.select(F.col("v").alias("k"), "m"), "k", "left").select("bucket", "k", F.coalesce("m", "k").alias("label"))
    several = each.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min_by("label", "k").alias("main")).filter("low != high")
    flagged = checkpoint(few_files(each.join(several.select("bucket", "main"), "bucket").select("bucket", "k", (F.col("label") != F.col("main")).alias("outside")), n, EDGES))
    sizes = flagged.groupBy("bucket").agg(F.sum(F.col("outside").cast("long")).alias("few"), F.sum((~F.col("outside")).cast("long")).alias("many"))
    members = flagged.join(sizes.select("bucket", blocks_of(F.col("many")).alias("inner"), blocks_of(F.col("few")).alias("outer")), "bucket")
    block = F.when(F.col("outside"), F.col("inner") + F.pmod(F.hash("k"), F.col("outer"))).otherwise(F.pmod(F.hash("k"), F.col("inner")))
    others = F.sequence(F.when(F.col("outside"), 0).otherwise(F.col("inner")), F.col("inner") + F.col("outer") - 1)
    return dealt(members, classes, F.col("inner") + F.col("outer"), block, others)


GROUP = ["bucket", "lo", "hi"]


def possible(dealt: DataFrame, threshold: float) -> DataFrame:
    """Rows of ``dealt`` that are in some pair which Bayesian pruning leaves."""

    fewest = fewest_matches(threshold, TOLERANCE)

    def run(batches):
        for bucket, lo, hi, part in runs(batches, GROUP):
            if part.num_rows < 2:
                continue
            sig, size, block = fixed(part.column("sig"), HASHES), part.column("size").to_numpy(), part.column("block").to_numpy()
            live = np.zeros(part.num_rows, dtype=bool)
            for i, j in pairs_left(sig, size, block, bucket, lo, hi, fewest, threshold):
                live[i] = live[j] = True
            if live.any():
                yield from part.filter(pa.array(live)).combine_chunks().to_batches()

    return dealt.select(*GROUP, "block", "k", "n", "size", "sig").repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(settled(run), dealt.select(*GROUP, "block", "k", "n", "size", "sig").schema)


def shared_counts(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs' sets.

    Few pairs are intersected one by one. Many are counted together, for one range of hashes after the other: a product
    of 0/1 matrices over the shingles that two sets or more have.
    """
    rows, columns = np.unique(i), np.unique(j)
    used = np.union1d(rows, columns)
    if len(i) < 2 * len(used):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], dtype=np.int64)
    ranges = 1 + sum(len(sets[k]) for k in used) // TOGETHER
    cuts = np.array([(k << 64) // ranges for k in range(1, ranges)], dtype=np.uint64)
    edge = {k: [0, *np.searchsorted(sets[k], cuts).tolist(), len(sets[k])] for k in used.tolist()}
    total = np.zeros((len(rows), len(columns)), dtype=np.float32)
    for r in range(ranges):
        parts = [sets[k][edge[k][r] : edge[k][r + 1]] for k in used.tolist()]
        owner = np.repeat(np.arange(len(used)), [len(x) for x in parts])
        value = np.concatenate(parts)
        order = np.argsort(value, kind="stable")
        value, owner = value[order], owner[order]
        fresh = np.ones(len(value), dtype=bool)
        fresh[1:] = value[1:] != value[:-1]
        number = np.cumsum(fresh) - 1
        often = np.bincount(number)[number] > 1 if len(number) else fresh
        owner, number = owner[often], np.cumsum(fresh[often]) - 1
        for a in range(0, int(number[-1]) + 1 if len(number) else 0, 2048):
            lo, hi = np.searchsorted(number, (a, a + 2048))
            part = np.zeros((len(used), min(2048, int(number[-1]) + 1 - a)), dtype=np.float32)
            part[owner[lo:hi], number[lo:hi] - a] = 1
            total += part[np.searchsorted(used, rows)] @ part[np.searchsorted(used, columns)].T
    return np.rint(total[np.searchsorted(rows, i), np.searchsorted(columns, j)]).astype(np.int64)


def gathered(parts, most: int):
    """Pairs of several parts put together, about so many at a time."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= most:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def forest(m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of m nodes the least node of its component under the links (i, j)."""
    label = np.arange(m)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        for x in (i, j, label[i], label[j]):
            np.minimum.at(new, x, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def verified(left: DataFrame, threshold: float) -> DataFrame:
    """For each class of each pair of blocks: links there (texts, documents), and the root of its links' forest."""

    fewest = fewest_matches(threshold, TOLERANCE)

    def run(batches):
        for bucket, lo, hi, part in runs(batches, GROUP):
            m = part.num_rows
            if m < 2:
                continue
            sig, size, block = fixed(part.column("sig"), HASHES), part.column("size").to_numpy(), part.column("block").to_numpy()
            n, keys = part.column("n").to_numpy(), part.column("k").to_pylist()
            sets = [np.frombuffer(s, dtype="<u8") for s in part.column("shingles").to_pylist()]
            texts, documents, links = np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64), []
            for i, j in gathered(pairs_left(sig, size, block, bucket, lo, hi, fewest, threshold), PAIRS):
                both = shared_counts(sets, i, j)
                real = both >= threshold * (size[i].astype(np.int64) + size[j] - both) - 1e-9
                i, j = i[real], j[real]
                texts += np.bincount(i, minlength=m) + np.bincount(j, minlength=m)
                np.add.at(documents, i, n[j])
                np.add.at(documents, j, n[i])
                root = forest(m, i, j)  # of this part's links only a spanning forest is kept
                own = np.flatnonzero(root != np.arange(m))
                links.append((own, root[own]))
            if not texts.any():
                continue
            i, j = (np.concatenate(x) for x in zip(*links, strict=True))
            root = forest(m, i, j)
            hit = np.flatnonzero(texts).tolist()
            if hit:
                yield pa.RecordBatch.from_arrays([pa.array([keys[x] for x in hit], pa.binary()), pa.array(texts[hit]), pa.array(documents[hit]), pa.array([keys[root[x]] for x in hit], pa.binary())], names=["k", "texts", "documents", "root"])

    return left.select(*GROUP, "block", "k", "n", "size", "sig", "shingles").repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(settled(run), "k binary, texts long, documents long, root binary")


def shingle_sets(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """Digest and shingle set of the wanted texts, once each."""
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    source = docs.filter(named(text).isNotNull()).select(F.unhex(F.md5(named(text))).alias("k"), named(text).alias("text")).join(wanted, "k", "left_semi")

    def run(batches):
        for batch in batches:
            first = {k: at for at, k in reversed(list(enumerate(batch.column(0).to_pylist())))}
            sets = [shingles(batch.column(1)[at].as_py().encode("utf-8", "replace")).astype("<u8").tobytes() for at in first.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(first), pa.binary()), pa.array(sets, pa.binary())], names=["k", "shingles"])

    return source.mapInArrow(settled(run), "k binary, shingles binary").groupBy("k").agg(F.first("shingles").alias("shingles"))


def pair_rows(pairs: DataFrame, keep, kind: str) -> DataFrame:
    """The pairs (u, v) of wide rows that ``keep(batch)``, a mask, lets through."""

    def run(batches):
        for batch in batches:
            mask = keep(batch)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)).filter(mask) for c in ("u", "v")], names=["u", "v"])

    return pairs.mapInArrow(settled(run), kind)


def star_links(shared: DataFrame, classes: DataFrame, docs: DataFrame, text: str, threshold: float, n: int) -> DataFrame:
    """Links (u, v) between each bucket's least class and its other members (bucket, k, u): rows grow with the members."""
    fewest = fewest_matches(threshold, TOLERANCE)
    pairs = checkpoint(few_files(shared.filter("k != u").select("u", F.col("k").alias("v")).distinct(), n, EDGES))
    side = lambda own: classes.select(F.col("k").alias(own), F.col("sig").alias(f"sig_{own}"), F.col("size").alias(f"size_{own}"))
    hubs = pairs.groupBy("u").agg(F.count("*").alias("pairs")).join(side("u"), "u")
    wide = join_by_key(pairs, hubs, ["u"], "pairs", pairs.count()).join(side("v"), "v")

    def column(batch, name):
        return batch.column(batch.schema.get_field_index(name))

    def may(batch):
        m = batch.num_rows
        a, b = (column(batch, f"size_{own}").to_numpy() for own in "uv")
        sig = np.concatenate([fixed(column(batch, f"sig_{own}"), HASHES) for own in "uv"])
        near = np.flatnonzero(np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9)
        mask = np.zeros(m, dtype=bool)
        mask[near[survivors(sig, near, near + m, fewest)]] = True
        return pa.array(mask)

    def are(batch):
        a, b = ([np.frombuffer(x, dtype="<u8") for x in column(batch, f"set_{own}").to_pylist()] for own in "uv")
        both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b, strict=True)]
        return pa.array([c >= threshold * (len(x) + len(y) - c) - 1e-9 for c, x, y in zip(both, a, b, strict=True)], pa.bool_())

    near = checkpoint(few_files(pair_rows(wide, may, "u binary, v binary"), n))
    sets = shingle_sets(docs, near.select(F.explode(F.array("u", "v")).alias("k")).distinct(), text)
    full = near.join(sets.select(F.col("k").alias("v"), F.col("shingles").alias("set_v")), "v").join(sets.select(F.col("k").alias("u"), F.col("shingles").alias("set_u")), "u")
    return checkpoint(few_files(pair_rows(full, are, "u binary, v binary"), n))


def components(edges: DataFrame, rows: int) -> DataFrame:
    """Node v and the least node m of its component, by alternating large and small stars; nodes without edges are absent.

    There are at most ``rows`` edges, and never more than that later: a star's edges are as many as its nodes.
    """
    edges = checkpoint(few_files(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), rows, EDGES))
    while True:
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("top")).union(edges.select("v", F.lit(0), F.lit(1)))
        if not ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("top").alias("top")).filter("up > 1 OR up = 1 AND top = 1").limit(1).count():
            return edges.select(F.col("u").alias("v"), F.col("v").alias("m"))  # each node hangs on one that hangs on none
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = checkpoint(few_files(small.filter("u != v").distinct(), rows, EDGES))


def first_of(member: DataFrame, classes: DataFrame) -> DataFrame:
    """For each class k of a component: the component m and its first text: least id (unless none is set), then digest."""
    member = member.unionByName(member.select(F.col("m").alias("v"), "m").distinct())
    grouped = member.join(classes.select(F.col("k").alias("v"), "least"), "v")
    first = F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("id"), F.col("v").alias("k")))
    return grouped.join(grouped.groupBy("m").agg(first.alias("first")), "m").select(F.col("v").alias("k"), "first", "m")


def known_classes(docs: DataFrame, text: str, row_id: str, threshold: float, n: int) -> DataFrame:
    """For each distinct text (digest k): its class's least id, and the counts of its rows.

    ``n``: rows of ``docs``, for the number of files that are written on the way.
    """
    classes = checkpoint(few_files(classes_of(docs, text, row_id), n))
    left = checkpoint(few_files(possible(candidates(classes), threshold), n))
    sets = shingle_sets(docs, left.select("k").distinct(), text)
    links = checkpoint(few_files(verified(left.join(sets, "k"), threshold), n))
    counts = links.groupBy("k").agg(F.sum("texts").alias("texts"), F.sum("documents").alias("documents"))
    member = components(links.select(F.col("k").alias("u"), F.col("root").alias("v")), links.count())
    return classes.select("k", "n", "least", "size").join(counts, "k", "left").join(first_of(member, classes), "k", "left").select(
        "k",
        F.coalesce("first.id", "least").alias("class_id"),
        (F.when(F.col("size") > 0, F.col("n") - 1).otherwise(0) + F.coalesce("documents", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("texts", F.lit(0)).cast("long").alias("n_linked_texts"),
        F.col("n").alias("n_copies"),
    )


def copied(docs: DataFrame, text: str, row_id: str, threshold: float, n: int) -> DataFrame:
    """Texts (digest k) that have copies or links: their component, its first id and that id's text.

    Components need no count of links: each bucket's members are first compared with one of them, and after that only with
    those of other components.
    """
    classes = checkpoint(few_files(classes_of(docs, text, row_id), n))
    each = banded(classes)
    shared = checkpoint(few_files(each.join(unlike(each, F.min("k").alias("u")), "bucket").select("bucket", "k", "u"), n))
    links = star_links(shared, classes, docs, text, threshold, n)
    member = components(links, links.count())
    left = checkpoint(few_files(possible(unresolved(shared, classes, member, n), threshold), n))
    if left.limit(1).count():
        sets = shingle_sets(docs, left.select("k").distinct(), text)
        more = checkpoint(few_files(verified(left.join(sets, "k"), threshold), n)).select(F.col("k").alias("u"), F.col("root").alias("v"))
        edges = member.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(more)
        member = components(edges, edges.count())
    out = classes.select("k", "n", "least", "size").join(first_of(member, classes), "k", "left").filter("size > 0 AND (n > 1 OR m IS NOT NULL)")
    return out.select("k", F.coalesce("m", "k").alias("class"), F.coalesce("first.id", "least").alias("class_id"), F.coalesce("first.k", "k").alias("class_text"))


def near_duplicates(docs: DataFrame, text: str = "text", row_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: its id, class_id, n_links, n_linked_texts and n_copies."""
    known = known_classes(docs, text, row_id, threshold, docs.count())
    each = docs.select(named(row_id).alias("__row"), F.unhex(F.md5(named(text))).alias("k"))
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v)).cast("long").alias(c)
    out = each.join(known, "k", "left")
    return out.select(F.col("__row").alias(row_id), F.coalesce("class_id", F.when(F.col("k").isNull(), F.col("__row"))).alias("class_id"), zero("n_links", 0), zero("n_linked_texts", 0), zero("n_copies", 1))


def drop_near_duplicates(docs: DataFrame, text: str = "text", row_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with all columns, of each class only one: the least id's document.

    Of texts that share the least id the one with the least digest stays; if no id of a class is set, that one of its texts
    stays too. Of rows with the same id and text any one stays. Null texts and texts without words all stay.
    """
    own_k, own_class, own_id, own_text = unused(docs, "__k", "__class", "__class_id", "__class_text")
    n, most = docs.groupBy(named(row_id)).count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    known = copied(docs, text, row_id, threshold, n)
    shared = known.select(F.col("k").alias(own_k), F.col("class").alias(own_class), F.col("class_id").alias(own_id), F.col("class_text").alias(own_text))
    shared = checkpoint(few_files(shared, n, EDGES))
    side = F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared.hint("shuffle_hash")
    keyed = docs.withColumn(own_k, F.unhex(F.md5(named(text)))).join(side, own_k, "left")
    first = named(row_id).eqNullSafe(F.col(own_id)) & (F.col(own_k) == F.col(own_text))
    kept = keyed.filter(F.col(own_class).isNull() | first)
    if most > 1:  # rows that share an id, or have none
        kept = kept.filter(F.col(own_class).isNull()).unionByName(kept.filter(F.col(own_class).isNotNull()).dropDuplicates([own_class]))
    return kept.select(*map(named, docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, text, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents WHERE text IS NOT NULL),
texts AS (SELECT md5(text) AS k, count(*) AS n, min(doc_id) AS least, any_value(w) AS w FROM docs GROUP BY 1),
sh AS (
  SELECT DISTINCT k, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT k, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM texts WHERE len(w) > 0)),
sizes AS (SELECT k, count(*) AS size FROM sh GROUP BY k),
often AS (SELECT a.k AS u, b.k AS v, count(*) AS met FROM sh a JOIN sh b ON a.s = b.s AND a.k < b.k GROUP BY 1, 2),
half AS (
  SELECT u, v FROM often JOIN sizes x ON x.k = u JOIN sizes y ON y.k = v WHERE 5 * met >= 4 * (x.size + y.size - met)),
links AS (SELECT u, v FROM half UNION ALL SELECT v, u FROM half),
reach AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
groups AS (SELECT r.u AS k, least(any_value(o.least), min(t.least)) AS least FROM reach r JOIN texts t ON t.k = r.v JOIN texts o ON o.k = r.u GROUP BY r.u),
counts AS (SELECT u AS k, count(*) AS texts, sum(t.n) AS documents FROM links JOIN texts t ON t.k = v GROUP BY u)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN d.doc_id ELSE coalesce(g.least, t.least) END AS class_id,
  CAST(coalesce(CASE WHEN len(t.w) > 0 THEN t.n - 1 ELSE 0 END, 0) + coalesce(c.documents, 0) AS BIGINT) AS n_links,
  CAST(coalesce(c.texts, 0) AS BIGINT) AS n_linked_texts, CAST(coalesce(t.n, 1) AS BIGINT) AS n_copies
FROM documents d LEFT JOIN texts t ON t.k = md5(d.text) LEFT JOIN groups g ON g.k = t.k LEFT JOIN counts c ON c.k = t.k
"""
