"""Line dedup by winnowing over line hashes, in DataFrame operations only.

Units are the lines of a text with at least one word. A run of consecutive lines with at least ``run_words`` words in
all is repeated if the same run stands earlier: in a document with a smaller id, or further up in the same one. All
lines of later runs are deleted, and blank ones between them.

1. For each line the shortest runs with enough words that begin or end at it are windows. A window's smallest line hash,
   at its first place, is selected as its fingerprint: a repeated run holds equal windows, so it always shares one.
2. Only fingerprints and their positions are shuffled first; those of one position alone go no further.
3. Around the other positions the match is extended: line by line to the left and to the right, as far as the windows
   go that selected the position, into a hash for each side. Positions are joined by fingerprint and both sides: each
   one with the first position that agrees with it over the whole window.
4. Matches of one document with one other on the same diagonal that touch are joined into runs, and runs are deleted.

Extensions are hashes and not pairs of positions, so a line that stands in a third of all documents makes as many rows as
it has places; a match with more than a thousandth of all rows is joined by broadcast.

Null texts stay null and have no lines; texts without words stay as they are. Rows with the same id and text are one
document (each such row gets the same result); with the same id and another text, the text's hash decides which is
earlier. Null ids come first; ids may be of any type that has an order. All texts are read whole. Columns of ``docs``
stay; ones named like a result give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import beside, checkpoint, few_files, join_by_key, named, table, unused

RUN_WORDS = 50


def n_words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))


def windows(lines: Column, run_words: int) -> Column:
    """Windows of an array of lines (hash, check, words, place): first and last place, fingerprint with its place, both sides."""
    n = F.size(lines)

    def shortest(part: Column) -> Column:
        """How many items from the left are needed for enough words; 0 if all do not suffice."""
        state = F.struct(F.lit(0).alias("k"), F.lit(0).cast("long").alias("w"))
        step = lambda a, x: F.struct((a["k"] + F.when(a["w"] < run_words, 1).otherwise(0)).alias("k"), (a["w"] + F.when(a["w"] < run_words, x["words"]).otherwise(0)).alias("w"))
        return F.aggregate(part, state, step, lambda a: F.when(a["w"] >= run_words, a["k"]).otherwise(0))

    def extended(first: Column, size: Column) -> Column:
        run = F.slice(lines, first, size)
        low = F.array_min(F.transform(run, lambda x, k: F.struct(x["hash"], k.alias("k"))))
        side = lambda start, count: F.xxhash64(F.transform(F.slice(lines, start, count), lambda x: F.struct(x["hash"], x["check"])))
        return F.struct(
            F.element_at(lines, first)["place"].alias("start"),
            F.element_at(lines, first + size - 1)["place"].alias("stop"),
            F.element_at(lines, first + low["k"])["place"].alias("at"),
            low["hash"].alias("fingerprint"),
            side(first, low["k"] + 1).alias("left"),
            side(first + low["k"], size - low["k"]).alias("right"),
        )

    def at(k: Column) -> Column:
        own = F.element_at(lines, k)["words"] >= run_words
        ahead = F.when(own, 1).otherwise(shortest(F.slice(lines, k, F.least(F.lit(run_words), n - k + 1))))
        start = F.greatest(F.lit(1), k - run_words + 1)
        back = F.when(own, 1).otherwise(shortest(F.reverse(F.slice(lines, start, k - start + 1))))
        return F.array(F.struct(k.alias("first"), ahead.alias("size")), F.struct((k - back + 1).alias("first"), back.alias("size")))

    spots = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), at)))
    return F.when(n > 0, F.transform(F.filter(spots, lambda s: s["size"] > 0), lambda s: extended(s["first"], s["size"])))


def hashed_lines(text: Column) -> Column:
    """Lines with a word, as (hash, check, words, place); the place is that among all lines, from 1 on."""
    split = F.split(text, "\n", -1)
    every = F.transform(split, lambda x, k: F.struct(F.xxhash64(x).alias("hash"), F.hash(x).alias("check"), n_words(x).cast("long").alias("words"), (k + 1).alias("place")))
    return F.filter(every, lambda x: x["words"] > 0)


def matches(docs: DataFrame, text: str, row_id: str, run_words: int) -> DataFrame:
    """Windows (id, key, start, stop) that are not the first of their kind, with the document and start of the first."""
    keyed = docs.select(named(row_id).alias("id"), F.xxhash64(named(text)).alias("key"), named(text).alias("text")).filter(F.length("text") > 0)
    lined = keyed.select("id", "key", hashed_lines(F.col("text")).alias("lines"))
    # The array of lines is a column of its own, made once, before the windows are taken from it. No filter on the windows
    # stands here: it would be pushed below and make them again for every row, from lines that are made for every use.
    n = docs.count()
    spots = checkpoint(few_files(lined.select("id", "key", windows(F.col("lines"), run_words).alias("spots")), n))
    selected = F.array_distinct(F.transform("spots", lambda s: F.struct(s["fingerprint"].alias("fingerprint"), s["at"].alias("at"))))
    positions = spots.select("id", "key", F.explode(selected).alias("s")).select("s.fingerprint", F.struct("id", "key", "s.at").alias("here"))
    # Fingerprints of more than one position: the least and the greatest differ.
    ends = positions.groupBy("fingerprint").agg(F.min("here").alias("lo"), F.max("here").alias("hi"))
    several = ends.filter(~F.col("lo").eqNullSafe(F.col("hi"))).select("fingerprint")
    each = spots.select("id", "key", F.explode("spots").alias("s")).select("id", "key", "s.*")
    near = checkpoint(few_files(each.join(several, "fingerprint", "left_semi"), n))
    sides = ["fingerprint", "left", "right"]
    start = F.struct("id", "key", "start")
    firsts = near.groupBy(*sides).agg(F.min(start).alias("first"), F.max(start).alias("last"), F.count("*").alias("n"))
    firsts = firsts.filter(~F.col("first").eqNullSafe(F.col("last"))).select(*sides, "first", "n")
    return join_by_key(near, firsts, sides, "n", near.count()).filter(~start.eqNullSafe(F.col("first"))).select("id", "key", "start", "stop", "first")


def repeated_runs(docs: DataFrame, text: str = "text", row_id: str = "doc_id", run_words: int = RUN_WORDS) -> DataFrame:
    """Later runs: id, key (the text's hash), start and stop (lines, from 1 on), and id, key and start of the first match."""
    found = matches(docs, text, row_id, run_words)
    beside_it = found.select("id", "key", F.col("first.id").alias("first_id"), F.col("first.key").alias("first_key"), F.col("first.start").alias("first_start"), "start", "stop")
    diagonal = ["id", "key", "first_id", "first_key", (F.col("start") - F.col("first_start")).alias("diagonal")]
    # A document's matches with one other are bounded by its lines.
    every = beside_it.groupBy(*diagonal).agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("m"))
    kind = "array<struct<start:int,stop:int>>"
    joined = F.aggregate(
        "m",
        F.array().cast(kind),
        lambda a, x: F.when(
            (F.size(a) > 0) & (x["start"] <= F.element_at(a, -1)["stop"] + 1),
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["stop"], x["stop"]).alias("stop")))),
        ).otherwise(F.concat(a, F.array(x))),
    )
    runs = every.select("id", "key", "first_id", "first_key", "diagonal", F.explode(joined).alias("r"))
    return runs.select("id", "key", "r.start", "r.stop", "first_id", "first_key", (F.col("r.start") - F.col("diagonal")).alias("first_start"))


def dedup_lines(docs: DataFrame, text: str = "text", row_id: str = "doc_id", run_words: int = RUN_WORDS) -> DataFrame:
    """``docs`` with later repeated runs of lines deleted from the text, and n_lines and n_removed of the old text."""
    new = ("n_lines", "n_removed")
    columns = beside(docs.columns, new)
    own_id, own_key, own_gone = unused(docs, "__id", "__key", "__gone")
    runs = repeated_runs(docs, text, row_id, run_words)
    gone = runs.groupBy("id", "key").agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("start", "stop")))).alias("gone"))
    gone = gone.select(F.col("id").alias(own_id), F.col("key").alias(own_key), F.col("gone").alias(own_gone)).hint("shuffle_hash")
    keyed = docs.select(*map(named, columns)).withColumns({own_id: named(row_id), own_key: F.xxhash64(named(text))})
    same = keyed[own_id].eqNullSafe(gone[own_id]) & (keyed[own_key] == gone[own_key])
    out = keyed.join(gone, same, "left").drop(gone[own_id], gone[own_key])
    lines, lost = F.split(named(text), "\n", -1), F.col(own_gone)
    stay = F.array_except(F.sequence(F.lit(1), F.size(lines)), lost)
    kept = F.array_join(F.transform(stay, lambda k: F.element_at(lines, k)), "\n")
    return out.select(
        *[F.when(lost.isNull(), named(text)).otherwise(kept).alias(text) if c == text else named(c) for c in columns],
        F.when(named(text).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(lost.isNull(), F.lit(0)).otherwise(F.size(lost)).cast("long").alias("n_removed"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLE = r"""
WITH raw AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS place, unnest(string_split(text, chr(10))) AS line
  FROM documents WHERE text <> ''),
lines AS (
  SELECT doc_id, place, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
    row_number() OVER (PARTITION BY doc_id ORDER BY place) AS k
  FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
summed AS (SELECT *, CAST(sum(words) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS upto FROM lines),
spots AS (
  SELECT doc_id, k AS i, j FROM (
    SELECT a.doc_id, a.k, min(b.k) AS j FROM summed a JOIN summed b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.k < a.k + 50 AND b.upto - a.upto + a.words >= 50 GROUP BY a.doc_id, a.k)
  UNION
  SELECT doc_id, i, k FROM (
    SELECT a.doc_id, a.k, max(b.k) AS i FROM summed a JOIN summed b ON a.doc_id = b.doc_id AND b.k <= a.k AND b.k > a.k - 50 AND a.upto - b.upto + b.words >= 50 GROUP BY a.doc_id, a.k)),
runs AS (
  SELECT s.doc_id, s.i, s.j, md5(string_agg(l.line, chr(10) ORDER BY l.k)) AS run, min(l.place) AS start, max(l.place) AS stop
  FROM spots s JOIN lines l ON l.doc_id = s.doc_id AND l.k BETWEEN s.i AND s.j GROUP BY s.doc_id, s.i, s.j),
later AS (
  SELECT doc_id, start, stop FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, start) AS nth FROM runs) WHERE nth > 1),
gone AS (SELECT DISTINCT r.doc_id, r.place FROM raw r JOIN later l ON r.doc_id = l.doc_id AND r.place BETWEEN l.start AND l.stop),
kept AS (
  SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.place) AS text
  FROM raw r LEFT JOIN gone g ON g.doc_id = r.doc_id AND g.place = r.place WHERE g.place IS NULL GROUP BY r.doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(m.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS text_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
LEFT JOIN (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents) n USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) m USING (doc_id)
"""
