"""Secret scans with a random forest that removes false positives, in DataFrame operations only.

A word (between white space) is cut into values at all characters that values don't have; a value that = or : joins to
another in front is its name. Each value of 12 characters or more with a digit (or with a known prefix) is a candidate, and
behind a telling name or neighbouring word each one of 8 characters or more, digits or not. A forest over its length,
character transitions, dictionary coverage, the document's path and the neighbouring words decides whether it is a secret.

The forest is trained on a table of labelled findings (word, the two words before, path, label), the required input of
``train``, and written out as SQL conditions, so that scoring stays within Spark's expressions. ``findings`` makes such a
table by rule where none is at hand; a user with reviewed findings passes those.

Null and empty texts have no candidates. Texts are read whole, whatever their length. Repeated rows and repeated
secrets are each reported at their own place; a score that ties with the threshold counts as a secret. Columns of
``docs`` that are not asked to be kept are dropped; a kept one named like a result gives way to it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import beside, named, table, unused

LEAST = 12
#: Behind a telling name or neighbouring word.
LEAST_NAMED = 8
THRESHOLD = 0.5
TREES, DEPTH = 15, 8
#: Labelled findings beyond so many rows are thinned by a hash of the word.
MOST_FINDINGS = 20_000
WORDS = """able access account action address admin after again agent alpha app apple area array asset auth back base batch beta big block blog board body book box branch build bug button byte cache call card case change chart check child city class clean click client cloud code color column com commit common config content copy core count create crypt current data date day debug default delete demo design dev device disk doc docker docs document domain down draft drive edit email end engine entry error event example export factory false feature field file filter find first fix flag folder font foo form frame front full function game git global graph green group guide handle hash head hello help here hidden home host house html http icon image img import index info init input issue item java job json just key kind label lang large last latest layer left level lib light line link linux list load local lock log login long loop machine mail main make map mark master max media menu merge message meta method min mobile mock mode model module month mouse name net network new next node note null number object old online open option order org output package page panel parent part pass path pattern pay phone photo pixel place plan play plugin point pool port post power print private process product profile project proxy public query queue quick random range read red release remote report request reset resource rest result return right role root route row rule run safe sample save scale scan schema score script search section select send server service session set share shell shop sign simple site size small snap some sort source space spec split stack staff stage start state static status step stop store stream string style sub submit super support switch system tab table tag target task team temp test text theme thing this thread time title todo tool top total track tree true type unit update upload url user util value version video view wait watch web week well width window with word work world write www year your zero zone""".split()
COVER = "(" + "|".join(sorted({w for w in WORDS if len(w) >= 3}, key=lambda w: (-len(w), w))) + ")"
NAMES = r"(?i:passw|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|auth(?!or(?!i[sz]))|bearer|credential|private)"
SHORT = "(?i:key|sig|signature|session|session_?id|code|database_?url)"
#: Names that tell before = and : only; in prose they are words like others.
SHORT_NAMES = rf"(?:^|[^A-Za-z0-9]){SHORT}$"
KNOWN = r"^(?:sk-[A-Za-z0-9_-]{20,}|gh[pousr]_[A-Za-z0-9_]{20,}|github_pat_[A-Za-z0-9_]{20,}|xox[baprs]-[A-Za-z0-9-]{20,}|AKIA[0-9A-Z]{16}|npm_[A-Za-z0-9]{20,})"
HARMLESS = r"(?i)(commit|sha|md5|uuid|guid|hash|checksum|digest|isbn|card|visa|phone|tel|mail|version|example|sample|build|order|invoice|ref)"
#: A quote, escaped or as an entity; what stands between a name and its value.
QUOTE = r"""(?:\\{0,4}["'`]|&quot;|&#3[49];)?"""
CHARS = "A-Za-z0-9+/_@~-"
JOIN = rf"(?<=[={CHARS}]){QUOTE}\]?[=:]{{1,3}}>?{QUOTE}"
#: Behind a telling name, a value goes on over other characters and over an & that starts neither a parameter nor an entity.
TELLING = rf"(?:{NAMES}[A-Za-z0-9_.-]{{0,24}}|(?<![A-Za-z0-9]){SHORT})"
FREE = r"""[^\s"'`,;&<>(){}\[\]|\\]"""
WHOLE = rf"""(?<=[=:>"'`;])(?<={TELLING}{JOIN})(?![A-Za-z0-9_.-]{{0,24}}{NAMES}[A-Za-z0-9_.-]{{0,24}}{JOIN}){FREE}+(?:&+(?![A-Za-z0-9_.-]+=|#?[A-Za-z0-9]+;){FREE}+){{0,99}}(?<![.:])"""
#: Any value, with the padding of base64 code.
VALUE = rf"[{CHARS}](?:[.{CHARS}]*[{CHARS}])?(?:={{1,2}}+(?![=>]|{QUOTE}[{CHARS}]))?"
PIECE = rf"({JOIN})?({WHOLE}|{VALUE})"
FEATURES = ("length", "changes", "digits", "uppers", "hexlike", "coverage", "slashes", "dots", "ats", "dashes", "known", "named", "near_name", "near_assigned", "near_harmless", "test_path", "distinct")


def pieces(word: Column) -> Column:
    """All values of a word in their order, as an array of (name, value); the name is the value before that = or : joins."""
    part = lambda k: F.regexp_extract_all(word, F.lit(PIECE), F.lit(k))
    joined = F.zip_with(part(1), part(2), lambda j, v: F.struct(j.alias("join"), v.alias("value")))
    named = F.zip_with(
        joined,
        F.concat(F.array(F.lit("")), part(2)),
        lambda p, last: F.struct(F.when(F.length(p["join"]) > 0, last).otherwise("").alias("name"), p["value"].alias("value")),
    )
    return F.filter(named, lambda p: p["value"].isNotNull())  # the value moved on from the last place has no partner


def nearby(before: Column, before2: Column) -> Column:
    """The two words before."""
    return F.concat_ws(" ", F.coalesce(before2, F.lit("")), F.coalesce(before, F.lit("")))


def telling(name: Column) -> Column:
    return name.rlike(NAMES) | name.rlike(SHORT_NAMES)


def is_candidate(value: Column, name: Column, before: Column, before2: Column) -> Column:
    told = telling(name) | nearby(before, before2).rlike(NAMES)
    return (F.length(value) >= LEAST) & (value.rlike("[0-9]") | value.rlike(KNOWN)) | (F.length(value) >= LEAST_NAMED) & told


def may_have_candidates(word: Column, before: Column, before2: Column) -> Column:
    """False only for words without candidates."""
    joined = word.rlike("[=:]") & (word.rlike(NAMES) | word.rlike(SHORT))
    return (F.length(word) >= LEAST) & (word.rlike("[0-9]") | word.rlike(KNOWN.replace("^", ""))) | (F.length(word) >= LEAST_NAMED) & (joined | nearby(before, before2).rlike(NAMES))


def features(value: Column, name: Column, before: Column, before2: Column, path: Column) -> Column:
    """The forest's inputs, as a struct of doubles."""
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    many = lambda rx: F.regexp_count(value, F.lit(rx)).cast("double")
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    near = nearby(before, before2)
    lower = F.lower(value)
    made = {
        "length": n,
        "changes": many(r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])") / n,
        "digits": many(r"[0-9]") / n,
        "uppers": many(r"[A-Z]") / n,
        "hexlike": yes(value.rlike(r"^[0-9a-fA-F]+$")),
        "coverage": (n - F.length(F.regexp_replace(lower, COVER, ""))) / n,
        "slashes": many(r"[/\\]"),
        "dots": many(r"\."),
        "ats": many(r"@"),
        "dashes": many(r"-"),
        "known": yes(value.rlike(r"^(AKIA[0-9A-Z]{16}|gh[pousr]_|github_pat_|sk-|xox[baprs]-|npm_|eyJ[A-Za-z0-9_-]{8,}\.|AIza)")),
        "named": yes(telling(name)),
        "near_name": yes(near.rlike(NAMES)),
        "near_assigned": yes(near.rlike(NAMES + r"""[A-Za-z0-9_.-]*["'`]? ?(?:[=:]+>?|is)$""")),
        "near_harmless": yes(near.rlike(HARMLESS) | name.rlike(HARMLESS)),
        "test_path": yes(F.coalesce(path, F.lit("")).rlike(r"(?i)(test|example|fixture|sample|mock|docs?/)")),
        "distinct": F.size(F.array_distinct(F.split(lower, ""))).cast("double") / n,
    }
    return F.struct(*[made[k].alias(k) for k in FEATURES])


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int) -> tuple | float:
    """A tree: (feature, cut, below, above) or the share of secrets in a leaf."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 10:
        return share
    best = None
    for f in rng.choice(x.shape[1], int(math.sqrt(x.shape[1])) + 1, replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, s = x[order, f], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        if not len(at):
            continue
        n1 = at + 1.0
        p1, p2 = s[at] / n1, (s[-1] - s[at]) / (len(y) - n1)
        impure = n1 * p1 * (1 - p1) + (len(y) - n1) * p2 * (1 - p2)
        k = int(np.argmin(impure))
        if best is None or impure[k] < best[0]:
            best = (float(impure[k]), int(f), float((v[at[k]] + v[at[k] + 1]) / 2))
    if best is None:
        return share
    _, f, cut = best
    low = x[:, f] <= cut
    return f, cut, grow(x[low], y[low], rng, depth - 1), grow(x[~low], y[~low], rng, depth - 1)


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> list:
    """A random forest on labelled findings (word, before, before2, path, label); a label is for its word's last candidate."""
    n = findings.count()
    if n > MOST_FINDINGS:
        findings = findings.filter(F.pmod(F.xxhash64("word"), F.lit(1_000_000)) < int(1_000_000 * MOST_FINDINGS / n))
    found = F.filter(pieces(F.col("word")), lambda p: is_candidate(p["value"], p["name"], F.col("before"), F.col("before2")))
    parts = findings.withColumn("w", F.get(found, F.size(found) - 1)).filter("w IS NOT NULL")
    f = features(F.col("w.value"), F.col("w.name"), F.col("before"), F.col("before2"), F.col("path"))
    rows = parts.select(f.alias("f"), "label").select("f.*", "label").collect()
    data = np.array(sorted(tuple(r) for r in rows), dtype=float)
    x, y, rng = data[:, :-1], data[:, -1], np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        at = rng.integers(0, len(y), len(y))
        out.append(grow(x[at], y[at], rng, depth))
    return out


def probability(forest: list, f: Column) -> Column:
    """The mean over the trees, as nested conditions."""

    def of(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        k, cut, low, high = tree
        return F.when(f[FEATURES[k]] <= cut, of(low)).otherwise(of(high))

    total = of(forest[0])
    for tree in forest[1:]:
        total = total + of(tree)
    return total / float(len(forest))


def scan(docs: DataFrame, forest: list, text: str = "text", path: str | None = "source", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with n_candidates and secrets: array of (place among the words, value, score) at or above the threshold."""
    new = ("n_candidates", "secrets")
    keep = beside(docs.columns if keep is None else keep, new)
    own_path, own_words, own_found = unused(docs, "__path", "__words", "__found")
    words, found = F.col(own_words), F.col(own_found)
    nothing = F.lit(None).cast("struct<place:int,word:string,before:string,before2:string>")
    pick = F.transform(
        words,
        lambda w, k: F.when(
            may_have_candidates(w, F.get(words, k - 1), F.get(words, k - 2)),
            F.struct(k.alias("place"), w.alias("word"), F.get(words, k - 1).alias("before"), F.get(words, k - 2).alias("before2")),
        ).otherwise(nothing),
    )
    split = F.flatten(F.transform(found, lambda c: F.transform(pieces(c["word"]), lambda p: F.struct(c["place"].alias("place"), c["before"].alias("before"), c["before2"].alias("before2"), p.alias("w")))))
    value = lambda c: c["w"]["value"]
    described = F.transform(found, lambda c: F.struct(c["place"].alias("place"), value(c).alias("value"), features(value(c), c["w"]["name"], c["before"], c["before2"], F.col(own_path)).alias("f")))
    scored = F.transform(found, lambda c: F.struct(c["place"].alias("place"), c["value"].alias("value"), probability(forest, c["f"]).alias("score")))
    kind = "array<struct<place:int,value:string,score:double>>"
    return (
        docs.select(*map(named, keep), (named(path) if path else F.lit(None).cast("string")).alias(own_path), F.split(named(text), r"[\x20\x09-\x0D]+").alias(own_words))
        .withColumn(own_found, F.array_compact(pick))
        .withColumn(own_found, F.filter(split, lambda c: is_candidate(value(c), c["w"]["name"], c["before"], c["before2"])))
        .withColumn("n_candidates", F.greatest(F.lit(0), F.coalesce(F.size(found), F.lit(0))).cast("long"))
        .withColumn(own_found, described)
        .withColumn(own_found, scored)
        .withColumn("secrets", F.coalesce(F.filter(found, lambda c: c["score"] >= threshold), F.array().cast(kind)))
        .select(*map(named, keep), *new)
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusmill.llm.findings import findings_by_rule

    forest = train(findings_by_rule(spark))  # the tables have no labelled findings
    out = scan(table(spark, sf_dir, "documents"), forest, keep=["doc_id"])
    return out.select(
        "doc_id",
        "n_candidates",
        F.size("secrets").cast("long").alias("n_secrets"),
        F.sha2(F.array_join(F.transform("secrets", lambda s: s["value"]), ","), 256).alias("secrets_sha256"),
    )
