"""Queries and pipeline stages over whole small tables against plain versions; held-out figures; odd names, ids and long texts."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corpusmill.llm import bpe, decontaminate, findings, language, linededup, ngramjoin, quality, registry, secrets, spandedup, tokencount, toxicity
from corpusmill.llm.common import words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_quality_counts_equal_plain_ones(spark, texts):
    got = by_id(registry.QUERIES["op6_quality"](spark, SF))
    assert got.keys() == texts.keys()
    for k, text in texts.items():
        found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        grams: dict[tuple, list[int]] = {}
        for i in range(len(found) - 2):
            grams.setdefault(tuple(found[i : i + 3]), []).append(i)
        twice = {i + j for at in grams.values() if len(at) > 1 for i in at for j in range(3)}
        want = (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(twice))
        assert tuple(got[k][c] for c in quality.COUNTS) == want
        assert got[k]["base_failed"] == (len(found) < 50 or 100 * len(twice) > 50 * len(found))
        assert not (got[k]["base_failed"] and got[k]["kept"])


def test_quality_keeps_what_is_labelled_good(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("good"))
    got = registry.QUERIES["op6_quality"](spark, sf).filter("NOT base_failed").join(labels, "doc_id").groupBy("good").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n")).collect()
    kept = {r["good"]: r["kept"] for r in got}
    assert kept[1] > 0.99 and kept[0] < 0.02


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = registry.QUERIES["op2_toxicity"](spark, sf).filter("held_out").join(labels, "doc_id").select("doc_id", "score", "predicted", "toxic").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    score, toxic = np.array([r["score"] for r in rows]), np.array([r["toxic"] for r in rows])
    rank = np.empty(len(score))
    rank[np.argsort(score)] = np.arange(len(score))
    auc = (rank[toxic == 1].mean() - (toxic.sum() - 1) / 2) / (toxic == 0).sum()
    said = np.array([r["predicted"] for r in rows])
    assert auc > 0.97 and said[toxic == 1].mean() > 0.92 and said[toxic == 0].mean() < 0.03


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang")
    rows = registry.QUERIES["op9_language"](spark, sf).filter("held_out AND lang_pred <> 'und'").join(docs, "doc_id").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows) and len(rows) > 100
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.98


def test_language_equals_a_plain_nearest_centroid(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs, F.lit(True))
    got = by_id(language.identify(docs, model, keep=["doc_id"]))
    for k, text in texts.items():
        if not any(map(str.isalpha, text or "")):
            assert got[k]["lang_pred"] == "und" and got[k]["score"] == 0
            continue
        x = np.log1p(language.counts(text)) * model.idf
        near = int(np.argmax(model.centroids @ (x / np.linalg.norm(x)).astype(np.float32)))
        assert got[k]["lang_pred"] == model.langs[model.owner[near]]


def test_encoding_equals_the_library(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = by_id(registry.QUERIES["op4_bpe"](spark, SF))
    for k, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[k]["n_tokens"] == len(ids) and got[k]["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_token_counts_equal_a_plain_search(spark, texts):
    own = tokencount.counter(public_tokenizers.path("piece_bpe_32k.model"))
    longest = max(map(len, own.pieces))
    known: dict[str, int] = {}

    def plain(word):
        best = [(0.0, 0)]
        for k in range(1, len(word) + 1):
            c = word[k - 1]
            spelled = 0 if c in own.pieces else len(c.encode())
            options = [(best[k - 1][0] + spelled * own.byte_score, best[k - 1][1] - spelled)] if spelled else []
            options += [(best[a][0] + own.pieces[word[a:k]], best[a][1] - 1) for a in range(max(0, k - longest), k) if word[a:k] in own.pieces]
            best.append(max(options))
        return -best[-1][1]

    got = by_id(registry.QUERIES["op5_token_counts"](spark, SF))
    for k, text in texts.items():
        total = 0
        for w in (text or "").split():
            if w not in known:
                known[w] = plain("▁" + w)
            total += known[w]
        assert got[k]["n_tokens"] == total


def arrow(df):
    return df.toArrow()


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), toxicity.learnable())
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "ngram_join", "decontaminate", "bpe"]
    folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/stages"

    def after(name, df):
        stages[name](spark, df, SF).write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    clean = after("toxicity", docs)
    keep = {r["doc_id"] for r in docs.collect() if model is None or model.score(*model.passages(r["text"] and r["text"].encode()))[0] < 0.3}
    assert {r["doc_id"] for r in clean.collect()} == keep and 0 < len(keep) < docs.count()

    thin = after("line_dedup", clean)
    con = duckdb.connect()
    con.register("documents", arrow(clean))
    want = {r[0]: r[1] for r in con.sql(f"SELECT doc_id, text_sha256 FROM ({linededup.ORACLE})").fetchall()}
    assert {r["doc_id"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in thin.collect()} == want
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in thin.collect())

    single = after("ngram_join", thin)
    con.register("documents", arrow(thin))
    classes = con.sql(f"SELECT doc_id, class_id FROM ({ngramjoin.ORACLE})").fetchall()
    whole = {r["doc_id"]: r["text"] for r in thin.collect()}
    assert {r["doc_id"] for r in single.collect()} == {k for k, c in classes if k == c or not words((whole[k] or "").encode())}

    cut = after("decontaminate", single)
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        item = words((r["text"] or "").encode())
        size = min(10, len(item))
        windows |= {tuple(item[k : k + size]) for k in range(len(item) - size + 1) if size}

    def without(text):
        if not text:
            return text
        raw = text.encode()
        spots = [m.span() for m in re.finditer(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw.lower())]
        found, hit = [raw[a:b].lower() for a, b in spots], set()
        for size in {len(w) for w in windows}:
            for k in range(len(found) - size + 1):
                if tuple(found[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
        out, at = b"", 0
        for k, (a, b) in enumerate(spots):
            if k in hit:
                out += raw[at:a] if k - 1 not in hit else b""
                at = b
        return (out + raw[at:]).decode()

    before = {r["doc_id"]: r["text"] for r in single.collect()}
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {k: without(t) for k, t in before.items()}
    assert any(without(t) != t for t in before.values())

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    left = {r["doc_id"]: r["text"] for r in cut.collect()}
    want = {k: hashlib.sha256(np.array(library.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes()).hexdigest() for k, t in left.items()}
    assert {r["doc_id"]: r["ids_sha256"] for r in after("bpe", cut).collect()} == want
    assert {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, SF).collect()} == want


ODD = "`id.x` string, `te.xt` string, `la.ng` string, `a.b` int, N_Words string, __id string, __key int, __k string, Score string, Votes int, KEPT int, Secrets string, Hit_Spans string, N_Removed int, Class_ID string, __class string, __later int, __gone int, __path string, __words string"
PASSAGE = "\n".join(" ".join(f"p{k}x{j}" for j in range(20)) + "." for k in range(4))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [("b-2", f"own start here.\n{PASSAGE}\nend two"), ("a-1", f"another one.\n{PASSAGE}\nand its end"), (None, None), ("", ""), ("c", "short text"), ("d", "short text"), ("e", "password=hunter2hunter2")]
    return spark.createDataFrame([(i, t, "en", 7, *(["MINE", "MINE", 1, "MINE", "MINE", 1, 1, "MINE", "MINE", 1, "MINE", "MINE", 1, 1, "MINE", "MINE"])) for i, t in rows], ODD)


def test_columns_of_any_name_and_ids_of_any_type(spark, odd):
    labels = spark.createDataFrame([("b-2", 0), ("e", 1)], "`id.x` string, toxic int")
    bench = spark.createDataFrame([("i", " ".join(f"p1x{j}" for j in range(12)))], "`it.em` string, `te.xt` string")
    given = {"text": "te.xt"}
    made = {
        "lines": linededup.dedup_lines(odd, row_id="id.x", **given), "spans": spandedup.dedup_spans(odd, row_id="id.x", **given), "thin": ngramjoin.drop_near_duplicates(odd, row_id="id.x", **given),
        "quality": quality.judge(odd, **given), "language": language.identify(odd, language.fit(odd, F.lit(True), lang="la.ng", row_id="id.x", **given), **given),
        "bpe": bpe.encode_documents(odd, public_tokenizers.path("word_bpe_49k.json"), **given), "tokens": tokencount.count_tokens(odd, public_tokenizers.path("piece_bpe_32k.model"), **given),
        "secrets": secrets.scan(odd, [0.7], path="a.b", **given), "bench": decontaminate.decontaminate(odd, bench, item_id="it.em", item_text="te.xt", **given), "cut": decontaminate.decontaminate(odd, bench, item_id="it.em", item_text="te.xt", cut=True, **given),
        "toxic": toxicity.score(odd, toxicity.fit(odd, labels, F.lit(True), row_id="id.x", **given), **given), "kept": toxicity.reject(odd, None, **given),
    }
    rows = {}
    for name, df in made.items():
        low = [c.lower() for c in df.columns]
        assert len(set(low)) == len(low), name
        rows[name] = df.collect()
        assert len(rows[name]) == 7 - 2 * (name == "thin"), name
        for r in rows[name]:
            assert r["a.b"] == 7 and r["__id"] == "MINE" and r["__key"] == 1 and r["__k"] == "MINE" and r["__words"] == "MINE", name
    text = lambda name: {r["id.x"]: r["te.xt"] for r in rows[name]}
    for name in ("lines", "spans"):
        assert PASSAGE in text(name)["a-1"] and "p1x1" not in text(name)["b-2"] and text(name)["b-2"].startswith("own start here") and text(name)[None] is None
    assert set(text("thin")) == {"a-1", None, "", "c", "e"}
    assert "p1x5" not in text("cut")["a-1"] and "p2x5" in text("cut")["a-1"] and next(r for r in rows["bench"] if r["id.x"] == "a-1")["hit_items"] == ["i"]
    assert next(r for r in rows["secrets"] if r["id.x"] == "e")["secrets"][0]["value"] == "hunter2hunter2"
    classes = {r["id.x"]: (r["class_id"], r["n_links"]) for r in ngramjoin.near_duplicates(odd, row_id="id.x", **given).collect()}
    assert classes["d"] == classes["c"] == ("c", 1) and classes[None] == (None, 0)


def test_dropping_keeps_one_of_each_class_of_links(spark):
    import random

    rng = random.Random(9)
    rows, text = [], []
    for group in range(12):  # chains, whose ends are not alike, and stars around their first text
        base = [f"g{group}w{rng.randint(0, 999)}" for _ in range(250)]
        last = base
        for _ in range(rng.randint(1, 25)):
            last = list(last if group % 2 else base)
            for _ in range(rng.randint(0, 5)):
                last[rng.randrange(250)] = f"x{rng.randint(0, 9999)}"
            text.append(" ".join(last))
    rng.shuffle(text)
    rows = list(enumerate(text))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    classes = {r["doc_id"]: r["class_id"] for r in ngramjoin.near_duplicates(df).collect()}
    assert {r["doc_id"] for r in ngramjoin.drop_near_duplicates(df).collect()} == {k for k, c in classes.items() if k == c}
    assert 12 <= len(set(classes.values())) < len(rows) / 2


def test_one_id_with_two_texts(spark):
    same = " ".join(f"s{k}" for k in range(60))
    rows = [(1, same), (1, same + " t"), (1, same), (2, same)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r["text"] for r in ngramjoin.drop_near_duplicates(df).collect()]
    assert got == [min((same, same + " t"), key=lambda t: hashlib.md5(t.encode()).digest())]
    lines = spark.createDataFrame([(1, f"{same}\nx"), (1, f"{same}\ny"), (1, f"{same}\nx")], "doc_id long, text string")
    kept = sorted(r["text"] for r in linededup.dedup_lines(lines).collect())
    assert kept in ([f"{same}\nx", f"{same}\nx", "y"], ["x", "x", f"{same}\ny"])


def test_later_runs_are_told_with_their_first_match(spark):
    lines = [" ".join(f"l{k}w{j}" for j in range(20)) for k in range(8)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["own", "", *lines[2:7], "", "more"])), (3, "\n".join(lines[:3] + ["other"] + lines[3:6]))]
    got = linededup.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["id"], r["start"], r["stop"], r["first_id"], r["first_start"]) for r in got) == [(2, 3, 7, 1, 3), (3, 1, 3, 1, 1), (3, 5, 7, 1, 4)]


def test_very_long_texts(spark):
    n = 200_000
    body = "\n".join(" ".join(f"w{(k * 31 + j * 7) % 5003}" for j in range(10)) + "." for k in range(n // 10))
    df = spark.createDataFrame([(1, body), (2, body + " changed"), (3, "x" * 1_000_000), (4, "y " * 500_000)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in ngramjoin.near_duplicates(df).collect()}
    assert rows[2]["class_id"] == 1 and rows[1]["n_linked_texts"] == 1 and rows[3]["n_links"] == rows[4]["n_links"] == 0
    counted = {r["doc_id"]: r["n_words"] for r in quality.judge(df).collect()}
    assert counted == {1: n, 2: n + 1, 3: 1, 4: 500_000}
    bench = spark.createDataFrame([(1, body[-200:]), (2, "y " * 12)], "item_id long, text string")
    hit = {r["doc_id"]: r["hit_items"] for r in decontaminate.decontaminate(df, bench).collect()}
    assert hit[1] == hit[2] == ["1"] and hit[3] == [] and hit[4] == ["2"]
    assert {r["doc_id"]: r["n_tokens"] > 0 for r in bpe.encode_documents(df, public_tokenizers.path("word_bpe_49k.json"), ids=False).collect()} == dict.fromkeys(range(1, 5), True)
    spans = {r["doc_id"]: r["n_removed"] / r["n_sentences"] for r in spandedup.dedup_spans(df).collect()}
    assert spans[2] > 0.99 and spans[3] == 0 and spans[4] > 0.99
    assert {r["doc_id"]: r["n_candidates"] for r in secrets.scan(df, secrets.train(findings.findings_by_rule(spark, 300)), path=None).collect()}.keys() == {1, 2, 3, 4}
    model = toxicity.fit(df, spark.createDataFrame([(1, 0), (4, 1)], "doc_id long, toxic int"), F.lit(True))
    assert toxicity.score(df, model).count() == 4 and tokencount.count_tokens(df, public_tokenizers.path("piece_bpe_32k.model")).count() == 4
    shorter = spark.createDataFrame([(1, body[: len(body) // 10]), (2, body[: len(body) // 10])], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] > 0 for r in linededup.dedup_lines(shorter).collect()}[2]
