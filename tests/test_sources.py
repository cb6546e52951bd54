"""Sources over small trees of files."""

import io

import pytest

from corpusmill import errors
from corpusmill.functions import patterns as P
from corpusmill.sources import corpus, files
from corpusmill.sources.ignore import IgnoreRules


def put(root, names):
    for name, text in names.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return root


@pytest.fixture
def project(tmp_path):
    return tmp_path / "project"


def test_a_directory_is_one_document_in_path_order(project):
    put(project, {"b.txt": "second", "a/z.txt": "first", "a.txt": "between", ".hidden/x.txt": "hidden too", "node_modules/m.js": "no", "sub/target/t.txt": "no"})
    name, text, notes = files.read_directory(project)
    assert name == str(project) and notes == []
    assert text == "\n\n## File: .hidden/x.txt\n\nhidden too\n\n## File: a/z.txt\n\nfirst\n\n## File: a.txt\n\nbetween\n\n## File: b.txt\n\nsecond"


def test_what_is_left_out_is_told(project):
    put(project, {".env.local": "A=1", "id_rsa.pub": "k", "keys/a.PEM": "k", ".ssh/config": "h", "big.txt": b"x" * (P.MAX_FILE_BYTES + 1), "bin.dat": b"a\0b", "latin.txt": "é".encode("latin-1"), "ok.txt": "fine"})
    _, text, notes = files.read_directory(project)
    assert text == "\n\n## File: ok.txt\n\nfine"
    assert sorted((c, m.rpartition(": ")[2]) for c, m, _ in notes) == [
        ("binary_file_skipped", "bin.dat"), ("non_utf8_file_skipped", "latin.txt"), ("oversized_file_skipped", "big.txt"),
        ("sensitive_path_skipped", ".env.local"), ("sensitive_path_skipped", ".ssh/config"), ("sensitive_path_skipped", "id_rsa.pub"), ("sensitive_path_skipped", "keys/a.PEM"),
    ]
    _, text, notes = files.read_directory(project, include_sensitive=True)
    assert "## File: .env.local" in text and not any(c == "sensitive_path_skipped" for c, *_ in notes)


def test_the_directory_limit(project):
    put(project, {f"f{k}.txt": b"y" * 950_000 for k in range(5)} | {"g.txt": "small ones still fit"})
    _, text, notes = files.read_directory(project)
    assert len(text.encode()) <= P.MAX_DIRECTORY_BYTES and "small ones" in text and "f4.txt" not in text
    assert [c for c, *_ in notes] == ["directory_byte_limit_reached"]


def test_the_rest_is_left_out_with_one_warning(project, monkeypatch):
    monkeypatch.setattr(P, "MAX_DIRECTORY_BYTES", 40)
    put(project, {"a.txt": "x" * (40 - len("\n\n## File: a.txt\n\n")), "b.txt": "1", "c.txt": "2"})
    _, text, notes = files.read_directory(project)
    assert len(text) == 40 and [c for c, *_ in notes] == ["directory_byte_limit_reached"] and "remaining" in notes[0][1]


def test_ignore_files_with_negation(project):
    put(project, {".gitignore": "*.log\n!keep.log\n/top.txt\nout/\n# note\n", "a.log": "1", "keep.log": "2", "top.txt": "3", "sub/top.txt": "4", "out/x.txt": "5", "sub/out": "6", "sub/.gitignore": "!a.log\nonly.txt", "sub/a.log": "7", "sub/only.txt": "8", "only.txt": "9", ".corpusmillignore": "drop.md\n!top.txt", "drop.md": "0"})
    _, text, _ = files.read_directory(project)
    assert [x for x in text.split("\n") if x.startswith("## ")] == [f"## File: {n}" for n in ("keep.log", "only.txt", "sub/a.log", "sub/out", "sub/top.txt", "top.txt")]


@pytest.mark.parametrize(
    ("rule", "hit", "miss"),
    [
        ("*.py", ["a.py", "x/y/a.py"], ["a.pyc"]), ("/a", ["a"], ["x/a"]), ("x/*.c", ["x/a.c"], ["x/y/a.c", "z/x/a.c"]), ("**/t", ["t", "a/b/t"], ["ta"]),
        ("a/**", ["a/b", "a/b/c"], ["a", "ba/b"]), ("a/**/z", ["a/z", "a/b/c/z"], ["a/zz"]), ("[ab]?", ["ax", "by"], ["cx", "a"]), ("[!a]1", ["b1"], ["a1"]), ("\\#x", ["#x"], ["x"]), ("e ", ["e"], ["e "]),
    ],
)
def test_patterns_of_ignore_files(rule, hit, miss):
    rules = IgnoreRules([("", ".gitignore", rule)])
    assert all(map(rules.ignored, hit)) and not any(map(rules.ignored, miss))


def test_rules_above_the_root_hold_too():
    rules = IgnoreRules([("..", ".gitignore", "docs/*.tmp\n*.bak"), ("../..", ".gitignore", "/home/docs/x")], above=("home", "docs"))
    assert all(map(rules.ignored, ("a.bak", "sub/a.bak", "a.tmp", "x"))) and not any(map(rules.ignored, ("sub/a.tmp", "y", "sub/x")))


def test_inputs_that_are_refused(project, monkeypatch):
    put(project, {"empty.txt": "", ".env": "A=1", "n.bin": b"\0", "l.txt": b"\xff", "big.txt": b"x" * (P.MAX_FILE_BYTES + 1), "node_modules/x.js": "x", ".ssh/known": "x", "none/image.png": b"\0"})
    cases = {"missing": errors.InputNotFound, ".env": errors.ReadInput, "n.bin": errors.ReadInput, "l.txt": errors.ReadInput, "big.txt": errors.ReadInput, "node_modules": errors.ReadInput, ".ssh": errors.ReadInput, "none": errors.ReadInput}
    for name, kind in cases.items():
        with pytest.raises(kind) as e:
            files.read_input(project / name)
        assert e.value.exit_code == (2 if kind is errors.InputNotFound else 3), name
    assert files.read_input(project / ".env", include_sensitive=True)[1] == "A=1" and files.read_input(project / "empty.txt")[1] == ""


def test_standard_input():
    assert files.read_stdin(io.BytesIO("é\n".encode())) == ("stdin", "é\n", [])
    for raw, kind in ((b" \n", errors.MissingInput), (b"\xff", errors.ReadInput), (b"x" * (P.MAX_DIRECTORY_BYTES + 1), errors.ReadInput)):
        with pytest.raises(kind):
            files.read_stdin(io.BytesIO(raw))


def test_a_tree_as_rows(spark, project):
    put(project, {"a+b (1)/x.txt": "text", "a+b (1)/y.bin": b"\0", "z.txt": b"\xff", "dist/d.txt": "no", "k.pem": "no", "big.txt": b"x" * (P.MAX_FILE_BYTES + 1)})
    got = {r["rel_path"]: (r["code"], r["content"] and bytes(r["content"])) for r in files.scan(spark, str(project)).collect()}
    assert got == {"a+b (1)/x.txt": (None, b"text"), "a+b (1)/y.bin": ("binary_file_skipped", b"\0"), "z.txt": ("non_utf8_file_skipped", b"\xff"), "k.pem": ("sensitive_path_skipped", None), "big.txt": ("oversized_file_skipped", None)}
    assert files.scan(spark, f"file://{project}", include_sensitive=True).filter("rel_path = 'k.pem' AND code IS NULL").count() == 1


def test_outputs_are_not_replaced_unasked(spark, tmp_path):
    out = tmp_path / "o.md"
    files.write_text("one", out)
    with pytest.raises(errors.OutputExists):
        files.write_text("two", out)
    files.write_text("two", out, force=True)
    assert out.read_text() == "two"
    with pytest.raises(errors.WriteOutput):
        files.write_text("x", tmp_path / "no" / "o.md")
    df = spark.range(2)
    files.write(df, str(tmp_path / "t"))
    with pytest.raises(Exception, match="(?i)exists"):
        files.write(df, str(tmp_path / "t"))
    files.write(df.limit(1), str(tmp_path / "t"), force=True)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_corpora_in_every_format(spark, tmp_path):
    rows = [(1, 'two\nlines, "quoted"'), (2, "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for fmt in ("parquet", "json", "csv"):
        out = str(tmp_path / fmt)
        df.coalesce(1).write.format(fmt).options(**({"header": "true", "escape": '"', "quoteAll": "true"} if fmt == "csv" else {})).save(out)
        got = corpus.read(spark, out, fmt, schema="doc_id long, text string")
        assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == rows, fmt
        with pytest.raises(ValueError, match="no column"):
            corpus.read(spark, out, fmt, text="body")
    put(tmp_path / "files", {"a.txt": "one\ntwo", "sub/b.txt": "three"})
    got = {r["source"].rpartition("/")[2]: r["text"] for r in corpus.read(spark, str(tmp_path / "files"), "text").collect()}
    assert got == {"a.txt": "one\ntwo", "b.txt": "three"}
    with pytest.raises(ValueError, match="fmt"):
        corpus.read(spark, "x", "xml")
