"""The command line, the service, the command runner, the Python calls and the stream."""

import io
import json
import sys

import pytest

from corpusmill import api, cli, runner, service
from corpusmill.operators import clean as C
from corpusmill.streaming import clean as S

PAGE = "<html><body><nav>Home</nav><h1>Title</h1><p>Kept words.</p><script>x()</script></body></html>"
LOG = "added 5 packages in 2s\nwarn slow\nwarn slow\nFAIL login.test.ts\n"


@pytest.fixture
def page(spark, tmp_path):
    path = tmp_path / "page.html"
    path.write_text(PAGE)
    return path


def test_options_are_checked():
    for given in ({"mode": "hard"}, {"format": "xml"}, {"fit": "none"}, {"max_tokens": -1}, {"fit": "claude-sonnet", "max_tokens": 1_000_001}):
        with pytest.raises(ValueError, match="."):
            C.CleanOptions(**given)
    assert C.CleanOptions(fit="gpt-4.1").limit == 1_047_576 and C.CleanOptions(fit="gpt-4.1", max_tokens=9).limit_source == "fit_and_max_tokens"


def test_python_calls(spark, page, tmp_path):
    assert "# Title\n\nKept words." in api.clean_text(PAGE) and "Home" not in api.clean_text(PAGE, output_format="text")
    parsed = api.clean_file(page, output_format="json")
    assert parsed["source"] == str(page) and api.output_text(parsed) == "# Title\n\nKept words."
    with pytest.raises(ValueError, match="output.content"):
        api.output_text({"output": None})
    (tmp_path / "ci.log").write_text(LOG)
    assert "[Repeated 2 times] slow\nFAIL" in api.clean_actions_log(tmp_path / "ci.log")
    assert api.report(page)["recommended_command"] == f"corpusmill {page} --format markdown"
    assert api.text_for_retrieval(page).startswith("# Cleaned Context")
    record = api.record_for_retrieval(page)
    assert record["text"] == "# Title\n\nKept words." and record["metadata"]["source"] == str(page) and record["metadata"]["tokens_saved"] > 0


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, 2, "x" * 3, PAGE), (2, 3, "yy", None)], "`a.b` int, `c d` int, content string, `te.xt` string")
    got = {r["a.b"]: r for r in api.passages(C.clean(docs, C.CleanOptions(max_tokens=100), text="te.xt", source="c d")).collect()}
    assert got[1]["text"] == "# Title\n\nKept words." and got[1]["c d"] == 2 and got[1]["metadata"]["source"] == "2" and got[2]["text"] == ""


def test_command_line(spark, page, tmp_path, capsys):
    out = tmp_path / "out.md"
    assert cli.main([str(page), "-o", str(out), "--verbose"]) == 0
    said = capsys.readouterr()
    assert "Kept words." in out.read_text() and "wrote cleaned output" in said.err and "input_tokens" in said.err
    assert cli.main([str(page), "-o", str(out)]) == 2 and "already exists" in capsys.readouterr().err
    assert cli.main([str(page), "-o", str(out), "--dry-run", "-f", "text", "--no-redact-secrets"]) == 0
    said = capsys.readouterr()
    assert "format: Text" in said.out and "dry run" in said.err and "redaction disabled" in said.err
    assert cli.main(["report", str(page), "--force", "-q", "-o", str(out)]) == 0 and out.read_text().startswith("# Context Report") and not capsys.readouterr().err
    (tmp_path / "ci.log").write_text(LOG)
    assert cli.main(["gha", str(tmp_path / "ci.log"), "-t", "60"]) == 0 and "added 5" not in capsys.readouterr().out
    assert cli.main(["repo", str(tmp_path)]) == 0 and "## File: page.html" in capsys.readouterr().out


@pytest.mark.parametrize(
    ("given", "code"),
    [
        (["/nowhere/at/all"], 2), (["x", "-q", "-v"], 2), (["x", "--redact-secrets", "--no-redact-secrets"], 2), (["x", "-t", "4"], 2), (["x", "-t", "0"], 2), (["x", "-t", "many"], 2),
        (["x", "--fit", "claude-sonnet", "-t", "1000001"], 2), (["x", "--mode", "hard"], 2), (["report"], 2), (["--help"], 0),
    ],
)
def test_exit_codes(given, code, capsys):
    assert cli.main(given) == code


def test_unreadable_input_ends_with_three(tmp_path, capsys):
    (tmp_path / "b.bin").write_bytes(b"\0")
    assert cli.main([str(tmp_path / "b.bin")]) == 3


def test_piped_input(spark, monkeypatch, capsys):
    class Piped:
        buffer = io.BytesIO(PAGE.encode())

        def isatty(self):
            return False

    monkeypatch.setattr(sys, "stdin", Piped())
    assert cli.main([]) == 0 and "# Title" in capsys.readouterr().out


def ask(*requests):
    out = io.StringIO()
    service.serve(io.StringIO("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in requests)), out)
    return [json.loads(x) for x in out.getvalue().splitlines()]


def test_service(spark, page):
    call = lambda i, name, **given: {"jsonrpc": "2.0", "id": i, "method": "tools/call", "params": {"name": name, "arguments": given}}
    got = ask(
        {"id": 1, "method": "initialize"}, "", {"method": "notified"}, {"id": 2, "method": "ping"}, {"id": 3, "method": "tools/list"}, "{no json", {"id": 4}, {"id": 5, "method": "else"},
        call(6, "corpusmill_clean", text=PAGE, format="text"), call(7, "corpusmill_clean", path=str(page), output="x", format="json", max_tokens=3), call(8, "corpusmill_report", input=PAGE, sourceName="given", format="json"),
        call(9, "corpusmill_clean", text="a", path="b"), call(10, "corpusmill_clean", path="-"), call(11, "corpusmill_clean", text="a", mode="hard"), call(12, "nothing"), call(13, "corpusmill_clean", path="/nowhere"),
        {"id": 14, "method": "shutdown"}, {"id": 15, "method": "ping"},
    )
    by = {r["id"]: r for r in got}
    assert set(by) == {None, *range(1, 15)}
    assert by[1]["result"]["protocolVersion"] and by[2]["result"] == {} and len(by[3]["result"]["tools"]) == 2 and by[14]["result"] is None
    assert [by[k]["error"]["code"] for k in (None, 4, 5, 9, 10, 11, 12, 13)] == [-32700, -32600, -32601] + [-32602] * 5
    text = lambda k: by[k]["result"]["content"][0]["text"]
    assert text(6).startswith("# Title\n\nKept words.\n\n---") and json.loads(text(7))["truncation"]["applied"]
    assert json.loads(text(8))["source"] == "given"


def test_command_runner(spark, capfd):
    ok = [sys.executable, "-c", "import sys; print('added 5 packages'); print('e', file=sys.stderr)"]
    assert runner.main(["--", *ok]) == 0
    said = capfd.readouterr()
    assert said.out == "added 5 packages\n" and said.err == "e\n"
    bad = [sys.executable, "-c", "import sys; print('found 0 vulnerabilities'); print('boom ' * 50, file=sys.stderr); sys.exit(7)"]
    assert runner.main(["--capture-limit-bytes", "40", "-v", "--", *bad]) == 7
    said = capfd.readouterr()
    assert "## stderr" in said.out and "stderr truncated after 40 bytes" in said.out and "\nfound 0" not in said.out and "exit code 7" in said.err and "stderr_truncated=true" in said.err
    assert runner.main(["--timeout-seconds", "1", "-q", sys.executable, "-c", "import time; time.sleep(60)"]) == 124
    assert "timed out after 1 second(s)" in capfd.readouterr().out
    assert runner.main(["/no/such/command"]) == 127 and runner.main([]) == 2 and runner.main(["-q", "-v", "true"]) == 2
    assert runner.main(["--capture-limit-bytes", "0", "true"]) == 2


def test_a_stream_gives_what_a_table_gives(spark, tmp_path):
    docs = spark.createDataFrame([(1, PAGE), (2, LOG), (3, None)], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    options = C.CleanOptions(mode="aggressive", max_tokens=50)
    query = S.write(S.clean(S.read(spark, str(tmp_path / "in"), 1), options), str(tmp_path / "out"), str(tmp_path / "state"))
    assert query.awaitTermination(120)
    pick = lambda df: {r["doc_id"]: r["result"]["output"]["content"] for r in df.collect()}
    assert pick(spark.read.parquet(str(tmp_path / "out"))) == pick(C.clean(docs, options))
    with pytest.raises(ValueError, match="stream"):
        S.clean(docs)
