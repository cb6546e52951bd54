"""Small documents through the cleaning passes."""

from pyspark.sql import functions as F

from corpusmill.functions import markup, tokens
from corpusmill.functions import text as X
from corpusmill.operators import passes as O


def through(spark, text, step):
    df = O.closed(step(O.with_accounts(spark.createDataFrame([(1, text)], "id int, content string"))))
    return df.first()


def test_repeats_become_one_line_with_times(spark):
    text = "2026-07-04T10:00:01Z warn Timeout\n2026-07-04T10:00:02Z warn Timeout\n2026-07-04T10:00:03Z warn Timeout\nother"
    got = through(spark, text, O.collapse_repeats)
    assert got["content"] == "[Repeated 3 times from 2026-07-04T10:00:01Z to 2026-07-04T10:00:03Z] Timeout\nother"
    assert [(s["kind"], s["count"]) for s in got["removed_sections"]] == [("duplicate_line", 1)]


def test_blank_lines_never_merge(spark):
    assert through(spark, "\n\n\na\na", O.collapse_repeats)["content"] == "\n\n\n[Repeated 2 times] a"


def test_frames_at_distinct_places_stay(spark):
    text = "at f (a.js:10:1)\nat f (a.js:20:1)\nat f (a.js:10:1)"
    assert through(spark, text, O.collapse_frames)["content"] == "at f (a.js:10:1)\nat f (a.js:20:1)\n[Collapsed stack frames: 1 duplicate frames removed]"


def test_install_noise_with_prefixes(spark):
    text = "2026-07-04T10:00:01Z [build] INFO added 5 packages in 2s\nfound 0 vulnerabilities\nerror: added 5 packages failed"
    assert through(spark, text, O.remove_install_noise)["content"] == "error: added 5 packages failed"


def test_boilerplate_lines(spark):
    got = through(spark, "Cookie preferences\nKeep this\nNewsletter signup\nwarning: advertisement", O.drop_boilerplate)
    assert got["content"] == "Keep this\nwarning: advertisement"
    assert got["noise_sources"][0]["label"] == "boilerplate lines"


def test_redaction(spark):
    got = through(spark, "https://x.org/?X-Amz-Signature=abcdef123456&safe=1 password: hunter2hunter2", O.redact)
    assert got["content"].count("[REDACTED_SECRET]") == 2 and "safe=1" in got["content"]
    assert got["warnings"][0]["code"] == "secrets_redacted"


def test_executed_blocks_and_entities(spark):
    got = through(spark, "a<script>x</script>b<STYLE>y</STYLE>", O.remove_executed)
    assert got["content"] == "a\nb\n"
    assert spark.range(1).select(X.decode_entities(F.lit("&amp;lt;&nbsp;"))).first()[0] == "< "


def test_no_text_survives(spark):
    for step in (O.collapse_repeats, O.collapse_frames, O.remove_install_noise, O.drop_boilerplate, O.redact, O.remove_executed):
        assert through(spark, "", step)["content"] == ""


def test_nested_noise_block_goes_once():
    text, gone = markup.noise_blocks('<p>a</p><div class="cookie-consent"><div>x</div><button>ok</button></div><p>b</p>')
    assert text == "<p>a</p>\n<p>b</p>" and [g[2] for g in gone] == [1]


def test_class_that_only_looks_like_noise_stays():
    assert "leads" in markup.markdown('<div class="leads uploads roads">leads</div>')


def test_malformed_lists_and_tables():
    got = markup.markdown("<ul><li>one<li>two</ul><table><tr><th>Mode<th>Keeps<tr><td>a<td>b</table><p>x <code>a < b</code>")
    assert "- one" in got and "- two" in got and "| Mode | Keeps |\n| --- | --- |\n| a | b |" in got and "`a < b`" in got


def test_packing_keeps_the_budget():
    text = "First part here.\n\n" + "word " * 300 + "\n\nlast"
    for most in (0, 3, 12, 40, 120):
        out, removed, applied = tokens.pack(text, most)
        assert applied and tokens.count(out) <= most
    assert tokens.pack("short", 50) == ("short", 0, False)
