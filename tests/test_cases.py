"""The tables of cases and recipes give the rows that are written out for them."""

import duckdb
import pytest

from corpusmill.functions import markup, tokens
from corpusmill.plans import cases, catalogue, recipes


def rows(df, names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", list(cases.QUERIES))
def test_cases(spark, name):
    query, sql = cases.QUERIES[name]
    got, want = query(spark, ""), duckdb.sql(sql)
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert rows(got, names) == sorted(want.select(*names).fetchall(), key=str)


def test_recipes_keep_what_matters_and_their_budgets(spark):
    got = recipes.checks(spark, "").collect()
    assert len(got) == 29 and all(r["fits"] for r in got)
    assert {(r["name"], r["what"]): r["present"] for r in got} == {(n, s): k for n, r in recipes.RECIPES.items() for k, part in ((True, r[3]), (False, r[4])) for s in part}
    saved = {r["name"]: r["reduction_percent"] for r in recipes.reductions(spark, "").collect()}
    assert all(saved[n] > least for n, least in (("page", 90), ("failed run", 95), ("providers", 99), ("stack dump", 93), ("article", 70)))


@pytest.mark.parametrize("name", ["biggest_noise_sources", "compression_metrics", "removed_section_summary", "redact_secrets", "collapse_repeated_lines_documents", "install_noise_aggressive"])
def test_sql_gives_the_same(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = catalogue.QUERIES[name](spark, sf), con.sql(catalogue.ORACLES[name])
    names = sorted(got.columns)
    assert rows(got, names) == sorted(want.select(*names).fetchall(), key=str)


def test_packing_equals_a_plain_version():
    import random

    def prefix(text, most):
        out = ""
        for part in tokens.chunks(text):
            if tokens.count(out + part) > most:
                break
            out += part
        if most and not out.strip():
            return "" if "```" in tokens.chunks(text)[0] else tokens.hard_prefix(text, most)
        return out if most else ""

    def plain(text, most):
        total = tokens.count(text)
        if total <= most or not most:
            return (text, 0, False) if total <= most else ("", total, True)
        for budget in range(most, -1, -1):
            kept = prefix(text, budget).rstrip()
            gone = total - tokens.count(kept)
            foot = f"[Context Truncated: Removed {gone} tokens to fit {most}-token budget]"
            foot = foot if tokens.count(foot) <= most else "[Context Truncated]"
            out = f"{kept}\n\n{foot}" if kept else foot
            if tokens.count(out) <= most:
                return out, gone, True
        return tokens.hard_prefix("[Context Truncated]", most), total, True

    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice(["word ", "\n", "\n\n", "```\n", "A sentence here. ", "  ", "é🙂", "x" * 30]) for _ in range(rng.randint(1, 60)))
        for most in (1, 5, 12, 20, 40, 90):
            assert tokens.pack(text, most) == plain(text, most)


def test_token_counts_equal_another_library():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice(["word ", "\n", "it's", " 1234", "  ", "é", "🙂", "<|endoftext|>", "zz.", "\t", "中文"]) for _ in range(rng.randint(0, 40)))
        assert tokens.count(text) == len(other.encode(text, add_special_tokens=False).ids)


def test_paths_are_judged_alike_by_both_forms():
    from corpusmill.sources import files

    for path, generated, sensitive in cases.PATHS:
        assert files.skipped_as(path) == ("generated" if generated else "sensitive" if sensitive else None)


def test_deep_pages_and_marks_of_the_page_itself():
    deep = "<div>" * 20_000 + "<nav>hidden</nav>shown" + "</div>" * 20_000
    assert markup.markdown(deep) == "shown"
    assert markup.markdown("<p>0 <code>x</code> </p>") == "0 `x` "
