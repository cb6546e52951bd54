"""Registered queries of the cleaning operators, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import patterns as P
from corpusmill.functions import text as X
from corpusmill.operators import clean as C
from corpusmill.operators import passes as O
from corpusmill.operators import render as R
from corpusmill.plans import cases, recipes

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark, sf_dir) -> DataFrame:
    return O.with_accounts(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("content")))


def pages(spark, sf_dir) -> DataFrame:
    return O.with_accounts(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.coalesce("html", F.lit("")).alias("content")))


def logs(spark, sf_dir) -> DataFrame:
    """A log for each user, made of events, with lines of tools and stack frames between them."""
    e = table(spark, sf_dir, "events")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    odd = F.col("event_id") % 11
    line = (
        F.when(odd == 0, F.lit("added 12 packages in 3s"))
        .when(odd == 1, F.concat(F.lit("    at Worker.run(src/worker.js:"), (F.col("event_id") % 3).cast("string"), F.lit(":7)")))
        .when(odd == 2, F.lit("  // remember to look here"))
        .when(odd == 3, F.lit("=========="))
        .when(odd == 4, F.lit("    at Worker.run(src/worker.js:1:7)"))
        .otherwise(F.concat(stamp, F.lit(" warn "), F.col("event_type")))
    )
    rows = e.select("user_id", F.struct("ts", "event_id", line.alias("line")).alias("r"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n")
    return O.with_accounts(rows.groupBy(F.col("user_id").alias("id")).agg(text.alias("content")))


LOGS = """logs AS (
  SELECT user_id AS id, string_agg(line, chr(10) ORDER BY ts, event_id) AS content FROM (
    SELECT user_id, ts, event_id, CASE event_id % 11 WHEN 0 THEN 'added 12 packages in 3s'
      WHEN 1 THEN '    at Worker.run(src/worker.js:' || CAST(event_id % 3 AS VARCHAR) || ':7)' WHEN 2 THEN '  // remember to look here'
      WHEN 3 THEN '==========' WHEN 4 THEN '    at Worker.run(src/worker.js:1:7)'
      ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' warn ' || event_type END AS line FROM events) GROUP BY user_id)"""
DOCS = "docs AS (SELECT doc_id AS id, coalesce(text, '') AS content FROM documents)"
PAGES = "docs AS (SELECT page_id AS id, coalesce(html, '') AS content FROM pages)"


def entry(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def digest(df: DataFrame) -> DataFrame:
    """Id, what the last pass removed, and a digest of the text."""
    total = lambda f: F.aggregate("removed_sections", F.lit(0).cast("long"), lambda a, s: a + s[f])
    return O.closed(df).select("id", total("count").alias("n_removed"), total("tokens_removed").alias("tokens_removed"), F.md5("content").alias("md5"))


@entry("doc_stats", f"WITH {DOCS} SELECT id, CAST(octet_length(encode(content)) AS BIGINT) AS bytes, CAST(length(content) AS BIGINT) AS chars, CAST(ceil(length(content) / 4.0) AS BIGINT) AS estimated FROM docs")
def doc_stats(spark, sf_dir):
    return docs(spark, sf_dir).select("id", F.octet_length("content").cast("long").alias("bytes"), F.length("content").cast("long").alias("chars"), X.estimate(F.col("content")).alias("estimated"))


NORMAL = r"""regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace({c}, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0b-\x1f\x7f\x{{80}}-\x{{9f}}]', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '\n{{3,}}', chr(10) || chr(10), 'g')"""


@entry("normalize_text", f"WITH {DOCS} SELECT id, md5({NORMAL.format(c='content')}) AS md5 FROM docs")
def normalize_text(spark, sf_dir):
    return docs(spark, sf_dir).select("id", F.md5(X.normalized(F.col("content"))).alias("md5"))


@entry("normalize_pages", f"WITH {PAGES} SELECT id, md5({NORMAL.format(c='content')}) AS md5 FROM docs")
def normalize_pages(spark, sf_dir):
    return pages(spark, sf_dir).select("id", F.md5(X.normalized(F.col("content"))).alias("md5"))


def removal_sql(source: str, pattern: str) -> str:
    p = pattern.replace("'", "''")
    return (
        f"WITH {source}, hits AS (SELECT id, content, regexp_extract_all(content, '{p}') AS found FROM docs) "
        f"SELECT id, CAST(len(found) AS BIGINT) AS n_removed, CAST(coalesce(list_sum(list_transform(found, lambda x: CAST(ceil(length(x) / 4.0) AS BIGINT))), 0) AS BIGINT) AS tokens_removed, "
        f"md5(regexp_replace(content, '{p}', chr(10), 'g')) AS md5 FROM hits"
    )


def strip_query(tag: str):
    return lambda spark, sf_dir: digest(O.remove_pattern(pages(spark, sf_dir), P.block(tag), "html", tag))


for _tag in P.EXECUTED_TAGS + P.FURNITURE_TAGS:
    entry(f"strip_{_tag}", removal_sql(PAGES, P.block(_tag)))(strip_query(_tag))


@entry("strip_html_comments", removal_sql(PAGES, P.HTML_COMMENT))
def strip_html_comments(spark, sf_dir):
    return digest(O.remove_comments(pages(spark, sf_dir)))


def stripped(spark, sf_dir) -> DataFrame:
    return O.closed(O.remove_comments(O.remove_furniture(O.remove_executed(pages(spark, sf_dir)))))


def stripped_sql() -> str:
    """CTEs up to ``every``: kind, label, number and tokens of what each pass takes from a page; and ``left``, what is left."""
    steps, name, union = [PAGES], "docs", []
    kinds = [(t, P.block(t), "html_execution_block", f"HTML execution/style block: {t}") for t in P.EXECUTED_TAGS]
    kinds += [(t, P.block(t), "html_boilerplate", f"HTML boilerplate block: {t}") for t in P.FURNITURE_TAGS] + [("comments", P.HTML_COMMENT, "html_comment", "HTML comments")]
    for t, p, kind, label in kinds:
        steps.append(f"s_{t} AS (SELECT id, regexp_extract_all(content, '{p}') AS found, regexp_replace(content, '{p}', chr(10), 'g') AS content FROM {name})")
        union.append(f"SELECT '{kind}' AS kind, '{label}' AS label, len(found) AS n, list_sum(list_transform(found, lambda x: CAST(ceil(length(x) / 4.0) AS BIGINT))) AS t FROM s_{t}")
        name = f"s_{t}"
    return f"WITH {', '.join(steps)}, every AS ({' UNION ALL '.join(union)})"


def summary_sql() -> str:
    return stripped_sql() + " SELECT kind, CAST(sum(n) AS BIGINT) AS n_sections, CAST(coalesce(sum(t), 0) AS BIGINT) AS tokens_removed FROM every WHERE n > 0 GROUP BY kind"


@entry("removed_section_summary", summary_sql())
def removed_section_summary(spark, sf_dir):
    s = stripped(spark, sf_dir).select(F.explode_outer("removed_sections").alias("s")).filter("s.kind IS NOT NULL")
    return s.groupBy("s.kind").agg(F.sum("s.count").alias("n_sections"), F.sum("s.tokens_removed").alias("tokens_removed"))


NOISE_SQL = stripped_sql() + """ SELECT 'html_boilerplate' AS kind, label, CAST(sum(t) AS BIGINT) AS tokens_removed
FROM every WHERE n > 0 GROUP BY label ORDER BY 3 DESC, 2 LIMIT 5"""


@entry("biggest_noise_sources", NOISE_SQL)
def biggest_noise_sources(spark, sf_dir):
    s = stripped(spark, sf_dir).select(F.explode_outer("noise_sources").alias("s")).filter("s.kind IS NOT NULL").groupBy("s.kind", "s.label").agg(F.sum("s.tokens_removed").alias("tokens_removed"))
    return s.orderBy(F.desc("tokens_removed"), "label").limit(5)  # the report lists the five biggest


SPLIT = "l_{to} AS (SELECT id, generate_subscripts(string_split(regexp_replace(content, '\\n\\z', ''), chr(10)), 1) AS k, unnest(string_split(regexp_replace(content, '\\n\\z', ''), chr(10))) AS line FROM {name})"
TOKENS = "CAST(ceil(length(line) / 4.0) AS BIGINT)"


def lines_step(name: str, to: str, gone: str) -> str:
    """CTEs from texts ``name`` to ``to``: what is left of each, and lines and tokens that are gone."""
    return (
        f"{SPLIT.format(name=name, to=to)}, m_{to} AS (SELECT *, ({gone}) AS gone FROM l_{to}), "
        f"{to} AS (SELECT id, count(*) FILTER (gone) AS n, coalesce(sum({TOKENS}) FILTER (gone), 0) AS t, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '') AS content FROM m_{to} GROUP BY id)"
    )


def digest_sql(source: str, *steps: tuple[str, str]) -> str:
    """The rows of ``digest`` after steps, each a name and its CTEs."""
    names = [name for name, _ in steps]
    total = lambda f: f"CAST({' + '.join(f'{n}.{f}' for n in names)} AS BIGINT)"
    joined = names[0] + "".join(f" JOIN {n} USING (id)" for n in names[1:])
    return f"WITH {', '.join([source, *(s for _, s in steps)])} SELECT id, {total('n')} AS n_removed, {total('t')} AS tokens_removed, md5({names[-1]}.content) AS md5 FROM {joined}"


def lines_sql(source: str, name: str, gone: str) -> str:
    return digest_sql(source, ("a", lines_step(name, "a", gone)))


def boilerplate_sql(aggressive: bool) -> str:
    equal = P.BOILERPLATE_EQUAL + (P.AGGRESSIVE_EQUAL if aggressive else ())
    part = P.BOILERPLATE_PART + (P.AGGRESSIVE_PART if aggressive else ())
    t = r"regexp_replace(line, '^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$', '', 'g')"
    low = f"translate({t}, '{X.UPPER}', '{X.LOWER}')"
    has = lambda words: " OR ".join(f"contains({low}, '{w}')" for w in words)
    return f"{t} <> '' AND octet_length(encode({t})) <= 220 AND NOT ({has(P.WEB_SIGNALS)}) AND NOT (contains({t}, '<') AND contains({t}, '>') AND NOT (({has(('cookie', 'newsletter', 'advertisement'))}) AND NOT ({has(('<main', '<article'))}))) AND ({low} IN ({', '.join(repr(w) for w in equal)}) OR {has(part)})"


@entry("boilerplate_lines_standard", lines_sql(DOCS, "docs", boilerplate_sql(False)))
def boilerplate_standard(spark, sf_dir):
    return digest(O.drop_boilerplate(docs(spark, sf_dir)))


@entry("boilerplate_lines_aggressive", lines_sql(DOCS, "docs", boilerplate_sql(True)))
def boilerplate_aggressive(spark, sf_dir):
    return digest(O.drop_boilerplate(docs(spark, sf_dir), True))


@entry("strip_comment_lines", lines_sql(LOGS, "logs", r"regexp_matches(line, '^\s*(//|/\*|\*)')"))
def strip_comment_lines(spark, sf_dir):
    return digest(O.strip_code_comments(logs(spark, sf_dir)))


@entry("aggressive_noise_lines", lines_sql(LOGS, "logs", r"starts_with(trim(line), '[![') OR contains(line, 'shields.io') OR (length(trim(line)) > 8 AND regexp_matches(trim(line), '^[-=*_ #]+$'))"))
def aggressive_noise_lines(spark, sf_dir):
    return digest(O.drop_decoration(logs(spark, sf_dir)))


def noise_sql(aggressive: bool) -> str:
    own = "trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(lower(trim(line)), '{t}', '')), '{b}', '')), '{l}', ''))".format(t=P.TIMESTAMP, b=P.BRACKET, l=P.LEVEL)
    known = " OR ".join(f"regexp_matches({own}, '{p}')" for p in P.LOG_NOISE + (P.LOG_NOISE_AGGRESSIVE if aggressive else ()))
    signal = " OR ".join([*(f"contains(lower(line), '{s}')" for s in P.LOG_SIGNALS), f"regexp_matches(lower(trim(line)), '{P.LOG_SIGNAL_START}')"])
    return f"{own} <> '' AND ({known}) AND NOT ({signal})"


@entry("install_noise_standard", lines_sql(LOGS, "logs", noise_sql(False)))
def install_noise_standard(spark, sf_dir):
    return digest(O.remove_install_noise(logs(spark, sf_dir)))


@entry("install_noise_aggressive", lines_sql(LOGS, "logs", noise_sql(True)))
def install_noise_aggressive(spark, sf_dir):
    return digest(O.remove_install_noise(logs(spark, sf_dir), True))


def repeats_step(name: str, to: str) -> str:
    stamp = P.TIMESTAMP
    plain = rf"trim(regexp_replace(regexp_replace(trim(line), '{stamp}', ''), '\s+', ' ', 'g'))"
    return rf"""{SPLIT.format(name=name, to=to)},
k_{to} AS (SELECT *, CASE WHEN {plain} = '' OR starts_with(trim(line), '[Collapsed stack frames:') THEN NULL ELSE translate({plain}, '{X.UPPER}', '{X.LOWER}') END AS key FROM l_{to}),
b_{to} AS (SELECT *, CASE WHEN key = lag(key) OVER (PARTITION BY id ORDER BY k) THEN 0 ELSE 1 END AS fresh FROM k_{to}),
g_{to} AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY k) AS g FROM b_{to}),
r_{to} AS (SELECT id, g, count(*) AS n, arg_min(line, k) AS first, arg_max(line, k) AS last, sum({TOKENS}) - CAST(ceil(length(arg_min(line, k)) / 4.0) AS BIGINT) AS gone FROM g_{to} GROUP BY id, g),
t_{to} AS (SELECT *, CASE WHEN n = 1 THEN first ELSE '[Repeated ' || CAST(n AS VARCHAR) || ' times' ||
  CASE WHEN regexp_extract(first, '{stamp}', 1) <> '' AND regexp_extract(last, '{stamp}', 1) <> '' AND regexp_extract(first, '{stamp}', 1) <> regexp_extract(last, '{stamp}', 1)
    THEN ' from ' || regexp_extract(first, '{stamp}', 1) || ' to ' || regexp_extract(last, '{stamp}', 1) ELSE '' END || '] ' ||
  trim(regexp_replace(regexp_replace(trim(regexp_replace(first, '{stamp}', '')), '{P.LEVEL}', ''), '\s+', ' ', 'g')) END AS line FROM r_{to}),
{to} AS (SELECT id, count(*) FILTER (n > 1) AS n, coalesce(sum(gone) FILTER (n > 1), 0) AS t, string_agg(line, chr(10) ORDER BY g) AS content FROM t_{to} GROUP BY id)"""


def repeats_sql(source: str, name: str) -> str:
    return digest_sql(source, ("a", repeats_step(name, "a")))


@entry("collapse_repeated_lines", repeats_sql(LOGS, "logs"))
def collapse_repeated_lines(spark, sf_dir):
    return digest(O.collapse_repeats(logs(spark, sf_dir)))


@entry("collapse_repeated_lines_documents", repeats_sql(DOCS, "docs"))
def collapse_repeated_documents(spark, sf_dir):
    return digest(O.collapse_repeats(docs(spark, sf_dir)))


FRAMES = " OR ".join(f"regexp_matches(line, '{p}')" for p in P.FRAMES)


def frames_step(name: str, to: str) -> str:
    return rf"""{SPLIT.format(name=name, to=to)},
f_{to} AS (SELECT *, ({FRAMES}) AS frame, lower(trim(regexp_replace(line, '\s+', ' ', 'g'))) AS key FROM l_{to}),
b_{to} AS (SELECT *, CASE WHEN frame = lag(frame) OVER (PARTITION BY id ORDER BY k) THEN 0 ELSE 1 END AS fresh FROM f_{to}),
g_{to} AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY k) AS g FROM b_{to}),
n_{to} AS (SELECT *, frame AND row_number() OVER (PARTITION BY id, g, key ORDER BY k) > 1 AS gone FROM g_{to}),
m_{to} AS (SELECT id, max(k) + 0.5 AS k, '[Collapsed stack frames: ' || CAST(count(*) FILTER (gone) AS VARCHAR) || ' duplicate frames removed]' AS line, count(*) FILTER (gone) AS n FROM n_{to} GROUP BY id, g),
e_{to} AS (SELECT id, CAST(k AS DOUBLE) AS k, line FROM n_{to} WHERE NOT gone UNION ALL SELECT id, k, line FROM m_{to} WHERE n > 0),
{to} AS (SELECT id, n, t, content FROM (SELECT id, string_agg(line, chr(10) ORDER BY k) AS content FROM e_{to} GROUP BY id)
  JOIN (SELECT id, count(*) FILTER (gone) AS n, coalesce(sum({TOKENS}) FILTER (gone), 0) AS t FROM n_{to} GROUP BY id) USING (id))"""


@entry("stack_frame_dedup", digest_sql(LOGS, ("a", frames_step("logs", "a"))))
def stack_frame_dedup(spark, sf_dir):
    return digest(O.collapse_frames(logs(spark, sf_dir)))


def redaction_sql(source: str) -> str:
    steps, name = [source], "docs"
    for k, pattern in enumerate(P.SECRETS):
        p = pattern.replace("'", "''")
        steps.append(f"r{k} AS (SELECT id, {'0' if not k else 'n'} + len(regexp_extract_all(content, '{p}')) AS n, regexp_replace(content, '{p}', '{P.REDACTED}', 'g') AS content FROM {name})")
        name = f"r{k}"
    return f"WITH {', '.join(steps)} SELECT id, CAST(n AS BIGINT) AS n_removed, CAST(0 AS BIGINT) AS tokens_removed, md5(content) AS md5 FROM {name}"


@entry("redact_secrets", redaction_sql(DOCS))
def redact_secrets(spark, sf_dir):
    return digest(O.redact(docs(spark, sf_dir)))


@entry("redact_secrets_pages", redaction_sql(PAGES))
def redact_secrets_pages(spark, sf_dir):
    return digest(O.redact(pages(spark, sf_dir)))


METRICS_SQL = stripped_sql() + """, counted AS (
  SELECT id, CAST(ceil(length(d.content) / 4.0) AS BIGINT) AS a, CAST(ceil(length(s.content) / 4.0) AS BIGINT) AS b FROM docs d JOIN s_svg s USING (id))
SELECT id, a AS input_tokens, b AS output_tokens, a - b AS tokens_saved, CASE WHEN a = 0 THEN 0.0 ELSE CAST(b AS DOUBLE) / a END AS compression_ratio,
  CASE WHEN a = 0 THEN 0.0 ELSE greatest(0.0, 1.0 - CAST(b AS DOUBLE) / a) * 100.0 END AS reduction_percent FROM counted"""


@entry("compression_metrics", METRICS_SQL)
def compression_metrics(spark, sf_dir):
    df = pages(spark, sf_dir).withColumn("before", X.estimate(F.col("content")))
    df = O.remove_furniture(O.remove_executed(df))
    return df.select("id", X.metrics(F.col("before"), X.estimate(F.col("content"))).alias("m")).select("id", "m.*")


@entry("log_crush", digest_sql(LOGS, ("a", lines_step("logs", "a", noise_sql(True))), ("b", frames_step("a", "b")), ("c", repeats_step("b", "c"))))
def log_crush(spark, sf_dir):
    return digest(O.crush_logs(logs(spark, sf_dir), True))


@entry("token_count_exact")
def token_count_exact(spark, sf_dir):
    return docs(spark, sf_dir).select("id", C.count_tokens("content").alias("n_tokens"))


@entry("html_to_markdown")
def html_to_markdown(spark, sf_dir):
    return pages(spark, sf_dir).select("id", C.markdown_udf("standard")("content").alias("markdown"))


@entry("noise_blocks")
def noise_blocks(spark, sf_dir):
    return digest(C.remove_noise_blocks(pages(spark, sf_dir), True))


@entry("noise_iframes", removal_sql(PAGES, P.NOISE_IFRAME))
def noise_iframes(spark, sf_dir):
    return digest(O.remove_pattern(pages(spark, sf_dir), P.NOISE_IFRAME, "html_boilerplate", "iframe noise"))


@entry("aggressive_blocks", removal_sql(PAGES, P.AGGRESSIVE_BLOCK))
def aggressive_blocks(spark, sf_dir):
    return digest(O.remove_pattern(pages(spark, sf_dir), P.AGGRESSIVE_BLOCK, "html_boilerplate", "promoted blocks"))


@entry("pack_to_budget")
def pack_to_budget(spark, sf_dir):
    return pages(spark, sf_dir).select("id", C.pack_udf(200)("content").alias("p")).select("id", "p.*")


def cleaned(spark, sf_dir, **options) -> DataFrame:
    return C.clean(table(spark, sf_dir, "pages").select("page_id", "url", "html"), C.CleanOptions(**options), text="html", source="url")


def clean_query(**options):
    return lambda spark, sf_dir: cleaned(spark, sf_dir, **options).select("page_id", "result.metrics.*", F.md5("result.output.content").alias("md5"))


for _mode in C.MODES:
    entry(f"clean_pages_{_mode}")(clean_query(mode=_mode))
entry("clean_pages_budget")(clean_query(max_tokens=200))


def render_query(fmt: str, limit: int | None = None):
    return lambda spark, sf_dir: R.render(cleaned(spark, sf_dir, max_tokens=limit), fmt, limit).select("page_id", "rendered")


for _fmt in C.FORMATS:
    entry(f"render_{_fmt}")(render_query(_fmt))
entry("render_capped")(render_query("markdown", 200))


def report_query(fmt: str):
    return lambda spark, sf_dir: R.render_report(C.report(cleaned(spark, sf_dir)), fmt).select("page_id", "rendered")


for _fmt in C.FORMATS:
    entry(f"report_{_fmt}")(report_query(_fmt))

for _name, (_query, _sql) in cases.QUERIES.items():
    entry(_name, _sql)(_query)
entry("recipes_checks", recipes.checks_sql())(recipes.checks)
entry("recipes_reductions")(recipes.reductions)


@entry("clean_report")
def clean_report(spark, sf_dir):
    return C.report(cleaned(spark, sf_dir)).select("page_id", "report.*")


@entry("conversation_clean")
def conversation_clean(spark, sf_dir):
    """Each turn cleaned, conversations put together again in the order of their turns."""
    turns = table(spark, sf_dir, "conversations")
    done = C.clean(turns, text="text").select("conv_id", F.struct("turn", "role", F.col("result.output.content").alias("text")).alias("t"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n")
    return done.groupBy("conv_id").agg(whole.alias("content"))
