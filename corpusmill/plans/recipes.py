"""Large noisy inputs made by formula, and what must and must not be left of them after cleaning to a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import clean as C


def page() -> str:
    """A documentation page among scripts and advertisements."""
    out = ["<!doctype html>", "<html><head><title>Noisy docs export</title>", "<style>body{margin:0}.ad{display:block}</style>", "<script>"]
    out += [f"window.analyticsQueue.push({{event:'scroll', id:{k}, cookie:'session-{k}', viewport:'1920x1080', referrer:'campaign-{k}'}});" for k in range(1, 1401)]
    out += ["</script></head><body>", "<nav>Home Pricing Login Cookie preferences Accept all cookies Manage preferences</nav>"]
    out += [f"<aside class='ad tracking-unit'>Advertisement slot {k} sponsored content newsletter signup cookie preferences</aside>" for k in range(1, 261)]
    out += ["<main>", "<h1>KEEP_HTML_ROOT_CAUSE: how the service was set up</h1>", "<p>A long page as scrapers bring it home, with an article among the furniture of a web site.</p>"]
    out += ["<table><tr><th>Configuration table</th><th>Preserved value</th></tr><tr><td>retry_timeout_ms</td><td>5000</td></tr></table>", '<pre><code>fn kept() { println!("KEEP_CODE_BLOCK"); }</code></pre>']
    out += [f"<p>Step {k}: keep this note about budgets of context, requests that failed, windows for retries, and src/service_{k}.ts:{k + 20}.</p>" for k in range(1, 521)]
    return "\n".join([*out, "</main>", "<footer>Newsletter signup Privacy choices All rights reserved</footer>", "</body></html>"]) + "\n"


def failed_run() -> str:
    """The log of a CI run that failed."""
    out = ["2026-07-04T10:00:00Z [group] npm install"]
    for k in range(1, 1101):
        out += [f"2026-07-04T10:00:{k % 60}.000Z info added 481 packages in {k} ms", f"2026-07-04T10:00:{k % 60}.000Z info found 0 vulnerabilities"]
    out += [f"2026-07-04T10:22:{k % 60:02}Z warn Connection timeout to database" for k in range(1, 901)]
    out += ["FAIL packages/api/user.test.ts", "Unique failure:", "TypeError: Cannot read properties of undefined", "Final error summary: request failed after retries"]
    frames = [x for k in range(1, 121) for x in (f"    at loadUser{k} (/workspace/packages/api/src/user.ts:{k + 40}:13)", f"    at main{k} (/workspace/packages/api/src/main.ts:{k + 8}:1)")]
    return "\n".join([*out, *frames, *frames]) + "\n"


def providers() -> str:
    """Lines of many tools around four that matter."""
    out = ["::group::install"]
    for k in range(1, 121):
        out += [
            f"npm http fetch GET 200 https://registry.npmjs.org/package-{k} {k} ms", f"npm WARN deprecated package-{k}@1.0.0: no longer kept up", f"Progress: resolved {k * 10}, reused {k * 9}, downloaded 1, added 1",
            f"Packages: +{k}", f"Downloaded crate_{k} v1.0.{k}", f"Compiling crate_{k} v1.0.{k}", f"tests/test_{k}.py::test_ok PASSED [ 50%]",
            f"#{k} [internal] load build definition from Dockerfile", f"#{k} CACHED", f"ok {k} [chromium] › feature_{k}.spec.ts:1:1 › passes (1.0s)",
        ]
    return "\n".join([*out, "FAIL packages/api/user.test.ts", "tests/test_api.py::test_user FAILED [ 16%]", "Error: KEEP_PROVIDER_FAILURE", "Final error summary: provider test failed"]) + "\n"


def stack_dump() -> str:
    """The same eighty frames eighteen times, and forty others."""
    out = ["Error: KEEP_STACK_ROOT payments do not add up", "Caused by: UNIQUE_DATABASE_CONSTRAINT a row of the ledger is missing"]
    out += [f"    at reconcileStep{k} (/srv/app/src/reconcile/processor.ts:{k + 10}:17)" for _ in range(18) for k in range(1, 81)]
    out += ["Frames of the recovery, all different:"]
    return "\n".join(out + [f"    at uniqueRecoveryFrame{k} (/srv/app/src/reconcile/recovery.ts:{k + 5}:9)" for k in range(1, 41)]) + "\n"


def article() -> str:
    """A small page with everything that is to go, and an article."""
    return """<!doctype html>
<html>
  <head><title>An article</title>
    <style>.banner { position: fixed; }</style>
    <script>window.analytics = { tracking: true };</script>
  </head>
  <body>
    <nav>Home Pricing Cookie preferences</nav>
    <svg><path d="M0 0h1"></path></svg>
    <div id="cookie-banner">Accept all cookies Manage preferences</div>
    <dialog class="newsletter-modal">Subscribe to our newsletter</dialog>
    <section class="ad-banner">Advertisement: buy</section>
    <aside>Related links</aside>
    <main>
      <h1>API Setup &amp; Troubleshooting</h1>
      <p>Install <code>corpusmill</code> and read the <a href="/docs/setup?lang=en&amp;step=2">guide</a>.</p>
      <table><tr><th>Mode</th><th>Keeps</th></tr><tr><td>standard</td><td>src/app.rs:42</td></tr></table>
      <pre><code>fn main() {
    println!("indented");
}</code></pre>
      <p>Unique visible conclusion: this stays.</p>
    </main>
    <footer>Newsletter signup and all rights reserved.</footer>
  </body>
</html>
"""


#: Name: the input, mode, budget, what must be left, and what must not. The stack dump has half as many tokens again in the
#: 50k vocabulary as in larger ones, and its budget with it: 1850 * 43130 / 28189.
RECIPES = {
    "page": (page, "standard", 5900, ("KEEP_HTML_ROOT_CAUSE", "Configuration table", "KEEP_CODE_BLOCK"), ("window.analyticsQueue", "Advertisement slot", "Accept all cookies")),
    "failed run": (failed_run, "aggressive", 3200, ("FAIL packages/api/user.test.ts", "Unique failure:", "Final error summary"), ("added 481 packages", "found 0 vulnerabilities")),
    "providers": (
        providers, "aggressive", 1600, ("FAIL packages/api/user.test.ts", "tests/test_api.py::test_user FAILED", "KEEP_PROVIDER_FAILURE", "Final error summary"),
        ("npm http fetch", "npm WARN deprecated", "Progress: resolved", "Downloaded crate_", "Compiling crate_", "[internal] load build definition", "[chromium]"),
    ),
    "stack dump": (stack_dump, "standard", 2830, ("KEEP_STACK_ROOT", "UNIQUE_DATABASE_CONSTRAINT", "Collapsed stack frames"), ()),
    "article": (article, "standard", None, ("API Setup & Troubleshooting", "Unique visible conclusion"), ("window.analytics", "Accept all cookies")),
}


def cleaned(spark: SparkSession) -> DataFrame:
    """Name and result of every recipe."""
    parts = []
    for name, (make, mode, budget, _, _) in RECIPES.items():
        docs = spark.createDataFrame([(name, make())], "name string, text string")
        parts.append(C.clean(docs, C.CleanOptions(mode=mode, max_tokens=budget), source="name"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each string that must (not) be left, and whether that holds; and whether the budget is kept."""
    wanted = [(n, s, k) for n, r in RECIPES.items() for k, part in ((True, r[3]), (False, r[4])) for s in part]
    asked = spark.createDataFrame(wanted, "name string, what string, present boolean")
    results = cleaned(spark).select("name", F.col("result.output.content").alias("content"), F.col("result.output.tokens").alias("tokens"), F.col("result.budget.effective_limit_tokens").alias("budget"))
    found = results.join(F.broadcast(asked), "name")  # the list above
    return found.select("name", "what", F.contains("content", "what").alias("present"), F.coalesce(F.col("tokens") <= F.col("budget"), F.lit(True)).alias("fits"))


def checks_sql() -> str:
    rows = ", ".join(f"('{n}', '{s}', {'true' if k else 'false'}, true)" for n, r in RECIPES.items() for k, part in ((True, r[3]), (False, r[4])) for s in part)
    return f"SELECT * FROM (VALUES {rows}) AS t(name, what, present, fits)"


def reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens before and after, and whether the budget cut anything."""
    m = "result.metrics."
    return cleaned(spark).select("name", m + "input_tokens", m + "output_tokens", m + "tokens_saved", F.round(m + "reduction_percent", 3).alias("reduction_percent"), F.col("result.truncation.applied").alias("cut"))
