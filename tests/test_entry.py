"""The driver's entry file in a process of its own."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_queries_can_be_listed_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert o.keys() <= q.keys(); print(*q)"
    got = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr
    assert {"removed_section_summary", "redact_secrets", "clean_pages_standard"} <= set(got.stdout.split())
