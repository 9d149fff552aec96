"""The command-line runner lists every registered query."""

from __future__ import annotations

import subprocess
import sys

from conftest import ROOT


def test_list_queries():
    out = subprocess.run([sys.executable, "-m", "ledgerline", "--list"], cwd=ROOT, capture_output=True,
                         text=True, timeout=120)
    assert out.returncode == 0
    names = [line.split()[0] for line in out.stdout.splitlines() if line.strip()]
    from ledgerline.registry import QUERIES
    assert names == list(QUERIES)


def test_unknown_query_is_an_error():
    out = subprocess.run([sys.executable, "-m", "ledgerline", "no_such_query"], cwd=ROOT,
                         capture_output=True, text=True, timeout=120)
    assert out.returncode == 2 and "unknown" in out.stderr
