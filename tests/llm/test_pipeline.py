"""The pipeline's stages against brute-force versions, in order, on the smallest tables."""

from __future__ import annotations

import re

import __spark_entry__ as entry
import corpus_pipeline as cp
from llm_cases import awkward, clashing, empty
from test_decision_list import literal as statistics
from test_simhash import _classes
from test_simhash import literal as fingerprint

from conftest import SF_SMALL
from ledgerline.llm.feistel import DEMONSTRATION_KEY, Pseudonyms
from ledgerline.plans.materialize import stage


def test_stages_and_registration():
    assert [len(s) for s in cp.STAGES] == [2] * 5
    names = list(entry.queries())
    assert "pipeline" in names
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10


def test_every_stage_on_its_input(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns = docs.columns
    bench = [r["text"] for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    words = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    kept = docs
    for i, (_, step) in enumerate(cp.STAGES):
        before = {r["doc_id"]: r["text"] for r in kept.collect()}
        kept = stage(step(spark, kept, SF_SMALL), "test-stage")
        rows = {r["doc_id"]: r.asDict() for r in kept.collect()}
        if i < 4:
            assert kept.columns == columns
        if i == 0:
            for d, t in before.items():
                s = statistics(t)
                if s["n_words"] < 20 or 100 * s["n_repeat_words"] > 30 * s["n_words"]:
                    assert d not in rows
            assert len(rows) > 0.6 * len(before)
        elif i == 1:
            ids = sorted(before)
            roots = _classes([fingerprint(before[d]) for d in ids], 4)
            assert sorted(rows) == sorted({ids[r] for r in roots})
        elif i == 2:
            leaked = {d for d, t in before.items() if any(words(b) in words(t) for b in bench)}
            assert leaked and set(before) - set(rows) == leaked
        elif i == 3:
            swap = Pseudonyms(DEMONSTRATION_KEY)
            assert {d: r["text"] for d, r in rows.items()} == {d: swap.replace(t)[0] for d, t in before.items()}
            assert all(r["n_chars"] == len(r["text"]) for d, r in rows.items() if r["text"] != before[d])
        else:
            assert set(rows) == set(before) and all(r["round_trip"] for r in rows.values())


def test_awkward_and_empty_tables_pass_every_stage(spark):
    for docs in (clashing(awkward(spark)), empty(spark)):
        n = docs.count()
        for _, step in cp.STAGES:
            made = step(spark, docs, SF_SMALL)
            assert made.count() <= n
