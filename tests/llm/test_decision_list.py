"""Quality statistics against a literal count; the learned list on held-out documents."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from llm_cases import awkward, clashing, documents, empty, prose

from conftest import SF_SMALL
from ledgerline.llm import decision_list as dl


def literal(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
        "n_upper": len(re.findall("[A-Z]", text)), "n_digits": len(re.findall("[0-9]", text)),
    }


def test_statistics_match_the_literal_count():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab é\n\r\t#|\x0b") for _ in range(rng.randint(0, 120))) for _ in range(300)]
    texts += [None, "", "a " * 30, "a b c d e f g h " * 2, "x\nx\n x\n\n\nx", prose(1, 400), "\x1c \x85  "]
    made = dl.statistics(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert {k: v[i].as_py() for k, v in made.items()} == literal(t), repr(t)


def _corpus(n, seed):
    rng = random.Random(seed)
    texts, bad = [], []
    for i in range(n):
        t = prose(seed * 100_000 + i, rng.randint(30, 120))
        kind = rng.random()
        if kind < 0.2:
            t = " ".join(w + rng.choice(["***", "###", "$$$"]) for w in t.split())
        elif kind < 0.35:
            t = t.upper()
        texts.append(t)
        bad.append(kind < 0.35)
    return texts, bad


def test_learned_list_on_held_out_documents(spark):
    texts, bad = _corpus(900, 3)
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 0 if b else 1, 0) for i, b in enumerate(bad) if i < 600],
                                   "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in dl.judge(docs, labels).select("doc_id", "kept").collect()}
    held = range(600, 900)
    assert np.mean([kept[i] != bad[i] for i in held]) > 0.97
    assert all(kept[i] for i in held if not bad[i])


def test_rules_are_ordered_conjunctions_that_prune():
    rng = np.random.default_rng(1)
    x = {f: rng.random(3000) for f in dl.FEATURES}
    bad = (x["words"] > 0.8) | ((x["mean_word"] < 0.3) & (x["symbols_per_char"] > 0.5))
    rules = dl.learn(x, bad)
    hit = np.zeros(3000, bool)
    for r in rules:
        hit |= dl._covers(r, x, 3000)
    assert (hit == bad).mean() > 0.99
    assert any(len(r) == 2 for r in rules)
    assert dl.learn(x, np.zeros(3000, bool)) == [] and dl.learn({f: v[:0] for f, v in x.items()}, bad[:0]) == []


def test_awkward_rows_and_missing_labels(spark):
    docs = clashing(awkward(spark))
    labels = spark.createDataFrame([(None, 0, 0), (0, None, 0), (4, 1, None), (4, 0, None)],
                                   "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        rows = dl.judge(docs, some).collect()
        assert len(rows) == 12
        by_id = {r["doc_id"]: r for r in rows}
        assert by_id[1]["n_words"] == 0 and by_id[1]["base_failed"] and not by_id[1]["kept"]
        assert by_id[0]["kept"] and not by_id[3]["kept"]
    assert dl.judge(empty(spark), labels).collect() == []


def test_registered_query_matches_the_literal_count(spark):
    from ledgerline.llm.queries import QUERIES

    rows = QUERIES["op3_decision_list"](spark, SF_SMALL).collect()
    texts = dict(spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect())
    assert len(rows) == len(texts)
    for r in rows:
        want = literal(texts[r["doc_id"]])
        assert all(r[k] == want[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        base = want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"]
        assert r["base_failed"] == base and not (base and r["kept"])


def test_sample_has_one_row_per_labelled_id(spark):
    """A third of the rows share one labelled id; they send one row to the driver."""
    texts = [prose(i % 7, 40) if i % 3 == 0 else prose(i, 40) for i in range(3000)]
    docs = spark.createDataFrame([(1 if i % 3 == 0 else i + 10, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 0), (11, 1, 0)], "doc_id long, quality int, toxic int")
    x, bad = dl.labelled_sample(docs, labels)
    assert sorted(bad.tolist()) == [False, True] and all(len(v) == 2 for v in x.values())
    again, _ = dl.labelled_sample(docs.repartition(5), labels)
    assert {k: v.tolist() for k, v in again.items()} == {k: v.tolist() for k, v in x.items()}
