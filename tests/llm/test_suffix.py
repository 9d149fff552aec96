"""Exact-substring dedup against a set of all windows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from llm_cases import awkward, clashing, documents, empty, prose

from ledgerline.llm import suffix


def literal(texts, length=100):
    seen, out = set(), []
    for t in texts:
        body = (t or "").encode()
        cover = bytearray(len(body))
        for p in range(len(body) - length + 1):
            w = body[p:p + length]
            if w in seen:
                cover[p:p + length] = b"\1" * length
            else:
                seen.add(w)
        kept = bytes(b for b, c in zip(body, cover) if not c)
        runs = len([r for r in bytes(cover).split(b"\0") if r])
        out.append((len(body), len(body) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def _made(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def _texts(seed, n):
    rng = random.Random(seed)
    base = [prose(seed * 50 + i, rng.randint(5, 120)) for i in range(5)]
    out = []
    for _ in range(n):
        kind, b = rng.random(), rng.choice(base)
        if kind < 0.2:
            out.append(b)
        elif kind < 0.5:
            words = b.split()
            words[rng.randrange(len(words))] = rng.choice(["zulu", "é"])
            out.append(" ".join(words))
        elif kind < 0.65:
            out.append(b[rng.randint(0, 40):] + rng.choice(base)[:rng.randint(0, 400)])
        elif kind < 0.75:
            out.append("a" * rng.randint(90, 260))
        elif kind < 0.85:
            out.append(("ab" * 150)[:rng.randint(100, 300)] + "x" + "ab" * 100)
        else:
            out.append(rng.choice([None, "", prose(rng.randint(1000, 9999), 60), "é" * 120]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_all_windows(spark, seed):
    texts = _texts(seed, 60)
    made = _made(suffix.drop_repeats(documents(spark, texts).repartition(3)))
    assert [made[i] for i in range(len(texts))] == literal(texts)


def test_other_lengths_and_kept_bytes(spark):
    texts = _texts(3, 25)
    df = suffix.drop_repeats(documents(spark, texts), length=40, gram=12)
    assert [_made(df)[i] for i in range(len(texts))] == literal(texts, 40)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in df.collect())
    with pytest.raises(ValueError):
        suffix.drop_repeats(documents(spark, texts), length=20, gram=32)


def test_hot_grams_change_the_path_not_the_result(spark, monkeypatch):
    texts = _texts(4, 60)
    monkeypatch.setattr(suffix, "HOT_ROWS", 2)
    docs = documents(spark, texts)
    assert len(suffix.hot_grams(docs.selectExpr("doc_id uid", "text"), 100, 32)) > 20
    made = _made(suffix.drop_repeats(docs))
    assert [made[i] for i in range(len(texts))] == literal(texts)


def test_hot_grams_of_one_text_are_found(spark, monkeypatch):
    """A gram that a single long text owns over and over counts like one of many documents."""
    rng = random.Random(6)
    passage = prose(77, 8)
    texts = [prose(i, 30) for i in range(40)]
    texts[17] = " ".join(f"{passage} {rng.randint(10**6, 10**9)}" for _ in range(400))
    monkeypatch.setattr(suffix, "HOT_ROWS", 100)
    hot = suffix.hot_grams(documents(spark, texts).selectExpr("doc_id uid", "text").repartition(4), 100, 32)
    assert 0 < len(hot) < 20 and (np.diff(hot) > 0).all()
    made = _made(suffix.drop_repeats(documents(spark, texts)))
    assert [made[i] for i in range(len(texts))] == literal(texts)


def test_hot_grams_are_a_bounded_share_of_all_rows(spark, monkeypatch):
    texts = _texts(5, 60)
    monkeypatch.setattr(suffix, "HOT_ROWS", 1)
    monkeypatch.setattr(suffix, "HOT_SHARE", 3)
    assert len(suffix.hot_grams(documents(spark, texts).selectExpr("doc_id uid", "text"), 100, 32)) <= 8
    assert len(suffix.hot_grams(empty(spark).selectExpr("doc_id uid", "text"), 100, 32)) == 0


def test_merge_sort_of_suffixes():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 2, 4000).astype(np.uint8)
    start = rng.permutation(3900)[:700]
    group = np.sort(rng.integers(0, 9, 700))
    order = suffix.Suffixes(data, 100).sort(start, group)
    want = sorted(range(700), key=lambda i: (group[i], data[start[i]:start[i] + 100].tobytes(), start[i]))
    assert order.tolist() == want


def test_false_matches_are_settled_by_bytes(monkeypatch):
    """With a hash that calls everything equal the verification still decides."""
    texts = [b"x" * 20 + b"same owner gram here" + bytes([65 + i]) * 60 for i in (0, 1, 0, 2, 1)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.arange(5) * 100
    monkeypatch.setattr(suffix.Suffixes, "common", lambda self, x, y: np.full(len(x), 100))
    context, window = suffix.repeated_windows(data, begin, np.full(5, 100), np.full(5, 20), np.zeros(5, np.int64), 100)
    assert sorted(zip(context.tolist(), window.tolist())) == [(2, 0), (4, 0)]


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = suffix.drop_repeats(clashing(docs)).collect()
    assert len(rows) == 12
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] not in (None, 7)}
    assert by_id[0]["n_removed"] == 0 and by_id[5]["n_removed"] == by_id[5]["n_bytes"] > 100
    assert by_id[1]["n_bytes"] == by_id[2]["n_bytes"] == 0
    same = "é😀 " * 40
    assert (by_id[6]["n_bytes"], by_id[6]["n_removed"], by_id[6]["n_spans"]) == literal([same])[0][:3]
    assert suffix.drop_repeats(empty(spark)).collect() == []


def test_query_equals_sql(spark):
    import duckdb

    from conftest import SF_SMALL
    from ledgerline.llm.queries import ORACLE, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    want = con.sql(ORACLE["op10_suffix_sort"])
    df = QUERIES["op10_suffix_sort"](spark, SF_SMALL)
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())
