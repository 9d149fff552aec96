"""Spelling variants against pairwise brute force, plain counting, and DuckDB."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from llm_cases import awkward, clashing, documents, empty, prose

from conftest import SF_SMALL
from ledgerline.llm import spelling
from ledgerline.llm.queries import ORACLE, QUERIES

COLUMNS = ["word", "n", "n_near", "form", "form_n", "root"]
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_counts(rows):
    n = Counter()
    for i, text in rows:
        for w in RUN.findall(text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def literal(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n.get(form[w]), root))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def misspelt(seed, size, letters="abcdeé"):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(40)]
    words = []
    for _ in range(size):
        w = rng.choice(base)
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            p, x = rng.randrange(len(w) + 1), rng.choice(letters)
            w = rng.choice([w[:p] + x + w[p:], w[:p] + x + w[p + 1 :], w[:p] + w[p + 1 :]])
        words.append(w)
    return " ".join(words)


def test_variants_like_brute_force(spark):
    texts = [misspelt(s, 1500) for s in range(4)] + [misspelt(9, 3000, "ab"), None, "", "ÀÉÎõü× ÷÷÷÷÷ ABCDE abcde éabcde É" * 4, "x" * 70 + " " + "x" * 71]
    docs = documents(spark, texts * 3).unionAll(awkward(spark))
    want = literal(plain_counts([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert len(want) > 400 and any(r[5] != (r[3] or r[0]) for r in want), "chains of forms are covered"
    assert rows_of(spelling.variants(docs)) == want
    assert rows_of(spelling.variants(clashing(docs))) == want


def test_empty_table_and_short_words(spark):
    assert spelling.variants(empty(spark)).collect() == []
    assert spelling.variants(documents(spark, [None, "", "one two"])).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(empty(spark), least_length=4)


def test_one_very_long_text_equals_its_parts():
    text = (prose(4, 200_000) + " äöüß Ünïcode 北京 ").replace("alpha", "Àlphabet")
    total = Counter()
    for words, n in spelling.slice_words([7], pa.array([text])):
        for w, k in zip(words.to_pylist(), n.to_pylist()):
            total[w] += k
    assert {w: k for w, k in total.items() if k >= 3} == plain_counts([(7, text)])
    long = "a" * 300_000
    assert sum(n.to_pylist()[0] for _, n in spelling.slice_words([None], pa.array([f"{long} {long}"]))) == 2


def test_crc_of_ranges():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 5000, np.uint8)
    starts = rng.integers(0, 4000, 300)
    ends = starts + rng.integers(0, 200, 300)
    before = rng.integers(0, 1 << 32, 300, np.uint32)
    got = spelling.crc32_ranges(before, data, starts, ends)
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes(), int(c)) for a, b, c in zip(starts, ends, before)]


@pytest.mark.parametrize("dictionary", [{}, "some", "all"])
def test_bound_holds_for_every_edit(dictionary):
    """Two words one edit apart meet in a list, whatever grams are frequent."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(5, 8))) for _ in range(60)]
    grams = Counter(s[i : i + q] for w in words for s in [f"^{w}$"] for q in range(2, 6) for i in range(len(s) - q + 1))
    if dictionary == "some":
        dictionary = {g: k for g, k in grams.items() if k > 12}
    elif dictionary == "all":
        dictionary = dict(grams)
    for w in words:
        keys = {(g, len(w), i) for i, g in spelling.listed(w, dictionary)}
        edits = {w[:p] + x + w[p:] for p in range(len(w) + 1) for x in "abz"} | {w[:p] + x + w[p + 1 :] for p in range(len(w)) for x in "abz"}
        for v in edits - {w}:
            other = spelling.listed(v, dictionary)
            if len(v) == len(w):
                assert keys & {(g, len(v), i) for i, g in other}
            else:
                assert keys & {(g, len(v) - 1, i - d) for i, g in other for d in (0, 1)}


def test_dictionary_is_bounded(spark):
    words = spark.createDataFrame([(f"{prose(i, 1)}x{i}", 3) for i in range(2000)], "word string, n long")
    assert 0 < len(spelling.gram_dictionary(words, most=200, least=1)) <= 200


def test_lists_can_be_split(spark):
    words = spark.createDataFrame([("abcde", 3), ("abcdf", 3)], "word string, n long")
    tree = spelling.near_words(words)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in tree and "NestedLoop" not in tree and "Window" not in tree


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    want = con.sql(ORACLE["op13_spelling_variants"])
    df = QUERIES["op13_spelling_variants"](spark, SF_SMALL)
    assert sorted(map(tuple, df.select(*want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)
