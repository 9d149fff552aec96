"""The lattice audit against running every order of the filters, and DuckDB."""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import permutations

import duckdb
import pytest
from llm_cases import awkward, clashing, documents, empty, prose

from conftest import SF_SMALL
from ledgerline.llm import filter_audit
from ledgerline.llm.queries import ORACLE, QUERIES

LABELS = "doc_id long, quality int, toxic int"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def literal(rows, labels):
    """Runs all 120 orders, one filter after the other, over (doc_id, text, source)."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))

    def failing(i, t):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        out = set()
        out |= {"A"} if len(words) < 200 else set()
        out |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        out |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else set()
        out |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        out |= {"E"} if i is not None and i > least[t] else set()
        return out

    judged = [(i, s or "", failing(i, t)) for i, t, s in rows]
    result = {}
    for part in {p for _, p, _ in judged}:
        docs = [(i, f) for i, p, f in judged if p == part]
        removed_by = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, x in enumerate(order, 1):
                out = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                removed_by[x] += len(out)
                result[part, order, step] = [
                    len(left), len(out), sum(x in f for _, f in docs) - len(out), sum(f == {x} for _, f in docs),
                    sum(i in good for i, _ in out), sum(i in toxic for i, _ in out),
                ]
        for (p, order, step), row in result.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return sorted((*k, *v) for k, v in result.items())


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_every_order_like_running_it(spark):
    long = prose(9, 400)
    texts = [long, long, "A" * 10, "a b c", None, "", long + " #", prose(3, 250).upper(), "x " * 300, long, "x " * 300, "é" * 300]
    docs = documents(spark, texts).unionAll(awkward(spark))
    labels = [(0, 1, 0), (1, 1, 1), (1, 0, None), (9, 1, 0), (8, None, 1), (None, 1, 1), (5, 0, 1), (77, 1, 1)]
    got = filter_audit.audit_documents(docs, spark.createDataFrame(labels, LABELS))
    want = literal([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], labels)
    assert rows_of(got) == want
    again = filter_audit.audit_documents(clashing(docs), spark.createDataFrame(labels, LABELS))
    assert rows_of(again) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit_documents(empty(spark), none).collect() == []
    one = rows_of(filter_audit.audit_documents(documents(spark, ["a"]), none))
    assert len(one) == 600 and {r[0] for r in one} == {"src0"}


@pytest.mark.parametrize("n", [1, 3, 5])
def test_path_counts_are_factorials(n):
    reach, leave = filter_audit.path_counts(n)
    for state in range(1 << n):
        k = state.bit_count()
        assert (reach[state], leave[state]) == (math.factorial(k), math.factorial(n - k))


def test_other_sets_of_filters(spark):
    counts = spark.createDataFrame([("p", 3, 5, 1, 0), ("p", 1, 2, 0, 2), ("p", 0, 4, 4, 4)], "part string, fails int, n long, good long, toxic long")
    got = {(r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.audit(counts, "xy").collect()}
    assert got == {
        ("xy", 1): (4, 7, 0, 2, 1, 2, 9), ("xy", 2): (4, 0, 5, 0, 0, 0, 5),
        ("yx", 1): (6, 5, 0, 0, 1, 0, 5), ("yx", 2): (4, 2, 5, 2, 0, 2, 9),
    }
    with pytest.raises(ValueError):
        filter_audit.audit(counts, "aa")


def test_long_texts_are_counted_in_pieces():
    text = ("alpha beta\x0bgamma\n" * 200_000) + "x" * 3_000_000
    assert b" ".join(filter_audit._pieces(text.encode(), 1000)).split() == text.encode().split()
    assert filter_audit.text_failures(text) == 2


def test_a_text_with_very_many_copies_is_split(spark):
    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        docs = documents(spark, [f"text {i if i % 3 else 0}" for i in range(6000)]).repartition(8)
        failed = filter_audit.failures(docs)
        assert failed.where("fails >= 16").count() == 1999
        query = failed._jdf.queryExecution()
        query.toRdd().count()
        assert "SortMergeJoin(skew=true)" in query.executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    want = con.sql(ORACLE["op12_filter_audit"])
    df = QUERIES["op12_filter_audit"](spark, SF_SMALL)
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())
