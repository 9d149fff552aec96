"""Two-pass shuffled shards against the laws they promise."""

from __future__ import annotations

import zlib
from collections import Counter

import pytest
from llm_cases import awkward, clashing, documents, empty, prose

from ledgerline.llm import sharding


def _rows(df):
    return [r.asDict() for r in df.collect()]


def _check_law(rows, n, shards):
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == n
    assert max(counts.values(), default=0) - min((counts[s] for s in range(shards)), default=0) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))


def test_shards_are_even_gapless_and_complete(spark):
    texts = [prose(i, 5 + i % 40) for i in range(200)]
    docs = documents(spark, texts)
    rows = _rows(sharding.digest(sharding.shuffle_shards(docs, shards=7, bucket_bytes=4000)))
    _check_law(rows, 200, 7)
    for r in rows:
        body = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(body) + 8, zlib.crc32(body), "rows", None)


def test_order_is_shuffled_and_repeats_with_the_seed(spark):
    docs = documents(spark, [prose(i, 8) for i in range(120)])

    def order(df, seed):
        made = sharding.shuffle_shards(df, shards=1, seed=seed, bucket_bytes=2000)
        return [r["doc_id"] for r in made.orderBy("slot").collect()]

    first = order(docs, 1)
    assert first != sorted(first)
    assert order(docs.repartition(5, "text"), 1) == first
    assert order(docs, 2) != first


def test_equal_texts_spread_over_shards(spark):
    rows = _rows(sharding.shuffle_shards(documents(spark, ["same text"] * 240), shards=8, bucket_bytes=400))
    _check_law(rows, 240, 8)
    assert len({(r["shard"], r["doc_id"] % 8) for r in rows}) > 30


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_awkward_rows_each_get_a_slot(spark, shards):
    docs = clashing(awkward(spark))
    made = sharding.shuffle_shards(docs, shards=shards, bucket_bytes=500)
    rows = _rows(sharding.digest(made))
    _check_law(rows, 12, shards)
    assert Counter(r["doc_id"] for r in rows) == Counter([0, 1, 2, 3, 4, 5, 5, 6, 7, 7, None, None])
    assert {r["size"] for r in rows if r["doc_id"] in (1, 2)} == {8}


def test_equal_rows_spread_over_buckets(spark):
    """Rows equal in id and text are dealt by their numbers; the other rows keep their buckets."""
    texts = [prose(i, 12) for i in range(200)]
    docs = documents(spark, texts)
    equal = spark.range(3000).selectExpr("7L doc_id", "'the same short text' text", "'en' lang", "'s' source", "1L n_chars")
    nulls = spark.range(2000).selectExpr("CAST(NULL AS LONG) doc_id", "CAST(NULL AS STRING) text", "'en' lang", "'s' source", "1L n_chars")
    both = docs.unionAll(equal).unionAll(nulls)
    placed, counts = sharding._bucketed(sharding.unclash(both, ("doc_id", "text")), 17, 40, 4000)
    made = {r["ll_bucket"]: (r["count"], r["bytes"]) for r in counts.collect()}
    assert sum(n for n, _ in made.values()) == 5200
    assert max(b for _, b in made.values()) < 8000 and len(made) == 40
    seen = Counter(r["ll_bucket"] for r in placed.collect())
    assert seen == {b: n for b, (n, _) in made.items()}
    alone, _ = sharding._bucketed(docs, 17, 40, 4000)
    where = {r["doc_id"]: r["ll_bucket"] for r in alone.collect()}
    assert all(where[r["doc_id"]] == r["ll_bucket"] for r in placed.where("text <> 'the same short text'").collect())
    rows = _rows(sharding.shuffle_shards(both, shards=9, bucket_bytes=3000))
    _check_law(rows, 5200, 9)
    assert len({r["shard"] for r in rows if r["text"] == "the same short text"}) == 9


def test_empty_table(spark):
    assert _rows(sharding.digest(sharding.shuffle_shards(empty(spark)))) == []
