"""Bitmap words of keys: exact key checks that shuffle little."""

from __future__ import annotations

import random
from dataclasses import replace

from helpers import make_star

from ledgerline.operators import dq
from ledgerline.plans.joins import BROADCAST_MAX_BYTES
from ledgerline.plans.key_words import holds, key_words, word_of
from ledgerline.plans.materialize import stage
from pyspark.sql import functions as F
from test_skew import _executed


def _keys(n, seed=3):
    rnd = random.Random(seed)
    big = [rnd.choice([-1, 1]) * rnd.randint(0, 2**62) for _ in range(n)]
    return big + list(range(-200, 300)) + [0, 0, 63, 64, -64, -64, -64, None, None, 2**63 - 1, -(2**63)]


def test_membership_is_exact(spark):
    keys = _keys(200)
    words = key_words(spark.createDataFrame([(k,) for k in keys], "k long"), "k")
    asked = sorted({k + d for k in keys if k is not None and abs(k) < 2**62 for d in (-1, 0, 1, 64)})
    found = spark.createDataFrame([(k,) for k in asked], "k long").withColumn("word", word_of("k")).join(words, "word", "left")
    got = {r["k"] for r in found.where(holds(F.col("bits"), "k")).collect()}
    assert got == set(asked) & set(keys)


def test_two_passes_count_like_one(spark):
    for keys in (_keys(100), [1, 2, 3], [None], [], [5] * 10):
        df = spark.createDataFrame([(k,) for k in keys], "k long")
        assert dq._key_totals_in_two_passes(df, "k").collect() == dq._key_totals(df, ["k"]).collect(), keys[:5]


def _shuffled(df):
    """Rows written by the exchanges of an executed query."""
    query = df._jdf.queryExecution()
    query.toRdd().count()
    text, seen, total = query.executedPlan(), [], 0

    def walk(node):
        nonlocal total
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        if name == "Exchange" and node not in seen:
            seen.append(node)
            total += node.metrics().apply("shuffleRecordsWritten").value()
        kids = node.children()
        for i in range(kids.size()):
            walk(kids.apply(i))

    walk(text)
    return total


def test_two_passes_shuffle_one_row_per_word(spark):
    """100,000 consecutive keys: the words are under 3 % of the keys' shuffle."""
    df = stage(spark.range(0, 100_000, 1, 4).withColumnRenamed("id", "k"), "keys")
    plain = _shuffled(df.groupBy("k").agg(F.count(F.lit(1)).alias("c")))
    words = _shuffled(key_words(df, "k"))
    assert plain == 100_000 and words <= 100_000 / 64 + 8


def test_large_dimension_is_tested_in_the_scan(spark):
    lines = [dict(order_id=o, date="2024-02-01", customer_key=o % 700 + 1, product_key=o % 50 + 1, net=3) for o in range(2000)]
    star = make_star(spark, lines)
    fewer = star.dim_customer.where("customer_key % 100 <> 7")
    null = star.fact_order_line.withColumn("customer_key", F.when(F.col("order_line_id") > 4, F.col("customer_key")))
    star = star.with_tables(dim_customer=fewer, fact_order_line=null)
    want = null.join(fewer, "customer_key", "left_anti").count()
    star = replace(star, rows={"dim_customer": fewer.count()})
    plain = {r["fk_column"]: r["orphan_rows"] for r in dq.foreign_key_report(star).collect()}
    spark.conf.set(BROADCAST_MAX_BYTES, "2000")  # the keys are more, their words less
    try:
        df = dq._orphans(star, "customer_key", "dim_customer", "customer_key")
        plan = _executed(df)
        words = {r["fk_column"]: r["orphan_rows"] for r in dq.foreign_key_report(star).collect()}
        spark.conf.set(BROADCAST_MAX_BYTES, "10")
        merged = {r["fk_column"]: r["orphan_rows"] for r in dq.foreign_key_report(star).collect()}
    finally:
        spark.conf.unset(BROADCAST_MAX_BYTES)
    assert plain == words == merged and words["customer_key"] == want > 4
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan.split("BroadcastExchange")[0]


def test_report_is_the_same_in_one_and_two_passes(spark, star):
    once = dq.primary_key_report(star, two_pass_rows=10**9).collect()
    assert dq.primary_key_report(star, two_pass_rows=0).collect() == once
