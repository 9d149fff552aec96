"""The fact clustered by order, its large orders, and cards as a lookup."""

from __future__ import annotations

import uuid

import pytest
from helpers import make_star, rows

from conftest import SF_SMALL
from ledgerline.operators import lookup, recommend
from ledgerline.registry import QUERIES
from ledgerline.session import scratch_dir
from ledgerline.sources.warehouse import materialize_star
from test_skew import _brute_force, _executed, _lines


def _path(spark):
    return f"{scratch_dir(spark)}/test-clustered-{uuid.uuid4().hex}"


def _clustered(spark, lines, large_lines, **more):
    star = make_star(spark, lines, **more)
    return star, materialize_star(star, _path(spark), fact_rows=len(lines), large_lines=large_lines)


def test_co_purchase_needs_no_exchange_above_the_fact(spark, star):
    assert star.clustered is not None and star.clustered.large is None
    plan = _executed(QUERIES["rec_co_purchase"](spark, SF_SMALL)).split("== Initial Plan ==")[0]
    exchanges = [ln for ln in plan.splitlines() if "Exchange" in ln and "Broadcast" not in ln and "Reused" not in ln]
    assert len(exchanges) == 1 and "product_key_1" in exchanges[0], exchanges
    assert plan.count("Bucketed: true") == 2


def test_order_totals_need_no_exchange_above_the_fact(spark):
    plan = _executed(QUERIES["kpi_avg_order_value"](spark, SF_SMALL)).split("== Initial Plan ==")[0]
    assert "hashpartitioning(order_id" not in plan


def test_large_orders_are_kept_apart_and_exact(spark):
    lines = _lines(hot_products=300, small_orders=400)
    star, clustered = _clustered(spark, lines, large_lines=100)
    assert clustered.clustered.large is not None
    assert {r[0] for r in clustered.clustered.large.select("order_id").distinct().collect()} == {"1"}
    assert clustered.fact_order_line.exceptAll(star.fact_order_line).count() == 0
    assert star.fact_order_line.exceptAll(clustered.fact_order_line).count() == 0
    got = {(r[0], r[1]): r[2] for r in recommend.co_purchase(clustered).collect()}
    assert got == dict(_brute_force(lines))
    plan = _executed(recommend.co_purchase(clustered))
    assert "hashpartitioning(order_id" in plan and "Bucketed: true" in plan  # the large orders are shuffled, the others not
    assert rows(recommend.top_k(clustered), "product_a", "product_b", "rn") == rows(recommend.top_k(star), "product_a", "product_b", "rn")


def test_lines_without_an_order_are_kept(spark):
    from pyspark.sql import functions as F

    star = make_star(spark, _lines(20, 30))
    orphan = star.fact_order_line.withColumn("order_id", F.when(F.col("order_line_id") > 5, F.col("order_id")))
    back = materialize_star(star.with_tables(fact_order_line=orphan), _path(spark), fact_rows=100)
    assert back.clustered.large.count() == 5 and back.fact_order_line.exceptAll(orphan).count() == 0
    assert back.with_tables(fact_order_line=orphan).clustered is None


@pytest.mark.parametrize("large_basket", [500, 10])
def test_cards_by_lookup_equal_cards_from_the_fact(spark, large_basket):
    lines = _lines(hot_products=40, small_orders=300) + [
        dict(order_id=900 + i, date="2024-12-15", customer_key=1, product_key=p, net=4) for i in range(4) for p in (1, 2, 2, 3)]
    star = make_star(spark, lines)
    index = lookup.build(star, recommend._margin(star.fact_order_line, "product_key"), n_ranges=5, large_basket=large_basket)
    assert (index.large.count() > 0) == (large_basket == 10)
    for key in (1, 2, 39, 300, 99_999):
        want = [tuple(r) for r in recommend.for_product(star, key, k=50).collect()]
        assert [tuple(r) for r in recommend.for_product(star, key, k=50, index=index).collect()] == want
    assert want == []


def _rows_read(df):
    query = df._jdf.queryExecution()
    query.toRdd().count()
    leaves = query.executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_a_lookup_reads_the_products_rows_only(spark, star):
    from pyspark.sql import functions as F

    index = lookup.build(star, recommend._margin(star.fact_order_line, "product_key"), n_ranges=100)
    total = index.orders.count()
    mine = index.orders.where(F.col("product_key") == 42)
    assert 0 < mine.count() < 100
    assert _rows_read(mine.select("order_id", "n")) <= total / 50
    scan = mine._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(product_key,42)" in scan
    assert "fact_order_line" not in recommend.for_product(star, 42, index=index)._jdf.queryExecution().executedPlan().toString()


def test_best_seller_from_the_index(spark, star):
    index = recommend.index_of(star)
    assert recommend.index_of(star) is index
    one = spark.range(1)
    assert one.select(lookup.best_seller(index)).first() == one.select(recommend.best_seller(star)).first()
