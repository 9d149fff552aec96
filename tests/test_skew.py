"""Hot orders and hot products are split by AQE or spread, and the scores stay exact."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from helpers import make_star
from ledgerline.operators import recommend

SKEW_CONF = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    # at test size AQE would merge every upstream partition into one map task,
    # leaving nothing to split; real data keeps many mappers
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def _lines(hot_products=1200, small_orders=1500):
    lines = [dict(order_id=1, date="2024-12-20", customer_key=1, product_key=p, net=5)
             for p in range(1, hot_products + 1)]
    for o in range(2, small_orders + 2):
        for p in (o % 900 + 1, (o * 7) % 900 + 1):
            lines.append(dict(order_id=o, date="2024-06-01", customer_key=o % 50 + 1, product_key=p, net=3))
    return lines


def _brute_force(lines):
    per_order = defaultdict(Counter)
    for ln in lines:
        per_order[ln["order_id"]][ln["product_key"]] += 1
    pairs = Counter()
    for counts in per_order.values():
        for a, na in counts.items():
            for b, nb in counts.items():
                if a != b:
                    pairs[(a, b)] += na * nb
    return pairs


def test_hot_order_is_split_and_exact(spark):
    lines = _lines()
    star = make_star(spark, lines)
    saved = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    try:
        for k, v in SKEW_CONF.items():
            spark.conf.set(k, v)
        df = recommend.pair_scores(star, want=("co",))
        qe = df._jdf.queryExecution()
        got = {(r[0], r[1]): r[2] for r in df.collect()}
        qe.toRdd().count()
        plan = qe.executedPlan().toString()
    finally:
        for k, v in saved.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert any("SortMergeJoin(skew=true) [order_id" in ln for ln in plan.splitlines()), plan[:3000]
    want = _brute_force(lines)
    assert got == dict(want)


@pytest.fixture()
def skewed(spark):
    saved = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in saved.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _hot_product_lines():
    """Product 1 is in every order and has by far the most partners."""
    lines = []
    for o in range(1, 3001):
        for p in (1, 2 + o % 700, 2 + (o * 7) % 700):
            lines.append(dict(order_id=o, date="2024-12-20", customer_key=o % 50 + 1, product_key=p, net=3 + p % 5))
    return lines


@pytest.mark.parametrize("name,joins", [
    ("final_scores", ["product_key", "product_a"]),
    ("association", ["product_key"]),
    ("co_purchase_norm", ["product_a"]),
])
def test_hot_product_joins_are_split(skewed, name, joins):
    star = make_star(skewed, _hot_product_lines())
    executed = []
    stage = recommend.stage

    def watched(df, label):
        executed.append((df, _executed(df)))
        return stage(df, label)

    recommend.stage = watched
    try:
        df = getattr(recommend, name)(star)
        executed.append((df, _executed(df)))
    finally:
        recommend.stage = stage
    plans = "\n".join(p for _, p in executed)
    for key in joins:
        found = [ln for ln in plans.splitlines() if f"SortMergeJoin(skew=true) [{key}" in ln]
        assert found, (key, [ln for ln in plans.splitlines() if "SortMergeJoin" in ln])


def _executed(df) -> str:
    qe = df._jdf.queryExecution()
    qe.toRdd().count()
    return qe.executedPlan().toString()


def test_top_k_spreads_a_hot_product(skewed):
    star = make_star(skewed, _hot_product_lines())
    one = [tuple(r) for r in recommend.top_k(star, spread=1).collect()]
    df = recommend.top_k(star)
    assert [tuple(r) for r in df.collect()] == one
    plan = _executed(df)
    assert "SortMergeJoin [product_a" in plan and ", part" in plan.split("SortMergeJoin [product_a")[1][:40]
    windows = [ln for ln in plan.splitlines() if "Window [" in ln]
    assert any("[product_a" in ln and "part" in ln for ln in windows)
    assert "BroadcastExchange" not in plan


def test_top_k_ranks_on_the_unrounded_score(spark):
    """Two partners whose scores differ below the sixth decimal keep their true order."""
    lines = [dict(order_id=o, date="2024-01-02", customer_key=1, product_key=p, net=1_000_000,
                  profit=profit, cost=1_000_000 - profit)
             for o, (p, profit) in enumerate([(2, 400_000.00), (3, 400_000.01)], start=1) for p, profit in ((1, 1), (p, profit))]
    star = make_star(spark, lines, as_of="2024-12-31")
    scored = {r["product_b"]: r["recommendation_score"] for r in recommend.final_scores(star).where("product_a = 1").collect()}
    assert scored[2] == scored[3]  # equal as shown
    top = [(r["product_b"], r["rn"]) for r in recommend.top_k(star).where("product_a = 1").collect()]
    assert top == [(3, 1), (2, 2)]  # by key it would be the other way round
    cards = [r["product_b"] for r in recommend.for_product(star, 1).collect()]
    assert cards == [3, 2]


def test_margins_do_not_depend_on_line_order(spark):
    from decimal import Decimal

    lines = [dict(order_id=i, date="2024-01-02", customer_key=1, product_key=1, net=7, profit=p, cost=7 - p)
             for i, p in enumerate([1, 2, 3, -3, 5] * 40)]
    lines += [dict(order_id=999, date="2024-01-02", customer_key=1, product_key=1, net=0, profit=0, cost=0)]
    star = make_star(spark, lines)
    shuffled = star.with_tables(fact_order_line=star.fact_order_line.repartition(7, "order_line_id"))
    a = recommend._margin(star.fact_order_line, "product_key").first()["margin"]
    assert a == recommend._margin(shuffled.fact_order_line, "product_key").first()["margin"]
    cut = [int(Decimal(p) * 10**12 / 7) for p in [1, 2, 3, -3, 5]]
    assert a == sum(cut) * 40 / 200 / 1e12
