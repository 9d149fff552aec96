"""Pairs dropped before the top-k never change it."""

from __future__ import annotations

import random

import pytest

from ledgerline.operators import recommend
from tests.helpers import START, make_star


def _lines(seed: int):
    rnd = random.Random(seed)
    for order in range(260):
        late = rnd.random() < 0.3
        for p in rnd.sample(range(1, 41), rnd.randint(1, 9)):
            for _ in range(rnd.choice((1, 1, 1, 2, 5))):
                net = rnd.choice((0, 10, 10, 25))
                yield dict(order_id=order, date="2024-12-20" if late else "2024-02-02", customer_key=1, product_key=p,
                           net=net, profit=rnd.choice((-3, 0, 4, net / 2)), cost=0)


def _products(without: set[int]):
    return [(k, f"PROD{k:06d}", f"product {k}", f"B{k % 3}", None, None, (0, 20, 100)[k % 3]) if k % 2 else
            (k, f"PROD{k:06d}", f"product {k}", None, "Entry", None, 100) for k in range(1, 41) if k not in without]


def _top(star, **more):
    return [tuple(r) for r in recommend.top_k(star, **more).collect()]


@pytest.mark.parametrize("more", [
    {}, {"k": 1}, {"k": 100}, {"weights": {"co_purchase": -0.5, "recency": 0.0}}, {"weights": {"association": 0.2}},
    {"weights": {"category": 0.0, "profit": 0.0, "stock": 0.0}},
], ids=["default", "one", "all", "negative", "association", "counts-only"])
def test_dropping_pairs_changes_nothing(spark, monkeypatch, more):
    star = make_star(spark, list(_lines(3)), products=_products({7, 8, 30}), start=START, as_of="2024-12-31")
    pruned = _top(star, **more)
    monkeypatch.setattr(recommend, "_contenders", lambda scores, score, k: scores)
    assert pruned == _top(star, **more)


def test_tied_partners_go_by_key(spark):
    """40 partners with one score: the smallest keys win, and ties of the k-th are kept until the end."""
    star = make_star(spark, [dict(order_id=1, date="2024-01-05", customer_key=1, product_key=p, net=10) for p in range(1, 41)])
    top = [r[1] for r in _top(star) if r[0] == 20]
    assert top == [1, 2, 3, 4]


def test_empty_fact(spark):
    star = make_star(spark, list(_lines(3)))
    assert _top(star.with_tables(fact_order_line=star.fact_order_line.limit(0))) == []


def test_limit_holds_before_the_exchange(spark, monkeypatch):
    """Only contenders are written, and tasks cut their pairs before they shuffle them."""
    lines = [dict(order_id=o, date="2024-02-02", customer_key=1, product_key=p, net=100, profit=p % 97, cost=0)
             for o in range(60) for p in (1, *range(2 + 20 * o, 22 + 20 * o))]
    star = make_star(spark, lines)
    written = {}
    stage = recommend.stage

    def watched(df, label):
        plan = df._jdf.queryExecution().executedPlan().toString()
        out = stage(df, label)
        written[label] = (plan, out.count())
        return out

    monkeypatch.setattr(recommend, "stage", watched)
    top = recommend.top_k(star)
    plan, rows = written["contenders"]
    pairs = recommend.pair_scores(star, want=("co",)).count()
    limits = [ln for ln in plan.splitlines() if "WindowGroupLimit" in ln]
    assert any("Partial" in ln for ln in limits) and any("Final" in ln for ln in limits)
    assert rows < pairs / 2
    assert [r[1] for r in top.collect() if r[0] == 1] == [96, 193, 290, 387]


def test_nothing_sized_by_products_goes_through_the_driver(spark, monkeypatch):
    """Small files may hold many rows: neither the maxima's copies nor attributes beyond the broadcast limit are broadcast."""
    from dataclasses import replace

    plans = {}
    stage = recommend.stage

    def recorded(df, label):
        out = stage(df, label)
        plans[label] = _plan(df)
        return out

    monkeypatch.setattr(recommend, "stage", recorded)
    star = make_star(spark, list(_lines(5)))
    star = replace(star, dim_product=stage(star.dim_product, "test-products"), rows={"dim_product": 10_000_000})
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 1 << 20
    top = _plan(recommend.top_k(star))
    for plan, key in ((top, "product_a"), (plans["products"], "product_key")):
        assert "BroadcastHashJoin" not in plan and f"SortMergeJoin [{key}" in plan, plan[:3000]


def _plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()
