"""Distinct orders from merged bitmap words against counting them one by one."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import kpis, order_sets
from tests.helpers import make_star


def _lines(orders: range, seed: int = 5):
    """Some orders stand on several days, some under two customers."""
    rnd = random.Random(seed)
    for order in orders:
        who = rnd.randint(1, 60) if rnd.random() < 0.7 else 1  # customer 1 is hot
        day = rnd.randint(1, 28)
        month = rnd.randint(1, 6)
        for _ in range(rnd.randint(1, 4)):
            yield dict(order_id=order, product_key=rnd.randint(1, 9), net=rnd.randint(0, 900) / 100,
                       customer_key=who if rnd.random() < 0.9 else 61,
                       date=f"2024-{month + (rnd.random() < 0.2):02d}-{day:02d}")


@pytest.fixture(scope="module")
def small(spark):
    return make_star(spark, list(_lines(range(700))))


def _brute(star, months: int) -> list[tuple]:
    lines = star.fact_order_line.join(star.dim_date, "date_key", "left").select(
        "year", "month", "customer_key", "order_id", "net_amount").collect()
    out = []
    for year, month in sorted({(r.year, r.month) for r in star.dim_date.select("year", "month").distinct().collect()}):
        held = [r for r in lines if r.month is not None and 0 <= 12 * (year - r.year) + month - r.month < months]
        if not held:
            continue
        orders = {r.order_id for r in held} - {None}
        cents = int(sum(r.net_amount for r in held) * 100)
        per = {}
        for r in held:
            per.setdefault(r.customer_key, set()).update({r.order_id} - {None})
        again = sum(len(o) > 1 for o in per.values())
        value = (2 * cents + len(orders)) // (2 * len(orders)) / 100 if orders else None
        out.append((year, month, len(orders), value, len(per), again, round(again * 100 / len(per), 2)))
    return out


@pytest.mark.parametrize("months", [1, 3])
def test_trailing_against_brute_force(small, months):
    assert [tuple(r) for r in order_sets.trailing(small, months).collect()] == _brute(small, months)


def test_totals_equal_the_plain_kpis(small):
    sets = order_sets.sets_of(small)
    assert order_sets.avg_order_value(sets).collect() == kpis.avg_order_value(small).collect()
    assert order_sets.repeat_rate(sets).collect() == kpis.repeat_rate(small).collect()
    assert order_sets.sets_of(small) is sets


def test_extended_sets_count_known_orders_once(spark, small):
    """The last orders arrive later, together with new lines of known orders."""
    lines = small.fact_order_line
    late = (F.col("order_id").cast("int") >= 500) | (F.col("order_line_id") % 5 == 0)
    sets = order_sets.build(small.with_tables(fact_order_line=lines.where(~late)))
    known = {r.order_id: r.order_no for r in sets.numbers.collect()}
    grown = order_sets.extend(sets, lines.where(late), n_ranges=3)
    numbers = {r.order_id: r.order_no for r in grown.numbers.collect()}
    assert sorted(numbers.values()) == list(range(1, 701))
    assert {o: numbers[o] for o in known} == known
    assert [tuple(r) for r in order_sets.trailing(small, 3, grown).collect()] == _brute(small, 3)


def test_lines_without_order_customer_or_day(spark, small):
    n = F.col("order_line_id")
    lines = small.fact_order_line
    for column, every in (("order_id", 7), ("customer_key", 11), ("date_key", 13)):
        lines = lines.withColumn(column, F.when(n % every != 0, F.col(column)))
    star = small.with_tables(fact_order_line=lines)
    assert [tuple(r) for r in order_sets.trailing(star).collect()] == _brute(star, 3)


def test_empty_fact(small):
    star = small.with_tables(fact_order_line=small.fact_order_line.limit(0))
    sets = order_sets.build(star)
    assert order_sets.trailing(star, sets=sets).collect() == []
    assert order_sets.avg_order_value(sets).collect() == kpis.avg_order_value(star).collect()
    assert order_sets.repeat_rate(sets).collect() == kpis.repeat_rate(star).collect()


def test_words_are_few(spark):
    """A customer's orders lie together: 6,400 orders of 10 customers on one day are about 100 rows."""
    lines = [dict(order_id=f"{o * 7919 % 6400:05d}", date="2024-03-01", customer_key=o % 10, product_key=1, net=1) for o in range(6400)]
    sets = order_sets.build(make_star(spark, lines))
    assert sets.numbers.count() == 6400
    assert sets.words.count() <= 120
