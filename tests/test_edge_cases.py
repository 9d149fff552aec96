"""Edge semantics of the analyses on small hand-made stars."""

from __future__ import annotations

import datetime as dt

import pytest

from helpers import make_star, rows
from ledgerline.model import SCHEMAS
from ledgerline.operators import customers, dq, kpis, products, ranking, recommend, timeseries


def L(order, date, cust, prod, net, **kw):
    return dict(order_id=order, date=date, customer_key=cust, product_key=prod, net=net, **kw)


# --- KPIs -----------------------------------------------------------------------------

def test_empty_fact_gives_null_kpis(spark):
    star = make_star(spark, [L(1, "2024-01-01", 1, 1, 10)])
    empty = star.with_tables(fact_order_line=star.fact_order_line.limit(0))
    assert kpis.total_revenue(empty).collect()[0].total_revenue is None
    assert kpis.avg_order_value(empty).collect()[0].avg_order_value is None
    assert kpis.profit_margin(empty).collect()[0].profit_margin_pct is None
    r = kpis.repeat_rate(empty).collect()[0]
    assert (r.total_customers, r.repeat_purchase_rate_pct) == (0, None)
    assert kpis.mom_growth(empty).count() == 0
    assert kpis.clv(empty).collect()[0].avg_customer_lifetime_value is None


def test_kpis_small(spark):
    star = make_star(spark, [
        L(1, "2024-01-05", 1, 1, 10), L(1, "2024-01-05", 1, 2, 20),
        L(2, "2024-02-01", 1, 1, 30), L(3, "2024-02-03", 2, 3, 0.05),
    ])
    assert kpis.total_revenue(star).collect()[0][0] == pytest.approx(60.05)
    # 60.05 / 3 orders = 20.01666 -> 20.02
    assert kpis.avg_order_value(star).collect()[0][0] == 20.02
    r = kpis.repeat_rate(star).collect()[0]
    assert (r.total_customers, r.repeat_customers, r.repeat_purchase_rate_pct) == (2, 1, 50.0)
    assert rows(kpis.clv_per_customer(star), "customer_key", "total_spend") == [(1, 60.0), (2, 0.05)]


def test_average_rounds_ties_away_from_zero(spark):
    # two orders 0.01 + 0.02 -> 0.015 exactly -> 0.02 (a double round would give 0.01 or 0.02)
    star = make_star(spark, [L(1, "2024-01-01", 1, 1, 0.01), L(2, "2024-01-01", 1, 1, 0.02)])
    assert kpis.avg_order_value(star).collect()[0][0] == 0.02


def test_mom_growth_previous_zero_is_null(spark):
    star = make_star(spark, [L(1, "2024-01-05", 1, 1, 0), L(2, "2024-02-05", 1, 1, 50)])
    got = rows(kpis.mom_growth(star), "month", "prev_month_revenue", "mom_growth_rate_pct")
    assert got == [(1, None, None), (2, 0.0, None)]


# --- module A ----------------------------------------------------------------------------

def test_moving_average_counts_rows_not_days(spark):
    lines = [L(i, d, 1, 1, v) for i, (d, v) in enumerate(
        [("2024-01-01", 10), ("2024-01-10", 20), ("2024-03-01", 30)], start=1)]
    star = make_star(spark, lines)
    got = rows(timeseries.moving_average(star, n=2), "full_date", "moving_avg_2")
    assert [g[1] for g in got] == [10.0, 15.0, 25.0]


def test_mom_compare_first_and_equal_months_decline(spark):
    lines = [L(1, "2023-08-02", 1, 1, 5), L(2, "2023-09-02", 1, 1, 5), L(3, "2024-07-02", 1, 1, 7),
             L(4, "2024-08-02", 1, 1, 7)]
    star = make_star(spark, lines, start="2023-08-01", end="2024-08-31")
    got = rows(timeseries.mom_compare(star), "year", "month", "performance_indicator")
    # 2023-08 is the first month (no previous) and 2024-08 equals 2024-07
    assert got == [(2023, 8, "DECLINE"), (2024, 8, "DECLINE")]


def test_acceleration_first_two_months_stable(spark):
    lines = [L(i, f"2024-0{m}-01", 1, 1, v) for i, (m, v) in enumerate([(1, 10), (2, 20), (3, 50), (4, 60)], 1)]
    star = make_star(spark, lines)
    got = rows(timeseries.acceleration(star), "month", "revenue_dynamics")
    assert got == [(1, "Stable"), (2, "Stable"), (3, "Accelerating"), (4, "Decelerating")]


def test_mtd_and_ytd_reset(spark):
    lines = [L(1, "2024-01-30", 1, 1, 1), L(2, "2024-01-31", 1, 1, 2), L(3, "2024-02-01", 1, 1, 4)]
    star = make_star(spark, lines)
    assert [r[3] for r in rows(timeseries.mtd_revenue(star), "month", "day", "year", "mtd_revenue")] \
        == [1.0, 3.0, 4.0]
    ytd = rows(timeseries.ytd_profit(star), "full_date", "ytd_profit")
    assert [r[1] for r in ytd] == pytest.approx([0.4, 1.2, 2.8])


# --- module B ------------------------------------------------------------------------------

def test_rank_ties_skip(spark):
    lines = [L(1, "2024-01-01", 1, 1, 10), L(2, "2024-01-01", 1, 2, 10), L(3, "2024-01-01", 1, 3, 5)]
    star = make_star(spark, lines)
    got = rows(ranking.product_rank(star), "product_id", "rank_product")
    assert got == [("PROD000001", 1), ("PROD000002", 1), ("PROD000003", 3)]


def test_region_rank_ties(spark):
    cust = [(1, "C1", None, None, "x", "North", None, "S"), (2, "C2", None, None, "x", "South", None, "S"),
            (3, "C3", None, None, "x", "East", None, "S")]
    lines = [L(1, "2024-01-01", 1, 1, 10, cost=5), L(2, "2024-01-01", 2, 1, 10, cost=5),
             L(3, "2024-01-01", 3, 1, 3, cost=1)]
    star = make_star(spark, lines, customers=cust)
    got = rows(ranking.region_rank(star), "region", "profit_rank")
    assert got == [("East", 3), ("North", 1), ("South", 1)]


def test_contribution_sums_to_100(spark):
    lines = [L(i, "2024-01-01", 1, p, v, category_key=c) for i, (p, v, c) in
             enumerate([(1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 7, 2)], 1)]
    star = make_star(spark, lines)
    got = ranking.contribution(star).groupBy("category_name").sum("contribution_pct").collect()
    assert {r[0]: round(r[1], 1) for r in got} == {"Cat A": 100.0, "Cat B": 100.0}


def test_pareto_running_share(spark):
    lines = [L(i, "2024-01-01", 1, p, v) for i, (p, v) in enumerate([(1, 50), (2, 30), (3, 20)], 1)]
    star = make_star(spark, lines)
    got = rows(ranking.pareto(star), "product_id", "cumulative_percent")
    assert got == [("PROD000001", 50.0), ("PROD000002", 80.0), ("PROD000003", 100.0)]
    cut = rows(ranking.pareto_cut(star, 80.0), "product_id")
    assert cut == [("PROD000001",), ("PROD000002",)]
    assert rows(ranking.pareto_cut(star, 79.99), "product_id") == [("PROD000001",)]


# --- module C -------------------------------------------------------------------------------

def test_purchase_intervals_same_day_and_split_order(spark):
    lines = [L(1, "2024-01-01", 1, 1, 5), L(2, "2024-01-01", 1, 1, 5),
             L(3, "2024-01-04", 1, 1, 5), L(3, "2024-01-05", 1, 2, 5)]
    star = make_star(spark, lines)
    got = rows(customers.purchase_intervals(star), "order_id", "current_purchase_date",
               "days_between_purchases")
    d = dt.date
    assert got == [("1", d(2024, 1, 1), None), ("2", d(2024, 1, 1), 0), ("3", d(2024, 1, 4), 3),
                   ("3", d(2024, 1, 5), 1)]


def test_recency_dense_rank(spark):
    lines = [L(1, "2024-12-31", 1, 1, 5), L(2, "2024-12-31", 2, 1, 5), L(3, "2024-12-01", 3, 1, 5)]
    star = make_star(spark, lines)
    got = rows(customers.recency_rank(star), "customer_key", "activity_rank", "last_activity")
    assert got == [(1, 1, 0), (2, 1, 0), (3, 2, 30)]


@pytest.mark.parametrize("n", [1, 3, 5, 6])
def test_spend_tiers_sizes(spark, n):
    lines = [L(i, "2024-01-01", i, 1, 10 * i) for i in range(1, n + 1)]
    star = make_star(spark, lines)
    got = rows(customers.spend_tiers(star), "customer_key", "spending_quartile", "spending_tier")
    sizes = {}
    for _, q, _ in got:
        sizes[q] = sizes.get(q, 0) + 1
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert got[-1][2] == ("top spender (vip)" if n >= 4 else got[-1][2])
    assert got[0][1] == 1 and got[0][2] == "low spender"


def test_top_percentile_single_customer(spark):
    star = make_star(spark, [L(1, "2024-01-01", 1, 1, 10)])
    assert rows(customers.top_percentile(star), "customer_id", "pr") == [("CUST0000001", 0.0)]


# --- module D -------------------------------------------------------------------------------

def test_single_month_product(spark):
    star = make_star(spark, [L(1, "2024-01-01", 1, 1, 10), L(2, "2024-01-09", 1, 1, 10)])
    assert rows(products.volatility(star), "product_key", "revenue_volatility") == [(1, None)]
    assert rows(products.consistency(star), "consistency_tier") == [("High Volatility",)]


def test_consistency_zero_and_negative_profit(spark):
    lines = [L(1, "2024-01-01", 1, 1, 10, cost=10), L(2, "2024-02-01", 1, 1, 10, cost=10),
             L(3, "2024-01-01", 1, 2, 10, cost=12), L(4, "2024-02-01", 1, 2, 10, cost=13)]
    star = make_star(spark, lines)
    got = rows(products.consistency(star), "product_key", "consistency_tier")
    assert got == [(1, "No Profit Data"), (2, "Highly Consistent")]


def test_sustained_decline_runs_and_gaps(spark):
    three = [(1, 40), (3, 30), (5, 20), (6, 10)]   # gaps skipped: 3 declines in a row
    two = [(1, 40), (2, 30), (3, 20), (4, 25)]     # only 2 declines in a row
    lines = [L(i, f"2024-{m:02d}-01", 1, 1, v) for i, (m, v) in enumerate(three, 1)]
    lines += [L(100 + i, f"2024-{m:02d}-01", 1, 2, v) for i, (m, v) in enumerate(two, 1)]
    star = make_star(spark, lines)
    assert rows(products.sustained_decline(star), "product_key") == [(1,)]


def test_trending_new_and_stable(spark):
    lines = [L(1, "2024-08-30", 1, 1, 10, category_key=1),          # recent only -> new category
             L(2, "2024-01-15", 1, 2, 10, category_key=2),           # history
             L(3, "2024-08-15", 1, 2, 10, category_key=2)]           # recent == history -> stable
    star = make_star(spark, lines, end="2024-08-31")
    got = rows(products.trending(star), "category_name", "trend_status", "growth_rate_pct")
    assert got == [("Cat A", "new category", None), ("Cat B", "stable", 0.0)]


def test_trending_month_end_cutoff(spark):
    # max date 2024-08-31 -> cutoff 2024-02-29 (clamped); 02-29 is history, 03-01 recent
    lines = [L(1, "2024-02-29", 1, 1, 10), L(2, "2024-03-01", 1, 1, 7)]
    star = make_star(spark, lines, end="2024-08-31")
    r = products.trending(star).collect()[0]
    assert (r.recent_revenue, r.historical_revenue, r.trend_status) == (7.0, 10.0, "trending down")


def test_seasonality_yoy(spark):
    lines = [L(1, "2023-03-01", 1, 1, 10), L(2, "2024-03-01", 1, 1, 15)]
    star = make_star(spark, lines, start="2023-01-01")
    got = rows(products.seasonality(star), "year", "prev_year_revenue", "yoy_growth_pct")
    assert got == [(2023, None, None), (2024, 10.0, 50.0)]


# --- recommendation ---------------------------------------------------------------------------

def test_co_purchase_counts_line_pairs(spark):
    lines = [L(1, "2024-01-01", 1, 1, 5), L(1, "2024-01-01", 1, 1, 5), L(1, "2024-01-01", 1, 2, 5),
             L(2, "2024-01-01", 1, 3, 5)]  # product 1 twice in order 1; order 2 single line
    star = make_star(spark, lines)
    got = rows(recommend.co_purchase(star), "product_a", "product_b", "co_purchase_score")
    assert got == [(1, 2, 2), (2, 1, 2)]


def test_recency_empty_and_scores(spark):
    prods = [(1, "P1", "p1", "B1", "Entry", None, 0), (2, "P2", "p2", "B1", "Luxury", None, 49),
             (3, "P3", "p3", "B2", "Entry", None, 50)]
    lines = [L(1, "2024-01-01", 1, 1, 5), L(1, "2024-01-01", 1, 2, 0, cost=0),
             L(1, "2024-01-01", 1, 3, 5)]
    star = make_star(spark, lines, products=prods)
    assert recommend.recency(star).count() == 0  # nothing within 30 days of 2024-12-31
    prof = dict(rows(recommend.product_profit(star), "product_key", "profit_score"))
    assert prof[2] is None and prof[1] == pytest.approx(0.4)
    stock = rows(recommend.stock_score(star), "product_a", "product_b", "stock_score")
    assert {(a, b): s for a, b, s in stock}[(3, 1)] == 0.0
    assert {(a, b): s for a, b, s in stock}[(1, 2)] == 0.5
    assert {(a, b): s for a, b, s in stock}[(1, 3)] == 1.0
    cat = {(a, b): s for a, b, s in rows(recommend.category_affinity(star), "product_a", "product_b",
                                           "category_score")}
    assert (cat[(1, 3)], cat[(1, 2)], cat[(2, 3)]) == (1.0, 0.7, 0.3)


def test_top_k_and_for_product(spark):
    lines = []
    oid = 0
    for partner, times in [(2, 5), (3, 4), (4, 3), (5, 2), (6, 1)]:
        for _ in range(times):
            oid += 1
            lines += [L(oid, "2024-12-20", 1, 1, 5), L(oid, "2024-12-20", 1, partner, 5)]
    star = make_star(spark, lines)
    top = rows(recommend.top_k(star).where("product_a = 1"), "rn", "product_b")
    assert top == [(1, 2), (2, 3), (3, 4), (4, 5)]
    cards = rows(recommend.for_product(star, 1), "rn", "product_b", "product_id")
    assert cards == [(1, 2, "PROD000002"), (2, 3, "PROD000003"), (3, 4, "PROD000004"),
                     (4, 5, "PROD000005")]


# --- data quality ------------------------------------------------------------------------------

def test_dq_reports_find_problems(spark):
    prods = [(1, "P1", "p1", "B", "Entry", dt.date(2024, 6, 1), 5),
             (1, "P1b", "p1", "B", "Entry", None, -3)]  # duplicate key, negative stock
    lines = [L(1, "2024-01-01", 1, 1, 10),                 # before launch
             L(2, "2024-02-01", 1, 9, 10),                 # orphan product 9
             L(3, "2024-03-01", 1, 1, 10, gross=5, discount=0)]  # wrong net, via gross
    star = make_star(spark, lines, products=prods)
    pk = {r.table_name: r.duplicate_keys for r in dq.primary_key_report(star).collect()}
    assert pk["dim_product"] == 1 and pk["dim_date"] == 0
    fk = {r.fk_column: r.orphan_rows for r in dq.foreign_key_report(star).collect()}
    assert fk["product_key"] == 1 and fk["date_key"] == 0
    chk = {r.rule_name: r.violations for r in dq.check_report(star).collect()}
    assert chk["chk_stock"] == 1 and chk["chk_quantity"] == 0
    ident = {r.rule_name: r.violations for r in dq.measure_identity_report(star).collect()}
    assert ident["net_eq_gross_minus_discount"] == 1
    t = dq.temporal_integrity_report(star).collect()[0]
    assert t.before_launch == 2  # order 1 and order 3 join both product-1 rows... counted per row
    nn = {(r.table_name, r.column_name): r.null_count for r in dq.not_null_report(star).collect()}
    assert nn[("dim_product", "launch_date")] == 1 and nn[("fact_order_line", "net_amount")] == 0
    assert len(nn) == sum(len(s.fields) for s in SCHEMAS.values()) - 1


def test_apply_defaults(spark):
    star = make_star(spark, [L(1, "2024-01-01", 1, 1, 10)],
                     categories=[(1, "Cat A", None, False)])
    filled = dq.apply_defaults(star)
    assert filled.dim_category.collect()[0].seasonal_flag is False


def test_last_mtd_equals_monthly_revenue(star):
    """Invariant on the conformed star: the last month-to-date value of each
    month is that month's revenue."""
    from pyspark.sql import functions as F
    from pyspark.sql import Window

    mtd = timeseries.mtd_revenue(star)
    last = mtd.withColumn("r", F.row_number().over(
        Window.partitionBy("year", "month").orderBy(F.col("day").desc()))).where("r = 1")
    monthly = kpis.revenue_by_period(star, "month")
    joined = last.join(monthly, ["year", "month"])
    assert joined.count() == monthly.count()
    assert joined.where(F.abs(F.col("mtd_revenue") - F.col("revenue")) > 1e-6).count() == 0


def test_as_of_parameter_moves_recency_window(spark):
    lines = [L(1, "2024-06-10", 1, 1, 5), L(1, "2024-06-10", 1, 2, 5)]
    star = make_star(spark, lines)
    assert recommend.recency(star).count() == 0
    assert recommend.recency(star.with_as_of("2024-06-20")).count() == 2


def test_revenue_by_period_filter(spark):
    lines = [L(1, "2023-03-01", 1, 1, 10), L(2, "2024-03-01", 1, 1, 20), L(3, "2024-07-01", 1, 1, 40)]
    star = make_star(spark, lines, start="2023-01-01")
    assert rows(kpis.revenue_by_period(star, "year"), "year", "revenue") == [(2023, 10.0), (2024, 60.0)]
    assert rows(kpis.revenue_by_period(star, "quarter", year=2024), "year", "quarter", "revenue") == \
        [(2024, 1, 20.0), (2024, 3, 40.0)]
    assert rows(kpis.revenue_by_period(star, "month", month=3), "year", "month", "revenue") == \
        [(2023, 3, 10.0), (2024, 3, 20.0)]


def test_association_weight_adds_lift(spark):
    lines = [L(1, "2024-12-20", 1, 1, 5), L(1, "2024-12-20", 1, 2, 5),
             L(2, "2024-12-20", 1, 1, 5), L(2, "2024-12-20", 1, 3, 5),
             L(3, "2024-12-20", 1, 4, 5)]
    star = make_star(spark, lines)
    base = {(a, b): s for a, b, s in rows(recommend.final_scores(star), "product_a", "product_b",
                                          "recommendation_score")}
    lift = {(a, b): v for a, b, v in rows(recommend.association(star), "product_a", "product_b", "lift")}
    # 3 orders; product 1 in 2 of them, product 2 in 1, both together in 1: lift = 1*3/(2*1)
    assert lift[(1, 2)] == 1.5 and lift[(2, 1)] == 1.5
    mixed = {(a, b): s for a, b, s in rows(recommend.final_scores(star, weights={"association": 0.1}),
                                           "product_a", "product_b", "recommendation_score")}
    assert set(mixed) == set(base)
    assert all(abs(mixed[p] - (base[p] + 0.1 * lift[p])) < 1e-5 for p in base)


def test_for_product_id_matches_key(spark):
    lines = [L(1, "2024-12-20", 1, 1, 5), L(1, "2024-12-20", 1, 2, 5), L(2, "2024-12-20", 1, 1, 5),
             L(2, "2024-12-20", 1, 3, 5), L(2, "2024-12-20", 1, 2, 5)]
    star = make_star(spark, lines)
    by_key = rows(recommend.for_product(star, 1), "rn", "product_b", "recommendation_score")
    by_id = rows(recommend.for_product_id(star, "PROD000001"), "rn", "product_b", "recommendation_score")
    assert by_key == by_id and [r[1] for r in by_key] == [2, 3]


def test_varchar_length_rules(spark):
    prods = [(1, "P" * 21, "x" * 101, "B", "Entry", None, 5), (2, "PROD2", "ok", "B", "Entry", None, 5)]
    star = make_star(spark, [L(1, "2024-01-01", 1, 1, 10)], products=prods)
    chk = {r.rule_name: r.violations for r in dq.check_report(star).collect()}
    assert chk["len_dim_product_product_id"] == 1 and chk["len_dim_product_product_name"] == 1
    assert chk["len_dim_product_brand"] == 0 and chk["len_dim_date_month_name"] == 0


def test_average_money_is_exact_at_any_total(spark):
    from decimal import Decimal

    from pyspark.sql import functions as F

    from ledgerline.functions.exprs import avg_money

    cases = [("1000000000000000000.00", 3, 333333333333333333.33), ("1000000000000000000.00", 1, 1e18),
             ("47000000000000000.05", 1_000_000_000, 47000000.0), ("-10.01", 2, -5.01), ("10.01", 2, 5.01),
             ("0.00", 7, 0.0), ("5.00", 0, None)]
    df = spark.createDataFrame([(Decimal(s), n) for s, n, _ in cases], "s decimal(32,2), n long")
    assert [r[0] for r in df.select(avg_money("s", "n").alias("a")).collect()] == [a for *_, a in cases]
