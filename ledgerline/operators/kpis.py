"""Core business KPIs over the order-line fact.

Money is summed as exact DECIMAL(12,2) and converted to double only at the
output; ratios divide doubles of the exact sums and guard the divisor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.exprs import avg_money, dbl, safe_div
from ledgerline.model import Star
from ledgerline.operators._common import by_date, money_out

GRAINS = {
    "year": ("year",),
    "quarter": ("year", "quarter"),
    "month": ("year", "month"),
    "day": ("full_date",),
}


def total_revenue(star: Star) -> DataFrame:
    """SUM(net_amount) over all order lines."""
    return star.fact_order_line.agg(money_out(F.sum("net_amount"), "total_revenue"))


def revenue_by_period(star: Star, grain: str = "month", year: int | None = None,
                      quarter: int | None = None, month: int | None = None) -> DataFrame:
    """Revenue per year, quarter, month or day, optionally only inside one
    period (the filter applies to the calendar, so the fact is reduced in the
    calendar join)."""
    keys = GRAINS[grain]
    wanted = {"year": year, "quarter": quarter, "month": month}
    cond = [F.col(c) == v for c, v in wanted.items() if v is not None]
    if cond:
        cal = star.dim_date
        for c in cond:
            cal = cal.where(c)
        star = star.with_tables(dim_date=cal)
    return by_date(star, "net_amount", "revenue", *keys).select(
        *keys, money_out("revenue", "revenue"))


def gross_profit(star: Star) -> DataFrame:
    """SUM(profit_amount)."""
    return star.fact_order_line.agg(money_out(F.sum("profit_amount"), "gross_profit"))


def avg_order_value(star: Star) -> DataFrame:
    """ROUND(SUM(net) / COUNT(DISTINCT order_id), 2)."""
    per_order = star.fact_order_line.groupBy("order_id").agg(F.sum("net_amount").alias("net"))
    totals = per_order.agg(F.sum("net").alias("s"), F.count(F.lit(1)).alias("n"))
    return totals.select(avg_money("s", "n").alias("avg_order_value"))


def clv_per_customer(star: Star) -> DataFrame:
    """Lifetime spend of every customer."""
    return star.fact_order_line.groupBy("customer_key").agg(
        money_out(F.sum("net_amount"), "total_spend"))


def clv(star: Star) -> DataFrame:
    """Average, minimum and maximum customer lifetime spend (2 dp)."""
    spend = star.fact_order_line.groupBy("customer_key").agg(F.sum("net_amount").alias("spend"))
    totals = spend.agg(F.sum("spend").alias("s"), F.count(F.lit(1)).alias("n"),
                       F.min("spend").alias("lo"), F.max("spend").alias("hi"))
    return totals.select(
        avg_money("s", "n").alias("avg_customer_lifetime_value"),
        F.round(dbl("lo"), 2).alias("min_clv"),
        F.round(dbl("hi"), 2).alias("max_clv"),
    )


def repeat_rate(star: Star) -> DataFrame:
    """Customers, customers with more than one distinct order, and their share (%)."""
    orders = star.fact_order_line.select("customer_key", "order_id").distinct()
    per_customer = orders.groupBy("customer_key").agg(F.count(F.lit(1)).alias("num_orders"))
    repeat = F.sum(F.when(F.col("num_orders") > 1, 1).otherwise(0))
    return per_customer.agg(
        F.count(F.lit(1)).alias("total_customers"),
        repeat.cast("long").alias("repeat_customers"),
        F.round(safe_div(repeat * F.lit(100.0), F.count(F.lit(1))), 2).alias("repeat_purchase_rate_pct"),
    )


def profit_margin(star: Star) -> DataFrame:
    """ROUND(SUM(profit) * 100 / NULLIF(SUM(net), 0), 2)."""
    f = star.fact_order_line
    return f.agg(F.round(safe_div(F.sum("profit_amount"), F.sum("net_amount")) * F.lit(100.0), 2)
                 .alias("profit_margin_pct"))


def mom_growth(star: Star) -> DataFrame:
    """Monthly revenue, previous month and month-over-month growth (%).

    The LAG runs over one row per calendar month (bounded by the calendar).
    """
    monthly = by_date(star, "net_amount", "revenue", "year", "month")
    prev = F.lag("revenue").over(Window.orderBy("year", "month"))
    return monthly.select(
        "year", "month", "revenue", prev.alias("prev")
    ).select(
        "year", "month",
        F.round(dbl("revenue"), 2).alias("revenue"),
        F.round(dbl("prev"), 2).alias("prev_month_revenue"),
        F.round(safe_div(F.col("revenue") - F.col("prev"), "prev") * F.lit(100.0), 2)
        .alias("mom_growth_rate_pct"),
    ).orderBy("year", "month")
