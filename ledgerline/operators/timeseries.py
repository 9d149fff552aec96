"""Module A: time-based performance.

Every series is first reduced to one row per day or month, so the ordered
windows below run over calendar-sized inputs (days or months), never over
order lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.exprs import dbl, growth
from ledgerline.model import Star
from ledgerline.operators._common import by_date, money_out
from ledgerline.plans.joins import as_of_col

UNBOUNDED = Window.unboundedPreceding


def yearly_revenue(star: Star) -> DataFrame:
    """Revenue per year (what the cumulative query computes as coded: the
    window is partitioned by the year it orders by, i.e. an annual total)."""
    yearly = by_date(star, "net_amount", "revenue", "year")
    return yearly.select("year", money_out("revenue", "revenue")).orderBy("year")


def cumulative_revenue(star: Star) -> DataFrame:
    """Running revenue by date from the first day (the documented intent)."""
    daily = by_date(star, "net_amount", "daily_revenue", "full_date")
    w = Window.orderBy("full_date").rowsBetween(UNBOUNDED, Window.currentRow)
    return daily.select(
        "full_date",
        money_out("daily_revenue", "daily_revenue"),
        money_out(F.sum("daily_revenue").over(w), "cumulative_revenue"),
    ).orderBy("full_date")


def mtd_revenue(star: Star) -> DataFrame:
    """Month-to-date revenue per day (default RANGE frame: all earlier days of the month)."""
    daily = by_date(star, "net_amount", "daily_revenue", "full_date", "day", "month", "year")
    w = Window.partitionBy("year", "month").orderBy("full_date").rangeBetween(
        UNBOUNDED, Window.currentRow)
    return daily.select(
        "day", "month", "year", money_out(F.sum("daily_revenue").over(w), "mtd_revenue"),
    )


def ytd_profit(star: Star) -> DataFrame:
    """Daily profit and its year-to-date running total."""
    daily = by_date(star, "profit_amount", "daily_profit", "year", "month", "full_date")
    w = Window.partitionBy("year").orderBy("full_date").rowsBetween(UNBOUNDED, Window.currentRow)
    return daily.select(
        "year", "month", "full_date",
        money_out("daily_profit", "daily_profit"),
        money_out(F.sum("daily_profit").over(w), "ytd_profit"),
    ).orderBy("full_date")


def moving_average(star: Star, n: int = 7) -> DataFrame:
    """AVG of daily revenue over the current and ``n-1`` preceding *rows*
    (days with sales, not calendar days)."""
    daily = by_date(star, "net_amount", "daily_revenue", "full_date")
    w = Window.orderBy("full_date").rowsBetween(-(n - 1), Window.currentRow)
    avg = dbl(F.sum("daily_revenue").over(w)) / F.count(F.lit(1)).over(w).cast("double")
    return daily.select(
        "full_date", money_out("daily_revenue", "daily_revenue"), avg.alias(f"moving_avg_{n}"),
    ).orderBy("full_date")


def mom_compare(star: Star) -> DataFrame:
    """Each year's as-of calendar month against the month before it.

    The LAG runs over all months first; only then are rows kept for the
    as-of month (a first month or an equal month is 'DECLINE').
    """
    monthly = by_date(star, "net_amount", "cur", "year", "month")
    prev = F.lag("cur").over(Window.orderBy("year", "month"))
    with_prev = monthly.select("year", "month", "cur", prev.alias("prev"))
    kept = with_prev.where(F.col("month") == F.month(as_of_col(star)))
    return kept.select(
        "year", "month",
        money_out("cur", "current_month_total"),
        money_out("prev", "previous_month_total"),
        F.when(F.col("cur") > F.col("prev"), "GROWTH").otherwise("DECLINE").alias("performance_indicator"),
    )


def acceleration(star: Star) -> DataFrame:
    """Growth rate per month and whether it sped up or slowed down."""
    monthly = by_date(star, "net_amount", "revenue", "year", "month")
    w = Window.orderBy("year", "month")
    g = monthly.select("year", "month", growth("revenue", F.lag("revenue").over(w)).alias("growth"))
    prev = F.lag("growth").over(w)
    return g.select(
        "year", "month", "growth", prev.alias("prev_growth"),
        F.when(F.col("growth") > prev, "Accelerating")
        .when(F.col("growth") < prev, "Decelerating")
        .otherwise("Stable").alias("revenue_dynamics"),
    )
