"""Module D: products and categories over time.

Per-product windows are partitioned by product over monthly rows, so a
partition holds at most one row per calendar month however much the product
sells. Category-level windows run over one row per category.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.exprs import avg_money, dbl, growth, safe_div
from ledgerline.model import Star
from ledgerline.operators._common import by_date, by_key_and_date, dated_rows, money_out
from ledgerline.plans.group_totals import moments, stddev_samp
from ledgerline.plans.joins import calendar_end_col, join_dim


def volatility(star: Star) -> DataFrame:
    """Monthly revenue per product with the product's sample standard
    deviation across its months (2 dp; NULL for a single month)."""
    monthly = by_key_and_date(star, "product_key", "net_amount", "revenue", "year", "month")
    monthly = join_dim(monthly, star, "dim_product", "product_key", "product_name")
    # one range exchange on the product serves both the per-product window (a
    # row per month, so bounded by the calendar) and the final ORDER BY
    monthly = monthly.repartitionByRange("product_key")
    each = Window.partitionBy("product_key")
    rows = monthly.select("*", *moments("revenue", over=each))
    return rows.select(
        "product_key", "product_name", "year", "month",
        money_out("revenue", "revenue"),
        F.round(stddev_samp(), 2).alias("revenue_volatility"),
    ).orderBy("product_key", "year", "month")


def trending(star: Star, months: int = 6) -> DataFrame:
    """Category revenue in the last ``months`` months of the calendar against
    all earlier history, ranked by growth (NULL growth last)."""
    cutoff = F.add_months(calendar_end_col(star), -months)
    daily = dated_rows(star, ["category_key"], "net_amount", "rev", "full_date")
    zero = F.lit(0).cast("decimal(12,2)")
    per = daily.groupBy("category_key").agg(
        F.sum(F.when(F.col("full_date") > cutoff, F.col("rev")).otherwise(zero)).alias("recent"),
        F.sum(F.when(F.col("full_date") <= cutoff, F.col("rev")).otherwise(zero)).alias("hist"),
    )
    per = join_dim(per, star, "dim_category", "category_key", "category_name")
    g = growth("recent", "hist")
    return per.select(
        "category_name",
        F.round(dbl("recent"), 2).alias("recent_revenue"),
        F.round(dbl("hist"), 2).alias("historical_revenue"),
        F.round(g * F.lit(100.0), 2).alias("growth_rate_pct"),
        F.rank().over(Window.orderBy(g.desc_nulls_last())).cast("long").alias("trend_rank"),
        F.when(F.col("hist") == 0, "new category")
        .when(F.col("recent") > F.col("hist"), "trending up")
        .when(F.col("recent") < F.col("hist"), "trending down")
        .otherwise("stable").alias("trend_status"),
    ).orderBy("trend_rank")


def seasonality(star: Star) -> DataFrame:
    """Revenue per (year, month) against the same month a year earlier."""
    monthly = by_date(star, "net_amount", "revenue", "year", "month", "month_name")
    prev = F.lag("revenue").over(Window.partitionBy("month").orderBy("year"))
    m = monthly.select("year", "month", "month_name", "revenue", prev.alias("prev"))
    return m.select(
        "year", "month", "month_name",
        money_out("revenue", "revenue"),
        money_out("prev", "prev_year_revenue"),
        F.round(growth("revenue", "prev") * F.lit(100.0), 2).alias("yoy_growth_pct"),
    ).orderBy("month", "year")


def consistency(star: Star) -> DataFrame:
    """Mean and sample deviation of monthly profit per product, coefficient of
    variation (4 dp) and a consistency tier."""
    monthly = by_key_and_date(star, "product_key", "profit_amount", "mp", "year", "month")
    stats = monthly.groupBy("product_key").agg(
        F.sum("mp").alias("s"), F.count(F.lit(1)).alias("n"), *moments("mp"))
    stats = join_dim(stats, star, "dim_product", "product_key", "product_name")
    stats = stats.withColumn("sd", stddev_samp())
    avg = safe_div("s", "n")
    cv = F.col("sd") / F.nullif(avg, F.lit(0.0))
    return stats.select(
        "product_key", "product_name",
        avg_money("s", "n").alias("avg_monthly_profit"),
        F.round("sd", 2).alias("profit_std_dev"),
        F.round(cv, 4).alias("coeff_of_variation"),
        F.when(F.col("s") == 0, "No Profit Data")
        .when(cv < 0.15, "Highly Consistent")
        .when(cv < 0.50, "Stable Earner")
        .otherwise("High Volatility").alias("consistency_tier"),
    ).orderBy(F.col("coeff_of_variation").asc_nulls_last())


def sustained_decline(star: Star, periods: int = 3) -> DataFrame:
    """Products whose revenue fell in ``periods`` consecutive months with sales."""
    monthly = by_key_and_date(star, "product_key", "net_amount", "revenue", "year", "month")
    m = monthly.select("product_key", (F.col("year") * 100 + F.col("month")).alias("period"), "revenue")
    w = Window.partitionBy("product_key").orderBy("period")
    flagged = m.select(
        "product_key", "period",
        F.when(F.col("revenue") < F.lag("revenue").over(w), 1).otherwise(0).alias("is_decline"))
    runs = flagged.select(
        "product_key",
        F.sum("is_decline").over(w.rowsBetween(-(periods - 1), Window.currentRow)).alias("declines"))
    hit = runs.where(F.col("declines") == periods).select("product_key").distinct()
    return join_dim(hit, star, "dim_product", "product_key", "product_name").select(
        "product_key", "product_name")
