"""Module C: customer behaviour.

Per-customer series are reduced to one row per (customer, day) or per
customer before any window. Windows that span all customers (quartiles,
percentiles) and per-customer order histories (one customer may own a huge
share of orders) use the range-bucketed global window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.constants import SPENDING_TIERS
from ledgerline.functions.exprs import case_map, ntile_from_row_number
from ledgerline.model import Star
from ledgerline.operators._common import buckets_for, money_out
from ledgerline.plans.global_window import (
    BUCKET, COUNT, LAG, RANK, ROW_NUMBER, global_window, percent_rank,
)
from ledgerline.plans.joins import as_of_col, broadcast_limit, estimated_bytes, join_dim


def cumulative_spend(star: Star) -> DataFrame:
    """Daily spend of each customer and its running total.

    A customer's partition holds at most one row per calendar day, so the
    window is bounded by the calendar whatever the customer's volume.
    """
    daily = star.fact_order_line.groupBy("customer_key", "date_key").agg(
        F.sum("net_amount").alias("spend"))
    daily = join_dim(daily, star, "dim_date", "date_key", "full_date")
    daily = join_dim(daily, star, "dim_customer", "customer_key", "customer_id")
    # one range exchange on the customer serves both the per-customer window
    # (clustered by customer) and the final ORDER BY (customer, date)
    daily = daily.repartitionByRange("customer_key")
    w = Window.partitionBy("customer_key").orderBy("full_date").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return daily.select(
        "customer_key",
        F.col("customer_id").alias("customer_name"),
        "full_date",
        money_out("spend", "daily_spend"),
        money_out(F.sum("spend").over(w), "cumulative_spend"),
    ).orderBy("customer_key", "full_date")


def purchase_intervals(star: Star) -> DataFrame:
    """Days between a customer's consecutive purchases.

    One row per distinct (customer, order, date); LAG over date, then order id
    for orders on the same day.
    """
    visits = star.fact_order_line.select("customer_key", "order_id", "date_key").distinct()
    visits = join_dim(visits, star, "dim_date", "date_key", "full_date")
    visits = join_dim(visits, star, "dim_customer", "customer_key", "customer_id")
    visits = visits.select("customer_id", "order_id", F.col("full_date").alias("order_date"))
    g = global_window(visits, "order_date", tiebreak=["order_id"], partition_by=["customer_id"],
                      lag=True, ordered_output=True, n_buckets=buckets_for(star, "fact_order_line", visits))
    g = g.orderBy(BUCKET, "customer_id", "order_date", "order_id")  # the window's own order
    return g.select(
        "customer_id", "order_id",
        F.col("order_date").alias("current_purchase_date"),
        F.col(LAG).alias("prev_purchase_date"),
        F.datediff("order_date", LAG).alias("days_between_purchases"),
    )


def recency_rank(star: Star) -> DataFrame:
    """DENSE_RANK of customers by days since their last order (1 = most recent).

    Days-since values come from the calendar, so the ranking is computed on
    the distinct day counts (at most one per calendar day) and joined back.
    """
    dated = join_dim(star.fact_order_line.select("customer_key", "date_key"), star, "dim_date",
                     "date_key", "full_date")
    last = dated.groupBy("customer_key").agg(F.max("full_date").alias("last_date"))
    last = last.select(
        "customer_key", F.datediff(as_of_col(star), "last_date").cast("int").alias("last_activity"))
    days = last.select("last_activity").distinct()
    ranks = days.select(
        "last_activity",
        F.dense_rank().over(Window.orderBy("last_activity")).cast("long").alias("activity_rank"))
    n_days = star.rows.get("dim_date")
    if n_days is not None and estimated_bytes(ranks, n_days) <= broadcast_limit(star):
        ranks = F.broadcast(ranks)  # at most one row per calendar day
    return last.join(ranks, "last_activity").select(
        "customer_key", "activity_rank", "last_activity",
    ).orderBy("last_activity", "customer_key")


def _customer_spend(star: Star) -> DataFrame:
    return star.fact_order_line.groupBy("customer_key").agg(F.sum("net_amount").alias("spend"))


def spend_tiers(star: Star, tiles: int = 4) -> DataFrame:
    """NTILE(4) of customers by ascending spend, labelled low .. top (vip)."""
    per = join_dim(_customer_spend(star), star, "dim_customer", "customer_key", "customer_id")
    per = per.select("customer_key", "customer_id", "spend")
    # NTILE runs over (spend, customer_key) ascending; the window is computed
    # in the exact reverse order, which is also the requested output order
    # (top tier, highest spend first), so no final sort exchange is needed
    g = global_window(per, "spend", descending=True, tiebreak=["customer_key"],
                      tiebreak_descending=True, ordered_output=True,
                      n_buckets=buckets_for(star, "dim_customer", per))
    rn_asc = F.col(COUNT) - F.col(ROW_NUMBER) + 1
    quart = ntile_from_row_number(rn_asc, COUNT, tiles)
    labels = dict(enumerate(SPENDING_TIERS, start=1)) if tiles == 4 else {}
    g = g.orderBy(BUCKET, F.col("spend").desc(), F.col("customer_key").desc())
    return g.select(
        "customer_key",
        F.col("customer_id").alias("customer_name"),
        F.round(F.col("spend").cast("double"), 2).alias("total_spend"),
        quart.alias("spending_quartile"),
        case_map(quart, labels).alias("spending_tier"),
    )


def top_percentile(star: Star, p: float = 0.25) -> DataFrame:
    """Customers whose PERCENT_RANK by descending revenue is at most ``p``."""
    per = join_dim(_customer_spend(star), star, "dim_customer", "customer_key",
                   "customer_id", "customer_segment")
    per = per.select("customer_id", "customer_segment", "spend")
    g = global_window(per, "spend", descending=True, tiebreak=["customer_id"], ordered_output=True,
                      n_buckets=buckets_for(star, "dim_customer", per))
    pr = percent_rank(RANK, COUNT)
    top = g.where(pr <= F.lit(float(p))).orderBy(BUCKET, F.col("spend").desc(), "customer_id")
    return top.select(
        "customer_id", "customer_segment", money_out("spend", "total_revenue"), pr.alias("pr"))


__all__ = ["cumulative_spend", "purchase_intervals", "recency_rank", "spend_tiers", "top_percentile"]
