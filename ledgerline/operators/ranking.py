"""Module B: ranking and contribution.

Facts are aggregated per product or customer key first; dimension names are
attached to the much smaller aggregates. Rankings over all products of a
category, or over all products, use the range-bucketed global window so no
single task has to hold a whole category or the whole table.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.exprs import pct
from ledgerline.model import Star
from ledgerline.operators._common import buckets_for, money_out
from ledgerline.plans.global_window import BUCKET, RANK, RUNNING_SUM, TOTAL, global_window
from ledgerline.plans.joins import join_dim


def _product_revenue(star: Star) -> DataFrame:
    """(product_key, category_key, revenue) - exact decimal sums."""
    return star.fact_order_line.groupBy("product_key", "category_key").agg(
        F.sum("net_amount").alias("revenue"))


def product_rank(star: Star) -> DataFrame:
    """Products ranked by revenue inside their category (RANK, ties share)."""
    per = _product_revenue(star)
    per = join_dim(per, star, "dim_product", "product_key", "product_id", "product_name")
    per = join_dim(per, star, "dim_category", "category_key", "category_name")
    per = per.select("product_id", "product_name", "category_name", "revenue")
    ranked = global_window(per, "revenue", descending=True, tiebreak=["product_id"],
                           partition_by=["category_name"], ordered_output=True,
                           n_buckets=buckets_for(star, "dim_product", per))
    # the window order (category, revenue desc, product_id) is the requested
    # order; sorting by bucket first needs no further exchange
    ranked = ranked.orderBy(BUCKET, "category_name", F.col("revenue").desc(), "product_id")
    return ranked.select(
        "product_id", "product_name", "category_name",
        money_out("revenue", "total_revenue"),
        F.col(RANK).alias("rank_product"),
    )


def contribution(star: Star) -> DataFrame:
    """Each product's share of its category's revenue (aggregated before
    the dimensions are joined)."""
    per = star.fact_order_line.groupBy("category_key", "product_key").agg(
        F.sum("net_amount").alias("prod_rev"))
    # one row per category; joined back by key (no window over a whole category)
    cat = per.groupBy("category_key").agg(F.sum("prod_rev").alias("categ_rev"))
    rb = per.join(cat, "category_key")
    rb = join_dim(rb, star, "dim_category", "category_key", "category_name")
    rb = join_dim(rb, star, "dim_product", "product_key", "product_name")
    return rb.select(
        "category_name", "product_name",
        money_out("prod_rev", "prod_rev"),
        money_out("categ_rev", "categ_rev"),
        pct("prod_rev", "categ_rev").alias("contribution_pct"),
    ).orderBy("category_name", F.col("contribution_pct").desc())


def _pareto_rows(star: Star) -> DataFrame:
    """Products in descending revenue with exact running sums, in output order."""
    per = star.fact_order_line.groupBy("product_key").agg(F.sum("net_amount").alias("revenue"))
    per = join_dim(per, star, "dim_product", "product_key", "product_id", "product_name")
    per = per.select("product_id", "product_name", "revenue")
    g = global_window(per, "revenue", descending=True, tiebreak=["product_id"], value="revenue",
                      ordered_output=True, n_buckets=buckets_for(star, "dim_product", per))
    return g.orderBy(BUCKET, F.col("revenue").desc(), "product_id")  # ORDER BY revenue DESC


def _pareto_columns(g: DataFrame) -> DataFrame:
    return g.select(
        "product_id", "product_name",
        money_out("revenue", "total_revenue"),
        money_out(TOTAL, "grand_total"),
        money_out(RUNNING_SUM, "cumulative_revenue"),
        pct("revenue", TOTAL).alias("percent_of_total"),
        pct(RUNNING_SUM, TOTAL).alias("cumulative_percent"),
    )


def pareto(star: Star) -> DataFrame:
    """Products by revenue with running share of the grand total."""
    return _pareto_columns(_pareto_rows(star))


def pareto_cut(star: Star, threshold: float = 80.0) -> DataFrame:
    """The head of the Pareto curve: products whose exact cumulative share of
    revenue is at most ``threshold`` percent."""
    limit = F.lit(Decimal(str(threshold)))
    head = _pareto_rows(star).where(F.col(RUNNING_SUM) * 100 <= F.col(TOTAL) * limit)
    return _pareto_columns(head).select(
        "product_id", "product_name", "total_revenue", "cumulative_revenue", "cumulative_percent")


def region_rank(star: Star) -> DataFrame:
    """Regions ranked by profit (RANK). Customers are aggregated first; the
    final window runs over one row per region."""
    per = star.fact_order_line.groupBy("customer_key").agg(F.sum("profit_amount").alias("p"))
    per = join_dim(per, star, "dim_customer", "customer_key", "region")
    reg = per.groupBy("region").agg(F.sum("p").alias("total_profit"))
    return reg.select(
        F.rank().over(Window.orderBy(F.col("total_profit").desc())).cast("long").alias("profit_rank"),
        "region",
        F.round(F.col("total_profit").cast("double"), 2).alias("total_profit"),
    ).orderBy("profit_rank")


def brand_rank(star: Star) -> DataFrame:
    """Brands ranked by profit inside each category (window over one row per
    (category, brand): bounded by the brand list, not by sales)."""
    per = star.fact_order_line.groupBy("category_key", "product_key").agg(
        F.sum("profit_amount").alias("p"))
    per = join_dim(per, star, "dim_product", "product_key", "brand")
    cb = per.groupBy("category_key", "brand").agg(F.sum("p").alias("profit"))
    cb = join_dim(cb, star, "dim_category", "category_key", "category_name")
    w = Window.partitionBy("category_key").orderBy(F.col("profit").desc())
    return cb.select(
        "category_name",
        F.rank().over(w).cast("long").alias("brand_rank"),
        "brand",
        money_out("profit", "profit_amount"),
    )
