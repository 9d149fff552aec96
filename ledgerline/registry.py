"""Every implemented operator as ``(spark, sf_dir) -> DataFrame``.

Each callable conforms (once per application) and reads the star derived
from the source tables in ``sf_dir``; nothing runs on made-up input.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline.model import Star
from ledgerline.operators import customers, dq, kpis, lookup, order_sets, order_windows, products, ranking, recommend, timeseries
from ledgerline.session import scratch_dir
from ledgerline.sources.star_io import catalog_counts, checksums, contents, load_star, save_star
from ledgerline.sources.warehouse import star_for

Query = Callable[[SparkSession, str], DataFrame]


def _on_star(fn: Callable[..., DataFrame], **params) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(star_for(spark, sf_dir), **params)
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def _dim_date(star: Star) -> DataFrame:
    """Calendar dimension: every day from the first to the last order date."""
    return star.dim_date


def _dim_customer(star: Star) -> DataFrame:
    """Customer dimension with region, city (nation) and segment."""
    return star.dim_customer


def _dim_category(star: Star) -> DataFrame:
    """Category dimension, keyed by position of the category name."""
    return star.dim_category


def _dim_product(star: Star) -> DataFrame:
    """Product dimension with brand, subcategory and stock."""
    return star.dim_product


def _fact(star: Star) -> DataFrame:
    """The conformed fact."""
    return star.fact_order_line


def _csv_round_trip(star: Star) -> DataFrame:
    """save_star as CSV, load_star it back: every row of all seven tables."""
    path = f"{scratch_dir(star.spark)}/star-csv-{uuid.uuid4().hex}"
    save_star(star, path, fmt="csv")
    return contents(load_star(star.spark, path, fmt="csv"))


def _parquet_round_trip(star: Star) -> DataFrame:
    """save_star as Parquet, load it back: rows and value checksum of every table."""
    path = f"{scratch_dir(star.spark)}/star-parquet-{uuid.uuid4().hex}"
    save_star(star, path, fmt="parquet")
    return checksums(load_star(star.spark, path, fmt="parquet"))


def _for_best_seller(star: Star) -> DataFrame:
    """Recommendation cards for the product on most order lines."""
    index = recommend.index_of(star)
    return recommend.for_product(star, lookup.best_seller(index), index=index)


def _on_orders(fn: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(order_windows.orders(spark, sf_dir))
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


QUERIES: dict[str, Query] = {
    # sources, sinks, conforming
    "src_star": _on_star(_csv_round_trip),
    "sink_star": _on_star(_parquet_round_trip),
    "dim_date": _on_star(_dim_date),
    "dim_customer": _on_star(_dim_customer),
    "dim_category": _on_star(_dim_category),
    "dim_product": _on_star(_dim_product),
    "fact_order_line": _on_star(_fact),
    "catalog_counts": _on_star(catalog_counts),
    # data quality
    "dq_primary_key": _on_star(dq.primary_key_report),
    "dq_foreign_key": _on_star(dq.foreign_key_report),
    "dq_check": _on_star(dq.check_report),
    "dq_not_null": _on_star(dq.not_null_report),
    "dq_measure_identity": _on_star(dq.measure_identity_report),
    "dq_temporal_integrity": _on_star(dq.temporal_integrity_report),
    # KPIs
    "kpi_total_revenue": _on_star(kpis.total_revenue),
    "kpi_revenue_by_period": _on_star(kpis.revenue_by_period, grain="quarter"),
    "kpi_revenue_by_year": _on_star(kpis.revenue_by_period, grain="year"),
    "kpi_revenue_by_month": _on_star(kpis.revenue_by_period, grain="month"),
    "kpi_revenue_in_1997": _on_star(kpis.revenue_by_period, grain="month", year=1997),
    "kpi_gross_profit": _on_star(kpis.gross_profit),
    "kpi_avg_order_value": _on_star(kpis.avg_order_value),
    "kpi_clv": _on_star(kpis.clv),
    "kpi_clv_per_customer": _on_star(kpis.clv_per_customer),
    "kpi_repeat_rate": _on_star(kpis.repeat_rate),
    "kpi_orders_trailing": _on_star(order_sets.trailing),
    "kpi_profit_margin": _on_star(kpis.profit_margin),
    "kpi_mom_growth": _on_star(kpis.mom_growth),
    # module A
    "q01_yearly_revenue": _on_star(timeseries.yearly_revenue),
    "q01_cumulative_revenue": _on_star(timeseries.cumulative_revenue),
    "q02_mtd_revenue": _on_star(timeseries.mtd_revenue),
    "q03_ytd_profit": _on_star(timeseries.ytd_profit),
    "q04_moving_avg": _on_star(timeseries.moving_average),
    "q05_mom_compare": _on_star(timeseries.mom_compare),
    "q06_acceleration": _on_star(timeseries.acceleration),
    # module B
    "q07_product_rank": _on_star(ranking.product_rank),
    "q08_contribution": _on_star(ranking.contribution),
    "q09_pareto": _on_star(ranking.pareto),
    "q09_pareto_cut": _on_star(ranking.pareto_cut),
    "q10_region_rank": _on_star(ranking.region_rank),
    "q11_brand_rank": _on_star(ranking.brand_rank),
    # module C
    "q12_customer_cumulative": _on_star(customers.cumulative_spend),
    "q13_purchase_intervals": _on_star(customers.purchase_intervals),
    "q14_recency_rank": _on_star(customers.recency_rank),
    "q15_spend_tiers": _on_star(customers.spend_tiers),
    "q16_top_percentile": _on_star(customers.top_percentile),
    # module D
    "q17_volatility": _on_star(products.volatility),
    "q18_trending": _on_star(products.trending),
    "q19_seasonality": _on_star(products.seasonality),
    "q20_consistency": _on_star(products.consistency),
    "q21_sustained_decline": _on_star(products.sustained_decline),
    # window functions over single orders
    "x_global_window": _on_orders(order_windows.all_ordinals),
    "x_customer_moving_avg": _on_orders(order_windows.customer_moving_average),
    "x_revenue_through_day": _on_orders(order_windows.revenue_through_day),
    # recommendation
    "rec_co_purchase": _on_star(recommend.co_purchase),
    "rec_recency": _on_star(recommend.recency),
    "rec_category_affinity": _on_star(recommend.category_affinity),
    "rec_product_profit": _on_star(recommend.product_profit),
    "rec_profit_score": _on_star(recommend.profit_score),
    "rec_stock_score": _on_star(recommend.stock_score),
    "rec_co_purchase_norm": _on_star(recommend.co_purchase_norm),
    "rec_recency_norm": _on_star(recommend.recency_norm),
    "rec_final_scores": _on_star(recommend.final_scores),
    "rec_top_k": _on_star(recommend.top_k),
    "rec_for_product": _on_star(_for_best_seller),
    "rec_association": _on_star(recommend.association),
}
