"""Window functions over single orders: groups and ties of any size.

The reports aggregate before their windows, so their frames run over days or
months. These run the same functions on the orders themselves, where one group
(a priority, a customer) or one key (a day) may hold a large share of all rows;
every frame is computed by the range-bucketed global window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.exprs import avg_money, dbl
from ledgerline.model import MONEY
from ledgerline.plans.global_window import (
    DENSE_RANK,
    FRAME_COUNT,
    FRAME_SUM,
    LAG,
    RANGE_SUM,
    RANK,
    ROW_NUMBER,
    RUNNING_SUM,
    global_window,
    range_buckets,
)
from ledgerline.plans.joins import estimated_bytes

FRAME_ORDERS = 7  # rows of a moving average


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order_key, customer_key, priority, order_date, price): all orders; a missing price counts as 0."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/orders.parquet")
    price = F.coalesce(F.col("o_totalprice").cast(MONEY), F.lit(0).cast(MONEY))
    return df.select(
        F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("customer_key"),
        F.col("o_orderpriority").alias("priority"), F.to_date("o_orderdate").alias("order_date"), price.alias("price"))


def _buckets(df: DataFrame) -> int:
    return range_buckets(df.sparkSession, estimated_bytes(df, df.count()))  # the count reads file footers


def all_ordinals(df: DataFrame, frame: int = FRAME_ORDERS, n_buckets: int | None = None) -> DataFrame:
    """Every ordinal of each priority's orders by day, in one pass of the global window.

    ROW_NUMBER, RANK, DENSE_RANK, LAG, running SUM by rows, by days (default RANGE
    frame) and over the last ``frame`` orders.
    """
    df = df.select("priority", "order_key", "order_date", "price")
    g = global_window(df, "order_date", tiebreak=["order_key"], partition_by=["priority"], value="price", lag=True,
                      dense=True, peers=True, frame=frame, n_buckets=n_buckets or _buckets(df))
    return g.select(
        "priority", "order_key", "order_date",
        F.col(ROW_NUMBER).alias("row_no"), F.col(RANK).alias("rank_no"), F.col(DENSE_RANK).alias("dense_rank_no"),
        F.col(LAG).alias("previous_date"), dbl(RUNNING_SUM).alias("sum_by_rows"), dbl(RANGE_SUM).alias("sum_by_days"),
        dbl(FRAME_SUM).alias("sum_of_last"), F.col(FRAME_COUNT).alias("n_last"))


def customer_moving_average(df: DataFrame, frame: int = FRAME_ORDERS, n_buckets: int | None = None) -> DataFrame:
    """Mean price of a customer's last ``frame`` orders, at every order (ROWS n-1 PRECEDING)."""
    df = df.select("customer_key", "order_key", "order_date", "price")
    g = global_window(df, "order_date", tiebreak=["order_key"], partition_by=["customer_key"], value="price",
                      frame=frame, n_buckets=n_buckets or _buckets(df))
    return g.select("customer_key", "order_key", "order_date", dbl("price").alias("price"),
                    F.col(FRAME_COUNT).alias("n_orders"), avg_money(FRAME_SUM, FRAME_COUNT).alias("moving_avg"))


def revenue_through_day(df: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """Every order with all revenue through its day: the running SUM whose peers are the orders of one day."""
    df = df.select("order_key", "order_date", "price")
    g = global_window(df, "order_date", tiebreak=["order_key"], value="price", peers=True, n_buckets=n_buckets or _buckets(df))
    return g.select("order_key", "order_date", dbl("price").alias("price"), dbl(RANGE_SUM).alias("revenue_through_day"))
