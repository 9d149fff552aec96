"""Recommendation cards as a lookup: what a product's score needs, filed under the product.

``build`` writes, once per star, one row per (product, order, day) with the lines
of the product and the whole basket of the order, clustered by product; and one
row per product with its mean margin and number of lines. A card then reads the
rows of its product (Parquet statistics prune files, row groups and pages), which
are as many as the product has orders, and never the fact.

A basket stands once per product in it, so orders of more than ``LARGE_BASKET``
products would grow with the square of their size. Their baskets are written
once, as rows in buckets of the order, and joined for the products that have any;
the join's partition filter reads only the buckets of those orders.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.model import Star
from ledgerline.plans.joins import as_of_col, estimated_bytes, join_dim
from ledgerline.plans.materialize import stage
from ledgerline.plans.global_window import range_buckets
from ledgerline.session import scratch_dir

LARGE_BASKET = 500  # products
BASKET_BUCKETS = 256  # of the large baskets, by order
ROW_GROUP_BYTES = 16 * 1024 * 1024


@dataclass(frozen=True)
class ProductIndex:
    """``orders``: product_key, order_id, full_date, n, partners (null: a large basket);
    ``large``: bucket, order_id, partner, n; ``products``: product_key, margin, lines."""

    orders: DataFrame
    large: DataFrame
    products: DataFrame


def build(star: Star, margins: DataFrame, n_ranges: int | None = None, large_basket: int = LARGE_BASKET) -> ProductIndex:
    """Write the index of a star; ``margins`` has product_key, margin."""
    spark = star.spark
    fact = star.fact_order_line
    lines = join_dim(fact.select("order_id", "product_key", "date_key"), star, "dim_date", "date_key", "full_date")
    own = stage(lines.groupBy("order_id", "product_key", "full_date").agg(F.count(F.lit(1)).alias("n")), "product-orders")
    basket = own.groupBy("order_id", "product_key").agg(F.sum("n").alias("n"))
    sizes = own.groupBy("order_id").agg(F.count_distinct("product_key").alias("products"))
    large = stage(sizes.where(F.col("products") > large_basket).select("order_id"), "large-baskets")
    entry = F.struct(F.col("product_key").alias("partner"), F.col("n").alias("n"))
    small = basket.join(large, "order_id", "left_anti").groupBy("order_id").agg(F.collect_list(entry).alias("partners"))
    rows = own.join(small, "order_id", "left").select("product_key", "order_id", "full_date", "n", "partners")
    ranges = n_ranges or range_buckets(spark, 4 * estimated_bytes(own, star.rows.get("fact_order_line", 0)))
    path = f"{scratch_dir(spark)}/product-index-{uuid.uuid4().hex}"
    clustered = rows.repartitionByRange(ranges, "product_key", "order_id").sortWithinPartitions("product_key")
    clustered.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{path}/orders")
    bucket = F.pmod(F.xxhash64("order_id"), F.lit(BASKET_BUCKETS)).cast("int").alias("bucket")
    apart = basket.join(large, "order_id", "left_semi").select(bucket, "order_id", F.col("product_key").alias("partner"), "n")
    apart.repartition("bucket", F.pmod(F.xxhash64("partner"), F.lit(16))).write.partitionBy("bucket").parquet(f"{path}/large")
    counts = own.groupBy("product_key").agg(F.sum("n").alias("lines"))
    margins.join(counts, "product_key", "full").write.parquet(f"{path}/products")
    schema = "order_id string, partner long, n long, bucket int"
    return ProductIndex(spark.read.parquet(f"{path}/orders"), spark.read.schema(schema).parquet(f"{path}/large"),
                        spark.read.parquet(f"{path}/products"))


def partners(star: Star, index: ProductIndex, key: Column, days: int) -> DataFrame:
    """product_a, product_b, co_purchase_score, recency_score of one product's partners."""
    mine = index.orders.where(F.col("product_key") == key)
    recent = F.when(F.col("full_date") >= F.date_sub(as_of_col(star), days), F.col("n")).otherwise(F.lit(0))
    mine = mine.select(F.col("product_key").alias("product_a"), "order_id", "n", recent.alias("r"), "partners")
    met = mine.where(F.col("partners").isNotNull()).select("product_a", "n", "r", F.explode("partners").alias("p"))
    met = met.select("product_a", "n", "r", F.col("p.partner").alias("product_b"), F.col("p.n").alias("n_b"))
    bucket = F.pmod(F.xxhash64("order_id"), F.lit(BASKET_BUCKETS)).cast("int").alias("bucket")
    apart = mine.where(F.col("partners").isNull()).select("product_a", "order_id", "n", "r", bucket)
    apart = apart.join(index.large.withColumnRenamed("n", "n_b"), ["bucket", "order_id"])
    pairs = met.unionByName(apart.select("product_a", "n", "r", F.col("partner").alias("product_b"), "n_b"))
    return pairs.where(F.col("product_a") != F.col("product_b")).groupBy("product_a", "product_b").agg(
        F.sum(F.col("n") * F.col("n_b")).alias("co_purchase_score"), F.sum(F.col("r") * F.col("n_b")).alias("recency_score"))


def best_seller(index: ProductIndex) -> Column:
    """Scalar subquery: the product on most order lines (smallest key on ties)."""
    return index.products.where(F.col("lines").isNotNull()).agg(
        F.min_by("product_key", F.struct(-F.col("lines"), F.col("product_key")))).scalar()
