"""The fact clustered by order: written in buckets of the order id, very large orders apart.

Whatever groups or joins by order reads whole orders from one bucket, so it needs
no exchange above the scan. A bucket is one task, and an order with a large share
of all lines would make one bucket as large; such orders, and the lines without
an order, are written as a table of their own that is shuffled (and split by AQE)
when it is used.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.plans.materialize import shuffles_freed, stage

#: Orders of more lines are kept apart.
LARGE_ORDER_LINES = 100_000


@dataclass(frozen=True)
class ClusteredFact:
    """``orders``: bucketed by order_id; ``large``: lines of large orders and without order (None: there are none)."""

    orders: DataFrame
    large: DataFrame | None
    table: str

    def lines(self) -> DataFrame:
        return self.orders if self.large is None else self.orders.unionByName(self.large)


def write_clustered(fact: DataFrame, path: str, buckets: int, order_ids: DataFrame | None = None,
                    large_lines: int = LARGE_ORDER_LINES) -> ClusteredFact:
    """Write ``fact`` under ``path`` in ``buckets`` buckets; return it as read back.

    ``order_ids`` (one row per line, column order_id) is read to find the large
    orders; give it where that is cheaper than reading ``fact``.
    """
    spark = fact.sparkSession
    ids = fact if order_ids is None else order_ids
    sizes = ids.groupBy("order_id").agg(F.count(F.lit(1)).alias("n"))
    large = stage(sizes.where((F.col("n") > large_lines) | F.col("order_id").isNull()).select("order_id"), "large-orders")
    apart = bool(large.head(1))
    rest = fact.where(F.col("order_id").isNotNull()).join(large, "order_id", "left_anti").select(*fact.columns) if apart else fact
    name = f"ledgerline_orders_{uuid.uuid4().hex}"
    writer = rest.repartition(buckets, "order_id").write.mode("error").format("parquet").option("compression", "zstd")
    with shuffles_freed(spark):
        writer.option("path", f"{path}/orders").bucketBy(buckets, "order_id").sortBy("order_id").saveAsTable(name)
    kept = None
    if apart:
        named = fact.where(F.col("order_id").isNotNull()).join(large, "order_id", "left_semi").select(*fact.columns)
        with shuffles_freed(spark):
            named.unionByName(fact.where(F.col("order_id").isNull())).write.mode("error").parquet(f"{path}/large")
        kept = spark.read.parquet(f"{path}/large")
    return ClusteredFact(spark.table(name), kept, name)
