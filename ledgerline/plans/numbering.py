"""Consecutive numbers over a whole table in a given order, without a one-task sort.

The rows are range-partitioned on the order, sorted inside their range and
written once with their place in the range; a range's offset is the number of
rows before it. One shuffle, and one small row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.plans.global_window import MAX_BUCKETS
from ledgerline.plans.materialize import stage

_PLACE_BITS = 33  # monotonically_increasing_id: partition above, place in it below


def number_rows(df: DataFrame, order: list[str | Column], alias: str, n_ranges: int) -> DataFrame:
    """``df`` with ``alias`` = 1, 2, 3, ... (long) in ascending ``order``, nulls first.

    Rows equal in ``order`` are numbered in no particular order, but each once.
    """
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    n = max(1, min(n_ranges, MAX_BUCKETS))
    placed = df.repartitionByRange(n, *by).sortWithinPartitions(*by)
    ranged = stage(placed.withColumn("_place", F.monotonically_increasing_id()), "numbered", compression="zstd")
    ranged = ranged.withColumn("_range", F.shiftright("_place", _PLACE_BITS))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.col("_place") - F.shiftleft(F.col("_range"), _PLACE_BITS)
    return ranged.join(F.broadcast(offsets), "_range").select(
        *df.columns, (F.col("_before") + inside + 1).cast("long").alias(alias))
