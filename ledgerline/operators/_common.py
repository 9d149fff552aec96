"""Building blocks shared by the analysis operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.exprs import dbl
from ledgerline.model import Star
from ledgerline.plans.global_window import range_buckets
from ledgerline.plans.joins import broadcast_limit, estimated_bytes, join_dim


def total(measure: str, alias: str) -> Column:
    """Exact decimal SUM; callers cast to double only at the output."""
    return F.sum(measure).alias(alias)


def _calendar_broadcastable(star: Star, *grain: str) -> bool:
    n = star.rows.get("dim_date")
    return n is not None and estimated_bytes(
        star.dim_date.select("date_key", *grain), n) <= broadcast_limit(star)


def dated_rows(star: Star, keys: list[str], measure: str, alias: str, *grain: str) -> DataFrame:
    """Rows of (keys, calendar grain, alias) whose ``alias`` sums to SUM(measure).

    With a calendar of checked size these are the fact rows themselves, the
    calendar joined by a broadcast hash join inside the scan, so the caller's
    aggregation is the only shuffle. Without it, the fact is first reduced per
    (keys, date_key) so only that aggregate meets the calendar.
    """
    f = star.fact_order_line
    if _calendar_broadcastable(star, *grain):
        rows = f.select(*keys, "date_key", F.col(measure).alias(alias))
    else:
        rows = f.groupBy(*keys, "date_key").agg(total(measure, alias))
    return join_dim(rows, star, "dim_date", "date_key", *grain)


def by_keys_and_date(star: Star, keys: list[str], measure: str, alias: str, *grain: str) -> DataFrame:
    """SUM(measure) per (fact keys, calendar grain), e.g. (product_key, year, month)."""
    rows = dated_rows(star, keys, measure, alias, *grain)
    return rows.groupBy(*keys, *grain).agg(F.sum(alias).alias(alias))


def by_date(star: Star, measure: str, alias: str, *grain: str) -> DataFrame:
    """SUM(measure) per calendar grain (e.g. year, month, full_date)."""
    return by_keys_and_date(star, [], measure, alias, *grain)


def by_key_and_date(star: Star, key: str, measure: str, alias: str, *grain: str) -> DataFrame:
    """SUM(measure) per (fact key, calendar grain)."""
    return by_keys_and_date(star, [key], measure, alias, *grain)


def buckets_for(star: Star, table: str, rows: DataFrame) -> int:
    """Range buckets for a window over ``rows``, which are at most as many as ``table`` has."""
    return range_buckets(star.spark, estimated_bytes(rows, star.rows.get(table, 0)))


def money_out(c: str | Column, alias: str | None = None) -> Column:
    out = dbl(c)
    return out.alias(alias) if alias else out
