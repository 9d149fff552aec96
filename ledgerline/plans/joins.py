"""Dimension joins that broadcast only behind a row-count check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.model import Star
from ledgerline.session import conf_int

BROADCAST_MAX_BYTES = "ledgerline.broadcast.maxBytes"
DEFAULT_BROADCAST_MAX_BYTES = 64 * 1024 * 1024

# per-value widths in the spirit of Spark's DataType.defaultSize
_WIDTHS = {"bigint": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8, "int": 4, "date": 4,
           "float": 4, "smallint": 2, "tinyint": 1, "boolean": 1, "string": 20}
_ROW_OVERHEAD = 16


def _width(dtype: str) -> int:
    if dtype.startswith("decimal"):
        precision = int(dtype[dtype.index("(") + 1:dtype.index(",")])
        return 8 if precision <= 18 else 16
    return _WIDTHS.get(dtype, 32)


def estimated_bytes(df: DataFrame, rows: int) -> int:
    """Exact row count times the projected row width: the broadcast size check."""
    return rows * (_ROW_OVERHEAD + sum(_width(t) for _, t in df.dtypes))


def broadcast_limit(star: Star) -> int:
    return conf_int(star.spark, BROADCAST_MAX_BYTES, DEFAULT_BROADCAST_MAX_BYTES)


def dim(star: Star, name: str, *columns: str) -> DataFrame:
    """A dimension projected to ``columns``; hinted for broadcast only when its
    exact row count is known and the estimated projected size is under the
    limit. Otherwise no hint: the planner and AQE choose from real sizes, with
    sort-merge beyond them."""
    df = star.table(name)
    if columns:
        df = df.select(*columns)
    n = star.rows.get(name)
    if n is not None and estimated_bytes(df, n) <= broadcast_limit(star):
        df = F.broadcast(df)
    return df


def join_dim(left: DataFrame, star: Star, name: str, on: str | list[str],
             *columns: str, how: str = "inner") -> DataFrame:
    keys = [on] if isinstance(on, str) else list(on)
    cols = list(dict.fromkeys(keys + list(columns))) if columns else []
    return left.join(dim(star, name, *cols), keys, how)


def calendar_end_col(star: Star) -> Column:
    """The calendar's last day: a literal once the star is materialised, else
    a scalar subquery (one value, computed once per query; no join needed)."""
    if star.calendar_end:
        return F.to_date(F.lit(star.calendar_end))
    return star.dim_date.agg(F.max("full_date")).scalar()


def as_of_col(star: Star) -> Column:
    """The as-of date: the given one, else the calendar's last day."""
    if star.as_of:
        return F.to_date(F.lit(star.as_of))
    return calendar_end_col(star)
