"""Aggregates of whole groups beside every row, where a group may be huge.

``Window.partitionBy(g)`` without an order gathers each group in one task. Here
the aggregates are computed as such (partially before the shuffle), written as
one row per group and joined back; both sides of that join are plain shuffles of
written rows, so AQE splits a group that holds a large share of them.

Deviations come from mergeable exact moments (count, sum, sum of squares of
whole cents), so they depend neither on partitioning nor on the order of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ledgerline.functions.exprs import col, dbl
from ledgerline.plans.materialize import stage


def group_totals(rows: DataFrame, keys: list[str], aggs: list[Column], label: str = "group-totals") -> DataFrame:
    """Written (keys, aggregates), one row per group."""
    return stage(rows.groupBy(*keys).agg(*aggs), label)


def with_group_totals(rows: DataFrame, keys: list[str], aggs: list[Column], *, written: bool = False,
                      null_keys: bool = True) -> DataFrame:
    """``rows`` with the aggregates of their group; NULL keys are a group.

    ``rows`` are read twice, so they are written first unless the caller says
    that they come from files already (``written``), as it may say that no key is
    NULL (``null_keys``), which makes the join a plain one.
    """
    rows = rows if written else stage(rows, "group-rows")
    names = {k: f"_total_{k}" for k in keys}
    totals = group_totals(rows, keys, aggs)
    if not null_keys:
        return rows.join(totals, keys)
    totals = totals.select(*[F.col(k).alias(names[k]) for k in keys], *[c for c in totals.columns if c not in keys])
    same = reduce(Column.__and__, [rows[k].eqNullSafe(totals[names[k]]) for k in keys])
    return rows.join(totals, same).drop(*names.values())


def moments(value: str | Column, prefix: str = "m", over: WindowSpec | None = None) -> list[Column]:
    """Aggregates ``<prefix>_n``, ``_s`` and ``_q``: count, sum and sum of squares of a money value, in whole cents.

    ``over`` makes them window aggregates, for groups that are bounded.
    """
    cents = (col(value) * 100).cast("decimal(19,0)")
    made = [("n", F.count(cents)), ("s", F.sum(cents)), ("q", F.sum((cents * cents).cast("decimal(38,0)")))]
    made = [(name, agg.over(over) if over is not None else agg) for name, agg in made]
    return [(agg.cast("decimal(38,0)") if name == "s" else agg).alias(f"{prefix}_{name}") for name, agg in made]


def stddev_samp(prefix: str = "m") -> Column:
    """Sample standard deviation from :func:`moments`; NULL for fewer than two values."""
    n, s, q = (F.col(f"{prefix}_{x}") for x in "nsq")
    wide = n.cast("decimal(19,0)")
    spread = (wide * q).cast("decimal(38,0)") - (s * s).cast("decimal(38,0)")
    return F.when(n > 1, F.sqrt(dbl(spread) / dbl(wide * (wide - 1))) / F.lit(100.0))
