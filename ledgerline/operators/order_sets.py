"""Exact distinct order counts that can be merged: sets of order numbers as bitmap words.

COUNT(DISTINCT order_id) of a month cannot be added to that of the next one, so every
period would shuffle (customer, order) again. Here orders are numbered once, a
customer's orders next to each other, and the fact is reduced to one row per
customer, day and 64 neighbouring numbers, with the revenue beside it. Sets of days
merge by OR, whatever the period; bits are counted at the end. An order that stands
on several days, or under several customers, keeps its one number and counts once.

Lines without an order have revenue but no bit, as COUNT(DISTINCT) leaves them out;
lines without a customer form one customer, as GROUP BY has it; periods leave out
lines without a day of the calendar.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.exprs import avg_money, safe_div
from ledgerline.model import Star
from ledgerline.operators._common import buckets_for
from ledgerline.plans.joins import join_dim
from ledgerline.plans.key_words import bit_of, word_of
from ledgerline.plans.materialize import stage, still_there
from ledgerline.plans.numbering import number_rows

MONTHS = 3  # of a trailing period


@dataclass(frozen=True)
class OrderSets:
    """``numbers``: (order_id, order_no); ``words``: (customer_key, date_key, word, bits, net)."""

    numbers: DataFrame
    words: DataFrame


def _words(lines: DataFrame, numbers: DataFrame) -> DataFrame:
    """Bitmap words of ``lines``; what repeats inside an order is added up before the join."""
    lines = lines.groupBy("order_id", "customer_key", "date_key").agg(F.sum("net_amount").alias("net"))
    numbered = lines.where(F.col("order_id").isNotNull()).join(numbers, "order_id")
    words = numbered.groupBy("customer_key", "date_key", word_of("order_no").alias("word")).agg(
        F.bit_or(bit_of("order_no")).alias("bits"), F.sum("net").alias("net"))
    without = lines.where(F.col("order_id").isNull()).groupBy("customer_key", "date_key").agg(
        F.lit(None).cast("long").alias("word"), F.lit(0).cast("long").alias("bits"), F.sum("net").alias("net"))
    return words.unionByName(without).withColumn("net", F.col("net").cast("decimal(28,2)"))


def _order_ids(lines: DataFrame) -> DataFrame:
    """One row per order with its (smallest) customer."""
    return lines.where(F.col("order_id").isNotNull()).groupBy("order_id").agg(F.min("customer_key").alias("customer_key"))


def build(star: Star) -> OrderSets:
    """Number the star's orders and write their words."""
    lines = star.fact_order_line
    ids = _order_ids(lines)
    numbered = number_rows(ids, ["customer_key", "order_id"], "order_no", buckets_for(star, "fact_order_line", ids))
    numbers = stage(numbered.select("order_id", "order_no"), "order-numbers")
    return OrderSets(numbers, stage(_words(lines, numbers), "order-words"))


def extend(sets: OrderSets, lines: DataFrame, n_ranges: int = 1) -> OrderSets:
    """``sets`` with further order lines, say of a new day; only these are read and written.

    Known orders keep their numbers, new ones follow behind the last.
    """
    last = sets.numbers.agg(F.coalesce(F.max("order_no"), F.lit(0).cast("long"))).first()[0]
    fresh = _order_ids(lines).join(sets.numbers, "order_id", "left_anti")
    fresh = number_rows(fresh, ["customer_key", "order_id"], "order_no", n_ranges)
    fresh = stage(fresh.select("order_id", (F.col("order_no") + last).alias("order_no")), "order-numbers")
    numbers = sets.numbers.unionByName(fresh)
    return OrderSets(numbers, sets.words.unionByName(stage(_words(lines, numbers), "order-words")))


_SETS: list[tuple[Star, OrderSets]] = []


def sets_of(star: Star) -> OrderSets:
    """The order sets of a star, written on their first use and anew if their files are gone."""
    for kept in [kept for kept in _SETS if kept[0] is star]:
        if still_there(kept[1].numbers, kept[1].words):
            return kept[1]
        _SETS[:] = [other for other in _SETS if other is not kept]
    _SETS.append((star, build(star)))
    return _SETS[-1][1]


def _merged(words: DataFrame, *keys: str) -> DataFrame:
    """Words of equal ``keys`` as one: their sets merged, their revenue added."""
    return words.groupBy(*keys, "word").agg(F.bit_or("bits").alias("bits"), F.sum("net").alias("net"))


def _order_value(merged: DataFrame, *keys: str) -> DataFrame:
    """Per ``keys``: n_orders and avg_order_value, from words merged over all customers."""
    sums = merged.groupBy(*keys).agg(
        F.coalesce(F.sum(F.bit_count("bits").cast("long")), F.lit(0).cast("long")).alias("n_orders"),
        F.sum("net").cast("decimal(34,2)").alias("net"))
    return sums.select(*keys, "n_orders", avg_money("net", "n_orders").alias("avg_order_value"))


def _repeat(merged: DataFrame, *keys: str) -> DataFrame:
    """Per ``keys``: customers, those with several orders and their share, from words merged per customer."""
    orders = merged.groupBy(*keys, "customer_key").agg(F.sum(F.bit_count("bits")).alias("n"))
    repeat = F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0).cast("long"))
    return orders.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_customers"), F.sum((F.col("n") > 1).cast("long")).alias("repeat_customers"),
        F.round(safe_div(repeat * F.lit(100.0), F.count(F.lit(1))), 2).alias("repeat_purchase_rate_pct"))


def avg_order_value(sets: OrderSets) -> DataFrame:
    """ROUND(SUM(net) / COUNT(DISTINCT order_id), 2) from the sets."""
    return _order_value(_merged(sets.words)).select("avg_order_value")


def repeat_rate(sets: OrderSets) -> DataFrame:
    """Customers, customers with more than one distinct order, and their share (%), from the sets."""
    return _repeat(_merged(sets.words, "customer_key"))


def trailing(star: Star, months: int = MONTHS, sets: OrderSets | None = None) -> DataFrame:
    """Per calendar month: orders, average order value, customers and repeat customers of the
    ``months`` months that end with it.

    A day's words go to the ``months`` periods that hold it; months without a sale in
    their period have no row.
    """
    words = (sets or sets_of(star)).words
    number = F.col("year").cast("int") * 12 + F.col("month").cast("int") - 1
    words = join_dim(words, star, "dim_date", "date_key", "year", "month").withColumn("at", number)
    monthly = words.groupBy("at", "customer_key", "word").agg(F.bit_or("bits").alias("bits"), F.sum("net").alias("net"))
    periods = monthly.withColumn("at", F.explode(F.sequence(F.col("at"), F.col("at") + (months - 1))))
    per_customer = _merged(periods, "at", "customer_key")
    found = _order_value(_merged(per_customer, "at"), "at").join(_repeat(per_customer, "at"), "at")
    calendar = star.dim_date.select("year", "month").distinct().withColumn("at", number)
    return calendar.join(found, "at").drop("at").orderBy("year", "month")
