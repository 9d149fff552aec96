"""Conform the TPC-H-like source tables into the retail star schema.

Mapping (one rule per star column, identical in the SQL oracle):

* full_date      = order date; dim_date holds every day from the first to the
                   last order date, date_key = 1-based day number.
* order_id       = l_orderkey as text; customer_key = o_custkey; product_key = l_partkey
* order_line_id  = the line's place (from 1) among all lines by order key, line
                   number, part, quantity, price and discount
* category       = p_type, category_key = its position in name order
* brand/name     = p_brand / p_name; subcategory by p_size % 6
* region / city / customer_segment = r_name / n_name / c_mktsegment
* stock_quantity = p_partkey * 37 % 500
* gender, age_group = by c_custkey % 4, % 6; registration_date = first order date
                   + c_custkey * 37 % 400 days; launch_date = it + p_partkey * 53 % 300
* parent_category = by category_key % 10; seasonal_flag = category_key * 2 % 5 < 2
* payment_key    = 1 + l_orderkey % 8;  shipping_key = 1 + l_orderkey % 6
* measures       gross -> discount -> net -> cost -> profit, each to cents,
                   cost ratio 0.40..0.80 from the part key.

Nothing is repaired or dropped on the way: a line without its order or part keeps
NULL for what is missing, negative discounts stay negative, a fractional quantity
becomes NULL; the data-quality reports count them, and analyses that need the
missing side leave such lines out by their own joins.

Everything is lazy but the numbering of the lines, which range-partitions and writes
them once. That and the two fact joins (lines x parts on the part key, then x
orders on the order id) are the only large shuffles; the planner and AQE pick broadcast or sort-merge from real sizes, and AQE splits a skewed
order or part key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.constants import (
    AGE_GROUPS,
    GENDERS,
    PARENT_CATEGORIES,
    PAYMENT_METHODS,
    SHIPPING_TYPES,
    SUBCATEGORIES,
)
from ledgerline.model import (
    DIM_CATEGORY,
    DIM_CUSTOMER,
    DIM_DATE,
    DIM_PAYMENT,
    DIM_PRODUCT,
    DIM_SHIPPING,
    FACT_ORDER_LINE,
    MONEY,
    Star,
    conform_to,
)
from ledgerline.plans.global_window import range_buckets
from ledgerline.plans.joins import estimated_bytes
from ledgerline.plans.numbering import number_rows

SOURCE_COLUMNS = {
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount"],
    "orders": ["o_orderkey", "o_custkey", "o_orderdate"],
    "customer": ["c_custkey", "c_nationkey", "c_mktsegment"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "region": ["r_regionkey", "r_name"],
}


def read_source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one source table, projecting only the columns the star needs."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*SOURCE_COLUMNS[name])


def order_date_bounds(orders: DataFrame) -> DataFrame:
    """One row: first and last order date (a global aggregate, exactly 1 row)."""
    d = F.to_date("o_orderdate")
    return orders.agg(F.min(d).alias("min_date"), F.max(d).alias("max_date"))


def calendar(bounds: DataFrame) -> DataFrame:
    """dim_date: every day between min_date and max_date of a 1-row frame."""
    days = bounds.select(
        "min_date", F.explode(F.sequence("min_date", "max_date")).alias("full_date")
    )
    out = days.select(
        (F.datediff("full_date", "min_date") + 1).alias("date_key"),
        "full_date",
        F.dayofmonth("full_date").alias("day"),
        F.month("full_date").alias("month"),
        F.date_format("full_date", "MMMM").alias("month_name"),
        F.quarter("full_date").alias("quarter"),
        F.year("full_date").alias("year"),
        F.weekofyear("full_date").alias("week_number"),  # ISO-8601 week
    )
    return conform_to(out, DIM_DATE)


def dim_date_between(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Calendar between two ISO dates (inclusive)."""
    bounds = spark.range(1).select(
        F.to_date(F.lit(start)).alias("min_date"), F.to_date(F.lit(end)).alias("max_date")
    )
    return calendar(bounds)


def categories(part: DataFrame) -> DataFrame:
    """dim_category: one row per part type, keyed by position in name order.

    The window runs over distinct type names only - a category vocabulary,
    not data-sized.
    """
    names = part.select(F.col("p_type").alias("category_name")).distinct()
    keyed = names.select(
        F.dense_rank().over(Window.orderBy("category_name")).alias("category_key"), "category_name")
    key = F.col("category_key")
    out = keyed.select(
        "category_key",
        "category_name",
        nth_of(PARENT_CATEGORIES, key).alias("parent_category"),
        (key * 2 % 5 < 2).alias("seasonal_flag"),
    )
    return conform_to(out, DIM_CATEGORY)


def nth_of(values: list[str], key: Column) -> Column:
    """The value at ``key`` modulo the list's length; as in SQL, none at place 0 (keys below zero)."""
    place = (key % F.lit(len(values))).cast("int") + 1
    return F.when(place.isNull() | (place != 0), F.element_at(F.array(*[F.lit(v) for v in values]), place))


def spread(key: Column, factor: int, modulus: int) -> Column:
    """``key * factor % modulus`` for every long key, without an overflow of the product."""
    return key % F.lit(modulus) * F.lit(factor) % F.lit(modulus)


def days_after(bounds: DataFrame, days: Column) -> Column:
    """A date so many days after the first order date (a scalar subquery)."""
    return F.date_add(bounds.select("min_date").scalar(), days.cast("int"))


def customers(customer: DataFrame, nation: DataFrame, region: DataFrame, bounds: DataFrame) -> DataFrame:
    geo = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", "n_name", "r_name"
    )
    joined = customer.join(geo, customer.c_nationkey == geo.n_nationkey, "left")
    out = joined.select(
        F.col("c_custkey").alias("customer_key"),
        F.format_string("CUST%07d", "c_custkey").alias("customer_id"),
        nth_of(GENDERS, F.col("c_custkey")).alias("gender"),
        nth_of(AGE_GROUPS, F.col("c_custkey")).alias("age_group"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("region"),
        days_after(bounds, spread(F.col("c_custkey"), 37, 400)).alias("registration_date"),
        F.col("c_mktsegment").alias("customer_segment"),
    )
    return conform_to(out, DIM_CUSTOMER)


def stock_of(partkey: Column) -> Column:
    return spread(partkey, 37, 500).cast("int")


def products(part: DataFrame, bounds: DataFrame) -> DataFrame:
    out = part.select(
        F.col("p_partkey").alias("product_key"),
        F.format_string("PROD%06d", "p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("brand"),
        nth_of(SUBCATEGORIES, F.col("p_size")).alias("subcategory"),
        days_after(bounds, spread(F.col("p_partkey"), 53, 300)).alias("launch_date"),
        stock_of(F.col("p_partkey")).alias("stock_quantity"),
    )
    return conform_to(out, DIM_PRODUCT)


def payments(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, m) for i, m in enumerate(PAYMENT_METHODS)]
    return spark.createDataFrame(rows, DIM_PAYMENT).coalesce(1)


def shippings(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, t, d) for i, (t, d) in enumerate(SHIPPING_TYPES)]
    return spark.createDataFrame(rows, DIM_SHIPPING).coalesce(1)


def measures(extendedprice: Column, discount_rate: Column, partkey: Column) -> dict[str, Column]:
    """gross -> discount -> net -> cost -> profit, each rounded to cents."""
    gross = extendedprice.cast(MONEY)
    rate = discount_rate.cast(T.DecimalType(14, 10))
    discount = F.round(gross * rate, 2).cast(MONEY)
    net = (gross - discount).cast(MONEY)
    cost_ratio = ((F.lit(40) + partkey % F.lit(41)) / F.lit(100).cast(T.DecimalType(5, 2))).cast(
        T.DecimalType(4, 2)
    )
    cost = F.round(net * cost_ratio, 2).cast(MONEY)
    profit = (net - cost).cast(MONEY)
    return {
        "gross_amount": gross,
        "discount_amount": discount,
        "net_amount": net,
        "cost_amount": cost,
        "profit_amount": profit,
    }


def _equal_as_text(a: T.DataType, b: T.DataType) -> bool:
    """Whether values of the two types are equal just when their texts are."""
    return all(isinstance(t, T.IntegralType) for t in (a, b)) or a == b == T.StringType()


def order_lines(lineitem: DataFrame, orders: DataFrame, part: DataFrame,
                dim_category: DataFrame, bounds: DataFrame) -> DataFrame:
    """fact_order_line: one row per line item with keys and measures."""
    part_cat = part.select("p_partkey", "p_type").join(
        dim_category.select(F.col("category_name").alias("p_type"), "category_key"), "p_type", "left"
    )
    # equal lines are interchangeable, so each load gives the same (id, line) pairs
    ranges = range_buckets(lineitem.sparkSession, estimated_bytes(lineitem, lineitem.count()))
    numbered = number_rows(lineitem.select(*SOURCE_COLUMNS["lineitem"]), SOURCE_COLUMNS["lineitem"], "line_id", ranges)
    lines = numbered.join(part_cat, F.col("l_partkey") == F.col("p_partkey"), "left").drop("p_partkey", "p_type", "l_linenumber")
    lines = lines.withColumn("order_id", F.col("l_orderkey").cast("string"))
    same_order = F.col("l_orderkey") == F.col("o_orderkey")
    if _equal_as_text(lineitem.schema["l_orderkey"].dataType, orders.schema["o_orderkey"].dataType):
        # by the fact's clustering key, so this shuffle of the lines (before their measures) is the one that clusters them
        orders = orders.select(F.col("o_orderkey").cast("string").alias("o_order_id"), "o_custkey", "o_orderdate")
        same_order = F.col("order_id") == F.col("o_order_id")
    lines = lines.join(orders, same_order, "left")
    whole = F.col("l_quantity") == F.floor("l_quantity")
    first_day = bounds.select("min_date").scalar()  # scalar subquery, computed once
    m = measures(F.col("l_extendedprice"), F.col("l_discount"), F.col("l_partkey"))
    out = lines.select(
        F.col("line_id").alias("order_line_id"),
        "order_id",
        (F.datediff(F.to_date("o_orderdate"), first_day) + 1).alias("date_key"),
        F.col("o_custkey").alias("customer_key"),
        F.col("l_partkey").alias("product_key"),
        "category_key",
        (F.lit(1) + F.col("l_orderkey") % F.lit(8)).alias("payment_key"),
        (F.lit(1) + F.col("l_orderkey") % F.lit(6)).alias("shipping_key"),
        F.when(whole, F.col("l_quantity").cast("int")).alias("quantity"),
        *[c.alias(name) for name, c in m.items()],
    )
    return conform_to(out, FACT_ORDER_LINE)


def conform_star(spark: SparkSession, sf_dir: str) -> Star:
    """Lazy star built from the source tables in ``sf_dir``."""
    src = {name: read_source(spark, sf_dir, name) for name in SOURCE_COLUMNS}
    bounds = order_date_bounds(src["orders"])
    dim_category = categories(src["part"])
    return Star(
        fact_order_line=order_lines(src["lineitem"], src["orders"], src["part"], dim_category, bounds),
        dim_date=calendar(bounds),
        dim_customer=customers(src["customer"], src["nation"], src["region"], bounds),
        dim_category=dim_category,
        dim_product=products(src["part"], bounds),
        dim_payment=payments(spark),
        dim_shipping=shippings(spark),
    )
