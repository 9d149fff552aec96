"""Star-schema data model: one order-line fact and six dimensions."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)

DIM_DATE = T.StructType([
    T.StructField("date_key", T.IntegerType(), False),
    T.StructField("full_date", T.DateType(), False),
    T.StructField("day", T.IntegerType(), False),
    T.StructField("month", T.IntegerType(), False),
    T.StructField("month_name", T.StringType(), False),
    T.StructField("quarter", T.IntegerType(), False),
    T.StructField("year", T.IntegerType(), False),
    T.StructField("week_number", T.IntegerType(), False),
])

DIM_CUSTOMER = T.StructType([
    T.StructField("customer_key", T.LongType(), False),
    T.StructField("customer_id", T.StringType(), False),
    T.StructField("gender", T.StringType(), True),
    T.StructField("age_group", T.StringType(), True),
    T.StructField("city", T.StringType(), True),
    T.StructField("region", T.StringType(), True),
    T.StructField("registration_date", T.DateType(), True),
    T.StructField("customer_segment", T.StringType(), True),
])

DIM_CATEGORY = T.StructType([
    T.StructField("category_key", T.IntegerType(), False),
    T.StructField("category_name", T.StringType(), False),
    T.StructField("parent_category", T.StringType(), True),
    T.StructField("seasonal_flag", T.BooleanType(), False),
])

DIM_PRODUCT = T.StructType([
    T.StructField("product_key", T.LongType(), False),
    T.StructField("product_id", T.StringType(), False),
    T.StructField("product_name", T.StringType(), True),
    T.StructField("brand", T.StringType(), True),
    T.StructField("subcategory", T.StringType(), True),
    T.StructField("launch_date", T.DateType(), True),
    T.StructField("stock_quantity", T.IntegerType(), False),
])

DIM_PAYMENT = T.StructType([
    T.StructField("payment_key", T.IntegerType(), False),
    T.StructField("payment_method", T.StringType(), False),
])

DIM_SHIPPING = T.StructType([
    T.StructField("shipping_key", T.IntegerType(), False),
    T.StructField("shipping_type", T.StringType(), False),
    T.StructField("delivery_days", T.IntegerType(), False),
])

# order_id is text end to end: ids of any shop load as they are and stay apart.
FACT_ORDER_LINE = T.StructType([
    T.StructField("order_line_id", T.LongType(), False),
    T.StructField("order_id", T.StringType(), False),
    T.StructField("date_key", T.IntegerType(), False),
    T.StructField("customer_key", T.LongType(), False),
    T.StructField("product_key", T.LongType(), False),
    T.StructField("category_key", T.IntegerType(), False),
    T.StructField("payment_key", T.IntegerType(), False),
    T.StructField("shipping_key", T.IntegerType(), False),
    T.StructField("quantity", T.IntegerType(), False),
    T.StructField("gross_amount", MONEY, False),
    T.StructField("discount_amount", MONEY, False),
    T.StructField("net_amount", MONEY, False),
    T.StructField("cost_amount", MONEY, False),
    T.StructField("profit_amount", MONEY, False),
])

SCHEMAS: dict[str, T.StructType] = {
    "dim_date": DIM_DATE,
    "dim_customer": DIM_CUSTOMER,
    "dim_category": DIM_CATEGORY,
    "dim_product": DIM_PRODUCT,
    "dim_payment": DIM_PAYMENT,
    "dim_shipping": DIM_SHIPPING,
    "fact_order_line": FACT_ORDER_LINE,
}

# Dimensions first, fact last: the load order of the warehouse.
TABLES = list(SCHEMAS)

PRIMARY_KEYS: dict[str, list[str]] = {
    "dim_date": ["date_key"],
    "dim_customer": ["customer_key"],
    "dim_category": ["category_key"],
    "dim_product": ["product_key"],
    "dim_payment": ["payment_key"],
    "dim_shipping": ["shipping_key"],
    "fact_order_line": ["order_line_id"],
}

# FIXED VALUES: declared VARCHAR lengths of the warehouse schema, per table
# and column.
VARCHAR_LENGTHS: dict[str, dict[str, int]] = {
    "dim_date": {"month_name": 10},
    "dim_customer": {"customer_id": 20, "gender": 40, "age_group": 40, "city": 50, "region": 50,
                     "customer_segment": 30},
    "dim_category": {"category_name": 50, "parent_category": 50},
    "dim_product": {"product_id": 20, "product_name": 100, "brand": 50, "subcategory": 50},
    "dim_payment": {"payment_method": 30},
    "dim_shipping": {"shipping_type": 30},
    "fact_order_line": {"order_id": 20},
}

# fact column -> (dimension table, dimension key)
FOREIGN_KEYS: dict[str, tuple[str, str]] = {
    "date_key": ("dim_date", "date_key"),
    "customer_key": ("dim_customer", "customer_key"),
    "product_key": ("dim_product", "product_key"),
    "category_key": ("dim_category", "category_key"),
    "payment_key": ("dim_payment", "payment_key"),
    "shipping_key": ("dim_shipping", "shipping_key"),
}


def conform_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast ``df`` to exactly the columns and types of ``schema``."""
    return df.select([df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])


@dataclass(frozen=True)
class Star:
    """The seven tables of the warehouse as DataFrames.

    ``rows`` holds exact row counts for tables whose size is known (filled
    when the star is materialised); joins use it to decide on broadcasting.
    ``as_of`` is the "today" of CURRENT_DATE in the analyses; ``None`` means
    the last day of the calendar dimension. ``calendar_end`` caches that last
    day once the star is materialised (the tables no longer change), so
    queries use a literal instead of a subquery. ``clustered`` is the fact by
    order (see ``sources.clustered``) where it was written so.
    """

    fact_order_line: DataFrame
    dim_date: DataFrame
    dim_customer: DataFrame
    dim_category: DataFrame
    dim_product: DataFrame
    dim_payment: DataFrame
    dim_shipping: DataFrame
    rows: dict[str, int] = field(default_factory=dict)
    as_of: str | None = None
    calendar_end: str | None = None
    clustered: object | None = None

    @property
    def spark(self) -> SparkSession:
        return self.fact_order_line.sparkSession

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in TABLES}

    def with_tables(self, **tables: DataFrame) -> "Star":
        # a replaced calendar may end elsewhere: drop the cached last day
        extra = {"calendar_end": None} if "dim_date" in tables else {}
        if "fact_order_line" in tables:
            extra["clustered"] = None
        return replace(self, **tables, **extra)

    def with_as_of(self, as_of: str | None) -> "Star":
        return replace(self, as_of=as_of)

    def register_views(self, prefix: str = "") -> None:
        """Expose the tables as temp views so plain SQL can run on them."""
        for name, df in self.tables().items():
            df.createOrReplaceTempView(prefix + name)

