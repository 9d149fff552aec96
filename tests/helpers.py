"""Hand-made stars for edge-case tests."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import SparkSession

from ledgerline.model import SCHEMAS, Star
from ledgerline.sources.conform import dim_date_between, payments, shippings

START = "2024-01-01"


def day_key(date: str, start: str = START) -> int:
    return (dt.date.fromisoformat(date) - dt.date.fromisoformat(start)).days + 1


def D(x) -> Decimal:
    return Decimal(str(x)).quantize(Decimal("0.01"))


def make_star(spark: SparkSession, lines, products=None, customers=None, categories=None,
              start: str = START, end: str = "2024-12-31", as_of: str | None = None) -> Star:
    """``lines``: dicts with order_id, date (ISO), customer_key, product_key and
    net (plus optional category_key, quantity, gross, discount, cost, profit).
    Missing measures are derived: gross = net, discount 0, cost = 60 % of net."""
    rows = []
    for i, ln in enumerate(lines):
        net = D(ln["net"])
        cost = D(ln.get("cost", float(net) * 0.6))
        rows.append((
            i + 1, str(ln["order_id"]), day_key(ln["date"], start), ln["customer_key"], ln["product_key"],
            ln.get("category_key", 1), 1, 1, ln.get("quantity", 1),
            D(ln.get("gross", net + D(ln.get("discount", 0)))), D(ln.get("discount", 0)), net, cost,
            D(ln.get("profit", net - cost)),
        ))
    fact = spark.createDataFrame(rows, SCHEMAS["fact_order_line"])
    pkeys = sorted({ln["product_key"] for ln in lines})
    products = products or [
        (k, f"PROD{k:06d}", f"product {k}", "B1", "Entry", None, 100) for k in pkeys]
    ckeys = sorted({ln["customer_key"] for ln in lines})
    customers = customers or [
        (k, f"CUST{k:07d}", None, None, "city", "R1", None, "SEG") for k in ckeys]
    categories = categories or [(1, "Cat A", None, False), (2, "Cat B", None, False)]
    return Star(
        fact_order_line=fact,
        dim_date=dim_date_between(spark, start, end),
        dim_customer=spark.createDataFrame(customers, SCHEMAS["dim_customer"]),
        dim_category=spark.createDataFrame(categories, SCHEMAS["dim_category"]),
        dim_product=spark.createDataFrame(products, SCHEMAS["dim_product"]),
        dim_payment=payments(spark),
        dim_shipping=shippings(spark),
        as_of=as_of,
    )


def rows(df, *cols):
    """Collect ``cols`` of ``df`` as a sorted list of tuples."""
    out = [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]
    return sorted(out, key=lambda t: tuple((x is None, x) for x in t))
