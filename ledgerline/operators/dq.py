"""Data-quality checks: the schema's keys, constraints and measure rules as
Spark jobs. Each check is one aggregation pass per table (fact foreign keys
are pre-aggregated to distinct key values before the anti-join), and each
returns a small report frame.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.model import FOREIGN_KEYS, PRIMARY_KEYS, SCHEMAS, VARCHAR_LENGTHS, Star
from ledgerline.plans.joins import broadcast_limit, dim, estimated_bytes
from ledgerline.plans.key_words import holds, key_words, word_of
from ledgerline.plans.materialize import stage


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, with their row counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).where(F.col("row_count") > 1)


#: Tables of at least so many rows (or of unknown size) are checked in two passes; below, the extra jobs cost more.
TWO_PASS_ROWS = 1_000_000


def _key_totals(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: row_count, distinct_keys, duplicate_keys, by counting every key."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    return per_key.agg(
        F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("row_count"),
        F.count(F.lit(1)).cast("long").alias("distinct_keys"),
        F.coalesce(F.sum(F.when(F.col("c") > 1, 1).otherwise(0)), F.lit(0)).cast("long").alias("duplicate_keys"))


def _key_totals_in_two_passes(df: DataFrame, key: str) -> DataFrame:
    """The same for one integer key, shuffling one row per 64 neighbouring keys.

    The first pass makes bitmap words: a word with more rows than bits holds a
    duplicate. Only the keys of such words are counted one by one.
    """
    words = stage(key_words(df.select(key), key), "key-words")
    bits = F.bit_count("bits")
    suspects = words.where(F.col("n") > bits).select("word")
    counted = df.where(F.col(key).isNotNull()).select(key, word_of(key).alias("word")).join(suspects, "word", "left_semi")
    doubles = counted.groupBy(key).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
    nulls = df.where(F.col(key).isNull()).agg(F.count(F.lit(1)).alias("n"))  # all NULL keys are one key
    parts = [
        words.agg(F.sum("n").alias("rows"), F.sum(bits).alias("keys")).select("rows", "keys", F.lit(0).alias("doubles")),
        doubles.agg(F.count(F.lit(1)).alias("d")).select(F.lit(0), F.lit(0), "d"),
        nulls.select("n", (F.col("n") > 0).cast("int"), (F.col("n") > 1).cast("int")),
    ]
    return reduce(DataFrame.union, parts).agg(*[
        F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
        for c, name in (("rows", "row_count"), ("keys", "distinct_keys"), ("doubles", "duplicate_keys"))])


def primary_key_report(star: Star, two_pass_rows: int = TWO_PASS_ROWS) -> DataFrame:
    """Per table: rows, distinct keys and keys held by more than one row."""
    frames = []
    for name, keys in PRIMARY_KEYS.items():
        df = star.table(name)
        whole = len(keys) == 1 and df.schema[keys[0]].dataType.typeName() in ("long", "integer")
        if whole and star.rows.get(name, two_pass_rows) >= two_pass_rows:
            totals = _key_totals_in_two_passes(df, keys[0])
        else:
            totals = _key_totals(df, keys)
        frames.append(totals.select(F.lit(name).alias("table_name"), "row_count", "distinct_keys", "duplicate_keys"))
    return _union(frames)


def _orphans(star: Star, column: str, table: str, key: str) -> DataFrame:
    """Fact rows (with their number as ``c``) whose key is missing in the dimension.

    A dimension whose keys may be broadcast is joined as it is. For a larger one
    the bitmap words of its keys are broadcast, if their counted size allows it:
    each fact row is then tested in the scan, exactly. Beyond that the keys of
    the fact are counted and sort-merged with the dimension.
    """
    fact, keys = star.fact_order_line.select(column), star.table(table).select(key)
    n, limit = star.rows.get(table), broadcast_limit(star)
    if n is not None and estimated_bytes(keys, n) > limit and n // 64 * 40 <= limit:
        words = stage(key_words(keys, key).select("word", "bits"), "dimension-words")
        if estimated_bytes(words, words.count()) <= limit:
            tested = fact.withColumn("word", word_of(column)).join(F.broadcast(words), "word", "left")
            return tested.where(~holds(F.col("bits"), column)).select(F.lit(1).alias("c"))
    per_key = fact.groupBy(column).agg(F.count(F.lit(1)).alias("c"))
    return per_key.join(dim(star, table, key).withColumnRenamed(key, column), column, "left_anti")


def foreign_key_report(star: Star) -> DataFrame:
    """Per foreign key of the fact: fact rows whose key is missing in the dimension.

    One check per key on purpose: small dimensions (calendar, category, payment,
    shipping) are broadcast and cost no shuffle, nor do large ones with mostly
    consecutive keys. A single anti-join against the union of all dimension keys
    would shuffle every key column instead.
    """
    frames = []
    for column, (table, key) in FOREIGN_KEYS.items():
        orphans = _orphans(star, column, table, key)
        frames.append(orphans.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("orphan_rows"))
                      .select(F.lit(column).alias("fk_column"), F.lit(table).alias("dim_table"),
                              "orphan_rows"))
    return _union(frames)


# rule name -> (table, SQL condition that must hold)
CHECKS: dict[str, tuple[str, str]] = {
    "chk_quantity": ("fact_order_line", "quantity > 0"),
    "chk_gross": ("fact_order_line", "gross_amount >= 0"),
    "chk_discount": ("fact_order_line", "discount_amount >= 0"),
    "chk_net": ("fact_order_line", "net_amount >= 0"),
    "chk_cost": ("fact_order_line", "cost_amount >= 0"),
    "chk_stock": ("dim_product", "stock_quantity >= 0"),
    "chk_delivery_days": ("dim_shipping", "delivery_days > 0"),
    # declared VARCHAR(n) lengths
    **{f"len_{table}_{col}": (table, f"length({col}) <= {n}")
       for table, cols in VARCHAR_LENGTHS.items() for col, n in cols.items()},
}


def _count_failures(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One pass over ``df``: rows failing each rule (NULL counts as passing,
    as in SQL CHECK constraints), as (rule_name, violations) rows."""
    aggs = [F.sum(F.when(~cond, 1).otherwise(0)).alias(name) for name, cond in rules.items()]
    wide = df.agg(*aggs)
    pairs = ", ".join(f"'{name}', CAST(coalesce(`{name}`, 0) AS BIGINT)" for name in rules)
    return wide.selectExpr(f"stack({len(rules)}, {pairs}) AS (rule_name, violations)")


def check_report(star: Star) -> DataFrame:
    """Rows violating each CHECK constraint and each declared VARCHAR length."""
    by_table: dict[str, dict[str, Column]] = {}
    for rule, (table, cond) in CHECKS.items():
        by_table.setdefault(table, {})[rule] = F.expr(cond)
    frames = [_count_failures(star.table(t), rules).select(
        F.lit(t).alias("table_name"), "rule_name", "violations") for t, rules in by_table.items()]
    return _union(frames)


NULLABLE = {("dim_category", "parent_category")}


def not_null_report(star: Star) -> DataFrame:
    """NULLs in every column declared NOT NULL, per (table, column)."""
    frames = []
    for name, schema in SCHEMAS.items():
        cols = [f.name for f in schema.fields if (name, f.name) not in NULLABLE]
        rules = {c: F.col(c).isNotNull() for c in cols}
        frames.append(_count_failures(star.table(name), rules).select(
            F.lit(name).alias("table_name"), F.col("rule_name").alias("column_name"),
            F.col("violations").alias("null_count")))
    return _union(frames)


def apply_defaults(star: Star) -> Star:
    """Fill declared defaults: seasonal_flag false, stock 0, discount 0."""
    return star.with_tables(
        dim_category=star.dim_category.withColumn(
            "seasonal_flag", F.coalesce("seasonal_flag", F.lit(False))),
        dim_product=star.dim_product.withColumn(
            "stock_quantity", F.coalesce("stock_quantity", F.lit(0))),
        fact_order_line=star.fact_order_line.withColumn(
            "discount_amount", F.coalesce("discount_amount", F.lit(0).cast("decimal(12,2)"))),
    )


def measure_identity_report(star: Star) -> DataFrame:
    """Rows where net != gross - discount or profit != net - cost."""
    rules = {
        "net_eq_gross_minus_discount":
            F.col("net_amount") == F.col("gross_amount") - F.col("discount_amount"),
        "profit_eq_net_minus_cost":
            F.col("profit_amount") == F.col("net_amount") - F.col("cost_amount"),
    }
    return _count_failures(star.fact_order_line, rules)


def temporal_integrity_report(star: Star) -> DataFrame:
    """Order lines dated before their product's launch or their customer's
    registration. Lines meet their dates by joins and are counted last, so the
    only data-sized shuffles are those of joins with large dimensions."""
    lines = star.fact_order_line.select("customer_key", "product_key", "date_key")
    lines = (lines.join(dim(star, "dim_date", "date_key", "full_date"), "date_key", "left")
              .join(dim(star, "dim_customer", "customer_key", "registration_date"), "customer_key", "left")
              .join(dim(star, "dim_product", "product_key", "launch_date"), "product_key", "left"))
    before_reg = F.col("full_date") < F.col("registration_date")
    before_launch = F.col("full_date") < F.col("launch_date")
    either = F.coalesce(before_reg, F.lit(False)) | F.coalesce(before_launch, F.lit(False))
    return lines.agg(
        F.coalesce(F.sum(F.when(before_reg, 1)), F.lit(0)).cast("long").alias("before_registration"),
        F.coalesce(F.sum(F.when(before_launch, 1)), F.lit(0)).cast("long").alias("before_launch"),
        F.coalesce(F.sum(F.when(either, 1)), F.lit(0)).cast("long").alias("violating_lines"),
    )
