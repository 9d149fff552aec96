"""Load and save the seven star tables (CSV with header, or Parquet)."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.model import SCHEMAS, TABLES, Star, conform_to

FORMATS = ("csv", "parquet")


def load_table(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt!r}; expected one of {FORMATS}")
    location = f"{path.rstrip('/')}/{name}"
    if fmt == "csv":
        # explicit schema, never inference; ISO dates; booleans as True/False text
        df = (spark.read.schema(SCHEMAS[name]).option("header", True)
              .option("dateFormat", "yyyy-MM-dd").option("mode", "FAILFAST").csv(location))
    else:
        df = spark.read.parquet(location)
    return conform_to(df, SCHEMAS[name])


def load_star(spark: SparkSession, path: str, fmt: str = "parquet",
              rows: dict[str, int] | None = None) -> Star:
    """Read a star written by :func:`save_star` (or by any tool, same layout)."""
    tables = {name: load_table(spark, path, name, fmt) for name in TABLES}
    return Star(**tables, rows=dict(rows or {}))


def save_star(star: Star, path: str, fmt: str = "csv", mode: str = "overwrite",
              order_prefix: str | None = None,
              max_records_per_file: int = 50_000_000,
              partition_fact_by: list[str] | None = None, only: list[str] | None = None) -> dict[str, str]:
    """Write each table (or ``only`` those named) to ``path/<table>``; returns table -> location.

    The seven writes are independent jobs and are submitted together, so the
    small dimension writes overlap the fact write instead of queueing behind
    it. ``order_prefix`` is put before the order ids, such as ``ORD123``.
    ``partition_fact_by`` (e.g. ``["date_key"]``) writes the fact in
    directories per key value, so a query that joins it to a filtered
    calendar reads only the matching directories (dynamic partition pruning).
    """
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt!r}; expected one of {FORMATS}")

    def write(name: str, df: DataFrame) -> str:
        location = f"{path.rstrip('/')}/{name}"
        if name == "fact_order_line" and order_prefix:
            df = df.withColumn("order_id", F.concat(F.lit(order_prefix), F.col("order_id")))
        writer = df.write.mode(mode).option("maxRecordsPerFile", max_records_per_file)
        if name == "fact_order_line" and partition_fact_by:
            writer = writer.partitionBy(*partition_fact_by)
        if fmt == "csv":
            writer.option("header", True).option("dateFormat", "yyyy-MM-dd").csv(location)
        else:
            writer.parquet(location)
        return location

    tables = {name: df for name, df in star.tables().items() if only is None or name in only}
    with ThreadPoolExecutor(max_workers=len(tables)) as pool:
        futures = {name: pool.submit(write, name, df) for name, df in tables.items()}
        return {name: f.result() for name, f in futures.items()}


def catalog_counts(star: Star) -> DataFrame:
    """Each table with its row count (the "7 tables expected" check)."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, df in star.tables().items()
    ]
    return reduce(DataFrame.unionByName, parts)


def row_text(name: str) -> Column:
    """All columns of a table's row as one text: values joined by ``|``, NULL spelled out."""
    return F.concat_ws("|", *[F.coalesce(F.col(f.name).cast("string"), F.lit("NULL")) for f in SCHEMAS[name].fields])


def contents(star: Star) -> DataFrame:
    """(table_name, content): every row of all seven tables."""
    parts = [df.select(F.lit(name).alias("table_name"), row_text(name).alias("content"))
             for name, df in star.tables().items()]
    return reduce(DataFrame.unionByName, parts)


def checksums(star: Star) -> DataFrame:
    """(table_name, row_count, checksum): the checksum sums 32 hash bits of every
    row's content (order-free, exact at any size), so a changed value shows."""
    bits = F.conv(F.substring(F.md5("content"), 1, 8), 16, 10).cast("decimal(20,0)")
    return contents(star).groupBy("table_name").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(bits).cast("string").alias("checksum"))
