"""Materialise the conformed star once per session and reuse it.

The analyses all read the star, not the raw tables. Re-deriving the fact per
query would repeat its two large joins; instead the star is written once as
Parquet into the shared scratch folder (``spark.checkpoint.dir``), which
also cuts the lineage, so a lost executor only re-reads files.
"""

from __future__ import annotations

import os
import threading
from concurrent.futures import ThreadPoolExecutor
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.model import TABLES, Star
from ledgerline.plans.global_window import range_buckets
from ledgerline.plans.joins import estimated_bytes
from ledgerline.plans.materialize import drop_staged, still_there
from ledgerline.session import scratch_dir
from ledgerline.sources.clustered import LARGE_ORDER_LINES, write_clustered
from ledgerline.sources.conform import conform_star, read_source
from ledgerline.sources.star_io import load_table, save_star

_LOCK = threading.Lock()
_STARS: dict[tuple[str, str], Star] = {}


def prepare_star(star: Star) -> Star:
    """Record exact row counts and the calendar's last day.

    Use it on any star read from storage (``load_star``): the counts enable
    size-checked broadcasts of small dimensions and size the buckets of global
    windows; the last day replaces a per-query subquery. Eight small jobs (Parquet counts read footers), run
    concurrently.
    """
    tables = star.tables()
    with ThreadPoolExecutor(max_workers=len(tables) + 1) as pool:
        counts = {name: pool.submit(df.count) for name, df in tables.items()}
        end = pool.submit(lambda: star.dim_date.agg(F.max("full_date").cast("string")).first()[0])
        rows = {name: f.result() for name, f in counts.items()}
        return replace(star, rows=rows, calendar_end=end.result())


def materialize_star(star: Star, path: str, fact_rows: int | None = None, order_ids: DataFrame | None = None,
                     large_lines: int = LARGE_ORDER_LINES) -> Star:
    """Write ``star`` as Parquet under ``path`` and return the re-read, prepared
    star (see :func:`prepare_star`), its fact clustered by order.

    ``order_ids`` (column order_id, one row per line) spares reading the fact to
    find very large orders; ``fact_rows`` sizes its buckets.
    """
    spark = star.spark
    buckets = range_buckets(spark, estimated_bytes(star.fact_order_line, fact_rows or 0))
    dims = [name for name in TABLES if name != "fact_order_line"]
    with ThreadPoolExecutor(max_workers=2) as pool:
        small = pool.submit(save_star, star, path, fmt="parquet", only=dims)
        clustered = write_clustered(star.fact_order_line, f"{path}/fact_order_line", buckets, order_ids, large_lines)
        small.result()
    tables = {name: load_table(spark, path, name) for name in dims}
    loaded = Star(**tables, fact_order_line=clustered.lines(), as_of=star.as_of, clustered=clustered)
    return prepare_star(loaded)


def star_for(spark: SparkSession, sf_dir: str, materialize: bool = True) -> Star:
    """The star for the source tables in ``sf_dir`` (memoised per application).

    Built anew if files of it are gone, as after the scratch folder was emptied.
    """
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))
    with _LOCK:
        cached = _STARS.get(key)
        if cached is not None and still_there(*cached.tables().values()):
            return cached
        star = conform_star(spark, sf_dir)
        if materialize:
            path = f"{scratch_dir(spark)}/star-{uuid.uuid4().hex}"
            lines = read_source(spark, sf_dir, "lineitem")
            ids = lines.select(F.col("l_orderkey").cast("string").alias("order_id"))
            lazy = star.fact_order_line
            star = materialize_star(star, path, fact_rows=lines.count(), order_ids=ids)  # counted in the file footers
            drop_staged(lazy)  # the numbered lines: only the written fact is read from now on
        _STARS[key] = star
        return star


def forget_stars() -> None:
    with _LOCK:
        _STARS.clear()
