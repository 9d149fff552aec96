"""Two-pass external shuffle of records into shards.

Pass 1 scatters every record into one of many memory-sized buckets by a seeded
hash of its id and text. Pass 2 puts each bucket into a canonical order,
Fisher-Yates shuffles it in memory with a generator seeded by (seed, bucket)
and writes it. Bucket sizes are known before pass 2, so every record gets its
global rank in the shuffled order and with it a shard: ranks are cut into
``shards`` consecutive runs whose lengths differ by at most one.

Only one row per bucket is ever ordered globally. The bucket count follows the
input's bytes, so a bucket stays memory-sized at any input size, and equal
texts scatter like any others because the id is part of the hash. Rows equal in
both, where they crowd a bucket, are numbered and written first, and scatter by
their numbers.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import on_workers, unclash
from ledgerline.plans.materialize import stage
from ledgerline.session import scratch_dir

BUCKET_BYTES = 32 << 20


def record_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8 for the id."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(8)


def _shuffled(seed: int, id_at: int, hash_at: int):
    def shuffle(bucket_rows: pa.Table) -> pa.Table:
        bucket = bucket_rows.column("ll_bucket")[0].as_py()
        names = bucket_rows.column_names
        order = pc.sort_indices(
            bucket_rows, sort_keys=[(names[id_at], "ascending"), (names[hash_at], "ascending")]
        ).to_numpy()
        order = np.random.default_rng([seed, bucket]).permutation(order)  # Fisher-Yates
        at = pa.array(np.arange(len(order)), pa.int64())
        return bucket_rows.take(pa.array(order)).append_column("ll_at", at)

    return shuffle


def _bucketed(docs: DataFrame, seed: int, buckets: int, bucket_bytes: int) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``ll_hash`` and ``ll_bucket``, and the written (ll_bucket, count, bytes).

    Where a bucket holds over twice its bytes, groups of equal (id, text hash)
    that make up a quarter of a bucket or more get a number per row. The numbers
    are written, so every later job deals such a row to the same bucket.
    """

    def place(rows: DataFrame, *also: str) -> DataFrame:
        key = F.xxhash64(F.lit(seed), "doc_id", "ll_hash", *also)
        return rows.withColumn("ll_bucket", F.pmod(key, F.lit(buckets)))

    def sizes(rows: DataFrame) -> DataFrame:
        counted = F.count(F.lit(1)).alias("count"), F.sum(record_bytes(F.col("text"))).alias("bytes")
        return stage(rows.groupBy("ll_bucket").agg(*counted), "shard-buckets")

    hashed = docs.withColumn("ll_hash", F.xxhash64("text"))
    placed = place(hashed)
    counts = sizes(placed)
    crowded = counts.where(F.col("bytes") > 2 * bucket_bytes).select("ll_bucket")
    if buckets == 1 or crowded.isEmpty():
        return placed, counts
    groups = placed.join(crowded, "ll_bucket").groupBy("doc_id", "ll_hash")
    groups = groups.agg(F.count(F.lit(1)).alias("n"), F.sum(record_bytes(F.col("text"))).alias("bytes"))
    groups = groups.where((F.col("n") > 1) & (4 * F.col("bytes") >= bucket_bytes))
    groups = stage(groups.select(F.col("doc_id").alias("i"), F.col("ll_hash").alias("g")), "equal-rows")
    equal = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("ll_hash") == F.col("g"))
    copies = hashed.join(groups, equal).drop("i", "g").withColumn("ll_copy", F.monotonically_increasing_id())
    others = hashed.join(groups, equal, "left_anti").withColumn("ll_copy", F.lit(None).cast("long"))
    # a null adds nothing to the hash: the other rows keep their buckets
    placed = place(others.unionAll(stage(copies, "numbered-copies")), "ll_copy").drop("ll_copy")
    return placed, sizes(placed)


def shuffle_shards(
    docs: DataFrame,
    shards: int = 24,
    seed: int = 17,
    bucket_bytes: int = BUCKET_BYTES,
    path: str | None = None,
) -> DataFrame:
    """Write ``docs`` as ``shards`` shuffled shards and return the written rows.

    Files go to ``path`` (default: a fresh folder in the shared scratch) as
    Parquet in one folder per shard, rows in slot order within a file. The
    result has the input's columns plus ``shard`` (int) and ``slot`` (long,
    0, 1, ... within its shard); input columns named like those are replaced.

    Defined cases: a null text counts no bytes and is kept as null; null ids
    sort last in their bucket; repeated rows each keep a slot of their own;
    a text larger than a bucket makes its bucket larger; an empty table gives empty shards; with fewer rows
    than shards the last shards are empty.
    """
    spark = docs.sparkSession
    on_workers(spark)
    docs = unclash(docs, ("doc_id", "text"), ("shard", "slot", "ll_bucket", "ll_hash", "ll_first", "ll_at", "ll_copy"))
    total = docs.agg(
        F.count(F.lit(1)).alias("n"), F.sum(record_bytes(F.col("text"))).alias("bytes")
    ).first()
    n, n_bytes = total["n"], total["bytes"] or 0
    buckets = max(1, math.ceil(n_bytes / bucket_bytes))

    numbered, counts = _bucketed(docs, seed, buckets, bucket_bytes)
    before = Window.orderBy("ll_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(  # one row per bucket
        F.col("ll_bucket").alias("b"),
        F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ll_first"),
    )
    scattered = numbered.join(firsts, F.col("ll_bucket") == F.col("b")).drop("b")
    schema = T.StructType(scattered.schema.fields + [T.StructField("ll_at", T.LongType())])
    columns = scattered.columns
    mixed = scattered.groupBy("ll_bucket").applyInArrow(
        _shuffled(seed, columns.index("doc_id"), columns.index("ll_hash")), schema
    )

    rank = F.col("ll_first") + F.col("ll_at")
    short, longer = divmod(n, shards)
    head = longer * (short + 1)  # rows in the shards that hold one row more
    tail = rank - F.lit(head)
    wide, narrow = F.lit(short + 1), F.lit(max(short, 1))
    in_head = rank < F.lit(head)
    shard = F.when(in_head, F.floor(rank / wide)).otherwise(F.lit(longer) + F.floor(tail / narrow))
    slot = F.when(in_head, rank % wide).otherwise(tail % narrow)
    out = mixed.withColumns({"shard": shard.cast("int"), "slot": slot.cast("long")})
    out = out.select(*docs.columns, "shard", "slot")
    path = path or f"{scratch_dir(spark)}/shards-{uuid.uuid4().hex}"
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def digest(written: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of written shards."""
    text = F.col("text")
    return written.select(
        "doc_id",
        record_bytes(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
