"""Window functions whose groups may be huge, without a one-task exchange.

``Window.orderBy(...)`` with no ``partitionBy`` moves every row into one task,
and ``Window.partitionBy(g)`` moves a whole group into one task. For
per-product or per-customer tables, or a group holding a third of all rows,
neither holds at scale. Here the ordinals are built in three steps:

1. range-partition the rows on (group, key, tie-breakers) and tag each row with
   its range bucket (the partition id right after the range exchange). The
   tie-breakers are part of the range key, so even one group or one key value
   shared by a third of the rows is spread over many buckets;
2. per-bucket summary (one row per bucket, a number we choose): row count,
   value sum, first and last (group, key), and the size of the trailing group
   and trailing tie run. Carries between buckets come from running sums and
   LAGs over this small table, which is then broadcast;
3. ordinary windows partitioned by (bucket, group) give local ordinals; adding
   the carries gives the exact ROW_NUMBER, RANK, DENSE_RANK, running SUM and LAG.

Two kinds of frame need more than a carried total:

* ROWS n-1 PRECEDING: a bucket's first rows need up to n-1 rows of earlier
  buckets. The last n-1 rows of each bucket's last group are copied forward
  ("halo" rows) into the next bucket, and into further ones while the buckets
  between hold fewer rows than the frame; they take part in the frame and are
  dropped afterwards.
* RANGE UNBOUNDED PRECEDING (the default frame): rows with equal keys are peers
  and share the sum after the last of them, which may stand in a later bucket.
  The sums of the peers at the head of later buckets are carried backwards.

There are at most ``MAX_BUCKETS`` buckets, so the summary is a few megabytes
whatever the table's size, and that is why it may be broadcast. The bucketed rows are written once to the shared scratch folder (the one
eager step), so every branch sees one set of range bounds even if executors
are lost and stages recompute. A descending key must be numeric.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.plans.materialize import stage
from ledgerline.session import default_parallelism

BUCKET = "_gw_bucket"
ROW_NUMBER = "gw_row_number"
RANK = "gw_rank"
RUNNING_SUM = "gw_running_sum"
COUNT = "gw_count"
TOTAL = "gw_total"
LAG = "gw_lag"
DENSE_RANK = "gw_dense_rank"
RANGE_SUM = "gw_range_sum"
FRAME_SUM = "gw_frame_sum"
FRAME_COUNT = "gw_frame_count"

#: Most range buckets of one window: bounds the summary (one row each).
MAX_BUCKETS = 16_384
#: Bytes that one bucket should hold, up to that number of buckets.
BUCKET_BYTES = 256 * 1024 * 1024
#: Longest ROWS frame: a bucket copies fewer than this many rows forward.
MAX_FRAME = 1024
#: Most (bucket, later bucket) pairs of a halo that are broadcast.
_BROADCAST_PAIRS = 1 << 18


def range_buckets(spark: SparkSession, size: int) -> int:
    """Buckets for about ``size`` bytes: as many as there are shuffle partitions, more for larger tables."""
    return min(MAX_BUCKETS, max(default_parallelism(spark), -(-size // BUCKET_BYTES)))


def global_window(df: DataFrame, key: str, *, descending: bool = False,
                  tiebreak: list[str] | tuple[str, ...] = (),
                  partition_by: list[str] | tuple[str, ...] = (),
                  value: str | None = None, lag: bool = False,
                  n_buckets: int | None = None, ordered_output: bool = False,
                  tiebreak_descending: bool = False, dense: bool = False, peers: bool = False,
                  frame: int | None = None) -> DataFrame:
    """Add ordinals of ``df`` ordered by ``key`` then ``tiebreak`` within
    ``partition_by`` groups (the whole table when empty).

    Adds ``gw_row_number`` (ROW_NUMBER over key, tiebreak), ``gw_rank`` (RANK
    over key), with ``value`` ``gw_running_sum`` (SUM(value) ROWS UNBOUNDED
    PRECEDING), with ``lag`` ``gw_lag`` (LAG(key) over key, tiebreak), and for
    an unpartitioned window ``gw_count`` and, with ``value``, ``gw_total``.
    ``dense`` adds ``gw_dense_rank`` (DENSE_RANK over key). With ``value``,
    ``peers`` adds ``gw_range_sum`` (SUM(value) over the default RANGE frame) and
    ``frame`` = n adds ``gw_frame_sum`` and ``gw_frame_count`` (SUM and COUNT of
    value, ROWS n-1 PRECEDING). ``value`` and
    a descending key must be non-null (NULL groups and NULL ascending keys sort first);
    (group, key, tiebreak) should be unique for deterministic row numbers.

    ``tiebreak_descending`` orders the (numeric) tie-breakers descending, so
    a descending key with descending tie-breakers is the exact reverse of the
    ascending order (row n of one is row N - n + 1 of the other).

    With ``ordered_output`` the result keeps the ``_gw_bucket`` column and is
    range-partitioned by it, so ``orderBy(_gw_bucket, <window order>)`` -
    the window's own order - needs no further exchange, only a local sort.
    """
    if (peers or frame) and value is None:
        raise ValueError("peers and frame need a value column")
    if frame is not None and not 1 <= frame <= MAX_FRAME:
        raise ValueError(f"a ROWS frame holds 1 to {MAX_FRAME} rows")
    n = min(n_buckets or default_parallelism(df.sparkSession), MAX_BUCKETS)
    parts = list(partition_by)
    k = F.col(key)
    kx = -k if descending else k  # ascending surrogate of the key
    key_order = k.desc() if descending else k.asc()
    tb_order = [F.col(c).desc() if tiebreak_descending else F.col(c).asc() for c in tiebreak]
    tb_asc = [-F.col(c) if tiebreak_descending else F.col(c) for c in tiebreak]  # ascending surrogates
    local_order = [key_order] + tb_order
    full_order = [F.col(c).asc() for c in parts] + local_order

    grp = F.struct(*[F.col(c) for c in parts]) if parts else F.lit(0)
    # Bucket ids depend on sampled range bounds, so they are fixed once by
    # writing them out; every branch below then reads the same assignment.
    ranged = stage(
        df.repartitionByRange(n, *full_order).withColumn(BUCKET, F.spark_partition_id()),
        "global-window",
    )

    # -- 2. one summary row per bucket --------------------------------------
    pos = F.struct(grp.alias("g"), kx.alias("k"), *[t.alias(f"t{i}") for i, t in enumerate(tb_asc)])
    aggs = [F.count(F.lit(1)).alias("_cnt"), F.min(pos).alias("_first"), F.max(pos).alias("_last")]
    if value is not None:
        aggs.append(F.sum(value).alias("_vsum"))
    stats = ranged.groupBy(BUCKET).agg(*aggs).select(
        BUCKET, "_cnt", *(["_vsum"] if value is not None else []),
        F.col("_first.g").alias("_gf"), F.col("_first.k").alias("_kf"),
        F.col("_last.g").alias("_gl"), F.col("_last.k").alias("_kl"),
    )

    # rows of the bucket's last group (and last key), which continue in the next
    # bucket, and of its first key, which continue from the one before
    in_last = F.col("_g").eqNullSafe(F.col("_gl"))
    at_first = F.col("_g").eqNullSafe(F.col("_gf")) & F.col("_kx").eqNullSafe(F.col("_kf"))
    border_aggs = [
        F.sum(F.when(in_last, 1).otherwise(0)).alias("_tcnt"),
        F.sum(F.when(in_last & F.col("_kx").eqNullSafe(F.col("_kl")), 1).otherwise(0)).alias("_ttie"),
    ]
    if value is not None:
        border_aggs.append(F.sum(F.when(in_last, F.col("_v"))).alias("_tsum"))
    if peers:
        border_aggs.append(F.sum(F.when(at_first, F.col("_v"))).alias("_hsum"))
    if dense:
        border_aggs.append(F.count_distinct(F.when(in_last, F.struct("_kx"))).alias("_tdis"))
    edges = stats.select(BUCKET, "_gf", "_kf", "_gl", "_kl")
    borders = (
        ranged.select(BUCKET, grp.alias("_g"), kx.alias("_kx"),
                      *([F.col(value).alias("_v")] if value is not None else []))
        .join(F.broadcast(edges), BUCKET)
        .groupBy(BUCKET)
        .agg(*border_aggs)
    )
    buckets = stats.join(borders, BUCKET)

    # Carries into bucket b come from the run of buckets just before it that
    # end in b's first group (and, for ties, its first key): rows are ordered,
    # so such buckets are contiguous and end at b-1. Running sums over runs of
    # equal (last group[, last key]) plus a LAG give them; every window here
    # runs over one row per bucket.
    order = Window.orderBy(BUCKET)
    upto = Window.unboundedPreceding
    run_g = Window.partitionBy("_gl").orderBy(BUCKET).rowsBetween(upto, Window.currentRow)
    run_gk = Window.partitionBy("_gl", "_kl").orderBy(BUCKET).rowsBetween(upto, Window.currentRow)
    same_g = F.coalesce(F.lag("_gl").over(order).eqNullSafe(F.col("_gf"))
                        & F.lag(BUCKET).over(order).isNotNull(), F.lit(False))
    same_gk = same_g & F.lag("_kl").over(order).eqNullSafe(F.col("_kf"))
    buckets = buckets.withColumn("_same_gk", same_gk)
    # a key shared with the bucket before is counted there already
    fresh = F.col("_tdis") - F.when(F.col("_same_gk") & F.col("_gf").eqNullSafe(F.col("_gl")), 1).otherwise(0) if dense else None
    onward = Window.partitionBy("_gf", "_kf").orderBy(F.col(BUCKET).desc()).rowsBetween(upto, Window.currentRow)
    runs = buckets.select(
        "*",
        F.row_number().over(order).alias("_place"),
        F.sum("_tcnt").over(run_g).alias("_rcnt"),
        F.sum("_ttie").over(run_gk).alias("_rtie"),
        *([F.sum("_tsum").over(run_g).alias("_rsum")] if value is not None else []),
        *([F.sum(fresh).over(run_g).alias("_rdis")] if dense else []),
        *([F.sum("_hsum").over(onward).alias("_hrun")] if peers else []),
    )
    cols = [
        BUCKET, "_gf", "_kf", "_gl", "_kl", "_place", "_rcnt", F.col("_same_gk").cast("int").alias("_same_gk"),
        F.when(same_g, F.lag("_rcnt").over(order)).otherwise(F.lit(0)).alias("_off"),
        F.when(same_gk, F.lag("_rtie").over(order)).otherwise(F.lit(0)).alias("_tied"),
        F.when(same_g, F.lag("_kl").over(order)).alias("_lagk"),
    ]
    if value is not None:
        cols.append(F.when(same_g, F.lag("_rsum").over(order)).otherwise(F.lit(0)).alias("_voff"))
    if dense:
        cols.append(F.when(same_g, F.lag("_rdis").over(order)).otherwise(F.lit(0)).alias("_doff"))
    if peers:
        continues = F.lead("_gf").over(order).eqNullSafe(F.col("_gl")) & F.lead("_kf").over(order).eqNullSafe(F.col("_kl"))
        continues = F.lead(BUCKET).over(order).isNotNull() & continues
        cols.append(F.when(continues, F.lead("_hrun").over(order)).otherwise(F.lit(0)).alias("_ahead"))
    if not parts:
        everything = Window.partitionBy(F.lit(0))
        cols.append(F.sum("_cnt").over(everything).alias(COUNT))
        if value is not None:
            cols.append(F.sum("_vsum").over(everything).alias(TOTAL))
    summary = runs.select(*cols)

    # -- 3. local ordinals inside (bucket, group) ---------------------------
    local = Window.partitionBy(BUCKET, *parts).orderBy(*local_order)
    local_rank = Window.partitionBy(BUCKET, *parts).orderBy(key_order)
    source = ranged
    if frame and frame > 1:
        halo = _halo(ranged, summary, grp, [(key, descending), *[(c, tiebreak_descending) for c in tiebreak]], frame, n)
        source = ranged.withColumn("_halo", F.lit(False)).unionByName(halo)
    # ranges of bucket ids satisfy the (bucket, group) clustering of the local
    # windows and, being ordered, a later sort by bucket
    if ordered_output:
        source = source.repartitionByRange(n, BUCKET)
    if frame:
        last_rows = local.rowsBetween(1 - frame, Window.currentRow)
        source = source.withColumn(FRAME_SUM, F.sum(value).over(last_rows)).withColumn(
            FRAME_COUNT, F.count(value).over(last_rows))
        if frame > 1:
            source = source.where(~F.col("_halo")).drop("_halo")
    rows = source.withColumn("_lrn", F.row_number().over(local)).withColumn(
        "_lrank", F.rank().over(local_rank))
    if dense:
        rows = rows.withColumn("_ldense", F.dense_rank().over(local_rank))
    if peers:
        rows = rows.withColumn("_lrange", F.sum(value).over(local_rank))
    if value is not None:
        rows = rows.withColumn("_lcum", F.sum(value).over(
            local.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    if lag:
        rows = rows.withColumn("_llag", F.lag(key).over(local))

    out = rows.join(F.broadcast(summary.drop("_place", "_rcnt")), BUCKET)
    first_grp = grp.eqNullSafe(F.col("_gf"))
    carried = F.when(first_grp, F.col("_off")).otherwise(F.lit(0))
    tied = F.when(first_grp & kx.eqNullSafe(F.col("_kf")), F.col("_tied")).otherwise(F.lit(0))
    extra = [
        (F.col("_lrn") + carried).cast("long").alias(ROW_NUMBER),
        (F.col("_lrank") + carried - tied).cast("long").alias(RANK),
    ]
    if value is not None:
        extra.append((F.col("_lcum") + F.when(first_grp, F.col("_voff")).otherwise(F.lit(0)))
                     .alias(RUNNING_SUM))
    if lag:
        prev = -F.col("_lagk") if descending else F.col("_lagk")
        extra.append(F.when((F.col("_lrn") == 1) & first_grp, prev)
                     .otherwise(F.col("_llag")).alias(LAG))
    if dense:
        shared = F.when(first_grp, F.col("_doff") - F.col("_same_gk")).otherwise(F.lit(0))
        extra.append((F.col("_ldense") + shared).cast("long").alias(DENSE_RANK))
    if peers:
        at_last = grp.eqNullSafe(F.col("_gl")) & kx.eqNullSafe(F.col("_kl"))
        extra.append((F.col("_lrange") + F.when(first_grp, F.col("_voff")).otherwise(F.lit(0))
                      + F.when(at_last, F.col("_ahead")).otherwise(F.lit(0))).alias(RANGE_SUM))
    if frame:
        extra += [F.col(FRAME_SUM), F.col(FRAME_COUNT).cast("long").alias(FRAME_COUNT)]
    if not parts:
        extra.append(F.col(COUNT).cast("long").alias(COUNT))
        if value is not None:
            extra.append(F.col(TOTAL))
    keep = [BUCKET] if ordered_output else []
    return out.select(*df.columns, *extra, *keep)


def _halo(ranged: DataFrame, summary: DataFrame, grp: Column, order: list[tuple[str, bool]], frame: int,
          n: int) -> DataFrame:
    """Copies of rows in the later buckets whose first rows have them in their ROWS frame.

    A row of a bucket's last group is needed in a later bucket that starts with
    that group if fewer than ``frame - 1`` rows stand between: those after it in
    its own bucket and all of the buckets in between, which hold that group only.
    """
    steps = F.explode(F.sequence(F.lit(1), F.lit(frame - 1)))
    here = summary.select(F.col(BUCKET).alias("_from"), F.col("_gl").alias("_g"), "_rcnt", F.col("_place").alias("_p"), steps.alias("_d"))
    there = summary.select(F.col(BUCKET).alias("_to"), F.col("_gf").alias("_tg"), "_off", F.col("_place").alias("_tp"))
    gap = F.col("_off") - F.col("_rcnt")
    reach = here.join(there, F.col("_tp") == F.col("_p") + F.col("_d")).where(
        F.col("_tg").eqNullSafe(F.col("_g")) & (gap < frame - 1)).select("_from", "_to", gap.alias("_gap"))
    if n * (frame - 1) <= _BROADCAST_PAIRS:
        reach = F.broadcast(reach)
    ends = ranged.join(F.broadcast(summary.select(F.col(BUCKET).alias("_from"), "_gl")), F.col(BUCKET) == F.col("_from"))
    ends = ends.where(grp.eqNullSafe(F.col("_gl"))).drop("_from", "_gl")
    backwards = Window.partitionBy(BUCKET).orderBy(*[_reverse(c) for c in order])
    ends = ends.withColumn("_after", F.row_number().over(backwards) - 1).where(F.col("_after") < frame - 1)
    copies = ends.join(reach, F.col(BUCKET) == F.col("_from")).where(F.col("_after") + F.col("_gap") < frame - 1)
    kept = [c for c in ranged.columns if c != BUCKET]
    return copies.select(*kept, F.col("_to").alias(BUCKET), F.lit(True).alias("_halo"))


def _reverse(order: tuple[str, bool]) -> Column:
    name, descending = order
    return F.col(name).asc() if descending else F.col(name).desc()


def percent_rank(rank: str | Column, count: str | Column) -> Column:
    """(rank - 1) / (n - 1), 0 for a single row."""
    r = F.col(rank) if isinstance(rank, str) else rank
    n = F.col(count) if isinstance(count, str) else count
    return F.when(n <= 1, F.lit(0.0)).otherwise((r - 1).cast("double") / (n - 1).cast("double"))
