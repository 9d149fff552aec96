"""The range-bucketed global window equals Spark's own window functions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions.exprs import ntile_from_row_number
from ledgerline.plans.global_window import (
    DENSE_RANK,
    FRAME_COUNT,
    FRAME_SUM,
    RANGE_SUM,
    COUNT,
    LAG,
    RANK,
    ROW_NUMBER,
    RUNNING_SUM,
    TOTAL,
    global_window,
    percent_rank,
)


def _data(spark, n, seed, hot_share=0.4, tie_values=(5, 7, 9)):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g = 0 if rnd.random() < hot_share else rnd.randint(1, 20)
        key = rnd.choice(tie_values) if rnd.random() < 0.5 else rnd.randint(0, 100)
        rows.append((i, g, key, rnd.randint(-50, 100)))
    return spark.createDataFrame(rows, "id long, g int, key long, v long")


def _expected(df, parts, desc):
    ko = F.col("key").desc() if desc else F.col("key").asc()
    w = (Window.partitionBy(*parts) if parts else Window).orderBy(ko, "id")
    wr = (Window.partitionBy(*parts) if parts else Window).orderBy(ko)
    return df.select(
        "id",
        F.row_number().over(w).alias("rn"),
        F.rank().over(wr).alias("rk"),
        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cs"),
        F.lag("key").over(w).alias("lg"),
    )


@pytest.mark.parametrize("parts", [[], ["g"]])
@pytest.mark.parametrize("desc", [False, True])
@pytest.mark.parametrize("buckets", [1, 7, 16])
def test_matches_plain_windows(spark, parts, desc, buckets):
    df = _data(spark, 1500, seed=buckets * 10 + len(parts) + desc)
    out = global_window(df, "key", descending=desc, tiebreak=["id"], partition_by=parts,
                        value="v", lag=True, n_buckets=buckets)
    joined = out.join(_expected(df, parts, desc), "id")
    bad = joined.where(
        (F.col(ROW_NUMBER) != F.col("rn")) | (F.col(RANK) != F.col("rk"))
        | (F.col(RUNNING_SUM) != F.col("cs")) | ~F.col(LAG).eqNullSafe(F.col("lg")))
    assert out.count() == 1500
    assert bad.count() == 0


def test_descending_tiebreak_is_exact_reverse(spark):
    df = _data(spark, 800, seed=11)
    out = global_window(df, "key", descending=True, tiebreak=["id"], tiebreak_descending=True,
                        value="v", lag=True, n_buckets=6)
    w = Window.orderBy(F.col("key").desc(), F.col("id").desc())
    ref = df.select("id", F.row_number().over(w).alias("rn"),
                    F.rank().over(Window.orderBy(F.col("key").desc())).alias("rk"),
                    F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cs"),
                    F.lag("key").over(w).alias("lg"),
                    F.row_number().over(Window.orderBy("key", "id")).alias("rn_asc"))
    j = out.join(ref, "id")
    bad = j.where((F.col(ROW_NUMBER) != F.col("rn")) | (F.col(RANK) != F.col("rk"))
                  | (F.col(RUNNING_SUM) != F.col("cs")) | ~F.col(LAG).eqNullSafe(F.col("lg"))
                  | (F.col(COUNT) - F.col(ROW_NUMBER) + 1 != F.col("rn_asc")))
    assert bad.count() == 0


def test_null_groups(spark):
    rows = [(i, None if i % 3 == 0 else i % 4, i % 7, 1) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, g int, key long, v long")
    out = global_window(df, "key", tiebreak=["id"], partition_by=["g"], value="v", lag=True, n_buckets=9)
    joined = out.join(_expected(df, ["g"], False), "id")
    bad = joined.where(
        (F.col(ROW_NUMBER) != F.col("rn")) | (F.col(RANK) != F.col("rk"))
        | (F.col(RUNNING_SUM) != F.col("cs")) | ~F.col(LAG).eqNullSafe(F.col("lg")))
    assert bad.count() == 0


def test_single_key_value_everywhere(spark):
    """All rows tie on the key (a worst-case hot value): still exact."""
    df = spark.createDataFrame([(i, 0, 42, 1) for i in range(300)], "id long, g int, key long, v long")
    out = global_window(df, "key", tiebreak=["id"], value="v", n_buckets=8)
    r = out.agg(F.max(RANK).alias("mr"), F.max(ROW_NUMBER).alias("mn"),
                F.max(RUNNING_SUM).alias("ms"), F.countDistinct(ROW_NUMBER).alias("d"))
    row = r.collect()[0]
    assert (row.mr, row.mn, row.ms, row.d) == (1, 300, 300, 300)


def test_totals_and_percent_rank(spark):
    df = _data(spark, 400, seed=3)
    out = global_window(df, "key", descending=True, tiebreak=["id"], value="v", n_buckets=5)
    ref = df.select("id", F.percent_rank().over(Window.orderBy(F.col("key").desc())).alias("pr"),
                    F.ntile(4).over(Window.orderBy(F.col("key").desc(), "id")).alias("nt"))
    j = out.join(ref, "id").select(
        percent_rank(RANK, COUNT).alias("mine"), "pr",
        ntile_from_row_number(ROW_NUMBER, COUNT, 4).alias("my_nt"), "nt", COUNT, TOTAL)
    rows = j.collect()
    total = df.agg(F.sum("v")).collect()[0][0]
    assert all(r.mine == r.pr and r.my_nt == r.nt and r[COUNT] == 400 and r[TOTAL] == total for r in rows)


def test_empty_input(spark):
    df = spark.createDataFrame([], "id long, g int, key long, v long")
    assert global_window(df, "key", tiebreak=["id"], value="v").count() == 0


@pytest.mark.parametrize("n,k", [(1, 4), (3, 4), (4, 4), (5, 4), (10, 4), (11, 3), (0, 4)])
def test_ntile_formula(spark, n, k):
    if n == 0:
        return
    df = spark.range(1, n + 1).select(F.col("id").alias("rn"))
    got = df.select("rn", ntile_from_row_number("rn", F.lit(n), k).alias("t"),
                    F.ntile(k).over(Window.orderBy("rn")).alias("ref")).collect()
    assert all(r.t == r.ref for r in got)


@pytest.mark.parametrize("parts", [[], ["g"]])
@pytest.mark.parametrize("desc", [False, True])
@pytest.mark.parametrize("buckets,frame", [(1, 7), (5, 2), (40, 7)])
def test_dense_peer_and_bounded_frames_match_plain_windows(spark, parts, desc, buckets, frame):
    """Buckets of a few rows, so ties and frames reach over several of them."""
    df = _data(spark, 240, seed=buckets + frame + desc, tie_values=(5,))
    ko = F.col("key").desc() if desc else F.col("key").asc()
    w = Window.partitionBy(*(parts or [F.lit(0)]))
    want = df.select(
        "id", F.dense_rank().over(w.orderBy(ko)).alias("dr"), F.sum("v").over(w.orderBy(ko)).alias("rs"),
        F.sum("v").over(w.orderBy(ko, "id").rowsBetween(1 - frame, 0)).alias("fs"),
        F.count("v").over(w.orderBy(ko, "id").rowsBetween(1 - frame, 0)).alias("fc"),
        F.row_number().over(w.orderBy(ko, "id")).alias("rn"), F.rank().over(w.orderBy(ko)).alias("rk"),
    )
    out = global_window(df, "key", descending=desc, tiebreak=["id"], partition_by=parts, value="v", lag=True,
                        n_buckets=buckets, dense=True, peers=True, frame=frame, ordered_output=bool(buckets % 2))
    rows = out.join(want, "id").collect()
    assert len(rows) == 240
    for r in rows:
        assert (r[DENSE_RANK], r[RANGE_SUM], r[FRAME_SUM], r[FRAME_COUNT]) == (r["dr"], r["rs"], r["fs"], r["fc"])
        assert (r[ROW_NUMBER], r[RANK]) == (r["rn"], r["rk"])


def test_one_key_over_many_buckets(spark):
    """All rows are peers: one dense rank, one shared sum, in every bucket."""
    df = spark.createDataFrame([(i, 7, i) for i in range(300)], "id long, key long, v long")
    out = global_window(df, "key", tiebreak=["id"], value="v", n_buckets=9, dense=True, peers=True, frame=50)
    rows = sorted(out.collect(), key=lambda r: r["id"])
    assert {r[DENSE_RANK] for r in rows} == {1} and {r[RANGE_SUM] for r in rows} == {sum(range(300))}
    assert [r[FRAME_SUM] for r in rows] == [sum(range(max(0, i - 49), i + 1)) for i in range(300)]


def test_null_groups_null_keys_and_empty_tables_in_frames(spark):
    schema = "id long, g string, key long, v long"
    df = spark.createDataFrame([(i, [None, "a", "b"][i % 3], i // 10 if i > 25 else None, i) for i in range(90)], schema)
    args = dict(tiebreak=["id"], partition_by=["g"], value="v", n_buckets=20, dense=True, peers=True, frame=4)
    w = Window.partitionBy("g")
    want = df.select("id", F.dense_rank().over(w.orderBy("key")).alias("dr"), F.sum("v").over(w.orderBy("key")).alias("rs"),
                     F.sum("v").over(w.orderBy("key", "id").rowsBetween(-3, 0)).alias("fs"))
    got = global_window(df, "key", **args).select("id", DENSE_RANK, RANGE_SUM, FRAME_SUM)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert global_window(df.limit(0), "key", **args).collect() == []


def test_frame_arguments_are_checked(spark):
    df = _data(spark, 5, seed=1)
    for bad in (dict(frame=3), dict(peers=True), dict(value="v", frame=0), dict(value="v", frame=5000)):
        with pytest.raises(ValueError):
            global_window(df, "key", tiebreak=["id"], **bad)


def test_rows_are_numbered_in_order(spark):
    from ledgerline.plans.numbering import number_rows

    rnd = random.Random(4)
    rows = [(rnd.choice([None, 1, 1, 1, rnd.randint(0, 50)]), rnd.randint(0, 3)) for _ in range(500)]
    df = spark.createDataFrame(rows, "a long, b long")
    got = sorted(map(tuple, number_rows(df, ["a", "b"], "n", 7).collect()), key=lambda r: r[2])
    assert [r[2] for r in got] == list(range(1, 501))
    assert [r[:2] for r in got] == sorted(rows, key=lambda r: (r[0] is not None, r))
    assert number_rows(df.limit(0), ["a", "b"], "n", 7).collect() == []
