"""Group aggregates beside every row: exact moments, null groups, hot groups."""

from __future__ import annotations

import random
import statistics
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerline.plans.group_totals import moments, stddev_samp, with_group_totals
from test_skew import SKEW_CONF, _executed

SCHEMA = "id long, g string, v decimal(12,2)"


def _rows(n, seed=1):
    rnd = random.Random(seed)
    return [(i, rnd.choice([None, "a", "a", "a", f"g{i % 40}"]), Decimal(rnd.randint(-10**6, 10**6)) / 100) for i in range(n)]


def test_moments_of_every_group(spark):
    rows = _rows(400) + [(999, "single", Decimal("5.00")), (1000, "none", None), (1001, "none", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = with_group_totals(df, ["g"], moments("v")).withColumn("sd", stddev_samp()).collect()
    assert sorted(r["id"] for r in out) == sorted(i for i, _, _ in rows)
    for r in out:
        values = [v for _, g, v in rows if g == r["g"] and v is not None]
        assert r["m_n"] == len(values)
        want = float(statistics.stdev(values)) if len(values) > 1 else None
        assert r["sd"] == (pytest.approx(want, rel=1e-12) if want is not None else None)


def test_moments_do_not_depend_on_partitioning(spark):
    """A small spread on large values, where sums of floats would cancel."""
    values = [Decimal("9999999999.00"), Decimal("9999999999.01"), Decimal("9999999999.02")] * 50
    rows = [(i, "a", v) for i, v in enumerate(values)]
    got = {spark.createDataFrame(rows, SCHEMA).repartition(n).agg(*moments("v")).select(stddev_samp()).first()[0] for n in (1, 3, 8)}
    assert len(got) == 1 and got.pop() == pytest.approx(float(statistics.stdev(values)), rel=1e-12)


def test_empty_table(spark):
    assert with_group_totals(spark.createDataFrame([], SCHEMA), ["g"], moments("v")).collect() == []


def test_a_hot_group_is_split(spark):
    saved = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    try:
        for k, v in SKEW_CONF.items():
            spark.conf.set(k, v)
        rows = spark.range(30_000).select(
            F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 3000)).alias("g"),
            (F.col("id") % 100).cast("decimal(12,2)").alias("v"))
        plan = _executed(with_group_totals(rows, ["g"], moments("v")))
    finally:
        for k, v in saved.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "SortMergeJoin(skew=true)" in plan and "Window" not in plan
