"""What loading and pairing leave on disk: nothing that is not read again."""

from __future__ import annotations

import datetime as dt
import os
import re
import time

import pytest

from ledgerline.plans.materialize import SHUFFLE_CLEANUP, drop_staged, shuffles_freed, stage
from ledgerline.session import scratch_dir
from ledgerline.sources.clustered import write_clustered
from ledgerline.sources.conform import categories, conform_star, order_date_bounds, order_lines
from ledgerline.sources.warehouse import star_for

ORDERS = {1: 11, 2: 12, 30: 13}


def _source(spark, folder):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")

    write("region", [(0, "r")], "r_regionkey int, r_name string")
    write("nation", [(0, "n", 0)], "n_nationkey int, n_name string, n_regionkey int")
    write("customer", [(k, 0, "m") for k in ORDERS.values()], "c_custkey long, c_nationkey int, c_mktsegment string")
    write("part", [(k, "p", "b", f"t{k % 3}", k) for k in range(6)],
          "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    write("orders", [(o, c, dt.datetime(1996, 1, c)) for o, c in ORDERS.items()], "o_orderkey long, o_custkey long, o_orderdate timestamp")
    lines = [(o, k, p, 2.0, 10.0 + k, 0.0) for o in (*ORDERS, 99, None) for k, p in enumerate((0, 4, 4, 7, None))]
    write("lineitem", lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_discount double")
    return str(folder), lines


def _shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (found.apply(i).getName() for i in range(found.size())) if name.startswith("shuffle_")}


def _gone(spark, before):
    for _ in range(100):  # they are deleted in the background
        left = _shuffle_files(spark) - before
        if not left:
            return True
        time.sleep(0.1)
    return left


def test_writes_leave_no_shuffle_files(spark, tmp_path):
    before = _shuffle_files(spark)
    held = stage(spark.range(1000).repartition(7, "id"), "test-freed")
    assert _gone(spark, before) is True
    assert held.count() == 1000
    sf, lines = _source(spark, tmp_path / "in")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fact = conform_star(spark, sf).fact_order_line
        before = _shuffle_files(spark)
        clustered = write_clustered(fact, f"{tmp_path}/out", 3)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert _gone(spark, before) is True
    assert clustered.large.count() == 5 and clustered.lines().count() == len(lines)


@pytest.mark.parametrize("before", [None, "false"])
def test_the_session_keeps_its_setting(spark, before):
    if before:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    try:
        with shuffles_freed(spark):
            with shuffles_freed(spark):
                pass
            assert spark.conf.get(SHUFFLE_CLEANUP) == "true"
        assert spark.conf.get(SHUFFLE_CLEANUP, None) == before
        with pytest.raises(ZeroDivisionError), shuffles_freed(spark):
            1 / 0
        assert spark.conf.get(SHUFFLE_CLEANUP, None) == before
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP)


def test_lines_are_shuffled_by_order_once(spark, tmp_path):
    """The join with the orders already deals the lines as the clustered fact holds them."""
    sf, _ = _source(spark, tmp_path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fact = conform_star(spark, sf).fact_order_line
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        plan = fact.repartition(n, "order_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = re.findall(r"Exchange hashpartitioning\((\w+)", plan)
    assert dealt.count("order_id") == 1 and "l_orderkey" not in dealt, plan
    assert "REPARTITION_BY_NUM" not in plan


def test_numbered_lines_are_dropped_with_the_star(spark, tmp_path):
    def numbered():
        folder = scratch_dir(spark).removeprefix("file:")
        return {x for x in os.listdir(folder) if x.startswith("numbered-")}

    sf, lines = _source(spark, tmp_path)
    before = numbered()
    fact = star_for(spark, sf).fact_order_line
    assert numbered() == before
    got = sorted(((r.order_id, r.customer_key, r.product_key, r.category_key, float(r.gross_amount)) for r in fact.collect()), key=str)
    want = [(None if o is None else str(o), ORDERS.get(o), p, None if p in (7, None) else p % 3 + 1, price) for o, _, p, _, price, _ in lines]
    assert got == sorted(want, key=str)
    assert sorted(r[0] for r in fact.select("order_line_id").collect()) == list(range(1, len(lines) + 1))
    other = stage(spark.range(3), "test-kept")
    gone = stage(spark.range(3), "test-dropped")
    assert drop_staged(gone) == [] and other.count() == 3 and not os.path.exists(gone.inputFiles()[0].removeprefix("file://"))


@pytest.mark.parametrize(("line_type", "order_type", "line_key", "order_key", "found"), [
    ("int", "long", 7, 7, True), ("string", "string", "07", "07", True), ("string", "string", "07", "7", False),
    ("string", "long", "07", 7, True), ("decimal(9,2)", "decimal(9,0)", 7, 7, True), ("double", "long", 7.0, 7, True),
])
def test_orders_match_as_their_keys_compare(spark, line_type, order_type, line_key, order_key, found):
    """The clustering key is text; keys whose texts may differ though they are equal are joined as they are."""
    from decimal import Decimal

    def key(kind, value):
        return Decimal(value) if kind.startswith("decimal") else value

    lineitem = spark.createDataFrame([(key(line_type, line_key), 1, 5, 2.0, 10.0, 0.0)],
                                     f"l_orderkey {line_type}, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_discount double")
    orders = spark.createDataFrame([(key(order_type, order_key), 42, dt.datetime(1996, 1, 1))], f"o_orderkey {order_type}, o_custkey long, o_orderdate timestamp")
    part = spark.createDataFrame([(5, "t")], "p_partkey long, p_type string")
    lines = order_lines(lineitem, orders, part, categories(part), order_date_bounds(orders))
    assert [r[0] for r in lines.select("customer_key").collect()] == [42 if found else None]
