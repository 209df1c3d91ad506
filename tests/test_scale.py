"""What bounds a task, the driver and the disk as the tables grow: shares of shuffles, trees of K-Means, joins of customer tables, slices."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens import registry, session
from marketlens.operators import churn, grains
from marketlens.operators.kmeans import multi_start_kmeans, point_trees
from marketlens.operators.prepare import prepare_fact
from marketlens.operators.star import build_star
from marketlens.plans.marts import build_marts
from marketlens.sources.testdata import raw_tables
from marketlens.sources.warehouse import PARTITION_COLUMN, read_table, write_star

from conftest import cust, item, order, prod, raw_frames, review, seller

ADVISORY, INITIAL = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


@pytest.fixture
def sized(spark):
    """The session without the settings under test, which are put back afterwards."""
    before = {key: spark.conf.get(key, None) for key in (ADVISORY, INITIAL)}
    kept = session._SIZED.pop(spark.sparkContext.applicationId, None)
    for key in before:
        spark.conf.unset(key)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    session._SIZED.pop(spark.sparkContext.applicationId, None)
    if kept is not None:
        session._SIZED[spark.sparkContext.applicationId] = kept


def _tables(spark, folder):
    ids = spark.range(1, 401)
    key = F.col("id")
    tables = {
        "nation": spark.range(25).select(key.cast("int").alias("n_nationkey"), key.cast("string").alias("n_name")),
        "customer": ids.select(key.alias("c_custkey"), F.concat(F.lit("c"), key).alias("c_name"), (key % 25).cast("int").alias("c_nationkey")),
        "supplier": ids.select(key.alias("s_suppkey"), (key % 25).cast("int").alias("s_nationkey")),
        "part": ids.select(key.alias("p_partkey"), F.lit("Brand#1").alias("p_brand"), F.lit("part").alias("p_name"), F.lit(3).alias("p_size")),
        "orders": ids.select(key.alias("o_orderkey"), (key % 90).alias("o_custkey"), F.lit("F").alias("o_orderstatus"),
                             F.expr("timestamp_ntz'1997-01-01' + make_dt_interval(int(id))").alias("o_orderdate")),
        "lineitem": ids.select((key % 300).alias("l_orderkey"), F.lit(1).alias("l_linenumber"), key.alias("l_partkey"), key.alias("l_suppkey"),
                               F.lit(10.0).alias("l_extendedprice"), F.lit(0.05).alias("l_tax")),
    }
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")


def test_shuffle_partitions_follow_the_input(sized, tmp_path, monkeypatch):
    _tables(sized, tmp_path)
    raw_tables(sized, str(tmp_path))
    assert int(sized.conf.get(ADVISORY)) == session.TASK_BYTES
    small = int(sized.conf.get(INITIAL))
    assert small == int(sized.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(session, "INPUT_BYTES", 128)
    fact = build_star(raw_tables(sized, str(tmp_path)))["fact_orders"]
    large = int(sized.conf.get(INITIAL))
    assert large > 4 * small
    assert f", {large})" in fact._jdf.queryExecution().executedPlan().toString()
    # 399 items have one of the orders 1 to 299, one has none; the orders 300 to 400 have no item
    assert fact.count() == 399 + 101
    session.size_shuffles(sized, 1)
    assert int(sized.conf.get(INITIAL)) == large


def test_settings_of_the_session_stay(sized):
    sized.conf.set(ADVISORY, "8m")
    sized.conf.set(INITIAL, "77")
    session.apply_core_conf(sized)
    session.size_shuffles(sized, 10**12)
    assert sized.conf.get(ADVISORY) == "8m" and sized.conf.get(INITIAL) == "77"


def test_trees_are_not_one_a_small_partition(spark):
    rows = spark.range(2000, numPartitions=64).select(F.col("id").cast("string").alias("key"), (F.col("id") % 97).cast("double").alias("a"),
                                                      (F.col("id") % 31).cast("double").alias("b"))
    trees = point_trees(rows, ["a", "b"], "key", count=2000)
    assert trees.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert sum(len(r["keys"]) // 8 for r in trees.collect()) == 2000
    one, two = (multi_start_kmeans(rows, ["a", "b"], "key", 3, 4, count=n) for n in (None, 2000))
    assert one.restart == two.restart and np.allclose(one.centers, two.centers)


def test_merges_of_partial_sums_have_few_partitions(spark):
    with session.plain_plans(spark, 3):
        assert spark.range(100).groupBy((F.col("id") % 5).alias("k")).count().rdd.getNumPartitions() == 3
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_customer_tables_are_not_broadcast(spark, tmp_path):
    ids = spark.range(60).select(F.concat(F.lit("c"), F.col("id")).alias("customer_unique_id"), (F.col("id") / 60).alias("churn_probability"),
                                 F.when(F.col("id") % 2 == 0, F.lit("Loyal")).otherwise(F.lit("Lost")).alias("segment"))
    ids.drop("segment").write.parquet(f"{tmp_path}/predictions")
    ids.drop("churn_probability").write.parquet(f"{tmp_path}/rfm")
    predictions, rfm = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("predictions", "rfm"))
    for out in (churn.churn_by_segment(predictions, rfm), churn.churn_scores_top(predictions, rfm, 5)):
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["segment"]: r["churn_probability"] for r in churn.churn_by_segment(predictions, rfm).collect()}
    assert got == pytest.approx({"Loyal": 100 * 29 / 60, "Lost": 50.0})


@pytest.fixture(autouse=True)
def unsized(spark):
    """Inputs that a test names are not those of the tests after it."""
    before = dict(session._INPUTS)
    yield
    session._INPUTS.clear()
    session._INPUTS.update(before)


def _in_slices(spark, monkeypatch, n):
    monkeypatch.setattr(session, "SLICE_BYTES", 10)
    monkeypatch.setitem(session._INPUTS, spark.sparkContext.applicationId, 10 * n)


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "/shuffle_" in f and f.endswith(".data")}


def _left(spark, before):
    """Shuffle files that are there now and were not before; deletion is asynchronous."""
    for _ in range(50):
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return left


def _raw(spark):
    orders = [order(f"o{i}", f"c{i % 7}", f"2020-{1 + i % 5:02d}-{1 + i % 9:02d} 10:00:00") for i in range(40)]
    orders += [order(None, "c1", "2020-02-02 00:00:00"), order("o3", "c2", "2020-03-03 00:00:00"), order("o4", None, None)]
    items = [item(f"o{i % 31}", 1 + i // 31, f"p{i % 6}", f"s{i % 4}", i + 0.25, 1) for i in range(80)] + [item(None, 1, "p1", "s1", 5), item("o5", 9, None, None, 2)]
    reviews = [review(f"o{i % 20}", 1 + i % 5) for i in range(30)]
    return raw_frames(spark, orders, items, [cust(f"c{i}") for i in range(6)], [prod(f"p{i}", f"k{i % 3}") for i in range(5)], [seller("s0"), seller("s1")], reviews)


def _rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_star_is_written_in_slices_of_whole_orders(spark, tmp_path, monkeypatch):
    star = build_star(_raw(spark))
    want = _rows(star["fact_orders"])
    _in_slices(spark, monkeypatch, 3)
    parts = session.slices(star["fact_orders"], "order_id")
    assert [len(_rows(p)) for p in parts] != [len(want), 0, 0] and sorted(sum(map(_rows, parts), [])) == want
    rows = write_star(star, str(tmp_path / "w"))
    assert rows["fact_orders"] == len(want) and rows["dim_customers"] == 6
    stored = spark.read.parquet(str(tmp_path / "w" / "fact_orders")).select(star["fact_orders"].columns)
    assert _rows(stored) == want
    assert {PARTITION_COLUMN} == {f.name.split("=")[0] for f in (tmp_path / "w" / "fact_orders").iterdir() if f.is_dir()}
    assert read_table(spark, str(tmp_path / "w"), "fact_orders").count() == len(want)


def test_a_slice_filters_orders_and_items_before_their_shuffles(sized, tmp_path, monkeypatch):
    _tables(sized, tmp_path)
    fact = build_star(raw_tables(sized, str(tmp_path)))["fact_orders"]
    _in_slices(sized, monkeypatch, 4)
    plan = session.slices(fact, "order_id")[1]._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.split("\n") if "Filter" in line and "pmod(xxhash64(" in line]
    # orders and items joined, orders without items, the items' keys, and two kinds of reviews for either
    assert sum("l_orderkey" in f for f in filters) == 2 and sum("o_orderkey" in f for f in filters) == 6
    monkeypatch.setattr(session, "SLICE_BYTES", 1)
    assert len(session.slices(fact, "order_id")) == session.MAX_SLICES


def test_empty_slices_and_facts_are_written(spark, tmp_path, monkeypatch):
    raw = _raw(spark)
    one = build_star(raw | {n: raw[n].where("order_id = 'o1'") for n in ("orders", "items", "reviews")})
    none = build_star(raw | {n: raw[n].where("order_id = concat('no', order_id)") for n in ("orders", "items", "reviews")})
    want = one["fact_orders"].count()
    assert write_star(none, str(tmp_path / "none"))["fact_orders"] == 0
    _in_slices(spark, monkeypatch, 5)
    assert write_star(one, str(tmp_path / "one"))["fact_orders"] == want > 1


def test_shuffles_of_written_tables_are_deleted(spark, tmp_path, monkeypatch):
    raw = _raw(spark)
    _in_slices(spark, monkeypatch, 2)
    before = _shuffle_files(spark)
    kept = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    kept.collect()
    held = _shuffle_files(spark)
    assert held - before  # a plan that may be used again keeps its files
    write_star(build_star(raw), str(tmp_path / "w"))
    assert not _left(spark, held)
    orders = grains.Stored(grains.order_grain(prepare_fact(build_star(raw)["fact_orders"])), "orders").df
    assert not _left(spark, held)
    months = grains.stored_customer_months(spark, orders)
    assert not _left(spark, held)
    assert months.df.agg(F.sum("orders")).first()[0] == 36  # 34 orders of known customers, one twice as o3, one without a number
    months.drop()
    assert len(kept.collect()) == 7


def test_tables_behind_the_churn_queries_leave_no_shuffles(sized, tmp_path, monkeypatch):
    _tables(sized, tmp_path)
    monkeypatch.setattr(session, "SLICE_BYTES", 10_000)
    before = _shuffle_files(sized)
    months = registry._months(sized, str(tmp_path))  # the star, the orders and the customer months, each stored
    assert len(session.slices(months, "customer_unique_id")) > 1
    assert not _left(sized, before)
    assert months.agg(F.sum("orders")).first()[0] == 396  # of 400 orders four have a customer 0, who is not known


def test_shuffle_deletion_is_put_back(spark):
    assert spark.conf.get(session._FREE, None) is None
    with session.freed_shuffles(spark), session.freed_shuffles(spark):
        assert spark.conf.get(session._FREE) == "true"
    assert spark.conf.get(session._FREE, None) is None
    spark.conf.set(session._FREE, "false")
    try:
        with session.freed_shuffles(spark):
            assert spark.conf.get(session._FREE) == "true"
        assert spark.conf.get(session._FREE) == "false"
    finally:
        spark.conf.unset(session._FREE)


def test_product_months_in_slices_are_the_same(spark, tmp_path, monkeypatch):
    fact = prepare_fact(build_star(_raw(spark))["fact_orders"])
    want = _rows(grains.product_months(fact))
    _in_slices(spark, monkeypatch, 4)
    got = grains.Stored(grains.product_months(fact), "product_months", slice_by="product_id").df
    assert _rows(got) == want
    counts = build_marts(fact, str(tmp_path), marts=("product",))
    assert counts["product/product_performance"] == len({(r["product_id"], r["product_category"]) for r in fact.collect() if r["product_id"]})
