"""Jobs and sinks: ingest + run log (S-05..S-08), warehouse reads (S-03/S-04), marts (B-*)."""

import datetime as dt

import pytest

from conftest import cust, item, order, prod, raw_frames, review, seller
from marketlens.plans.ingest import run_ingest
from marketlens.plans.marts import build_marts
from marketlens.sources.warehouse import (
    expire_versions, latest_run, load_fact, open_star, publish_star, read_fact, read_runs, read_table, star_versions)


def _raw(spark):
    orders, items = [], []
    for i in range(40):
        month = 1 + i % 6
        orders.append(order(f"o{i}", f"c{i % 8}", f"2020-{month:02d}-{1 + i % 27:02d} 10:00:00",
                            delivered=f"2020-{month:02d}-28 10:00:00"))
        items.append(item(f"o{i}", 1, f"p{i % 5}", f"s{i % 3}", f"{10 + i}.50", "1.25"))
    return raw_frames(spark, orders, items, [cust(f"c{i}", state=["SP", "RJ"][i % 2]) for i in range(8)],
                      [prod(f"p{i}", ["toys", "auto"][i % 2]) for i in range(5)], [seller(f"s{i}") for i in range(3)],
                      [review(f"o{i}", 1 + i % 5) for i in range(40)])


def test_ingest_writes_star_and_logs_run(spark, tmp_path):
    out = str(tmp_path / "wh")
    res = run_ingest(spark, out, raw=_raw(spark))
    assert res.status == "success" and res.rows_loaded == 40 + 8 + 5 + 3
    assert res.rows_per_table == {"fact_orders": 40, "dim_customers": 8, "dim_products": 5, "dim_sellers": 3}
    assert "56" in res.message
    assert isinstance(latest_run(spark, out), dt.datetime)
    assert latest_run(spark, out, status="failed") is None
    fact, fresh, source = load_fact(spark, out)
    assert source == "warehouse" and fresh is not None and fact.count() == 40
    assert "order_month" not in fact.columns and "month" in fact.columns


def test_failed_ingest_is_logged_not_raised(spark, tmp_path):
    out = str(tmp_path / "wh")
    res = run_ingest(spark, out, raw_dir=str(tmp_path / "missing"))
    assert res.status == "failed" and res.rows_loaded == 0 and "Missing required CSV" in res.message
    runs = read_runs(spark, out).collect()
    assert [r.status for r in runs] == ["failed"]


def _star(spark, n):
    """Star with ``n`` orders."""
    from marketlens.operators.star import build_star

    raw = _raw(spark)
    raw["orders"] = raw["orders"].limit(n)
    return build_star(raw)


def test_failing_load_leaves_the_old_star_whole(spark, tmp_path):
    from pyspark.sql import functions as F

    out = str(tmp_path / "wh")
    first = publish_star(_star(spark, 40), out)
    broken = _star(spark, 10)
    broken["dim_sellers"] = broken["dim_sellers"].withColumn("city", F.raise_error(F.lit("no sellers today")).cast("string"))
    with pytest.raises(Exception, match="no sellers today"):
        publish_star(broken, out)
    now = open_star(spark, out)
    assert now.version == first.version and star_versions(spark, out) == [first.version]
    assert {name: read_table(spark, now.path, name).count() for name in first.rows} == first.rows
    assert read_fact(spark, now.path, schema=now.schemas["fact_orders"]).count() == 40
    assert [p.name for p in (tmp_path / "wh" / "versions").iterdir()] == [first.version]  # nothing of the failed one is left


def test_reader_keeps_its_version_during_a_reload(spark, tmp_path):
    out = str(tmp_path / "wh")
    publish_star(_star(spark, 40), out)
    before, _, _ = load_fact(spark, out)
    held = open_star(spark, out)
    second = publish_star(_star(spark, 12), out)
    assert before.count() == 40 and read_table(spark, held.path, "dim_customers").count() == 8
    assert load_fact(spark, out)[0].count() == 12
    assert open_star(spark, out, held.version).rows["fact_orders"] == 40
    third = publish_star(_star(spark, 3), out)
    assert expire_versions(spark, out, keep=2) == [held.version]
    assert star_versions(spark, out) == [second.version, third.version] and open_star(spark, out, held.version) is None
    assert load_fact(spark, out)[0].count() == 3


def test_fact_from_raw_files_is_built_once(spark, tmp_path):
    for name, df in _raw(spark).items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    fact, fresh, source = load_fact(spark, str(tmp_path / "none"), str(tmp_path), "parquet", state="SP")
    assert source == "PARQUET" and fresh is None and fact.count() == 20
    plan = spark._jvm.PythonSQLUtils.explainString(fact._jdf.queryExecution(), "formatted")
    assert "Join" not in plan and "EqualTo(customer_state,SP)" in plan
    with pytest.raises(RuntimeError):
        load_fact(spark, str(tmp_path / "none"))


def test_date_range_prunes_partitions(spark, tmp_path):
    out = str(tmp_path / "wh")
    run_ingest(spark, out, raw=_raw(spark))
    df = read_fact(spark, open_star(spark, out).path, "2020-02-10", "2020-03-05")
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(order_month" in plan
    assert "PushedFilters: [IsNotNull(order_purchase_timestamp), GreaterThanOrEqual(order_purchase_timestamp" in plan
    got = [r.order_purchase_timestamp for r in df.collect()]
    assert got and all(dt.datetime(2020, 2, 10) <= t < dt.datetime(2020, 3, 6) for t in got)


def test_marts(spark, tmp_path):
    out = str(tmp_path / "wh")
    run_ingest(spark, out, raw=_raw(spark))
    fact, _, _ = load_fact(spark, out)
    counts = build_marts(fact, str(tmp_path / "marts"), restarts=2)
    assert counts["executive/kpi_summary"] == 4
    assert counts["customer/rfm_segments"] == 8
    assert counts["product/review_sentiment"] == 3
    assert counts["predictive/churn_metrics"] == 2
    assert counts["predictive/forecast_ewma"] == 7  # 6 months + 1 future
    filtered = build_marts(fact, str(tmp_path / "marts_f"), "2020-01-01", "2020-02-28", "toys", "SP",
                           marts=("executive", "product"))
    assert filtered["executive/category_revenue_top10"] == 1


def test_parquet_raw_source(spark, tmp_path):
    from marketlens.sources.raw import load_raw

    raw = _raw(spark)
    d = tmp_path / "rawpq"
    for name, df in raw.items():
        df.write.parquet(str(d / f"{name}.parquet"))
    loaded = load_raw(spark, str(d), fmt="parquet")
    res = run_ingest(spark, str(tmp_path / "wh"), raw=loaded)
    assert res.status == "success" and res.rows_per_table["fact_orders"] == 40
    with pytest.raises(FileNotFoundError):
        load_raw(spark, str(tmp_path / "none"), fmt="parquet")
