"""KPIs (A-02..A-06, W-02/W-03) and filters (F-01..F-08)."""

import datetime as dt

import pytest

from conftest import cust, item, order, prepared, prod, seller
from marketlens.operators import kpi
from marketlens.operators.prepare import apply_filters, filter_domains


def _fact(spark, months_revenue):
    orders, items, custs = [], [], []
    for i, (ts, rev) in enumerate(months_revenue):
        orders.append(order(f"o{i}", f"c{i % 2}", ts))
        items.append(item(f"o{i}", 1, "p1", "s1", rev))
    return prepared(spark, orders, items, [cust("c0"), cust("c1", state="RJ")], [prod("p1")], [seller("s1")])


def test_mom_uses_last_two_present_months(spark):
    """Q6: non-adjacent months 100 -> 150 gives +50%."""
    fact = _fact(spark, [("2020-01-10 00:00:00", "100"), ("2020-04-10 00:00:00", "150")])
    rows = {r.metric: r for r in kpi.kpi_summary(fact).collect()}
    assert rows["Total Revenue"].value == 250.0
    assert rows["Total Revenue"].delta == pytest.approx(50.0)
    assert rows["Total Orders"].delta == 0.0
    assert rows["Total Revenue"].display_value == "R$ 250"
    assert rows["Total Revenue"].display_delta == "+50.0% MoM"
    assert rows["Total Orders"].display_value == "2"


def test_single_month_zero_deltas(spark):
    """Q7."""
    fact = _fact(spark, [("2020-01-10 00:00:00", "100"), ("2020-01-20 00:00:00", "40")])
    assert {r.delta for r in kpi.kpi_summary(fact).collect()} == {0.0}


def test_monthly_kpis_no_gap_fill_and_invariant(spark):
    """Q8 (KPIs keep only present months) and sum(monthly revenue) = total."""
    fact = _fact(spark, [("2020-01-10 00:00:00", "100.10"), ("2020-04-10 00:00:00", "50.20"),
                         ("2020-04-11 00:00:00", "0.05")])
    m = kpi.monthly_kpis(fact).orderBy("month").collect()
    assert [r.month for r in m] == [dt.datetime(2020, 1, 1), dt.datetime(2020, 4, 1)]
    assert m[1].revenue == 50.25 and m[1].total_orders == 2 and m[1].aov == pytest.approx(25.125)
    total = [r for r in kpi.kpi_summary(fact).collect() if r.metric == "Total Revenue"][0].value
    assert sum(r.revenue for r in m) == pytest.approx(total)


def test_category_status_state(spark):
    fact = _fact(spark, [("2020-01-10 00:00:00", "100"), ("2020-02-10 00:00:00", "30")])
    assert [tuple(r) for r in kpi.category_revenue_top(fact, 10).collect()] == [("toys", 130.0)]
    assert [tuple(r) for r in kpi.order_status_funnel(fact).collect()] == [("delivered", 2)]
    geo = {r.customer_state: r for r in kpi.state_revenue_geo(fact).collect()}
    assert set(geo) == {"SP", "RJ"} and geo["SP"].lat == -23.55


def test_state_na_not_on_map(spark):
    """Q24: 'NA' can be filtered on but has no centroid."""
    fact = prepared(spark, [order("o1", "cX", "2020-01-10 00:00:00")], [item("o1", 1, "p1", "s1", "5")],
                    [], [prod("p1")], [seller("s1")])
    assert apply_filters(fact, state="NA").count() == 1
    assert kpi.state_revenue_geo(fact).count() == 0


def test_filters(spark):
    fact = _fact(spark, [("2020-01-10 23:00:00", "1"), ("2020-01-11 00:00:00", "2"), ("2020-01-12 00:00:00", "3")])
    assert apply_filters(fact).count() == 3  # "All" = identity
    assert apply_filters(fact, "2020-01-10", "2020-01-10").count() == 1  # inclusive day grain
    assert apply_filters(fact, dt.date(2020, 1, 11), None).count() == 2
    assert apply_filters(fact, category="toys").count() == 3
    assert apply_filters(fact, category="other").count() == 0
    assert apply_filters(fact, state="RJ").count() == 1
    dom = {(r.control, r.value) for r in filter_domains(fact).collect()}
    assert ("min_date", "2020-01-10") in dom and ("max_date", "2020-01-12") in dom and ("category", "toys") in dom


def test_date_filter_is_pushed_down(spark, tmp_path):
    fact = _fact(spark, [("2020-01-10 00:00:00", "1")])
    fact.write.parquet(str(tmp_path / "f"))
    plan = apply_filters(spark.read.parquet(str(tmp_path / "f")), "2020-01-01", "2020-01-31")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(order_purchase_timestamp), GreaterThanOrEqual(order_purchase_timestamp" in plan
