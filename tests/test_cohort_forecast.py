"""Cohorts (R-01/R-02, A-17) and forecasts (A-18, W-05, M-08, M-09)."""

import datetime as dt

import numpy as np
import pytest

from conftest import cust, item, order, prepared, prod, seller
from marketlens.operators import cohort, forecast


def test_cohort_rounding_half_even(spark):
    """Q28: 49 of 400 returning = 12.25% -> 12.2; period 0 = 100."""
    orders = [order(f"a{i}", f"c{i}", "2020-01-05 00:00:00") for i in range(400)]
    orders += [order(f"b{i}", f"c{i}", "2020-02-05 00:00:00") for i in range(49)]
    custs = [cust(f"c{i}") for i in range(400)]
    fact = prepared(spark, orders, customers=custs)
    got = {r.period_number: r for r in cohort.cohort_retention(fact).collect()}
    assert got[0].retention_pct == 100.0 and got[0].cohort_size == 400
    assert got[1].retention_pct == 12.2 and got[1].customers == 49
    wide = cohort.cohort_matrix(fact).collect()
    assert len(wide) == 1 and wide[0]["0"] == 100.0 and wide[0]["1"] == 12.2 and wide[0].cohort_month == "2020-01"


def test_cohort_matrix_fills_missing_with_zero(spark):
    orders = [order("o1", "c1", "2020-01-05 00:00:00"), order("o2", "c1", "2020-03-05 00:00:00"),
              order("o3", "c2", "2020-02-05 00:00:00")]
    fact = prepared(spark, orders, customers=[cust("c1"), cust("c2")])
    wide = {r.cohort_month: r.asDict() for r in cohort.cohort_matrix(fact).collect()}
    assert wide["2020-01"] == {"cohort_month": "2020-01", "0": 100.0, "2": 100.0}
    assert wide["2020-02"]["2"] == 0.0


def _monthly(spark, values, start_month=1, skip=()):
    orders, items = [], []
    m = start_month
    for i, v in enumerate(values):
        while m in skip:
            m += 1
        orders.append(order(f"o{i}", "c1", f"{2020 + (m - 1) // 12}-{(m - 1) % 12 + 1:02d}-10 00:00:00"))
        items.append(item(f"o{i}", 1, "p1", "s1", str(v)))
        m += 1
    return prepared(spark, orders, items, [cust("c1")], [prod("p1")], [seller("s1")])


def test_series_gap_fill(spark):
    """Q8: Jan and Apr -> 4 calendar months with two zeros."""
    fact = _monthly(spark, [10, 20], skip=(2, 3))
    ys = [r.y for r in forecast.monthly_revenue_series(fact).orderBy("ds").collect()]
    assert ys == [10.0, 0.0, 0.0, 20.0]


def test_ewma_matches_recurrence(spark):
    fact = _monthly(spark, [10, 20, 30])
    rows = forecast.forecast_ewma(fact).orderBy("ds").collect()
    assert [r.yhat for r in rows] == [10.0, 14.0, 20.4, 20.4]
    assert rows[-1].ds == dt.datetime(2020, 4, 1) and rows[-1].actual is None
    resid = [0.0, 6.0, 9.6]
    import statistics
    band = 1.96 * statistics.stdev(resid)
    assert rows[0].yhat_upper == pytest.approx(10.0 + band, abs=1e-4)


def test_ewma_periods_and_history(spark):
    fact = _monthly(spark, list(range(1, 31)), start_month=1) if False else None  # noqa: F841
    vals = [float(i) for i in range(1, 13)]
    fact = _monthly(spark, vals)
    rows = forecast.forecast_ewma(fact, periods=3, history=5).orderBy("ds").collect()
    assert len(rows) == 8 and [r.actual for r in rows[-3:]] == [None] * 3
    assert len({r.yhat for r in rows[-3:]}) == 1


def test_short_series_is_empty(spark):
    assert forecast.forecast_ewma(_monthly(spark, [5, 6])).count() == 0
    assert forecast.forecast_seasonal(_monthly(spark, [5, 6])).count() == 0


def test_seasonal_forecast_shape(spark):
    vals = [100 + 10 * (i % 12) for i in range(12)]
    fact = _monthly(spark, vals)
    rows = forecast.forecast_seasonal(fact, periods=2).orderBy("ds").collect()
    assert len(rows) == 14
    assert all(r.yhat_lower <= r.yhat <= r.yhat_upper for r in rows)
    assert rows[-1].ds == dt.datetime(2021, 2, 1)


def _broken_line(n=72, at=40, noise=2.0, seed=1):
    t = np.arange(n)
    season = 15 * np.sin(2 * np.pi * t / 12)
    return 200 + 3.0 * t - 7.0 * np.maximum(0, t - at) + season + np.random.default_rng(seed).normal(scale=noise, size=n)


def test_trend_finds_a_known_break():
    from marketlens.operators.trend import fit

    y = _broken_line()
    found = fit(y[:-6], 1, 6)
    assert 1 <= len(found.knots) <= 5  # of 25 candidates
    assert sum(change for at, change in found.knots if abs(at - 40) <= 5) == pytest.approx(-7.0, abs=1.2)
    assert np.abs(found.yhat[-6:] - y[-6:]).max() < 12
    assert (np.diff(found.sd[-6:]) >= 0).all() and found.sd[0] < 4


def test_trend_without_break_uses_few_knots():
    from marketlens.operators.trend import fit

    y = 50 + 0.5 * np.arange(60) + np.random.default_rng(3).normal(size=60)
    found = fit(y, 4, 1)
    assert len(found.knots) <= 2 and abs(found.yhat[-1] - 80) < 3
    assert fit(np.zeros(10), 1, 2).yhat.tolist() == [0.0] * 12
    assert fit(np.array([1.0, 2, 3]), 1, 1).yhat[-1] == pytest.approx(4, abs=0.7)


def test_coordinate_descent_meets_the_conditions_of_the_optimum():
    from marketlens.operators.trend import descend

    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(50, 8)), rng.normal(size=50)
    gram, target = x.T @ x, x.T @ y
    b = descend(gram, target, 4.0, np.zeros(8))
    slope = target - gram @ b
    assert np.allclose(slope[b != 0], 4.0 * np.sign(b[b != 0]), atol=1e-6) and (np.abs(slope[b == 0]) <= 4.0 + 1e-6).all()
    assert 0 < np.count_nonzero(b) < 8


def test_backtest_sees_only_the_past(spark):
    vals = [float(round(v)) for v in _broken_line(30, 15)]
    rows = forecast.forecast_backtest(_monthly(spark, vals), origins=5).collect()
    assert len(rows) == 10 and all(r.error == pytest.approx(r.actual - r.yhat) for r in rows)
    from marketlens.operators.trend import fit

    for r in rows:
        at = (r.origin.year - 2020) * 12 + r.origin.month  # months known
        assert r.actual == vals[at] and 25 <= at <= 29
        s = vals[0]
        for v in vals[1:at]:
            s = 0.4 * v + 0.6 * s
        want = s if r.method == forecast.SMOOTHING else fit(np.array(vals[:at]), 1, 1).yhat[-1]
        assert r.yhat == pytest.approx(want, rel=1e-9)
    rated = {r.method: r for r in forecast.forecast_accuracy(forecast.forecast_backtest(_monthly(spark, vals), origins=5)).collect()}
    assert rated[forecast.SEASONAL].preferred and not rated[forecast.SMOOTHING].preferred and rated[forecast.SEASONAL].origins == 5
    assert forecast.forecast_backtest(_monthly(spark, [1, 2, 3])).count() == 0  # no next month after three


def test_keyed_forecast_fans_out(spark):
    orders, items = [], []
    for i in range(4):
        orders.append(order(f"o{i}", "c1", f"2020-{i + 1:02d}-10 00:00:00"))
        items.append(item(f"o{i}", 1, "pa", "s1", "10"))
        items.append(item(f"o{i}", 2, "pb", "s1", "20"))
    fact = prepared(spark, orders, items, [cust("c1")], [prod("pa", "A"), prod("pb", "B")], [seller("s1")])
    got = forecast.forecast_ewma(fact, ["product_category"]).groupBy("product_category").count().collect()
    assert {r.product_category: r["count"] for r in got} == {"A": 5, "B": 5}
