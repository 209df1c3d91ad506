"""Product & seller (A-07..A-12), sentiment buckets (Q25/Q26), item weighting (Q5)."""

import numpy as np
import pytest

from conftest import cust, item, order, prepared, prod, review, seller
from marketlens.operators import product


def test_item_weighted_seller_rating(spark):
    """Q5: 3 items at score 1 + 1 item at score 5 -> mean 2.0."""
    fact = prepared(
        spark,
        [order("o1", "c1", "2020-01-01 00:00:00"), order("o2", "c1", "2020-01-02 00:00:00")],
        [item("o1", 1, "p1", "s1", "1"), item("o1", 2, "p1", "s1", "1"), item("o1", 3, "p1", "s1", "1"),
         item("o2", 1, "p1", "s1", "1")],
        [cust("c1")], [prod("p1")], [seller("s1")], [review("o1", 1), review("o2", 5)],
    )
    r = product.seller_leaderboard(fact).first()
    assert r.avg_rating == 2.0 and r.orders == 2 and r.revenue == 4.0


def test_sentiment_buckets(spark):
    """Q25: 0,1,2 neg; 2.5,3 neu; 3.1,5 pos; 5.5,-1,null none."""
    from marketlens.functions import sentiment_bucket

    scores = [0.0, 1.0, 2.0, 2.5, 3.0, 3.1, 5.0, 5.5, -1.0, None]
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    got = [r.b for r in df.select(sentiment_bucket(df.s).alias("b")).collect()]
    assert got == ["negative"] * 3 + ["neutral"] * 2 + ["positive"] * 2 + [None] * 3


def test_empty_sentiment_buckets_reported(spark):
    """Q26: only score 1 present -> neutral and positive rows with 0."""
    fact = prepared(spark, [order("o1", "c1", "2020-01-01 00:00:00")], [item("o1", 1, "p1", "s1", "1")],
                    [cust("c1")], [prod("p1")], [seller("s1")], [review("o1", 1)])
    got = {r.sentiment: r.orders for r in product.review_sentiment(fact).collect()}
    assert got == {"negative": 1, "neutral": 0, "positive": 0}


def test_slow_movers_mean_over_active_months(spark):
    """Q9 + F-06: mean of distinct orders per active month, < 5 kept."""
    orders, items = [], []
    for i in range(6):  # p_fast: 6 orders in one month; p_slow: 1 order in each of 2 months
        orders.append(order(f"f{i}", "c1", "2020-01-05 00:00:00"))
        items.append(item(f"f{i}", 1, "p_fast", "s1", "1"))
    for i, m in enumerate(["2020-01-05 00:00:00", "2020-03-05 00:00:00"]):
        orders.append(order(f"s{i}", "c1", m))
        items.append(item(f"s{i}", 1, "p_slow", "s1", "1"))
    fact = prepared(spark, orders, items, [cust("c1")], [prod("p_fast"), prod("p_slow")], [seller("s1")])
    got = [(r.product_id, r.orders) for r in product.slow_movers(fact).collect()]
    assert got == [("p_slow", 1.0)]
    pm = {(r.product_id, r.month.month): r.orders for r in product.product_month_orders(fact).collect()}
    assert pm[("p_fast", 1)] == 6


def test_delivery_box_stats_match_numpy(spark):
    rng = np.random.default_rng(7)
    orders = []
    for i in range(203):
        days = int(rng.integers(1, 30))
        hours = int(rng.integers(0, 24))
        orders.append(order(f"o{i}", f"c{i % 3}", "2020-01-01 00:00:00", delivered=f"2020-01-{min(days + 1, 28):02d} {hours:02d}:00:00"))
    orders.append(order("late", "c0", "2020-01-01 00:00:00", delivered="2020-12-31 00:00:00"))  # outlier
    custs = [cust("c0", state="SP"), cust("c1", state="SP"), cust("c2", state="RJ")]
    fact = prepared(spark, orders, customers=custs)
    stats = {r.customer_state: r for r in product.delivery_time_by_state(fact).collect()}
    for state, ids in (("SP", {"c0", "c1"}), ("RJ", {"c2"})):
        vals = np.array([r.delivery_days for r in fact.collect() if r.customer_id in ids])
        s = stats[state]
        q1, med, q3 = np.percentile(vals, [25, 50, 75])
        assert s["count"] == len(vals)
        assert (s.q1, s.median, s.q3) == pytest.approx((q1, med, q3), abs=1e-9)
        q1, q3 = round(q1, 9), round(q3, 9)
        iqr = q3 - q1
        assert s.lower_whisker == vals[vals >= q1 - 1.5 * iqr].min()
        assert s.upper_whisker == vals[vals <= q3 + 1.5 * iqr].max()
    assert stats["SP"].max > stats["SP"].upper_whisker  # the outlier sits beyond the whisker
