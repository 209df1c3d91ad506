"""Shared pre-aggregates give what the fact gives, without shuffling customers again."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import cust, item, order, prepared, prod, review, seller
from marketlens.operators import churn, cohort, customer, grains, kpi, product


@pytest.fixture(scope="module")
def fact(spark):
    """300 orders of 23 customers, one of whom holds a third; 0 to 4 items an order, one with 60; some without review or delivery."""
    draw = random.Random(5)
    orders, items, reviews = [], [], []
    for i in range(300):
        day = dt.datetime(2020, 1, 1) + dt.timedelta(days=draw.randrange(400), hours=draw.randrange(24))
        delivered = None if i % 7 == 0 else str(day + dt.timedelta(days=draw.randrange(1, 30), hours=5))
        orders.append(order(f"o{i}", "c0" if i % 3 == 0 else f"c{draw.randrange(1, 23)}", str(day), draw.choice(["delivered", "shipped"]), delivered))
        for n in range(60 if i == 42 else draw.randrange(5)):
            items.append(item(f"o{i}", n, f"p{draw.randrange(9)}", f"s{draw.randrange(3)}", f"{draw.randrange(1000) / 100}", "0.10"))
        if i % 5:
            reviews.append(review(f"o{i}", draw.randrange(1, 6)))
    df = prepared(spark, orders, items, [cust(f"c{i}", state=["SP", "RJ", "AM"][i % 3]) for i in range(23)],
                  [prod(f"p{i}", ["toys", "auto"][i % 2]) for i in range(9)], [seller(f"s{i}") for i in range(3)], reviews)
    return df.cache()


@pytest.fixture(scope="module")
def orders(fact):
    return grains.Stored(grains.order_grain(fact), "orders").df


@pytest.fixture(scope="module")
def months(spark, orders):
    stored = grains.stored_customer_months(spark, orders)
    yield stored.df
    stored.drop()


def same(one, other):
    """Equal rows, in any order; numbers to 9 places."""
    rows = [sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(sorted(df.columns)).collect()), key=str) for df in (one, other)]
    assert rows[0] == rows[1] and rows[0]


def test_orders_stand_for_the_fact(fact, orders):
    assert orders.count() == 300 and orders.agg(F.sum("items")).first()[0] == fact.count()
    for table in (kpi.kpi_summary, kpi.monthly_kpis, kpi.order_status_funnel, kpi.state_revenue_geo, product.review_sentiment):
        same(table(fact), table(orders))
    same(product.delivery_time_by_state(fact), product.delivery_time_by_state(orders, grains.ITEMS))


def test_heavy_rows_in_quantiles(fact, orders):
    """Rows that stand for more items than the sketch takes: their ranks are found by the exact counts."""
    from marketlens.functions import grouped_quantiles

    probs = [0.05, 0.5, 0.9]
    same(grouped_quantiles(fact, "customer_state", "delivery_days", probs),
         grouped_quantiles(orders, "customer_state", "delivery_days", probs, weight="items", max_candidates=10))


def test_product_months_stand_for_the_fact(fact):
    table = grains.product_months(fact)
    same(product.product_performance(fact), product.performance_of_months(table))
    same(product.slow_movers(fact), product.slow_movers_of_months(table))
    same(kpi.category_revenue_top(fact, 10), kpi.category_revenue_top(table, 10))


def test_customer_months_stand_for_the_fact(fact, months):
    totals = grains.customer_totals(months)
    same(customer.rfm_base(fact), totals.select("customer_unique_id", "recency", "frequency", "monetary"))
    same(churn.customer_features(fact), churn.labelled_features(totals))
    same(cohort.cohort_retention(fact), cohort.retention(cohort.cohort_counts_of_months(months)))


def test_customers_are_not_shuffled_again(spark, months):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the whole plan at once
    try:
        for df in (grains.customer_totals(months), cohort.retention(cohort.cohort_counts_of_months(months))):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(customer_unique_id" not in plan and "Bucketed: true" in plan, plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
