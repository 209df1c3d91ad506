"""Edge cases: every operator on an empty fact, all-null reviews,
zero variance."""

import pytest

from conftest import cust, item, order, prepared, prod, seller
from marketlens.operators import churn, cohort, customer, forecast, kpi, prepare, product


@pytest.fixture(scope="module")
def empty(spark):
    fact = prepared(spark, [order("o1", "c1", "2020-01-01 00:00:00")], customers=[cust("c1")])
    return fact.limit(0)


def test_empty_fact_everywhere(spark, empty):
    assert kpi.monthly_kpis(empty).count() == 0
    assert {r.value for r in kpi.kpi_summary(empty).collect()} == {0.0}
    assert kpi.category_revenue_top(empty).count() == 0
    assert kpi.state_revenue_geo(empty).count() == 0
    assert prepare.filter_domains(empty).count() == 0
    assert product.product_performance(empty).count() == 0
    assert {r.orders for r in product.review_sentiment(empty).collect()} == {0}
    assert product.delivery_time_by_state(empty).count() == 0
    assert product.slow_movers(empty).count() == 0
    assert cohort.cohort_retention(empty).count() == 0
    assert cohort.cohort_matrix(empty).count() == 0
    assert forecast.monthly_revenue_series(empty).count() == 0
    assert forecast.forecast_ewma(empty).count() == 0
    assert forecast.forecast_seasonal(empty).count() == 0
    assert customer.rfm_segments(empty).count() == 0
    feats = churn.customer_features(empty)
    assert feats.count() == 0
    res = churn.train_churn_model(feats)
    assert {r.value for r in res.metrics.collect()} == {0.0}


def test_all_null_reviews_and_single_month(spark):
    orders = [order(f"o{i}", f"c{i}", "2020-05-0{} 00:00:00".format(1 + i)) for i in range(3)]
    fact = prepared(spark, orders, [item(o["order_id"], 1, "p1", "s1", "2") for o in orders],
                    [cust(f"c{i}") for i in range(3)], [prod("p1")], [seller("s1")])
    assert product.product_performance(fact).first().review_score is None
    assert {r.orders for r in product.review_sentiment(fact).collect()} == {0}
    feats = churn.customer_features(fact).collect()
    assert {r.avg_review_score for r in feats} == {0.0}  # no median -> 0
    assert forecast.forecast_ewma(fact).count() == 0  # one month < 3
    assert {r.delta for r in kpi.kpi_summary(fact).collect()} == {0.0}


def test_zero_variance_features_standardize_to_zero(spark):
    df = spark.createDataFrame([(f"u{i}", 5, 1, 10.0, 4.0, 2.0, i % 2) for i in range(12)],
                               "customer_unique_id string, recency bigint, frequency bigint, monetary double, "
                               "avg_review_score double, avg_delivery_days double, churned int")
    res = churn.train_churn_model(df)
    probs = {round(r.churn_probability, 9) for r in res.predictions.collect()}
    assert len(probs) == 1  # all features constant -> one score
    assert {r.importance for r in res.drivers.collect()} == {0.0}
