"""Query registry over the test binding: name -> (spark, sf_dir) -> DataFrame.

Every entry reads the generated tables (through the star materialised once
per session) and runs over all rows. Model-based entries fit once per
session and share the fitted result.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.operators import churn, cohort, customer, forecast, grains, kpi, prepare, product
from marketlens.operators.star import build_star
from marketlens.plans.ingest import run_ingest
from marketlens.plans.marts import build_marts
from marketlens.schemas import CHURN_FEATURES, RAW_FILES, RAW_SCHEMAS
from marketlens.session import scratch_folder
from marketlens.sources.raw import load_raw
from marketlens.sources.registry_data import input_state, prepared_fact, star_table
from marketlens.sources.testdata import raw_tables
from marketlens.sources.warehouse import latest_run, read_runs

# Fixed filter used by ``filtered_fact`` (a date window, one category, one state).
FILTER_START, FILTER_END = "1997-03-15", "1999-10-20"
FILTER_CATEGORY, FILTER_STATE = "Brand#1", "AM"

# Model settings (reference values: k=4, 20 restarts, seed 42; 120 churn days).
KMEANS_K, KMEANS_RESTARTS, SEED, CHURN_DAYS = 4, 20, 42, 120

_LOCK = threading.RLock()
_MEMO: dict = {}


def _memo(spark: SparkSession, sf: str, name: str, build):
    key = (*input_state(spark, sf), name)
    with _LOCK:
        if key not in _MEMO:
            _MEMO[key] = build()
        return _MEMO[key]


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Columns rounded for the comparison with the SQL twin: engines differ in the last bits."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


_FORECAST = (4, "yhat", "yhat_lower", "yhat_upper")


def _fact(spark: SparkSession, sf: str) -> DataFrame:
    return prepared_fact(spark, sf)


def _months(spark, sf):
    """Customer-month grain, bucketed by customer, built once a session."""
    def build():
        orders = grains.Stored(grains.order_grain(_fact(spark, sf)), "orders").df
        return grains.stored_customer_months(spark, orders)
    return _memo(spark, sf, "months", build).df


def _totals(spark, sf):
    return grains.customer_totals(_months(spark, sf))


def _rfm(spark, sf):
    return _memo(spark, sf, "rfm", lambda: customer.segment_customers(_totals(spark, sf), KMEANS_K, KMEANS_RESTARTS, SEED))


def _features(spark, sf):
    return _memo(spark, sf, "features", lambda: churn.labelled_features(_totals(spark, sf), CHURN_DAYS))


def _churn(spark, sf):
    return _memo(spark, sf, "churn", lambda: churn.train_churn_model(_features(spark, sf), SEED))


# Parameters of the keys that check the steps around the fitted models: centres of standardised recency, frequency
# and monetary value; coefficients of the standardised churn features.
CENTRES = [[1.0, -0.8, -0.8], [-0.5, 0.2, 0.1], [-0.6, 1.2, 1.3], [0.4, 0.3, -0.2]]
COEFFICIENTS, INTERCEPT = [0.9, -0.5, -0.4, -0.2, 0.1], -0.3


#: No customer is inactive for so many days: one class.
ONE_CLASS_DAYS = 1_000_000


def _one_class(spark, sf):
    """M-06: all that a model of a single class gives, as (kind, name, value)."""
    result = churn.train_churn_model(churn.customer_features(_fact(spark, sf), ONE_CLASS_DAYS), SEED)
    parts = (("metric", result.metrics, "metric", "value"), ("driver", result.drivers, "feature", "importance"),
             ("prediction", result.predictions, "customer_unique_id", "churn_probability"))
    frames = [df.select(F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col(value).alias("value")) for kind, df, name, value in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def _drivers_by_coefficient(spark, sf):
    model = _churn(spark, sf)
    scaled = customer.standardize(_features(spark, sf), CHURN_FEATURES)
    scored = churn.with_probability(scaled, model.coefficients, model.intercept).withColumn("is_test", F.lit(True))
    return _rounded(churn.evaluate(scored, model.coefficients, "abs_coefficient")[1], 6, "importance")


def _rfm_given(spark, sf):
    return customer.segments_by_centers(customer.rfm_base(_fact(spark, sf)), CENTRES)


def _scored_given(spark, sf):
    scaled = customer.standardize(_features(spark, sf), CHURN_FEATURES)
    return churn.with_probability(scaled, COEFFICIENTS, INTERCEPT).withColumn("is_test", F.lit(True))


def _backtest(spark, sf):
    return forecast.forecast_backtest(_fact(spark, sf), ["product_category"])


def _cohort_matrix(spark, sf):
    return cohort.cohort_matrix(_fact(spark, sf))


def _star_from_text(spark, sf):
    """S-01, S-02, C-01, C-02: the raw tables written as CSV files of text, read back and turned into the fact."""
    def build():
        folder = scratch_folder(spark, "csv")
        for name, df in raw_tables(spark, sf).items():
            columns = [f.name for f in RAW_SCHEMAS[name] if f.name in df.columns]
            df.select(*[F.col(c).cast("string").alias(c) for c in columns]).write.option("header", True).csv(f"{folder}/{RAW_FILES[name]}")
        return folder
    return build_star(load_raw(spark, _memo(spark, sf, "csv", build)))["fact_orders"]


def _ingest_run_log(spark, sf):
    """S-06..S-08: (status, message, latest) of a load and of one whose files are missing."""
    folder = scratch_folder(spark, "log")
    run_ingest(spark, folder, raw=raw_tables(spark, sf))
    run_ingest(spark, folder, raw_dir=f"{folder}/none")
    runs = read_runs(spark, folder)
    good, last = (latest_run(spark, folder, status) for status in ("success", None))
    message = F.when(F.col("status") == "failed", F.regexp_extract("message", "^[A-Za-z ]+", 0)).otherwise(F.col("message"))
    return runs.select("status", message.alias("message"), (F.col("run_at") == F.lit(last)).alias("latest"),
                       (F.col("run_at") == F.lit(good)).alias("latest_success"))


def _marts(spark, sf) -> tuple[str, dict[str, int]]:
    """Folder and row counts of all marts, built once a session."""
    def build():
        folder = scratch_folder(spark, "marts")
        return folder, build_marts(_fact(spark, sf), folder, k=KMEANS_K, restarts=KMEANS_RESTARTS, seed=SEED, churn_days=CHURN_DAYS)
    return _memo(spark, sf, "marts", build)


def _mart_row_counts(spark, sf):
    counts = _marts(spark, sf)[1]
    return spark.createDataFrame(sorted(counts.items()), "table_name string, row_count bigint")


#: Per mart and table the column that names a row and the measures compared, (name, decimals).
MART_MEASURES = {
    "executive": {
        "kpi_summary": ("metric", ("value", 6), ("delta", 6)),
        "monthly_kpis_last24": ("month", ("revenue", 4), ("total_orders", 0), ("customers", 0), ("aov", 6), ("clv", 6)),
        "category_revenue_top10": ("product_category", ("revenue", 4)),
        "order_status_funnel": ("order_status", ("orders", 0)),
        "state_revenue_geo": ("customer_state", ("revenue", 4), ("lat", 4), ("lon", 4)),
    },
    "customer": {
        "rfm_segments": ("customer_unique_id", ("recency", 0), ("frequency", 0), ("monetary", 4)),
        "cohort_retention": ("cohort_month", ("period_number", 0), ("customers", 0), ("cohort_size", 0), ("retention_pct", 1)),
        "top_customers": ("customer_unique_id", ("recency", 0), ("frequency", 0), ("lifetime_value_brl", 4)),
    },
    "product": {
        "product_performance": ("product_id", ("revenue", 4), ("review_score", 6), ("orders", 0)),
        "seller_leaderboard": ("seller_id", ("revenue", 4), ("avg_rating", 6), ("avg_delivery_days", 6), ("orders", 0)),
        "review_sentiment": ("sentiment", ("orders", 0)),
        "delivery_time_by_state": ("customer_state", ("count", 0), ("min", 6), ("q1", 6), ("median", 6), ("q3", 6), ("max", 6),
                                   ("lower_whisker", 6), ("upper_whisker", 6)),
        "slow_movers": ("product_id", ("orders", 6)),
    },
    "predictive": {
        "forecast_ewma": ("ds", ("actual", 4), ("yhat", 4), ("yhat_lower", 4), ("yhat_upper", 4)),
        "churn_predictions": ("customer_unique_id", ("avg_review_score", 6), ("avg_delivery_days", 6), ("churned", 0), ("churn_probability", 6)),
        "churn_metrics": ("metric", ("value", 6)),
        "churn_drivers": ("feature", ("importance", 6)),
    },
}


def _mart(name: str):
    """(table_name, name, measure, value) of the tables of a mart, as written."""
    def query(spark, sf):
        folder, out = _marts(spark, sf)[0], None
        for table, (key, *measures) in MART_MEASURES[name].items():
            df = spark.read.parquet(f"{folder}/{name}/{table}")
            label = F.date_format(key, "yyyy-MM") if key in ("month", "ds") else F.col(key).cast("string")
            values = F.array(*[F.struct(F.lit(m).alias("measure"), F.round(F.col(m).cast("double"), digits).alias("value")) for m, digits in measures])
            rows = df.select(F.lit(table).alias("table_name"), label.alias("name"), F.inline(values))
            out = rows if out is None else out.unionByName(rows)
        return out
    return query


def _star_row_counts(spark, sf):
    parts = [
        star_table(spark, sf, name).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name in ("fact_orders", "dim_customers", "dim_products", "dim_sellers")
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


QUERIES = {
    # S-03/S-05, X-01, C-06..C-09: star tables
    "star_fact_orders": lambda spark, sf: star_table(spark, sf, "fact_orders"),
    "dim_customers": lambda spark, sf: star_table(spark, sf, "dim_customers"),
    "dim_products": lambda spark, sf: star_table(spark, sf, "dim_products"),
    "dim_sellers": lambda spark, sf: star_table(spark, sf, "dim_sellers"),
    "star_row_counts": _star_row_counts,
    "star_from_text": _star_from_text,  # S-01, S-02, C-01, C-02
    "ingest_run_log": _ingest_run_log,  # S-05..S-08
    # B-01..B-04: the marts as written by the job
    "mart_row_counts": _mart_row_counts,
    "mart_executive": _mart("executive"),
    "mart_customer": _mart("customer"),
    "mart_product": _mart("product"),
    "mart_predictive": _mart("predictive"),
    # C-10, F-01..F-08
    "fact_prepared": _fact,
    "filtered_fact": lambda spark, sf: prepare.apply_filters(
        prepared_fact(spark, sf, FILTER_START, FILTER_END, FILTER_CATEGORY, FILTER_STATE),
        FILTER_START, FILTER_END, FILTER_CATEGORY, FILTER_STATE
    ),
    "filter_domains": lambda spark, sf: prepare.filter_domains(_fact(spark, sf)),
    # A-02..A-06, W-02, W-03, T-01, J-07
    "monthly_kpis": lambda spark, sf: kpi.monthly_kpis(_fact(spark, sf)),
    "monthly_kpis_last24": lambda spark, sf: kpi.monthly_kpis_last(_fact(spark, sf), 24),
    "kpi_summary": lambda spark, sf: kpi.kpi_summary(_fact(spark, sf)),
    "category_revenue_top10": lambda spark, sf: kpi.category_revenue_top(_fact(spark, sf), 10),
    "order_status_funnel": lambda spark, sf: kpi.order_status_funnel(_fact(spark, sf)),
    "state_revenue_geo": lambda spark, sf: kpi.state_revenue_geo(_fact(spark, sf)),
    # A-07..A-12, T-03, T-04
    "product_performance": lambda spark, sf: product.product_performance(_fact(spark, sf)),
    "seller_leaderboard": lambda spark, sf: product.seller_leaderboard(_fact(spark, sf), 15),
    "review_sentiment": lambda spark, sf: product.review_sentiment(_fact(spark, sf)),
    "delivery_time_by_state": lambda spark, sf: _rounded(product.delivery_time_by_state(_fact(spark, sf)), 9, "q1", "median", "q3"),
    "product_month_orders": lambda spark, sf: product.product_month_orders(_fact(spark, sf)),
    "slow_movers": lambda spark, sf: product.slow_movers(_fact(spark, sf)),
    # A-13, A-14, A-20, T-02
    "rfm_base": lambda spark, sf: _totals(spark, sf).select("customer_unique_id", *customer.RFM_FEATURES),
    "top_customers_ltv": lambda spark, sf: customer.top_customers(customer.rfm_base(_fact(spark, sf)), 10),
    "customer_features": _features,
    "churn_class_balance": lambda spark, sf: churn.class_balance(_features(spark, sf)),
    # A-17, W-01, W-07, R-01, R-02
    "cohort_retention": lambda spark, sf: cohort.retention(cohort.cohort_counts_of_months(_months(spark, sf))),
    "cohort_matrix": _cohort_matrix,
    # A-18, W-05, M-08, U-01
    "monthly_revenue_series": lambda spark, sf: forecast.monthly_revenue_series(_fact(spark, sf)),
    "forecast_ewma": lambda spark, sf: _rounded(forecast.forecast_ewma(_fact(spark, sf)), *_FORECAST),
    "forecast_ewma_by_category": lambda spark, sf: _rounded(forecast.forecast_ewma(_fact(spark, sf), ["product_category"]), *_FORECAST),
    "forecast_methods": lambda spark, sf: forecast.forecast_methods(_fact(spark, sf), ["product_category"]),  # M-08
    "forecast_backtest_smoothing": lambda spark, sf: _rounded(  # M-08 out of sample
        forecast.forecast_backtest(_fact(spark, sf), ["product_category"], methods=[forecast.SMOOTHING]), 4, "yhat", "error"),
    # The steps around the models, with given parameters
    "rfm_scaled": lambda spark, sf: _rounded(
        customer.standardize(customer.rfm_base(_fact(spark, sf)), customer.RFM_FEATURES).drop(*customer.RFM_FEATURES),
        9, *(f"{c}_z" for c in customer.RFM_FEATURES)),  # M-01
    "rfm_segments_given": _rfm_given,  # M-02 assignment, A-15, W-04, J-08
    "segment_profile_given": lambda spark, sf: _rounded(
        customer.segment_profile(_rfm_given(spark, sf)), 6, *(f"mean_{c}" for c in customer.RFM_FEATURES)),  # A-15
    "segment_churn_heuristic_given": lambda spark, sf: _rounded(
        customer.segment_churn_heuristic(_rfm_given(spark, sf)), 6, "churn_probability"),  # A-16, W-06
    "top_customers_segmented_given": lambda spark, sf: customer.top_customers(_rfm_given(spark, sf), 10),  # T-02
    "churn_scores_given": lambda spark, sf: _rounded(
        _scored_given(spark, sf).select("customer_unique_id", "churn_probability"), 9, "churn_probability"),  # M-04
    "churn_metrics_given": lambda spark, sf: _rounded(churn.evaluate(_scored_given(spark, sf), COEFFICIENTS)[0], 9, "value"),  # M-05
    "churn_drivers_given": lambda spark, sf: _rounded(churn.evaluate(_scored_given(spark, sf), COEFFICIENTS)[1], 9, "importance"),  # M-07, T-06
    "churn_by_segment_given": lambda spark, sf: _rounded(
        churn.churn_by_segment(_scored_given(spark, sf), _rfm_given(spark, sf)), 6, "churn_probability"),  # J-06, A-19
    "churn_scores_top100_given": lambda spark, sf: churn.churn_scores_top(_scored_given(spark, sf), _rfm_given(spark, sf), 100),  # T-05
    "kmeans_lloyd_steps": lambda spark, sf: _rounded(  # M-02: five steps from given centres
        customer.lloyd_steps(customer.rfm_base(_fact(spark, sf)), CENTRES, 5), 9, *(f"{c}_z" for c in customer.RFM_FEATURES)),
    # The churn model: its holdout, its fit by Newton steps, and what follows from it
    "churn_split": lambda spark, sf: churn.churn_split(_features(spark, sf), SEED),  # M-03
    "churn_metrics": lambda spark, sf: _rounded(_churn(spark, sf).metrics, 9, "value"),  # M-03..M-05
    "churn_drivers": lambda spark, sf: _rounded(_churn(spark, sf).drivers, 6, "importance"),  # M-07, T-06
    "churn_drivers_coefficient": _drivers_by_coefficient,  # M-07 without SHAP values
    "churn_predictions": lambda spark, sf: _rounded(_churn(spark, sf).predictions, 6, "churn_probability"),  # M-04 scores for all customers
    "churn_one_class": _one_class,  # M-06
    # K-Means and seasonal model (rows-only in the driver check; covered by tests)
    "rfm_segments": _rfm,  # M-01, M-02, A-15, W-04, J-08
    "segment_profile": lambda spark, sf: customer.segment_profile(_rfm(spark, sf)),  # A-15
    "segment_churn_heuristic": lambda spark, sf: _rounded(customer.segment_churn_heuristic(_rfm(spark, sf)), 6, "churn_probability"),  # A-16, W-06
    "top_customers_segmented": lambda spark, sf: customer.top_customers(_rfm(spark, sf), 10),  # T-02
    "churn_by_segment": lambda spark, sf: churn.churn_by_segment(_churn(spark, sf).predictions, _rfm(spark, sf)),  # J-06, A-19
    "churn_scores_top100": lambda spark, sf: churn.churn_scores_top(_churn(spark, sf).predictions, _rfm(spark, sf), 100),  # T-05
    "forecast_seasonal": lambda spark, sf: forecast.forecast_seasonal(_fact(spark, sf)),  # M-09
    "forecast_backtest": _backtest,  # M-08 and M-09 out of sample
    "forecast_accuracy": lambda spark, sf: forecast.forecast_accuracy(_backtest(spark, sf), ["product_category"]),
    "forecast_seasonal_by_category": lambda spark, sf: forecast.forecast_seasonal(_fact(spark, sf), ["product_category"]),
}
