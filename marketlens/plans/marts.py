"""Analysis marts (B-01..B-04): the dashboard pages as batch tables.

``build_marts`` takes a prepared fact (any source), applies the dashboard
filters, and writes one Parquet table per analysis under
``out_dir/<mart>/<table>``. The fact is scanned at most three times: for the
order grain, the product-month grain and the sellers (``operators.grains``).
All other tables come from those and from the customer-month grain, which the
order grain gives. RFM segments are computed once and reused by the customer
and predictive marts.

usage: python -m marketlens.plans.marts --warehouse DIR --out DIR
           [--start YYYY-MM-DD] [--end YYYY-MM-DD] [--category C] [--state S]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from marketlens.operators import churn, cohort, customer, forecast, grains, kpi, prepare, product
from marketlens.session import freed_shuffles

MARTS = ("executive", "customer", "product", "predictive")


def _write(df: DataFrame, out_dir: str, mart: str, table: str, counts: dict) -> DataFrame:
    """Write one mart table; its row count comes from ``observe`` on the
    write itself (no second pass). Returns the written table, read back."""
    path = f"{out_dir.rstrip('/')}/{mart}/{table}"
    obs = Observation(f"rows_{mart}_{table}")
    with freed_shuffles(df.sparkSession):
        df.observe(obs, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    counts[f"{mart}/{table}"] = int(obs.get["n"])
    return df.sparkSession.read.schema(df.schema).parquet(path)


def build_marts(fact: DataFrame, out_dir: str, start=None, end=None, category: str = "All", state: str = "All",
                marts=MARTS, k: int = 4, restarts: int = 20, seed: int = 42, churn_days: int = 120,
                forecast_periods: int = 1) -> dict[str, int]:
    """Write the requested marts; returns rows per written table."""
    data = prepare.apply_filters(fact, start, end, category, state)
    spark = fact.sparkSession
    counts: dict[str, int] = {}
    rfm, months = None, None
    orders = grains.Stored(grains.order_grain(data), "orders").df
    products = grains.Stored(grains.product_months(data), "product_months", slice_by="product_id").df if {"executive", "product"} & set(marts) else None

    if "executive" in marts:  # B-01
        _write(kpi.kpi_summary(orders), out_dir, "executive", "kpi_summary", counts)
        _write(kpi.monthly_kpis_last(orders, 24), out_dir, "executive", "monthly_kpis_last24", counts)
        _write(kpi.category_revenue_top(products, 10), out_dir, "executive", "category_revenue_top10", counts)
        _write(kpi.order_status_funnel(orders), out_dir, "executive", "order_status_funnel", counts)
        _write(kpi.state_revenue_geo(orders), out_dir, "executive", "state_revenue_geo", counts)

    if "customer" in marts or "predictive" in marts:
        months = grains.stored_customer_months(spark, orders)
        totals = grains.customer_totals(months.df)
        rfm = _write(customer.segment_customers(totals, k, restarts, seed), out_dir, "customer", "rfm_segments", counts)

    if "customer" in marts:  # B-02
        _write(customer.segment_churn_heuristic(rfm), out_dir, "customer", "segment_churn_heuristic", counts)
        long = _write(cohort.retention(cohort.cohort_counts_of_months(months.df)), out_dir, "customer", "cohort_retention", counts)
        periods = sorted(r[0] for r in long.select("period_number").distinct().collect())  # <= months
        _write(cohort.retention_matrix(long, periods), out_dir, "customer", "cohort_matrix", counts)
        _write(customer.top_customers(rfm, 10), out_dir, "customer", "top_customers", counts)

    if "product" in marts:  # B-03
        _write(product.performance_of_months(products), out_dir, "product", "product_performance", counts)
        _write(product.seller_leaderboard(data, 15), out_dir, "product", "seller_leaderboard", counts)
        _write(product.review_sentiment(orders), out_dir, "product", "review_sentiment", counts)
        _write(product.delivery_time_by_state(orders, grains.ITEMS), out_dir, "product", "delivery_time_by_state", counts)
        _write(product.slow_movers_of_months(products), out_dir, "product", "slow_movers", counts)

    if "predictive" in marts:  # B-04
        _write(forecast.forecast_ewma(orders, periods=forecast_periods), out_dir, "predictive", "forecast_ewma", counts)
        _write(forecast.forecast_seasonal(orders, periods=forecast_periods), out_dir, "predictive", "forecast_seasonal", counts)
        result = churn.train_churn_model(churn.labelled_features(totals, churn_days), seed)
        predictions = _write(result.predictions, out_dir, "predictive", "churn_predictions", counts)
        _write(result.metrics, out_dir, "predictive", "churn_metrics", counts)
        _write(result.drivers, out_dir, "predictive", "churn_drivers", counts)
        _write(churn.churn_by_segment(predictions, rfm), out_dir, "predictive", "churn_by_segment", counts)
        _write(churn.churn_scores_top(predictions, rfm, 100), out_dir, "predictive", "churn_scores_top100", counts)
    if months is not None:
        months.drop()
    return counts


def main(argv=None) -> None:
    from marketlens.session import apply_core_conf
    from marketlens.sources.warehouse import load_fact

    ap = argparse.ArgumentParser(description=__doc__)
    ap.add_argument("--warehouse", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--start")
    ap.add_argument("--end")
    ap.add_argument("--category", default="All")
    ap.add_argument("--state", default="All")
    ap.add_argument("--marts", default=",".join(MARTS))
    ap.add_argument("--restarts", type=int, default=20)
    args = ap.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    apply_core_conf(spark)
    fact, _, _ = load_fact(spark, args.warehouse, start=args.start, end=args.end, category=args.category, state=args.state)
    counts = build_marts(fact, args.out, args.start, args.end, args.category, args.state,
                         marts=tuple(args.marts.split(",")), restarts=args.restarts)
    for name, n in sorted(counts.items()):
        print(f"{name}\t{n}")


if __name__ == "__main__":
    main()
