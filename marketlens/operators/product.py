"""Product and seller intelligence (A-07..A-12, T-03, T-04)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions import grouped_quantiles, mean_days_between, money_sum, sentiment_bucket
from marketlens.schemas import DATE_COLUMN
from marketlens.schemas import SENTIMENT_BINS


def performance_of_months(months: DataFrame) -> DataFrame:
    """A-07 from the product-month grain."""
    return (
        months.filter(F.col("product_id").isNotNull() & F.col("product_category").isNotNull())
        .groupBy("product_id", "product_category")
        .agg(
            money_sum(F.col("revenue")).alias("revenue"),
            (F.sum("review_sum") / F.nullif(F.sum("reviews"), F.lit(0))).alias("review_score"),
            F.sum("orders").alias("orders"),
        )
    )


def product_performance(fact: DataFrame) -> DataFrame:
    """A-07: (product, category) -> revenue, item-weighted mean review, distinct orders."""
    return (
        fact.filter(F.col("product_id").isNotNull() & F.col("product_category").isNotNull())
        .groupBy("product_id", "product_category")
        .agg(
            money_sum(F.col("revenue")).alias("revenue"),
            F.avg("review_score").alias("review_score"),
            F.count_distinct("order_id").alias("orders"),
        )
    )


def seller_leaderboard(fact: DataFrame, n: int = 15) -> DataFrame:
    """A-08 / T-03: top-n sellers by revenue with mean rating and delivery days."""
    return (
        fact.filter(F.col("seller_id").isNotNull())
        .groupBy("seller_id")
        .agg(
            money_sum(F.col("revenue")).alias("revenue"),
            F.avg("review_score").alias("avg_rating"),
            mean_days_between(F.col(DATE_COLUMN), F.col("order_delivered_customer_date")).alias("avg_delivery_days"),
            F.count_distinct("order_id").alias("orders"),
        )
        .orderBy(F.desc("revenue"), F.asc("seller_id"))
        .limit(n)
    )


def sentiment_domain(spark: SparkSession) -> DataFrame:
    """Fixed 3-row bucket domain, so empty buckets still report 0."""
    return spark.createDataFrame([(i, label) for i, (label, _, _) in enumerate(SENTIMENT_BINS)], "position int, sentiment string")


def review_sentiment(fact: DataFrame) -> DataFrame:
    """A-09: sentiment bucket -> distinct orders; all three buckets present."""
    counts = (
        fact.select(sentiment_bucket(F.col("review_score")).alias("sentiment"), "order_id")
        .filter(F.col("sentiment").isNotNull())
        .groupBy("sentiment")
        .agg(F.count_distinct("order_id").alias("orders"))
    )
    domain = sentiment_domain(fact.sparkSession)
    return (
        domain.join(F.broadcast(counts), "sentiment", "left")  # <= 3 rows per side
        .select("sentiment", F.coalesce(F.col("orders"), F.lit(0)).cast("long").alias("orders"))
    )


def delivery_time_by_state(fact: DataFrame, items: str | None = None) -> DataFrame:
    """A-10: box statistics of delivery days per customer state, over items: a row of ``fact`` is one, or as many as its
    column ``items`` says (order grain).

    Quartiles use linear interpolation between order statistics (as the box
    plot does); whiskers are the most extreme values
    within 1.5 IQR of the box. Exact without holding a state's rows in one
    task: ``grouped_quantiles`` finds the order statistics by partial
    aggregates and bounded windows, so a state holding a third of all rows
    is spread over the whole cluster; the whiskers are one
    more partial aggregate against the per-state box.
    """
    dd, st = F.col("delivery_days"), F.col("customer_state")
    rows = fact.select("customer_state", "delivery_days", *([items] if items else [])).filter(dd.isNotNull() & st.isNotNull())
    stats = grouped_quantiles(rows, "customer_state", "delivery_days", [0.25, 0.5, 0.75], weight=items)
    stats = stats.toDF("customer_state", "n", "min", "max", "q1", "median", "q3")
    iqr = F.col("q3") - F.col("q1")
    fences = rows.join(stats, "customer_state").groupBy("customer_state").agg(
        F.min(F.when(dd >= F.col("q1") - 1.5 * iqr, dd)).alias("lower_whisker"),
        F.max(F.when(dd <= F.col("q3") + 1.5 * iqr, dd)).alias("upper_whisker"),
    )
    out = stats.join(fences, "customer_state")
    return out.select(
        "customer_state",
        F.col("n").cast("long").alias("count"),
        *[F.col(c) for c in ("min", "q1", "median", "q3", "max", "lower_whisker", "upper_whisker")],
    )


def product_month_orders(fact: DataFrame) -> DataFrame:
    """A-11: (product, category, month) -> distinct orders."""
    return (
        fact.filter(F.col("product_id").isNotNull() & F.col("product_category").isNotNull() & F.col("month").isNotNull())
        .groupBy("product_id", "product_category", "month")
        .agg(F.count_distinct("order_id").alias("orders"))
    )


def slow_movers(fact: DataFrame, threshold: float = 5.0, n: int = 50) -> DataFrame:
    """A-12 / T-04: products whose mean distinct orders per *active* month is
    below ``threshold``, slowest first (ties by product id)."""
    return slow_movers_of_months(product_month_orders(fact), threshold, n)


def slow_movers_of_months(months: DataFrame, threshold: float = 5.0, n: int = 50) -> DataFrame:
    """A-12 from the product-month grain (product_id, product_category, month, orders)."""
    return (
        months.filter(F.col("product_id").isNotNull() & F.col("product_category").isNotNull() & F.col("month").isNotNull())
        .groupBy("product_id", "product_category")
        .agg(F.avg("orders").alias("mean_orders"))
        .filter(F.col("mean_orders") < threshold)  # HAVING on the exact mean
        .orderBy(F.asc("mean_orders"), F.asc("product_id"), F.asc("product_category"))
        .limit(n)
        .select("product_id", "product_category", F.col("mean_orders").alias("orders"))
    )
