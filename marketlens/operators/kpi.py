"""Executive KPIs (A-02..A-06, W-02, W-03, T-01).

All are hash aggregates with map-side partial aggregation. Distinct counts
are planned by Catalyst as a first aggregation on (key, distinct value), so
a month holding a third of all rows is still spread over many tasks before
the final, tiny per-month merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from marketlens.functions import money_sum, ratio_or_zero
from marketlens.schemas import STATE_CENTROIDS

KPI_METRICS = [
    ("Total Revenue", "revenue"),
    ("Total Orders", "total_orders"),
    ("Average Order Value", "aov"),
    ("Customer Lifetime Value", "clv"),
]


def _by_order(fact: DataFrame) -> DataFrame:
    """Items added up to one row per month, order and customer, so that the
    distinct counts that follow expand orders and not items."""
    return (
        fact.filter(F.col("month").isNotNull())
        .groupBy("month", "order_id", "customer_unique_id")
        .agg(money_sum(F.col("revenue")).alias("revenue"))
    )


def monthly_kpis(fact: DataFrame) -> DataFrame:
    """A-02: month -> revenue, distinct orders, distinct customers, AOV, CLV, in order of months.

    Months without rows are not filled (only present months appear)."""
    agg = (
        _by_order(fact)
        .groupBy("month")
        .agg(
            money_sum(F.col("revenue")).alias("revenue"),
            F.count_distinct("order_id").alias("total_orders"),
            F.count_distinct("customer_unique_id").alias("customers"),
        )
    )
    return agg.select(
        "month",
        "revenue",
        "total_orders",
        "customers",
        ratio_or_zero(F.col("revenue"), F.col("total_orders")).alias("aov"),
        ratio_or_zero(F.col("revenue"), F.col("customers")).alias("clv"),
    ).orderBy("month")


def monthly_kpis_last(fact: DataFrame, months: int = 24) -> DataFrame:
    """W-03: the trailing ``months`` present months (a top-k on a per-month table)."""
    return monthly_kpis(fact).orderBy(F.desc("month")).limit(months)


def kpi_summary(fact: DataFrame) -> DataFrame:
    """A-03: one row per headline metric with its month-over-month delta (%).

    The delta compares the last two *present* months (W-02) and is 0 with
    fewer than two months or a zero previous value. Display strings match the
    dashboard tiles.

    One pass over the fact: ``rollup(month)`` yields the per-month rows and the
    grand total (distinct counts are not additive, so the total cannot come
    from the month rows); everything after works on that months+1-row table.
    """
    agg = (
        _by_order(fact)
        .rollup("month")
        .agg(
            money_sum(F.col("revenue")).alias("revenue"),
            F.count_distinct("order_id").cast("double").alias("total_orders"),
            F.count_distinct("customer_unique_id").cast("double").alias("customers"),
            F.grouping_id().alias("gid"),
        )
        .withColumns({
            "aov": ratio_or_zero(F.col("revenue"), F.col("total_orders")),
            "clv": ratio_or_zero(F.col("revenue"), F.col("customers")),
        })
    )
    # months+1 rows: a window over this small table is fine
    rn = F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("month")))
    ranked = agg.withColumn("rn", F.when(F.col("gid") == 0, rn))
    cols = [c for _, c in KPI_METRICS]
    one = ranked.agg(
        F.count(F.col("rn")).alias("n_months"),
        *[F.max(F.when(F.col("gid") == 1, F.col(c))).alias(f"tot_{c}") for c in cols],
        *[F.max(F.when(F.col("rn") == 1, F.col(c))).alias(f"cur_{c}") for c in cols],
        *[F.max(F.when(F.col("rn") == 2, F.col(c))).alias(f"prev_{c}") for c in cols],
    )

    def delta(c: str):
        cur, prev = F.col(f"cur_{c}"), F.col(f"prev_{c}")
        return F.when((F.col("n_months") >= 2) & (prev != 0), (cur - prev) / prev * 100).otherwise(F.lit(0.0))

    def total(c: str):
        # an empty fact has no grand-total row: every value is 0 then
        return F.coalesce(F.col(f"tot_{c}"), F.lit(0.0))

    rows = [
        F.struct(F.lit(i + 1).alias("position"), F.lit(label).alias("metric"), total(c).alias("value"),
                 delta(c).alias("delta"))
        for i, (label, c) in enumerate(KPI_METRICS)
    ]
    out = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    display = F.format_number(F.col("value"), 0)
    return out.select(
        "position",
        "metric",
        "value",
        "delta",
        F.when(F.col("metric") == "Total Orders", display).otherwise(F.concat(F.lit("R$ "), display)).alias("display_value"),
        F.format_string("%+.1f%% MoM", F.col("delta")).alias("display_delta"),
    )


def category_revenue_top(fact: DataFrame, n: int = 10) -> DataFrame:
    """A-04 / T-01: top-n categories by revenue (ties by name)."""
    return (
        fact.filter(F.col("product_category").isNotNull())
        .groupBy("product_category")
        .agg(money_sum(F.col("revenue")).alias("revenue"))
        .orderBy(F.desc("revenue"), F.asc("product_category"))
        .limit(n)
    )


def order_status_funnel(fact: DataFrame) -> DataFrame:
    """A-05: status -> distinct orders, descending (T-07 presentation sort)."""
    return (
        fact.filter(F.col("order_status").isNotNull())
        .groupBy("order_status")
        .agg(F.count_distinct("order_id").alias("orders"))
        .orderBy(F.desc("orders"), F.asc("order_status"))
    )


def state_centroids(spark: SparkSession) -> DataFrame:
    """Fixed 27-row state -> (lat, lon) lookup."""
    rows = [(s, float(lat), float(lon)) for s, (lat, lon) in STATE_CENTROIDS.items()]
    return spark.createDataFrame(rows, "customer_state string, lat double, lon double")


def state_revenue_geo(fact: DataFrame) -> DataFrame:
    """A-06 + J-07: revenue per customer state with its map centroid; states
    without a centroid (e.g. ``NA``) are dropped. The lookup has a fixed 27
    rows, so broadcasting it is bounded."""
    by_state = (
        fact.filter(F.col("customer_state").isNotNull())
        .groupBy("customer_state")
        .agg(money_sum(F.col("revenue")).alias("revenue"))
    )
    return by_state.join(F.broadcast(state_centroids(fact.sparkSession)), "customer_state", "inner")
