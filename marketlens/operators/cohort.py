"""Monthly cohort retention (A-17, W-01, W-07, R-01, R-02).

One shuffle on the customer: a partial ``collect_set`` of purchase months
per customer (map-side de-duplication, bounded by the number of months even
for a customer holding a third of all rows), then the cohort is the minimum
month and each member month is exploded back with its period offset. The
(cohort, period) counts are tiny.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from marketlens.functions import month_index, month_start
from marketlens.schemas import DATE_COLUMN
from marketlens.session import plain_plans, scratch_folder


def cohort_counts(fact: DataFrame) -> DataFrame:
    """A-17: (cohort_month, period_number) -> distinct customers."""
    months = (
        fact.filter(F.col("customer_unique_id").isNotNull() & F.col(DATE_COLUMN).isNotNull())
        .groupBy("customer_unique_id")
        .agg(F.collect_set(month_start(F.col(DATE_COLUMN))).alias("months"))
    )
    return _counts(months)


def cohort_counts_of_months(months: DataFrame) -> DataFrame:
    """A-17 from the customer-month grain (customer_unique_id, month)."""
    return _counts(months.groupBy("customer_unique_id").agg(F.collect_set("month").alias("months")))


def _counts(months: DataFrame) -> DataFrame:
    members = months.select(F.array_min("months").alias("cohort"), F.explode("months").alias("m"))
    return (
        members.withColumn("period_number", month_index(F.col("m")) - month_index(F.col("cohort")))
        .groupBy("cohort", "period_number")
        .agg(F.count(F.lit(1)).alias("customers"))
    )


def cohort_retention(fact: DataFrame) -> DataFrame:
    """R-02 (long form): retention % = customers / cohort size x 100, rounded
    half-even to 1 place; cohort labelled ``yyyy-MM``."""
    return retention(cohort_counts(fact))


def retention(counts: DataFrame) -> DataFrame:
    """R-02 of (cohort, period_number, customers)."""
    size = F.max(F.when(F.col("period_number") == 0, F.col("customers"))).over(Window.partitionBy("cohort"))
    return counts.select(
        F.date_format("cohort", "yyyy-MM").alias("cohort_month"),
        F.col("period_number").cast("int").alias("period_number"),
        F.col("customers").cast("long").alias("customers"),
        size.cast("long").alias("cohort_size"),
        F.bround(F.col("customers") / size * F.lit(100.0), 1).alias("retention_pct"),
    ).orderBy("cohort_month", "period_number")


def cohort_matrix(fact: DataFrame, periods: list[int] | None = None) -> DataFrame:
    """R-01: wide matrix, one row per cohort, one column per period that occurs
    (as text), missing cells 0. The columns of a plan must be known when it is
    made: pass ``periods``, else the long table (at most months x months rows)
    is written once and its periods are read from there."""
    long = cohort_retention(fact)
    if periods is not None:
        return retention_matrix(long, periods)
    spark, path = fact.sparkSession, scratch_folder(fact.sparkSession, "cohorts")
    long.write.parquet(path)
    long = spark.read.schema(long.schema).parquet(path)
    with plain_plans(spark):
        periods = sorted(r[0] for r in long.select("period_number").distinct().collect())  # <= months
    return retention_matrix(long, periods)


def retention_matrix(long: DataFrame, periods: list[int]) -> DataFrame:
    """R-01 of the long form for the given periods."""
    if not periods:
        return long.select("cohort_month")
    wide = long.groupBy("cohort_month").pivot("period_number", periods).agg(F.first("retention_pct"))
    renamed = wide.select("cohort_month", *[F.col(str(p)).alias(str(p)) for p in periods])
    return renamed.fillna(0.0, subset=[str(p) for p in periods])
