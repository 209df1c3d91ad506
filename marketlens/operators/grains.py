"""Shared pre-aggregates of the prepared fact, from which the marts are computed.

* order grain: one row per order with its attributes, number of items and
  revenue. It has the fact's column names, so every operator that counts
  orders or customers, or adds up revenue, takes it in place of the fact;
* product-month grain: distinct orders, revenue and review sums;
* customer-month grain, bucketed by customer: what RFM, churn features and
  cohorts need, at most a row per customer and month, so a customer who holds
  a third of all orders is a few rows. Bucketed as it is, none of the three
  shuffles it by customer again.

An order has one purchase time, so distinct orders add up over months.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions import days_between, money_parts, money_sum, money_total
from marketlens.schemas import DATE_COLUMN
from marketlens.session import freed_shuffles, scratch_folder, slices

DELIVERED = "order_delivered_customer_date"
_ORDER_COLUMNS = ["order_id", "customer_unique_id", "customer_state", "order_status", "review_score", DATE_COLUMN, DELIVERED, "delivery_days",
                  "month", "order_date"]
#: Column of the order grain with the number of the order's items, the weight of its row in item-weighted means.
ITEMS = "items"


def order_grain(fact: DataFrame) -> DataFrame:
    """One row per order, and per differing values of its attributes if there are any."""
    cents, rest = money_parts(F.col("revenue"))
    return fact.groupBy(*_ORDER_COLUMNS).agg(
        F.count(F.lit(1)).alias(ITEMS), money_sum(F.col("revenue")).alias("revenue"), F.sum(cents).alias("cents"), F.sum(rest).alias("rest"))


def product_months(fact: DataFrame) -> DataFrame:
    """(product_id, product_category, month, orders, revenue, review_sum, reviews)."""
    return fact.groupBy("product_id", "product_category", "month").agg(
        F.count_distinct("order_id").alias("orders"),
        money_sum(F.col("revenue")).alias("revenue"),
        F.sum("review_score").alias("review_sum"),
        F.count("review_score").alias("reviews"),
    )


def customer_months(orders: DataFrame) -> DataFrame:
    """(customer_unique_id, month, last, orders, cents, rest, review_sum, reviews, micros, deliveries) from the order grain."""
    micros = F.timestamp_diff("MICROSECOND", F.col(DATE_COLUMN), F.col(DELIVERED))
    return orders.where(F.col("customer_unique_id").isNotNull()).groupBy("customer_unique_id", "month").agg(
        F.max(DATE_COLUMN).alias("last"),
        F.count_distinct("order_id").alias("orders"),
        F.sum("cents").alias("cents"),
        F.sum("rest").alias("rest"),
        F.sum(F.col("review_score") * F.col(ITEMS)).alias("review_sum"),
        F.sum(F.when(F.col("review_score").isNotNull(), F.col(ITEMS))).alias("reviews"),
        F.sum(micros * F.col(ITEMS)).alias("micros"),
        F.sum(F.when(micros.isNotNull(), F.col(ITEMS))).alias("deliveries"),
    )


class Stored:
    """A pre-aggregate written to the shared checkpoint folder; ``bucket_by`` a column, it is a bucketed table of the session's catalog;
    ``slice_by`` one of its keys, it is written in ``session.slices``."""

    def __init__(self, df: DataFrame, name: str, bucket_by: str | None = None, slice_by: str | None = None):
        spark, path = df.sparkSession, scratch_folder(df.sparkSession, name)
        self._spark, self._table = spark, None
        if bucket_by is None:
            with freed_shuffles(spark):
                for part in slices(df, slice_by) if slice_by else [df]:
                    part.write.mode("append").parquet(path)
            self.df = spark.read.schema(df.schema).parquet(path)
        else:
            self._table = f"marketlens_{name}_{uuid.uuid4().hex[:12]}"
            buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
            # one file a bucket: rows arrive at the writers as they are bucketed
            with freed_shuffles(spark):
                df.repartition(buckets, bucket_by).write.bucketBy(buckets, bucket_by).sortBy(bucket_by).option("path", path).saveAsTable(self._table)
            self.df = spark.table(self._table)

    def drop(self) -> None:
        """Forget the catalog's entry; the files go with the scratch folder."""
        if self._table is not None:
            self._spark.sql(f"DROP TABLE IF EXISTS {self._table}")


def stored_customer_months(spark: SparkSession, orders: DataFrame) -> Stored:
    return Stored(customer_months(orders), "customer_months", "customer_unique_id")


def customer_totals(months: DataFrame) -> DataFrame:
    """A-13 and the means of A-14 from the customer-month grain: (customer_unique_id, recency, frequency, monetary,
    avg_review_score, avg_delivery_days)."""
    snap = months.agg(F.max("last") + F.make_dt_interval(F.lit(1))).scalar()
    totals = months.groupBy("customer_unique_id").agg(
        F.max("last").alias("_last"),
        F.sum("orders").alias("frequency"),
        money_total(F.col("cents"), F.col("rest")).alias("monetary"),
        (F.sum("review_sum") / F.nullif(F.sum("reviews"), F.lit(0))).alias("avg_review_score"),
        (F.sum("micros") / F.nullif(F.sum("deliveries"), F.lit(0)) / F.lit(86400e6)).alias("avg_delivery_days"),
    )
    return totals.withColumn("recency", F.floor(days_between(F.col("_last"), snap)).cast("long")).drop("_last")
