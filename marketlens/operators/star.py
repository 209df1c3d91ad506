"""Star schema from the raw tables (X-01: C-01..C-09, J-01..J-05, A-01).

The fact equals ``orders LEFT JOIN items LEFT JOIN customers LEFT JOIN
products LEFT JOIN sellers LEFT JOIN review_means`` (order-item grain, orders
without items kept), but the plan is shaped for scale:

* order attributes (customer, per-order review mean) are joined at *order*
  grain and item attributes (product, seller) on the *narrow* items, so the
  wide item-grain fact is never reshuffled for a dimension lookup;
* the order-item join is an INNER join (AQE can split a hot ``order_id`` on
  either side, e.g. one order holding a third of all items) plus a LEFT ANTI
  join of orders against the de-duplicated item keys (partial aggregation
  first, so a hot key cannot pile up) for the orders without items.

All dimension joins are left joins on keys of the preserved side, so this
regrouping gives the same rows as joining in source order. No broadcast
hints: dimension sizes grow with the data, so Spark broadcasts only below
its size threshold (static estimate or AQE runtime size) and otherwise uses
sort-merge joins whose skewed left partitions AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions import days_between, to_double, to_int, to_long, to_timestamp_ntz
from marketlens.schemas import FACT_COLUMNS, ORDER_TIMESTAMPS, PRODUCT_MEASURES, UNKNOWN_CATEGORY


def _types(df: DataFrame) -> dict:
    return {f.name: f.dataType for f in df.schema.fields}


def clean_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    """C-01: parse the listed timestamp columns (bad values -> NULL); absent ones are skipped."""
    types = _types(df)
    present = {c: to_timestamp_ntz(F.col(c), types[c]).alias(c) for c in columns if c in types}
    return df.withColumns(present) if present else df


def review_means(reviews: DataFrame) -> DataFrame:
    """A-01: mean review score per order (NULL order ids dropped)."""
    score = to_double(F.col("review_score"), _types(reviews)["review_score"])
    return (
        reviews.filter(F.col("order_id").isNotNull())
        .groupBy("order_id")
        .agg(F.avg(score).alias("review_score"))
    )


def dim_customers(customers: DataFrame) -> DataFrame:
    """C-07."""
    t = _types(customers)
    return customers.select(
        "customer_id",
        "customer_unique_id",
        to_long(F.col("customer_zip_code_prefix"), t["customer_zip_code_prefix"]).alias("zip_code_prefix"),
        F.col("customer_city").alias("city"),
        F.col("customer_state").alias("state"),
    )


def dim_products(products: DataFrame) -> DataFrame:
    """C-08 (category defaults to ``unknown``)."""
    t = _types(products)
    return products.select(
        "product_id",
        F.coalesce(F.col("product_category_name"), F.lit(UNKNOWN_CATEGORY)).alias("category"),
        *[to_double(F.col(src), t.get(src)).alias(dst) for src, dst in PRODUCT_MEASURES.items()],
    )


def dim_sellers(sellers: DataFrame) -> DataFrame:
    """C-09."""
    t = _types(sellers)
    return sellers.select(
        "seller_id",
        to_long(F.col("seller_zip_code_prefix"), t["seller_zip_code_prefix"]).alias("zip_code_prefix"),
        F.col("seller_city").alias("city"),
        F.col("seller_state").alias("state"),
    )


def fact_orders(raw: dict[str, DataFrame]) -> DataFrame:
    """Order-item grain fact (J-01..J-05 + C-02..C-06); orders without items survive."""
    orders = clean_dates(raw["orders"], ORDER_TIMESTAMPS).select(
        "order_id", "customer_id", "order_status", *ORDER_TIMESTAMPS
    )
    items = raw["items"]
    it = _types(items)
    items = items.select(
        "order_id",
        to_int(F.col("order_item_id"), it["order_item_id"]).alias("order_item_id"),
        "product_id",
        "seller_id",
        to_double(F.col("price"), it["price"]).alias("price"),
        to_double(F.col("freight_value"), it["freight_value"]).alias("freight_value"),
    )
    customers = raw["customers"].select("customer_id", "customer_unique_id", "customer_state")
    products = raw["products"].select(
        "product_id", F.coalesce(F.col("product_category_name"), F.lit(UNKNOWN_CATEGORY)).alias("category")
    )
    sellers = raw["sellers"].select("seller_id", "seller_state")

    # J-03 products, J-04 sellers (only the needed columns, so no name clashes)
    item_side = items.join(products, "product_id", "left").join(sellers, "seller_id", "left")
    # J-02 customers, J-05 per-order review mean (A-01)
    order_side = orders.join(customers, "customer_id", "left").join(review_means(raw["reviews"]), "order_id", "left")
    matched = order_side.join(item_side, "order_id", "inner")
    item_keys = items.select("order_id").filter(F.col("order_id").isNotNull()).distinct()
    lonely = order_side.join(item_keys, "order_id", "left_anti").select(
        "*", *[F.lit(None).cast(item_side.schema[c].dataType).alias(c) for c in item_side.columns if c != "order_id"]
    )
    joined = matched.unionByName(lonely)
    # C-02 numeric defaults, C-03 null category, C-04 revenue, C-05 delivery days
    price = F.coalesce(F.col("price"), F.lit(0.0))
    freight = F.coalesce(F.col("freight_value"), F.lit(0.0))
    fact = joined.select(
        "*",
        price.alias("_price"),
        freight.alias("_freight"),
    ).select(
        "order_id",
        "order_item_id",
        "customer_id",
        "customer_unique_id",
        "product_id",
        "seller_id",
        "order_status",
        "customer_state",
        "seller_state",
        F.coalesce(F.col("category"), F.lit(UNKNOWN_CATEGORY)).alias("product_category"),
        F.col("_price").alias("price"),
        F.col("_freight").alias("freight_value"),
        (F.col("_price") + F.col("_freight")).alias("revenue"),
        "review_score",
        *ORDER_TIMESTAMPS,
        days_between(F.col("order_purchase_timestamp"), F.col("order_delivered_customer_date")).alias("delivery_days"),
    )
    return fact.select(FACT_COLUMNS)


def build_star(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """X-01: the four star tables as lazy plans."""
    return {
        "fact_orders": fact_orders(raw),
        "dim_customers": dim_customers(raw["customers"]),
        "dim_products": dim_products(raw["products"]),
        "dim_sellers": dim_sellers(raw["sellers"]),
    }
