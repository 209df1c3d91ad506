"""Binding of the generated TPC-H-style test tables to the raw contract.

Test-side only: the engine itself knows only the six raw tables. Every raw
table is a projection of a given table (plus a lookup of the fixed 25-row
``nation`` table), so all of the work scales with the inputs. The same
expressions are written as SQL in ``__spark_entry__.oracle_sql``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.schemas import BR_STATES
from marketlens.session import apply_core_conf, size_shuffles
from marketlens.sources import storage

# nation keys 0..23 map to the first 24 states; key 24 has no state (NULL)
# so that the "NA" default is exercised.
def _state(nation_key):
    states = F.array(*[F.lit(s) for s in BR_STATES[:24]])
    return F.when(nation_key < 24, F.element_at(states, nation_key + 1))


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    apply_core_conf(spark)
    size_shuffles(spark, storage.total_bytes(spark, sf_dir))

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

    orders, lineitem = table("orders"), table("lineitem")
    # 25 rows by definition of the schema: a fixed-size lookup, safe to broadcast.
    nation = F.broadcast(table("nation").select("n_nationkey", "n_name"))

    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    raw_orders = orders.select(
        key.alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("order_status"),
        day.alias("order_purchase_timestamp"),
        (day + F.make_dt_interval(F.lit(1))).alias("order_approved_at"),
        (day + F.make_dt_interval(F.lit(2))).alias("order_delivered_carrier_date"),
        F.when(
            F.col("o_orderstatus") != "O",
            day + F.make_dt_interval(F.lit(2) + (key % 22).cast("int"), (key % 24).cast("int")),
        ).alias("order_delivered_customer_date"),
        (day + F.make_dt_interval(F.lit(18))).alias("order_estimated_delivery_date"),
    )

    price = F.col("l_extendedprice")
    freight = F.round(price.cast("decimal(18,2)") * F.col("l_tax").cast("decimal(4,2)"), 2).cast("double")
    raw_items = lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        price.alias("price"),
        freight.alias("freight_value"),
    )

    raw_customers = table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_unique_id"),
        F.col("c_custkey").alias("customer_zip_code_prefix"),
        F.col("n_name").alias("customer_city"),
        _state(F.col("c_nationkey")).alias("customer_state"),
    )

    pk = F.col("p_partkey")
    none = F.lit(None).cast("double")
    raw_products = table("part").select(
        pk.alias("product_id"),
        F.when(pk % 50 != 0, F.col("p_brand")).alias("product_category_name"),
        F.length("p_name").cast("double").alias("product_name_lenght"),
        none.alias("product_description_lenght"),
        none.alias("product_photos_qty"),
        F.col("p_size").cast("double").alias("product_weight_g"),
        none.alias("product_length_cm"),
        none.alias("product_height_cm"),
        none.alias("product_width_cm"),
    )

    raw_sellers = table("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("s_suppkey").alias("seller_id"),
        F.col("s_suppkey").alias("seller_zip_code_prefix"),
        F.col("n_name").alias("seller_city"),
        _state(F.col("s_nationkey")).alias("seller_state"),
    )

    # One review per order except every 20th (key % 20 = 3, no review), and a
    # second review on every 10th order, so per-order means are fractional.
    first = orders.filter(key % 20 != 3).select(
        key.alias("order_id"), (F.lit(1) + (key * 7) % 5).cast("double").alias("review_score")
    )
    second = orders.filter(key % 10 == 0).select(
        key.alias("order_id"), (F.lit(1) + key % 4).cast("double").alias("review_score")
    )
    raw_reviews = first.unionByName(second)

    return {
        "orders": raw_orders,
        "items": raw_items,
        "customers": raw_customers,
        "products": raw_products,
        "sellers": raw_sellers,
        "reviews": raw_reviews,
    }
