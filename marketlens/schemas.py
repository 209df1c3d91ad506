"""Table contracts and fixed values.

The raw contract is the six marketplace tables (orders, items, customers,
products, sellers, reviews). Raw CSV is read as strings and coerced
afterwards (``functions.columns``), so one schema serves CSV and typed sources.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the source application's for matching results)
# ---------------------------------------------------------------------------

# Raw product columns (spelled as in the files) and their star names.
PRODUCT_MEASURES = {
    "product_name_lenght": "name_length",
    "product_description_lenght": "description_length",
    "product_photos_qty": "photos_qty",
    "product_weight_g": "weight_g",
    "product_length_cm": "length_cm",
    "product_height_cm": "height_cm",
    "product_width_cm": "width_cm",
}

# Brazilian federative units, alphabetical.
BR_STATES = [
    "AC", "AL", "AM", "AP", "BA", "CE", "DF", "ES", "GO", "MA", "MG", "MS", "MT", "PA",
    "PB", "PE", "PI", "PR", "RJ", "RN", "RO", "RR", "RS", "SC", "SE", "SP", "TO",
]

# Map centroid (lat, lon) per state.
STATE_CENTROIDS = {
    "AC": (-8.77, -70.55),
    "AL": (-9.71, -35.73),
    "AM": (-3.07, -61.66),
    "AP": (1.41, -51.77),
    "BA": (-12.96, -38.51),
    "CE": (-3.71, -38.54),
    "DF": (-15.83, -47.86),
    "ES": (-19.19, -40.34),
    "GO": (-16.64, -49.31),
    "MA": (-2.55, -44.30),
    "MG": (-18.10, -44.38),
    "MS": (-20.51, -54.54),
    "MT": (-12.64, -55.42),
    "PA": (-5.53, -52.29),
    "PB": (-7.06, -35.55),
    "PE": (-8.28, -35.07),
    "PI": (-8.28, -43.68),
    "PR": (-24.89, -51.55),
    "RJ": (-22.84, -43.15),
    "RN": (-5.22, -36.52),
    "RO": (-11.22, -62.80),
    "RR": (1.89, -61.22),
    "RS": (-30.01, -51.22),
    "SC": (-27.33, -49.44),
    "SE": (-10.90, -37.07),
    "SP": (-23.55, -46.64),
    "TO": (-10.25, -48.25),
}

# RFM segment names, from lowest to highest cluster score.
SEGMENT_LABELS = ["Lost", "At Risk", "Loyal", "Champions"]

# Review sentiment buckets: (label, lower, upper); the first bin includes its
# lower edge, the others are left-open.
SENTIMENT_BINS = [("negative", 0.0, 2.0), ("neutral", 2.0, 3.0), ("positive", 3.0, 5.0)]

# Raw CSV file names per table.
RAW_FILES = {
    "orders": "olist_orders_dataset.csv",
    "items": "olist_order_items_dataset.csv",
    "customers": "olist_customers_dataset.csv",
    "products": "olist_products_dataset.csv",
    "sellers": "olist_sellers_dataset.csv",
    "reviews": "olist_order_reviews_dataset.csv",
}

# Defaults for missing dimension values.
UNKNOWN_CATEGORY = "unknown"
UNKNOWN_STATE = "NA"

# Text tokens read as null in raw CSV.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
               "n/a", "nan", "null"]

# Text of a date or timestamp: yyyy-MM-dd, with an optional HH:mm:ss.
TIMESTAMP_TEXT = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}:\d{2}(\.\d+)?)?$"
DATE_COLUMN = "order_purchase_timestamp"

ORDER_TIMESTAMPS = [
    "order_purchase_timestamp",
    "order_approved_at",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
]

CHURN_FEATURES = ["recency", "frequency", "monetary", "avg_review_score", "avg_delivery_days"]

# ---------------------------------------------------------------------------
# Raw contract: every column read as text, coerced after the read.
# ---------------------------------------------------------------------------


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


RAW_SCHEMAS = {
    "orders": _strings("order_id", "customer_id", "order_status", *ORDER_TIMESTAMPS),
    "items": _strings(
        "order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_date", "price", "freight_value"
    ),
    "customers": _strings(
        "customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city", "customer_state"
    ),
    "products": _strings(
        "product_id",
        "product_category_name",
        "product_name_lenght",
        "product_description_lenght",
        "product_photos_qty",
        "product_weight_g",
        "product_length_cm",
        "product_height_cm",
        "product_width_cm",
    ),
    "sellers": _strings("seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"),
    "reviews": _strings(
        "review_id", "order_id", "review_score", "review_comment_title", "review_comment_message",
        "review_creation_date", "review_answer_timestamp",
    ),
}

# Star-schema output columns, in order.
FACT_COLUMNS = [
    "order_id",
    "order_item_id",
    "customer_id",
    "customer_unique_id",
    "product_id",
    "seller_id",
    "order_status",
    "customer_state",
    "seller_state",
    "product_category",
    "price",
    "freight_value",
    "revenue",
    "review_score",
    *ORDER_TIMESTAMPS,
    "delivery_days",
]

PIPELINE_RUNS_SCHEMA = T.StructType(
    [
        T.StructField("run_at", T.TimestampNTZType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("message", T.StringType(), True),
    ]
)
