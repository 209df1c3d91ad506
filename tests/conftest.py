import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marketlens.schemas import RAW_SCHEMAS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from marketlens.session import apply_core_conf

    ckpt = tempfile.mkdtemp(prefix="marketlens-test-ckpt-")
    session = (
        SparkSession.builder.master("local[*]")
        .appName("marketlens-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", ckpt)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    apply_core_conf(session)
    yield session
    session.stop()


def raw_frames(spark, orders, items=(), customers=(), products=(), sellers=(), reviews=()):
    """Raw tables from dict rows, every column text (as read from CSV)."""
    data = {"orders": orders, "items": items, "customers": customers, "products": products,
            "sellers": sellers, "reviews": reviews}
    out = {}
    for name, rows in data.items():
        schema = RAW_SCHEMAS[name]
        cols = schema.fieldNames()
        tuples = [tuple(None if r.get(c) is None else str(r.get(c)) for c in cols) for r in rows]
        out[name] = spark.createDataFrame(tuples, schema)
    return out


def order(oid, cust, ts, status="delivered", delivered=None):
    return {"order_id": oid, "customer_id": cust, "order_status": status, "order_purchase_timestamp": ts,
            "order_delivered_customer_date": delivered}


def item(oid, n, pid, sid, price, freight=0):
    return {"order_id": oid, "order_item_id": n, "product_id": pid, "seller_id": sid, "price": price,
            "freight_value": freight}


def cust(cid, uid=None, state="SP"):
    return {"customer_id": cid, "customer_unique_id": uid or f"u{cid}", "customer_state": state,
            "customer_zip_code_prefix": "01001", "customer_city": "sao paulo"}


def prod(pid, category="toys"):
    return {"product_id": pid, "product_category_name": category}


def seller(sid, state="SP"):
    return {"seller_id": sid, "seller_state": state, "seller_zip_code_prefix": "02002", "seller_city": "x"}


def review(oid, score):
    return {"review_id": f"r{oid}{score}", "order_id": oid, "review_score": score}


def prepared(spark, *args, **kwargs):
    from marketlens.operators.prepare import prepare_fact
    from marketlens.operators.star import build_star

    return prepare_fact(build_star(raw_frames(spark, *args, **kwargs))["fact_orders"])
