"""Star schema, cleaning and source quirks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import cust, item, order, prepared, prod, raw_frames, review, seller
from marketlens.operators.star import build_star
from marketlens.schemas import FACT_COLUMNS


def test_order_without_items_survives(spark):
    fact = prepared(spark, [order("o1", "c1", "2020-01-05 10:00:00")], customers=[cust("c1")])
    rows = fact.collect()
    assert len(rows) == 1
    r = rows[0]
    assert r.revenue == 0.0 and r.price == 0.0 and r.product_id is None
    assert r.product_category == "unknown"


def test_fact_columns_and_revenue(spark):
    star = build_star(raw_frames(
        spark,
        [order("o1", "c1", "2020-01-05 10:00:00", delivered="2020-01-07 22:00:00")],
        [item("o1", 1, "p1", "s1", "10.50", "2.25"), item("o1", 2, "p2", "s1", "1.00", "0")],
        [cust("c1")], [prod("p1"), prod("p2", None)], [seller("s1", "RJ")], [review("o1", 4), review("o1", 5)],
    ))
    fact = star["fact_orders"]
    assert fact.columns == FACT_COLUMNS
    rows = {r.order_item_id: r for r in fact.collect()}
    assert rows[1].revenue == pytest.approx(12.75)
    assert rows[2].product_category == "unknown"
    assert rows[1].review_score == 4.5 and rows[2].review_score == 4.5  # per-order mean, repeated per item
    assert rows[1].delivery_days == pytest.approx(2.5)
    assert rows[1].seller_state == "RJ" and rows[1].customer_state == "SP"
    assert set(star) == {"fact_orders", "dim_customers", "dim_products", "dim_sellers"}
    assert star["dim_products"].filter(F.col("product_id") == "p2").first().category == "unknown"


def test_bad_values_coerced(spark):
    raw = raw_frames(
        spark,
        [order("o1", "c1", "2020-01-05 10:00:00"), order("o2", "c1", "2017-13-01 00:00:00")],
        [item("o1", 1, "p1", "s1", "abc", "NaN"), item("o1", 2, "p1", "s1", " 1.5 ", "0.5")],
        [cust("c1")], [prod("p1")], [seller("s1")],
    )
    fact = build_star(raw)["fact_orders"]
    rows = fact.collect()
    by_item = {r.order_item_id: r for r in rows if r.order_id == "o1"}
    assert by_item[1].price == 0.0 and by_item[1].freight_value == 0.0
    assert by_item[2].price == 1.5 and by_item[2].revenue == 2.0
    bad = [r for r in rows if r.order_id == "o2"][0]
    assert bad.order_purchase_timestamp is None
    from marketlens.operators.prepare import prepare_fact
    assert prepare_fact(fact).filter(F.col("order_id") == "o2").count() == 0  # dropped: no purchase date


def test_null_tokens_from_csv(spark, tmp_path):
    from marketlens.sources.raw import load_raw
    from marketlens.schemas import RAW_FILES, RAW_SCHEMAS

    d = tmp_path / "raw"
    d.mkdir()
    tokens = ["NA", "N/A", "null", "None", ""]
    for name, fname in RAW_FILES.items():
        cols = RAW_SCHEMAS[name].fieldNames()
        lines = [",".join(cols)]
        if name == "products":
            for i, t in enumerate(tokens):
                lines.append(f"p{i},{t}" + "," * (len(cols) - 2))
        if name == "reviews":
            lines.append('r1,o1,5,"title","multi\nline comment",2020-01-01 00:00:00,2020-01-02 00:00:00')
        (d / fname).write_text("\n".join(lines) + "\n")
    raw = load_raw(spark, str(d))
    cats = [r.product_category_name for r in raw["products"].collect()]
    assert cats == [None] * len(tokens)
    rv = raw["reviews"].collect()
    assert len(rv) == 1 and rv[0].review_score == "5" and "\n" in rv[0].review_comment_message
    dims = build_star(raw)["dim_products"].collect()
    assert {r.category for r in dims} == {"unknown"}


def test_missing_csv_raises(spark, tmp_path):
    from marketlens.sources.raw import load_raw

    with pytest.raises(FileNotFoundError):
        load_raw(spark, str(tmp_path / "nowhere"))


def test_null_keys_do_not_match(spark):
    """Q1: a NULL product id stays unmatched (plain SQL equality)."""
    fact = prepared(
        spark, [order("o1", "c1", "2020-01-05 10:00:00")], [item("o1", 1, None, "s1", "5")],
        [cust("c1")], [{"product_id": None, "product_category_name": "toys"}], [seller("s1")],
    )
    r = fact.first()
    assert r.product_category == "unknown"


def test_prepare_defaults_and_time_columns(spark):
    fact = prepared(spark, [order("o1", "c9", "2020-03-15 23:59:59")], customers=[])
    r = fact.first()
    assert r.customer_state == "NA" and r.product_category == "unknown"
    assert r.month == dt.datetime(2020, 3, 1) and r.order_date == dt.date(2020, 3, 15)
