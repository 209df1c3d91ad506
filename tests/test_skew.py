"""Hot keys: one order, one customer and one product each hold about a third
of the rows. With broadcast joins off and AQE's skew thresholds lowered, the
star join must split skewed partitions and still give the brute-force result."""

import pandas as pd
import pytest

from conftest import cust, item, order, prod, raw_frames, seller
from marketlens.operators import kpi, product
from marketlens.operators.prepare import prepare_fact
from marketlens.operators.star import build_star

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture()
def skew_conf(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _rows():
    orders, items = [], []
    for i in range(600):
        c = "hot" if i % 3 == 0 else f"c{i % 40}"
        orders.append(order(f"o{i}", c, f"2020-{1 + i % 12:02d}-{1 + i % 28:02d} 08:00:00",
                            delivered=f"2020-{1 + i % 12:02d}-28 20:00:00"))
        for j in range(2):
            items.append(item(f"o{i}", j + 1, "p_hot" if (i + j) % 3 == 0 else f"p{i % 30}", f"s{i % 7}",
                              f"{10 + i % 17}.{j}5", "1.10"))
    for j in range(600):  # one order holding a third of all items
        items.append(item("o1", 10 + j, "p_hot", "s1", "3.30", "0.20"))
    custs = [cust("hot", state="SP")] + [cust(f"c{i}", state=["RJ", "MG"][i % 2]) for i in range(40)]
    prods = [prod("p_hot", "toys")] + [prod(f"p{i}", ["auto", "home"][i % 2]) for i in range(30)]
    sells = [seller(f"s{i}") for i in range(7)]
    return orders, items, custs, prods, sells


def _brute(orders, items, custs, prods, sells):
    o = pd.DataFrame(orders)
    i = pd.DataFrame(items)
    i["price"] = i["price"].astype(float)
    i["freight_value"] = i["freight_value"].astype(float)
    f = o.merge(i, on="order_id", how="left").merge(pd.DataFrame(custs), on="customer_id", how="left")
    f = f.merge(pd.DataFrame(prods), on="product_id", how="left")
    f["revenue"] = f["price"].fillna(0) + f["freight_value"].fillna(0)
    f["product_category"] = f["product_category_name"].fillna("unknown")
    return f


def test_skewed_star_matches_brute_force(spark, skew_conf):
    rows = _rows()
    raw = raw_frames(spark, *rows)
    fact = build_star(raw)["fact_orders"]
    got = fact.collect()
    plan = fact._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan  # AQE split the hot partitions
    exp = _brute(*rows)
    assert len(got) == len(exp)
    assert round(sum(r.revenue for r in got), 2) == round(float(exp["revenue"].sum()), 2)

    prepared = prepare_fact(fact)
    by_cat = {r.product_category: r.revenue for r in kpi.category_revenue_top(prepared, 10).collect()}
    exp_cat = exp.groupby("product_category")["revenue"].sum().round(2).to_dict()
    assert by_cat == pytest.approx(exp_cat, abs=1e-9)
    sellers = {r.seller_id: r.orders for r in product.seller_leaderboard(prepared, 15).collect()}
    assert sellers == exp.groupby("seller_id")["order_id"].nunique().to_dict()


def test_skewed_box_statistics_match_brute_force(spark, skew_conf):
    """A-10 when one state holds most rows: exact quartiles and whiskers."""
    import numpy as np

    rows = _rows()
    prepared = prepare_fact(build_star(raw_frames(spark, *rows))["fact_orders"])
    got = {r.customer_state: r for r in product.delivery_time_by_state(prepared).collect()}
    exp = _brute(*rows)
    days = (pd.to_datetime(exp["order_delivered_customer_date"]) - pd.to_datetime(exp["order_purchase_timestamp"]))
    exp["days"] = days.dt.total_seconds() / 86400
    assert set(got) == set(exp["customer_state"].dropna())
    for state, g in exp.dropna(subset=["customer_state", "days"]).groupby("customer_state"):
        v = g["days"].to_numpy()
        q1, med, q3 = (float(np.quantile(v, p)) for p in (0.25, 0.5, 0.75))
        iqr = q3 - q1
        r = got[state]
        assert r["count"] == len(v)
        assert (r["min"], r["q1"], r["median"], r["q3"], r["max"]) == pytest.approx((v.min(), q1, med, q3, v.max()), abs=1e-9)
        assert r["lower_whisker"] == pytest.approx(v[v >= q1 - 1.5 * iqr].min(), abs=1e-9)
        assert r["upper_whisker"] == pytest.approx(v[v <= q3 + 1.5 * iqr].max(), abs=1e-9)
