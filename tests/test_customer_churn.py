"""RFM / K-Means (A-13, M-01, M-02, A-15/16), churn (A-14, M-03..M-07), exact median."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import cust, item, order, prepared, prod, seller
from marketlens.functions import exact_median
from marketlens.operators import churn, customer
from marketlens.schemas import CHURN_FEATURES, SEGMENT_LABELS


def test_recency_floors_days(spark):
    """Q10: last order 2020-01-01 00:00, latest 2020-01-02 12:00 -> snapshot +1 day -> 2."""
    fact = prepared(spark, [order("o1", "c1", "2020-01-01 00:00:00"), order("o2", "c2", "2020-01-02 12:00:00")],
                    customers=[cust("c1"), cust("c2")])
    got = {r.customer_unique_id: r.recency for r in customer.rfm_base(fact).collect()}
    assert got == {"uc1": 2, "uc2": 1}


def test_few_customers_single_segment(spark):
    """Q11."""
    fact = prepared(spark, [order(f"o{i}", f"c{i}", "2020-01-01 00:00:00") for i in range(3)],
                    customers=[cust(f"c{i}") for i in range(3)])
    rows = customer.rfm_segments(fact, k=4, restarts=1).collect()
    assert {(r.cluster, r.segment) for r in rows} == {(0, "Champions")}


def test_label_count_must_match_k(spark):
    """Q12."""
    fact = prepared(spark, [order("o1", "c1", "2020-01-01 00:00:00")], customers=[cust("c1")])
    with pytest.raises(ValueError):
        customer.rfm_segments(fact, k=5)


def _segment_fact(spark, n=120, seed=3):
    rng = np.random.default_rng(seed)
    orders, items, custs = [], [], []
    for c in range(n):
        group = c % 4
        n_orders = 1 + group * 2 + int(rng.integers(0, 2))
        last_day = 28 - group * 6
        for j in range(n_orders):
            oid = f"o{c}_{j}"
            day = max(1, last_day - j)
            orders.append(order(oid, f"c{c}", f"2020-06-{day:02d} 00:00:00"))
            items.append(item(oid, 1, "p1", "s1", f"{10 + group * 50 + int(rng.integers(0, 5))}.00"))
        custs.append(cust(f"c{c}"))
    return prepared(spark, orders, items, custs, [prod("p1")], [seller("s1")])


def test_segments_ordered_by_score(spark):
    fact = _segment_fact(spark)
    rfm = customer.rfm_segments(fact, k=4, restarts=3)
    assert rfm.count() == 120
    prof = {r.segment: r for r in rfm.groupBy("segment").agg(
        F.avg("recency").alias("r"), F.avg("frequency").alias("f"), F.avg("monetary").alias("m")).collect()}
    assert set(prof) == set(SEGMENT_LABELS)
    segs = sorted(prof)
    def rank(key):
        order_ = sorted(segs, key=lambda s: getattr(prof[s], key))
        return {s: i + 1 for i, s in enumerate(order_)}
    rr, fr, mr = rank("r"), rank("f"), rank("m")
    score = {s: -rr[s] + fr[s] + mr[s] for s in segs}
    ordered = [s for s in SEGMENT_LABELS]
    assert [score[s] for s in ordered] == sorted(score[s] for s in ordered)
    profile = {r.segment: r for r in customer.segment_profile(rfm).collect()}
    assert sum(r.customers for r in profile.values()) == 120
    assert len({r.cluster for r in profile.values()}) == 4  # one cluster per segment
    heur = customer.segment_churn_heuristic(rfm).collect()
    assert len(heur) == 4 and all(0 <= r.churn_probability <= 100 for r in heur)
    top = customer.top_customers(rfm, 10).collect()
    assert len(top) == 10 and top[0].lifetime_value_brl >= top[-1].lifetime_value_brl


def test_standardize_population_std(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    got = customer.standardize(df, ["a", "b"]).collect()
    s = np.std([1.0, 2.0, 3.0])
    assert [r.a_z for r in got] == pytest.approx([-1 / s, 0.0, 1 / s])
    assert [r.b_z for r in got] == [0.0, 0.0, 0.0]  # zero variance -> 0


@pytest.mark.parametrize("n", [1, 2, 999, 1000])
def test_exact_median_matches_numpy(spark, n):
    rng = np.random.default_rng(n)
    vals = np.round(rng.normal(size=n) * 10, 1)  # ties on purpose
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,)], "x double")
    assert exact_median(df, "x", buckets=4, max_candidates=20) == pytest.approx(float(np.median(vals)), abs=1e-12)
    assert exact_median(df, "x") == pytest.approx(float(np.median(vals)), abs=1e-12)


def test_exact_median_empty(spark):
    assert exact_median(spark.createDataFrame([(None,)], "x double"), "x") is None


def test_churn_label_boundary_and_imputation(spark):
    """recency 120 -> 0, 121 -> 1; a customer without reviews gets the median."""
    from conftest import review

    orders = [order("o_new", "c_new", "2020-06-01 00:00:00"),
              order("o120", "c120", "2020-02-03 00:00:00"),  # 120 days before 2020-06-02
              order("o121", "c121", "2020-02-02 00:00:00")]
    fact = prepared(spark, orders, [item(o["order_id"], 1, "p1", "s1", "1") for o in orders],
                    [cust("c_new"), cust("c120"), cust("c121")], [prod("p1")], [seller("s1")],
                    [review("o_new", 5), review("o120", 1)])
    feats = {r.customer_unique_id: r for r in churn.customer_features(fact).collect()}
    assert feats["uc120"].recency == 120 and feats["uc120"].churned == 0
    assert feats["uc121"].recency == 121 and feats["uc121"].churned == 1
    assert feats["uc121"].avg_review_score == 3.0  # median of 5 and 1
    assert feats["uc121"].avg_delivery_days == 0.0  # all null -> median null -> 0


def test_single_class_degenerate(spark):
    df = spark.createDataFrame([(f"u{i}", 10, 1, 5.0, 4.0, 3.0, 0) for i in range(10)],
                               "customer_unique_id string, recency bigint, frequency bigint, monetary double, "
                               "avg_review_score double, avg_delivery_days double, churned int")
    res = churn.train_churn_model(df)
    assert {r.value for r in res.metrics.collect()} == {0.0}
    assert {r.churn_probability for r in res.predictions.collect()} == {0.0}
    assert {r.importance for r in res.drivers.collect()} == {0.0}


def _newton_balanced_l2(x, y, iters=100):
    """Independent solve of min 0.5||w||^2 + sum_i s_i * logloss_i (C=1, balanced s)."""
    n = len(y)
    s = np.where(y == 1, n / (2.0 * y.sum()), n / (2.0 * (n - y.sum())))
    xa = np.hstack([x, np.ones((n, 1))])
    theta = np.zeros(xa.shape[1])
    reg = np.eye(xa.shape[1]); reg[-1, -1] = 0.0
    for _ in range(iters):
        p = 1 / (1 + np.exp(-xa @ theta))
        grad = xa.T @ (s * (p - y)) + reg @ theta
        hess = xa.T @ (xa * (s * p * (1 - p))[:, None]) + reg
        step = np.linalg.solve(hess, grad)
        theta -= step
        if np.abs(step).max() < 1e-12:
            break
    return theta[:-1], theta[-1]


def test_logistic_matches_independent_newton_solve(spark):
    rng = np.random.default_rng(11)
    n = 600
    feats = rng.normal(size=(n, 5)) * [30, 2, 100, 1, 5] + [100, 3, 500, 4, 10]
    logit = 0.04 * (feats[:, 0] - 100) - 0.5 * (feats[:, 1] - 3) + rng.normal(size=n)
    y = (logit > 0.3).astype(int)
    rows = [(f"u{i}", *map(float, feats[i]), int(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "customer_unique_id string, recency double, frequency double, monetary double, "
                                     "avg_review_score double, avg_delivery_days double, churned int")
    res = churn.train_churn_model(df)
    # rebuild the same scaled train split independently
    z = (feats - feats.mean(axis=0)) / feats.std(axis=0)
    flags = _plain_split({f"u{i}": int(y[i]) for i in range(n)})
    train = np.array([not flags[f"u{i}"] for i in range(n)])
    coef, intercept = _newton_balanced_l2(z[train], y[train])
    assert res.coefficients == pytest.approx(list(coef), rel=1e-9, abs=1e-9)
    assert res.intercept == pytest.approx(intercept, rel=1e-9, abs=1e-9)
    probs = [r.churn_probability for r in res.predictions.collect()]
    assert len(probs) == n and all(0.0 <= p <= 1.0 for p in probs)
    metrics = {r.metric: r.value for r in res.metrics.collect()}
    assert 0.5 < metrics["AUC-ROC"] <= 1.0 and 0.0 < metrics["F1"] <= 1.0
    drivers = res.drivers.collect()
    assert len(drivers) == 5 and drivers[0].feature == "recency" and drivers[0].source == "mean_abs_shap"
    exp_imp = np.abs(coef * (z - z.mean(axis=0))).mean(axis=0)
    got = {r.feature: r.importance for r in drivers}
    assert [got[f] for f in CHURN_FEATURES] == pytest.approx(list(exp_imp), rel=1e-3)
    # the test split is a quarter of each class, to the row
    assert (~train).sum() == 150 and abs((~train)[y == 1].sum() - y.sum() / 4) < 1
    # the fallback without SHAP values
    zs = customer.standardize(df, CHURN_FEATURES)
    scored = churn.with_probability(zs, res.coefficients, res.intercept).withColumn("is_test", F.lit(True))
    by_size = churn.evaluate(scored, res.coefficients, "abs_coefficient")[1].collect()
    assert {r.feature: r.importance for r in by_size} == pytest.approx({f: abs(w) for f, w in zip(CHURN_FEATURES, res.coefficients)})
    assert {r.source for r in by_size} == {"abs_coefficient"}
    with pytest.raises(ValueError):
        churn.evaluate(scored, res.coefficients, "gain")


def _plain_split(labels, seed=42):
    """{id: held out} by sorting each class on (md5 of seed:id, id)."""
    from hashlib import md5

    n = len(labels)
    n_test = -(-n // 4)
    classes = {c: [i for i in labels if labels[i] == c] for c in sorted(set(labels.values()))}
    if min(len(v) for v in classes.values()) < 2:
        classes, quota = {0: list(labels)}, {0: n_test}
    else:
        share = {c: (n - n_test) * len(v) / n for c, v in classes.items()}
        train = {c: int(s) for c, s in share.items()}
        for c in sorted(share, key=lambda c: (train[c] - share[c], c))[: n - n_test - sum(train.values())]:
            train[c] += 1
        quota = {c: len(v) - train[c] for c, v in classes.items()}
    out = dict.fromkeys(labels, False)
    for c, ids in classes.items():
        for i in sorted(ids, key=lambda i: (md5(f"{seed}:{i}".encode()).hexdigest(), i))[: quota[c]]:
            out[i] = True
    return out


@pytest.mark.parametrize("n, positives", [(400, 101), (401, 3), (50, 1), (7, 2), (2, 1)])
def test_split_holds_out_a_quarter_of_each_class(spark, n, positives):
    labels = {f"c{i}": int(i < positives) for i in range(n)}
    df = spark.createDataFrame([(i, y) for i, y in labels.items()], "customer_unique_id string, churned int")
    got = {r.customer_unique_id: r.is_test for r in churn.churn_split(df).collect()}
    assert got == _plain_split(labels)


def test_quota_narrows_prefix_by_prefix(spark):
    from hashlib import md5

    from marketlens.functions import smallest

    df = spark.range(3000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 2).alias("g"))
    flag = smallest(df, "k", F.col("g"), {0: 700, 1: 2000}, seed=5, digits=1, small=2)
    got = {r.k for r in df.where(flag).collect()}
    of = lambda g: sorted((str(i) for i in range(g, 3000, 2)), key=lambda k: (md5(f"5:{k}".encode()).hexdigest(), k))
    assert got == set(of(0)[:700]) | set(of(1))  # class 1 has 1500 rows, fewer than its quota


def test_area_under_roc_with_heavy_ties(spark):
    from marketlens.functions import area_under_roc

    rng = np.random.default_rng(2)
    score = np.where(rng.random(900) < 0.34, 0.5, np.round(rng.random(900), 2))
    y = (rng.random(900) < 0.3 + 0.4 * score).astype(int)
    df = spark.createDataFrame([(float(s), int(v)) for s, v in zip(score, y)] + [(None, 1)], "s double, y int")
    pos, neg = score[y == 1], score[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert area_under_roc(df, "s", "y") == pytest.approx(want, abs=1e-12)
    assert area_under_roc(df.where("y = 1"), "s", "y") is None


def test_newton_steps_survive_separable_classes(spark):
    """A feature that separates the classes: the penalty alone bounds the coefficients."""
    from marketlens.operators.logistic import fit_logistic

    x = np.linspace(-2, 2, 200)
    y = (x > 0.3).astype(int)
    df = spark.createDataFrame([(float(a), 1.0, int(b), 1.0) for a, b in zip(x, y)], "a double, b double, y int, w double")
    fit = fit_logistic(df, ["a", "b"], "y", "w")
    theta = np.zeros(3)
    xa = np.stack([x, np.ones(200), np.ones(200)], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-xa @ theta))
        theta -= np.linalg.solve(xa.T @ (xa * (p * (1 - p))[:, None]) + np.diag([1, 1, 0]), xa.T @ (p - y) + theta * [1, 1, 0])
    assert fit.coefficients + [fit.intercept] == pytest.approx(theta.tolist(), abs=1e-7)
    assert fit.steps < 20
