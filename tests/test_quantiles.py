"""Exact grouped quantiles (histogram narrowing) against numpy brute force."""

import numpy as np
import pytest

from marketlens.functions import grouped_quantiles

PROBS = [0.25, 0.5, 0.75]


def _brute(groups):
    out = {}
    for k, vals in groups.items():
        v = np.array([x for x in vals if x is not None and not np.isnan(x)], dtype=float)
        if len(v):
            out[k] = (len(v), v.min(), v.max(), *[_interp(np.sort(v), p) for p in PROBS])
    return out


def _interp(s, p):
    """Linear interpolation between the order statistics at floor/ceil of
    (n-1)p, written as lo*(1-f) + hi*f (equal to np.quantile for finite data;
    with infinities the engines' interpolation conventions differ)."""
    h = (len(s) - 1) * p
    lo, hi, f = s[int(np.floor(h))], s[int(np.ceil(h))], h - np.floor(h)
    return float(lo * (1 - f) + hi * f)


def _frame(spark, groups):
    rows = [(k, None if x is None else float(x)) for k, vals in groups.items() for x in vals]
    return spark.createDataFrame(rows, "k string, x double")


def _check(spark, groups, **kw):
    got = {r["k"]: (r["n"], r["min"], r["max"], r["q0"], r["q1"], r["q2"])
           for r in grouped_quantiles(_frame(spark, groups), "k", "x", PROBS, **kw).collect()}
    want = _brute(groups)
    assert set(got) == set(want)
    for k in want:
        assert got[k][0] == want[k][0]
        assert got[k][1:] == pytest.approx(want[k][1:], rel=1e-12, abs=1e-12, nan_ok=True)
        if k != "inf":
            v = [x for x in groups[k] if x is not None and not np.isnan(x)]
            assert got[k][3:] == pytest.approx([float(np.quantile(v, p)) for p in PROBS], rel=1e-12, abs=1e-12)


def test_hot_group_many_rounds(spark):
    rng = np.random.default_rng(7)
    groups = {
        # one group holds most rows, with heavy duplicates and a tight cluster
        "hot": list(rng.normal(10, 3, 3000)) + [5.0] * 700 + list(10 + rng.random(300) * 1e-9),
        "small": [1.0, 2.0, 3.0, 4.0],
        "one": [42.0],
        "same": [7.0] * 200,
        "gaps": [None, float("nan"), -1.0, 1e12, 3.0],
        "inf": [float("-inf"), 1.0, 2.0, 2.5, 3.0, float("inf"), float("inf")] * 5,
    }
    # tiny buckets / candidate limit force several narrowing rounds
    _check(spark, groups, buckets=4, max_candidates=16)
    # brackets that miss their ranks are found out and searched again
    _check(spark, groups, buckets=64, rank_error=0.0)
    _check(spark, groups, rank_error=-0.2)
    _check(spark, groups)


def test_no_rows(spark):
    df = spark.createDataFrame([("a", None)], "k string, x double")
    assert grouped_quantiles(df, "k", "x", PROBS).count() == 0


def test_brackets_hold_the_ranks_of_a_large_group(spark):
    """The sketch no longer holds all values here; nothing is left to the narrowing."""
    from pyspark.sql import functions as F

    from marketlens.functions import quantiles

    df = spark.range(300_000).select(F.lit("k").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7.0).alias("x"))
    values = np.sort([r.x for r in df.select("x").collect()])
    narrowed = []
    whole, quantiles._narrowed = quantiles._narrowed, lambda *a: narrowed.append(a) or whole(*a)
    try:
        got = grouped_quantiles(df, "k", "x", [0.1, 0.5, 0.999]).first()
    finally:
        quantiles._narrowed = whole
    assert not narrowed
    assert [got.q0, got.q1, got.q2] == pytest.approx([float(np.quantile(values, p)) for p in (0.1, 0.5, 0.999)], rel=1e-12)
