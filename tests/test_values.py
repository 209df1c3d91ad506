"""Values that text, sizes and sessions may bring: whole numbers, infinities, parts of a cent, ties, time zones, CSV headers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import raw_frames
from marketlens.functions import exact_median, exact_medians, money_sum, null_tokens_to_null, to_int, to_timestamp_ntz
from marketlens.plans.ingest import run_ingest
from marketlens.sources.raw import read_raw_csv
from marketlens.sources.warehouse import read_runs


def test_median_of_many_ties(spark):
    df = spark.range(400_000).select((F.col("id") % 2).cast("double").alias("x"), F.lit(None).cast("double").alias("none"))
    assert exact_medians(df, ["x", "none"]) == {"x": 0.5, "none": None}


def test_median_narrows_without_ranking(spark):
    values = np.random.default_rng(0).lognormal(0, 30, 5001)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    assert exact_median(df, "x", buckets=4, max_candidates=1) == np.median(values)


@pytest.mark.parametrize("amounts, total", [
    ([0.004] * 1000, 4.0), ([0.1] * 30, 3.0), ([float("inf"), 1.0], float("inf")), ([None], 0.0), ([], 0.0), ([1e300, 1.0], 1e300)])
def test_money_sum(spark, amounts, total):
    df = spark.createDataFrame([(a,) for a in amounts], "x double")
    assert df.agg(money_sum(F.col("x")).alias("s")).first()["s"] == pytest.approx(total, rel=1e-12)


def test_text_numbers_and_tokens(spark):
    df = spark.createDataFrame([("1.0",), (" 7 ",), ("1.5",), ("x",), ("1e2",)], "t string")
    assert [r[0] for r in df.select(to_int(F.col("t"))).collect()] == [1, 7, None, None, 100]
    tokens = spark.createDataFrame([("<NA>",), ("#NA",), ("-nan",), (" NA ",), ("",)], "t string")
    assert [r[0] for r in tokens.select(null_tokens_to_null(F.col("t"))).collect()] == [None, None, None, " NA ", None]


def test_timestamps_do_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([("2017-10-15 00:30:00",), ("2017-10-15",), ("2017-13-01",), ("15/10/2017",)], "t string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
        got = [r[0] for r in df.select(to_timestamp_ntz(F.col("t")).cast("string")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == ["2017-10-15 00:30:00", "2017-10-15 00:00:00", None, None]


def test_csv_columns_by_name(spark, tmp_path):
    (tmp_path / "s.csv").write_text("seller_state,extra,seller_id\nSP,1,s1\nNA,2,s2\n")
    got = read_raw_csv(spark, str(tmp_path), "sellers", "s.csv").collect()
    assert [(r["seller_id"], r["seller_state"], r["seller_city"]) for r in got] == [("s1", "SP", None), ("s2", None, None)]


def test_whole_failure_text_is_logged(spark, tmp_path):
    raw = raw_frames(spark, [])
    raw["orders"] = raw["orders"].drop("order_id").withColumn("a" * 6000, F.lit(1))
    result = run_ingest(spark, str(tmp_path / "wh"), raw=raw)
    logged = read_runs(spark, str(tmp_path / "wh")).first()
    assert result.status == logged.status == "failed" and logged.message == result.message and len(result.message) > 4000


def test_forecast_methods(spark):
    from marketlens.operators.forecast import forecast_methods

    fact = spark.sql("""SELECT c AS product_category, make_timestamp_ntz(2020, m, 1, 0, 0, 0) AS month, 1.0D AS revenue
                        FROM VALUES ('long', 1), ('long', 4), ('short', 1), ('short', 2) AS t(c, m)""")
    got = {r["product_category"]: (r["months"], r["method"]) for r in forecast_methods(fact, ["product_category"]).collect()}
    assert got == {"long": (4, "Exponential smoothing fallback"), "short": (2, "Insufficient history")}
