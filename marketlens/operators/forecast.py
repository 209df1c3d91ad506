"""Revenue forecasts (A-18, W-05, M-08, M-09, U-01).

Every forecast fans out over optional series keys (e.g. category x state):
the fact is first reduced to one row per (keys, month) by a partial
aggregate, so each series is at most a few hundred monthly points however
many rows feed it; the per-series work then runs on those short series.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions import money_sum
from marketlens.operators import trend
from marketlens.session import ship_package

HISTORY_ROWS = 24


def _month_step():
    return F.make_ym_interval(F.lit(0), F.lit(1))


def _series_maps(fact: DataFrame, keys: list[str]) -> DataFrame:
    """One row per series: first/last month and a month -> revenue map.

    Per-(series, month) partial aggregation first, then one grouping by the
    series keys; the map holds at most one entry per month."""
    present = fact.filter(F.col("month").isNotNull())
    for k in keys:
        present = present.filter(F.col(k).isNotNull())
    monthly = present.groupBy(*keys, F.col("month").alias("ds")).agg(money_sum(F.col("revenue")).alias("y"))
    return monthly.groupBy(*keys).agg(
        F.min("ds").alias("first"),
        F.max("ds").alias("last"),
        F.map_from_entries(F.collect_list(F.struct("ds", "y"))).alias("by_month"),
    )


def _calendar_values(ds: Column) -> Column:
    return F.coalesce(F.try_element_at(F.col("by_month"), ds), F.lit(0.0))


def monthly_revenue_series(fact: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A-18: calendar-month revenue per series from its first to last month,
    empty months as 0 (columns: keys..., ds, y)."""
    keys = list(keys)
    maps = _series_maps(fact, keys)
    rows = maps.select(*keys, "by_month", F.explode(F.sequence("first", "last", _month_step())).alias("ds"))
    return rows.select(*keys, "ds", _calendar_values(F.col("ds")).alias("y"))


def _series_arrays(fact: DataFrame, keys: list[str], min_points: int) -> DataFrame:
    maps = _series_maps(fact, keys).withColumn("ds_arr", F.sequence("first", "last", _month_step()))
    return maps.filter(F.size("ds_arr") >= min_points).select(
        *keys, "ds_arr", F.transform("ds_arr", _calendar_values).alias("y_arr")
    )


def ewma_array(y: Column, alpha: float) -> Column:
    """W-05: exponentially weighted mean without bias adjustment over an
    ordered array: s0 = y0, s_t = alpha*y_t + (1-alpha)*s_{t-1}."""
    return F.aggregate(
        F.slice(y, 2, F.size(y) - 1),
        F.array(F.element_at(y, 1)),
        lambda acc, x: F.concat(acc, F.array(F.lit(alpha) * x + F.lit(1.0 - alpha) * F.element_at(acc, -1))),
    )


def _sample_std(arr: Column) -> Column:
    n = F.size(arr)
    mean = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x) / n
    ss = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
    return F.when(n > 1, F.sqrt(ss / (n - 1)))


def forecast_ewma(fact: DataFrame, keys: Sequence[str] = (), periods: int = 1, span: int = 4,
                  history: int = HISTORY_ROWS) -> DataFrame:
    """M-08: smoothing forecast per series with at least 3 months.

    Output (keys..., ds, actual, yhat, yhat_lower, yhat_upper): the last
    ``history`` months with their smoothed value and ``periods`` future
    months carrying the last smoothed value (``actual`` NULL). The band is
    +/-1.96 x std of residuals, else std of y, else 0.
    """
    keys = list(keys)
    alpha = 2.0 / (span + 1.0)
    arrays = _series_arrays(fact, keys, 3)
    y, ds = F.col("y_arr"), F.col("ds_arr")
    arrays = arrays.withColumn("yhat_arr", ewma_array(y, alpha))
    resid_std = _sample_std(F.zip_with(y, F.col("yhat_arr"), lambda a, b: a - b))
    y_std = _sample_std(y)
    band = (
        F.when(F.coalesce(resid_std, F.lit(0.0)) != 0, resid_std)
        .when(F.coalesce(y_std, F.lit(0.0)) != 0, y_std)
        .otherwise(F.lit(0.0))
    )
    arrays = arrays.withColumn("band", F.lit(1.96) * band)
    n = F.size(y)
    start = F.greatest(n - history + 1, F.lit(1))
    hist = F.slice(
        F.arrays_zip(ds.alias("ds"), y.alias("actual"), F.col("yhat_arr").alias("yhat")), start, F.least(n, F.lit(history))
    )
    last_ds, last_hat = F.element_at(ds, -1), F.element_at(F.col("yhat_arr"), -1)
    future = F.transform(
        F.sequence(F.lit(1), F.lit(periods)),
        lambda i: F.struct(
            F.add_months(last_ds, i).cast("timestamp_ntz").alias("ds"),
            F.lit(None).cast("double").alias("actual"),
            last_hat.alias("yhat"),
        ),
    )
    rows = arrays.select(*keys, "band", F.explode(F.concat(hist, future)).alias("r"))
    yhat = F.col("r.yhat")
    return rows.select(
        *keys,
        F.col("r.ds").alias("ds"),
        F.col("r.actual").alias("actual"),
        yhat.alias("yhat"),
        (yhat - F.col("band")).alias("yhat_lower"),
        (yhat + F.col("band")).alias("yhat_upper"),
    ).orderBy(*keys, "ds")


def forecast_methods(fact: DataFrame, keys: Sequence[str] = (), least: int = 3) -> DataFrame:
    """M-08: (keys..., months, method) of every series: smoothing, or no forecast for fewer than ``least`` months."""
    series = monthly_revenue_series(fact, keys)
    counted = (series.groupBy(*keys) if keys else series).agg(F.count(F.lit(1)).alias("months"))
    return counted.withColumn("method", F.when(F.col("months") >= least, "Exponential smoothing fallback").otherwise("Insufficient history"))


# --- M-09: seasonal model -------------------------------------------------


def _trend_udf():
    """(months, first calendar month, periods) -> fitted and future values with their standard deviations, one series a row."""

    @F.pandas_udf("yhat array<double>, sd array<double>")
    def model(y: pd.Series, first: pd.Series, periods: pd.Series) -> pd.DataFrame:
        fits = [trend.fit(np.asarray(own, dtype=float), int(m), int(p)) for own, m, p in zip(y, first, periods, strict=True)]
        return pd.DataFrame({"yhat": [f.yhat for f in fits], "sd": [f.sd for f in fits]})

    return model


def _spread(arrays: DataFrame) -> DataFrame:
    """One task slot per shuffle partition: rows are small, what is done with each is not."""
    return arrays.repartition(int(arrays.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def forecast_seasonal(fact: DataFrame, keys: Sequence[str] = (), periods: int = 1, history: int = HISTORY_ROWS, z: float = 1.2816) -> DataFrame:
    """M-09: forecast per series with at least 3 months from a piecewise-linear
    trend and yearly seasonality (``operators.trend``), 80% band.

    A series is one row with its monthly values (hundreds, never raw facts);
    the rows are spread over the tasks that fit them."""
    keys = list(keys)
    ship_package(fact.sparkSession)
    arrays = _spread(_series_arrays(fact, keys, 3))
    fitted = arrays.withColumn("fit", _trend_udf()("y_arr", F.month(F.element_at("ds_arr", 1)), F.lit(periods)))
    steps = F.sequence(F.lit(1), F.lit(periods))
    last = F.element_at("ds_arr", -1)
    ahead = F.transform(steps, lambda i: F.add_months(last, i).cast("timestamp_ntz"))
    none = F.transform(steps, lambda i: F.lit(None).cast("double"))
    rows = F.arrays_zip(F.concat("ds_arr", ahead).alias("ds"), F.concat("y_arr", none).alias("actual"), F.col("fit.yhat").alias("yhat"), F.col("fit.sd").alias("sd"))
    kept = F.least(F.size(rows), F.lit(history + periods))
    out = fitted.select(*keys, F.explode(F.slice(rows, F.size(rows) - kept + 1, kept)).alias("r"))
    yhat, band = F.col("r.yhat"), F.lit(z) * F.col("r.sd")
    return out.select(*keys, "r.ds", "r.actual", yhat.alias("yhat"), (yhat - band).alias("yhat_lower"), (yhat + band).alias("yhat_upper")).orderBy(*keys, "ds")


# --- out-of-sample comparison ---------------------------------------------

SMOOTHING, SEASONAL = "smoothing", "seasonal"


def forecast_backtest(fact: DataFrame, keys: Sequence[str] = (), origins: int = 12, least: int = 3, span: int = 4,
                      methods: Sequence[str] = (SMOOTHING, SEASONAL)) -> DataFrame:
    """M-08 and M-09 out of sample: rolling origins with expanding windows.

    For each of the last ``origins`` months of a series that have a next month
    and at least ``least`` months of history, every method sees the months up
    to the origin and forecasts the next one: (keys..., origin, method, yhat,
    actual, error), error = actual - yhat."""
    keys = list(keys)
    arrays = _series_arrays(fact, keys, least + 1)
    n = F.size("y_arr")
    seen = arrays.select("*", F.explode(F.sequence(F.greatest(n - origins, F.lit(least)), n - 1)).alias("seen"))
    rows = seen.select(
        *keys, F.element_at("ds_arr", F.col("seen")).alias("origin"), F.month(F.element_at("ds_arr", 1)).alias("first"),
        F.slice("y_arr", 1, F.col("seen")).alias("known"), F.element_at("y_arr", F.col("seen") + 1).alias("actual"))
    columns = {}
    if SMOOTHING in methods:
        columns[SMOOTHING] = F.element_at(ewma_array(F.col("known"), 2.0 / (span + 1.0)), -1)
    if SEASONAL in methods:
        ship_package(fact.sparkSession)
        rows = _spread(rows)
        columns[SEASONAL] = F.element_at(_trend_udf()("known", "first", F.lit(1))["yhat"], -1)
    guesses = F.map_from_arrays(F.array(*[F.lit(m) for m in columns]), F.array(*columns.values()))
    return rows.select(*keys, "origin", "actual", F.explode(guesses).alias("method", "yhat")).select(
        *keys, "origin", "method", "yhat", "actual", (F.col("actual") - F.col("yhat")).alias("error"))


def forecast_accuracy(backtest: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., method, origins, mae, rmse, preferred): errors per series and method; of a series the method with the
    smallest mean absolute error is preferred (ties: the first by name)."""
    keys = list(keys)
    error = F.col("error")
    rated = backtest.groupBy(*keys, "method").agg(
        F.count(error).alias("origins"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"))
    return rated.withColumn("preferred", F.row_number().over(Window.partitionBy(*keys).orderBy("mae", "method")) == 1)
