"""Prepared fact and dashboard filters (C-10, F-01..F-08)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions import month_start, to_double, to_timestamp_ntz
from marketlens.schemas import DATE_COLUMN, ORDER_TIMESTAMPS, UNKNOWN_CATEGORY, UNKNOWN_STATE

_MEASURES = ["price", "freight_value", "revenue", "review_score", "delivery_days"]


def prepare_fact(fact: DataFrame) -> DataFrame:
    """C-10: re-coerce types, default revenue/category/state, add ``month`` and
    ``order_date``, drop rows without a purchase timestamp.

    Tolerant of a fact read from elsewhere: absent optional columns are
    skipped or defaulted.
    """
    types = {f.name: f.dataType for f in fact.schema.fields}
    cols = {}
    for c in ORDER_TIMESTAMPS:
        if c in types:
            cols[c] = to_timestamp_ntz(F.col(c), types[c])
    for c in _MEASURES:
        if c in types:
            cols[c] = to_double(F.col(c), types[c])
    if "revenue" in types:
        revenue = cols["revenue"]
    else:
        revenue = cols.get("price", F.lit(0.0)) + cols.get("freight_value", F.lit(0.0))
    cols["revenue"] = F.coalesce(revenue, F.lit(0.0))
    cols["product_category"] = F.coalesce(
        F.col("product_category") if "product_category" in types else F.lit(None).cast("string"), F.lit(UNKNOWN_CATEGORY)
    )
    cols["customer_state"] = F.coalesce(
        F.col("customer_state") if "customer_state" in types else F.lit(None).cast("string"), F.lit(UNKNOWN_STATE)
    )
    data = fact.withColumns(cols)
    ts = F.col(DATE_COLUMN)
    # F-05: rows without a purchase date are dropped
    return data.withColumns({"month": month_start(ts), "order_date": F.to_date(ts)}).filter(ts.isNotNull())


def _day(value) -> dt.datetime | None:
    if value is None:
        return None
    if isinstance(value, str):
        value = dt.date.fromisoformat(value[:10])
    if isinstance(value, dt.datetime):
        value = value.date()
    return dt.datetime(value.year, value.month, value.day)


def date_predicate(start=None, end=None, column: str = DATE_COLUMN):
    """F-01 as a sargable range: ``start.date <= ts.date <= end.date`` becomes
    ``ts >= start_day AND ts < end_day + 1``, which Parquet can push down.
    F-08: a missing bound means no predicate on that side."""
    ts = F.col(column)
    cond = F.lit(True)
    s, e = _day(start), _day(end)
    if s is not None:
        cond = cond & (ts >= F.lit(s).cast("timestamp_ntz"))
    if e is not None:
        cond = cond & (ts < F.lit(e + dt.timedelta(days=1)).cast("timestamp_ntz"))
    return cond


def apply_filters(fact: DataFrame, start=None, end=None, category: str = "All", state: str = "All") -> DataFrame:
    """F-04 = F-01 and F-02 and F-03 (``"All"`` disables a control)."""
    out = fact
    if start is not None or end is not None:
        out = out.filter(date_predicate(start, end))
    if category not in (None, "All"):
        out = out.filter(F.col("product_category") == F.lit(category))
    if state not in (None, "All"):
        out = out.filter(F.col("customer_state") == F.lit(state))
    return out


def filter_domains(fact: DataFrame) -> DataFrame:
    """F-07: the control domains in long form, (control, value) rows: the
    distinct categories and states plus the min/max purchase date.

    The values are distinct pairs (partial aggregation first), the dates one
    more aggregate; no task sees all values."""
    ts = F.col(DATE_COLUMN)
    pair = lambda control, column: F.struct(F.lit(control).alias("control"), F.col(column).cast("string").alias("value"))
    values = fact.select(F.explode(F.array(pair("category", "product_category"), pair("state", "customer_state"))).alias("r")).select("r.*").distinct()
    bound = lambda name, day: F.struct(F.lit(name).alias("control"), F.date_format(day.cast("date"), "yyyy-MM-dd").alias("value"))
    dates = fact.agg(F.array(bound("min_date", F.min(ts)), bound("max_date", F.max(ts))).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    return values.unionByName(dates).filter(F.col("value").isNotNull())
