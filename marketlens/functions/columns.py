"""Type coercion, measures and bucketing as built-in Column expressions.

Everything here stays inside whole-stage codegen: no Python UDFs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.schemas import NULL_TOKENS, SENTIMENT_BINS, TIMESTAMP_TEXT



def null_tokens_to_null(col: Column) -> Column:
    """Text null tokens (``NA``, ``N/A``, ``null``, ``None``, empty, ...) -> NULL."""
    return F.when(~col.isin(NULL_TOKENS), col)


def to_double(col: Column, dtype: T.DataType | None = None) -> Column:
    """Coerce to double; unparsable text and NaN become NULL."""
    if isinstance(dtype, T.DoubleType):
        casted = col
    elif isinstance(dtype, T.StringType) or dtype is None:
        casted = F.trim(col.cast("string")).try_cast("double")
    else:
        casted = col.try_cast("double")
    return F.nanvl(casted, F.lit(None).cast("double"))


def _whole(col: Column, kind: str) -> Column:
    """Text as a whole number; ``1.0`` is 1, ``1.5`` is NULL."""
    text = F.trim(col.cast("string"))
    real = text.try_cast("double")
    return F.coalesce(text.try_cast(kind), F.when(real == F.floor(real), real.try_cast(kind)))


def to_int(col: Column, dtype: T.DataType | None = None) -> Column:
    if isinstance(dtype, T.IntegerType):
        return col
    if isinstance(dtype, (T.StringType, T.NullType)) or dtype is None:
        return _whole(col, "int")
    return col.try_cast("int")


def to_long(col: Column, dtype: T.DataType | None = None) -> Column:
    if isinstance(dtype, T.LongType):
        return col
    if isinstance(dtype, (T.StringType, T.NullType)) or dtype is None:
        return _whole(col, "long")
    return col.try_cast("long")


def to_timestamp_ntz(col: Column, dtype: T.DataType | None = None) -> Column:
    """Coerce to TIMESTAMP_NTZ; unparsable text becomes NULL.

    Text is a date, or a date and a time as in the raw files; it is read as
    it stands, without any time zone.
    """
    if isinstance(dtype, T.TimestampNTZType):
        return col
    if isinstance(dtype, (T.TimestampType, T.DateType)):
        return col.cast("timestamp_ntz")
    text = F.trim(col.cast("string"))
    return F.when(text.rlike(TIMESTAMP_TEXT), text.try_cast("timestamp_ntz"))


def days_between(start: Column, end: Column) -> Column:
    """Fractional days from ``start`` to ``end`` (microsecond resolution)."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(86400e6)


def mean_days_between(start: Column, end: Column) -> Column:
    """Aggregate: mean duration in fractional days, from an exact LONG sum of
    microseconds, so the result does not depend on merge order."""
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return F.sum(micros) / F.nullif(F.count(micros), F.lit(0)) / F.lit(86400e6)


def month_start(ts: Column) -> Column:
    """First instant of the month, kept as TIMESTAMP_NTZ."""
    return F.date_trunc("month", ts).cast("timestamp_ntz")


def month_index(ts: Column) -> Column:
    """Calendar month number (year*12 + month) for month arithmetic."""
    return F.year(ts) * 12 + F.month(ts)


#: Larger amounts have no exact cents as a double.
_LARGEST_AMOUNT = 9e13


def money_parts(col: Column) -> tuple[Column, Column]:
    """An amount as whole cents (LONG) and what is left of it (DOUBLE); both add up exactly, or nearly so, in any order."""
    amount = col.cast("double")
    cents = F.when(F.abs(amount) < F.lit(_LARGEST_AMOUNT), F.rint(amount * F.lit(100.0)).cast("long")).otherwise(F.lit(0).cast("long"))
    return cents, amount - cents / F.lit(100.0)


def money_total(cents: Column, rest: Column) -> Column:
    """Sum of amounts kept as parts; 0 when empty."""
    return F.coalesce(F.sum(cents) / F.lit(100.0) + F.sum(rest), F.lit(0.0))


def money_sum(col: Column) -> Column:
    """Sum of a money column as DOUBLE; 0 when empty.

    The whole cents of each value are summed as a LONG, what is left of it
    (0 for amounts of two decimals) as a DOUBLE. So totals of plain amounts
    are exact and do not depend on the order in which partitions are merged,
    parts of a cent count, and infinite values make the total infinite.
    """
    return money_total(*money_parts(col))


def ratio_or_zero(num: Column, den: Column) -> Column:
    """``num / den``, 0 when the denominator is 0 or NULL."""
    return F.coalesce(num / F.nullif(den, F.lit(0)), F.lit(0.0))


def clip(col: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(col, F.lit(low)), F.lit(high))


def sentiment_bucket(score: Column) -> Column:
    """Review score -> negative [0,2] / neutral (2,3] / positive (3,5]; else NULL."""
    (neg, lo, b1), (neu, _, b2), (pos, _, hi) = SENTIMENT_BINS
    return (
        F.when((score >= lo) & (score <= b1), F.lit(neg))
        .when((score > b1) & (score <= b2), F.lit(neu))
        .when((score > b2) & (score <= hi), F.lit(pos))
    )
