"""Column expressions shared by the operators (all JVM-side built-ins)."""

from marketlens.functions.columns import (  # noqa: F401
    clip,
    days_between,
    mean_days_between,
    money_parts,
    money_sum,
    money_total,
    month_index,
    month_start,
    null_tokens_to_null,
    ratio_or_zero,
    sentiment_bucket,
    to_double,
    to_int,
    to_long,
    to_timestamp_ntz,
)
from marketlens.functions.quantiles import exact_median, exact_medians, grouped_quantiles  # noqa: F401
from marketlens.functions.quota import smallest  # noqa: F401
from marketlens.functions.roc import area_under_roc  # noqa: F401
