"""Exact quantiles without gathering a column or a group into one task.

Spark's exact ``percentile`` aggregate keeps a value->count map of the whole
group in one reducer; over billions of rows that is unbounded. Here a KLL
sketch per group brackets each order statistic, and one exact pass counts the
rows below the brackets and ranks the values inside them. Where a bracket
holds too many rows for that, or turns out not to hold its rank, histogram
narrowing finds the order statistic (see ``grouped_quantiles``). Medians of
several columns are one such search with the column's name as its group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.session import freed_shuffles, plain_plans, scratch_folder

#: Size of the sketches, and their rank error as a share of the rows: the 99 % bound of a KLL sketch, 2.296 / k**0.9723, three times over.
SKETCH_K = 4096
RANK_ERROR = 3 * 2.296 / SKETCH_K**0.9723
_SKETCHED = 16


def _stored(df: DataFrame) -> DataFrame:
    """A small intermediate table, written once to the shared checkpoint folder."""
    spark = df.sparkSession
    path = scratch_folder(spark, "quantiles")
    with plain_plans(spark), freed_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exact_medians(df: DataFrame, columns: list[str], **search) -> dict[str, float | None]:
    """Exact medians of the non-null, non-NaN values of ``columns`` (None without any), found in one search.

    Equal to the mean of the two middle values; ties of any size are one value."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    found = {r["c"]: r["q0"] for r in grouped_quantiles(long, "c", "v", [0.5], **search).select("c", "q0").collect()}
    return {c: found.get(c) for c in columns}


def exact_median(df: DataFrame, column: str, **search) -> float | None:
    """``exact_medians`` of one column."""
    return exact_medians(df, [column], **search)[column]


def _bucket(v, lo, hi, buckets: int):
    """Equal-width bucket of ``v`` in [lo, hi]; monotone in ``v``, so the rows
    of one bucket are exactly those between its smallest and largest value."""
    width = hi - lo
    raw = F.least(F.floor((v - lo) / width * F.lit(float(buckets))), F.lit(buckets - 1))
    inf = float("inf")
    # an infinite range (values at -inf/+inf): -inf, finite, +inf as three buckets
    unbounded = F.when(v == -inf, F.lit(0)).when(v == inf, F.lit(buckets - 1)).otherwise(F.lit(buckets // 2))
    return (F.when(width == inf, unbounded).when(width > 0, raw).otherwise(F.lit(0))).cast("int")


def grouped_quantiles(df: DataFrame, key: str, value: str, probs: list[float], buckets: int = 16384,
                      max_candidates: int = 200_000, rank_error: float = RANK_ERROR, weight: str | None = None) -> DataFrame:
    """Exact per-group quantiles with linear interpolation (pandas' default).

    Returns ``key, n, min, max, q0 .. q{len(probs)-1}`` over the non-null,
    non-NaN values; a row stands for ``weight`` (a whole number column) equal
    ones. The quantile at ``p`` is read from the order statistics
    at ranks floor(h) and ceil(h), h = (n - 1) p, interpolated by h's fraction.

    One aggregate gives count, extremes and a KLL sketch of each group (merged
    map-side, some 100 KB a group). The sketch's values at the wanted rank
    minus and plus ``rank_error`` bracket the order statistics; a group of at
    most ``max_candidates`` rows is its own bracket. The next pass
    counts each group's rows below a bracket and its values inside, and a
    window over the inside values of one bracket, at most ``max_candidates``
    expected, reads the ranks off. The error of a sketch holds with high
    probability only, so each rank is checked against the exact counts.

    Brackets that are too wide or miss go through histogram narrowing over the
    group's whole range (``_narrowed``). No group is ever held by one task,
    even when one key holds a third of the rows. The driver reads only how
    many targets are open."""
    v = F.col(value).cast("double")
    copies = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    data = df.select(F.col(key).alias("_k"), v.alias("_v"), copies.alias("_w")).filter(
        F.col("_k").isNotNull() & F.col("_v").isNotNull() & ~F.isnan("_v") & (F.col("_w") > 0)
    )
    h = [(F.col("n") - 1).cast("double") * F.lit(float(p)) for p in probs]
    if weight is None:
        sketched, rows = data, F.count(F.lit(1))
    else:  # the sketch takes a row a few times at most; heavier ones may miss their bracket, which is found out below
        sketched = data.select("*", F.explode(F.sequence(F.lit(1), F.least("_w", F.lit(_SKETCHED)))).alias("_i"))
        rows = F.sum(F.when(F.col("_i") == 1, F.col("_w")))
    stats = sketched.groupBy("_k").agg(
        rows.alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.kll_sketch_agg_double("_v", SKETCH_K).alias("_sketch"))
    whole = F.col("n") <= max_candidates  # few rows: the bracket is the group's range
    bracket = []
    for i, p in enumerate(probs):
        for side, rank, end in (("lo", p - rank_error, "min"), ("hi", p + rank_error, "max")):
            value_at = F.kll_sketch_get_quantile_double("_sketch", F.lit(float(rank))) if 0 < rank < 1 else F.col(end)
            bracket.append(F.when(whole, F.col(end)).otherwise(value_at).alias(f"_{side}{i}"))
    stats = _stored(stats.select("_k", "n", "min", "max", *bracket))
    # targets: two ranks per quantile, within the bracket of the quantile
    targets = stats.select("_k", "n", "min", "max", F.explode(F.array(*[
        F.struct(F.lit(2 * i + j).alias("t"), end(hi).cast("long").alias("rank"), F.col(f"_lo{i}").alias("lo"), F.col(f"_hi{i}").alias("hi"))
        for i, hi in enumerate(h) for j, end in enumerate((F.floor, F.ceil))])).alias("x")).select("_k", "n", "min", "max", "x.*")
    small = (F.col("n") <= max_candidates) | (F.col("n") * (2 * abs(rank_error)) <= max_candidates) | (F.col("lo") == F.col("hi"))
    brackets = targets.where(small).select(F.col("_k").alias("_rk"), "lo", "hi").distinct()
    met = data.join(brackets, (F.col("_k") == F.col("_rk")) & (F.col("_v") <= F.col("hi")))
    inside = F.when(F.col("_v") >= F.col("lo"), F.col("_v"))  # null: below the bracket
    counted = met.groupBy("_k", "lo", "hi", inside.alias("v")).agg(F.sum("_w").alias("c"))
    upto = Window.partitionBy("_k", "lo", "hi").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = counted.withColumn("cum", F.sum("c").over(upto))
    hit = targets.join(counted, ["_k", "lo", "hi"]).where(
        F.col("v").isNotNull() & (F.col("cum") - F.col("c") <= F.col("rank")) & (F.col("rank") < F.col("cum")))
    found = _stored(hit.select("_k", "t", "v"))
    open_ = targets.join(found, ["_k", "t"], "left_anti")
    with plain_plans(df.sparkSession):
        missing = open_.limit(1).count()
    if missing:
        start = open_.select("_k", "t", "rank", F.col("min").alias("lo"), F.col("max").alias("hi"), F.col("n").alias("rows"))
        found = found.unionByName(_narrowed(data, _stored(start), buckets, max_candidates))
    picked = found.groupBy("_k").agg(*[F.first(F.when(F.col("t") == t, F.col("v")), ignorenulls=True).alias(f"_o{t}")
                                       for t in range(2 * len(probs))])
    out = stats.select("_k", "n", "min", "max").join(picked, "_k", "left")
    cols = []
    for i, hi in enumerate(h):
        frac = hi - F.floor(hi)
        # a whole rank is one order statistic: 0 times an infinite neighbour is not added
        upper = F.when(frac == 0, F.lit(0.0)).otherwise(F.col(f"_o{2 * i + 1}") * frac)
        cols.append((F.col(f"_o{2 * i}") * (1 - frac) + upper).alias(f"q{i}"))
    return out.select(F.col("_k").alias(key), "n", "min", "max", *cols)


def _narrowed(data: DataFrame, open_t: DataFrame, buckets: int, max_candidates: int) -> DataFrame:
    """(_k, t, v): the values at the open targets (_k, t, rank within the range, lo, hi, rows in range) by histogram narrowing.

    Each round, one partial aggregate counts the rows of each range into
    ``buckets`` equal-width buckets, and a window over at most ``buckets``
    rows per range finds the bucket holding the rank, which becomes the next
    range. Ranges of one group are disjoint, so a row joins at most one.
    A range of more than one value always splits (its ends fall into different
    buckets), so the search ends at any size and distribution. Once a range
    holds at most ``max_candidates`` rows (or one value), its distinct values
    are ranked exactly by a window of bounded size."""
    found = []
    range_keys = ["_k", "lo", "hi"]

    def in_range(targets: DataFrame) -> DataFrame:
        # fresh column names, so joining the result back to the targets is unambiguous
        ranges = targets.select(F.col("_k").alias("_rk"), F.col("lo").alias("_rlo"), F.col("hi").alias("_rhi")).distinct()
        cond = (F.col("_k") == F.col("_rk")) & F.col("_v").between(F.col("_rlo"), F.col("_rhi"))
        return data.join(ranges, cond).select("_k", "_v", "_w", F.col("_rlo").alias("lo"), F.col("_rhi").alias("hi"))

    while True:
        is_final = (F.col("rows") <= max_candidates) | (F.col("lo") == F.col("hi"))
        final, narrow = open_t.filter(is_final), open_t.filter(~is_final)
        sizes = open_t.agg(F.count_if(is_final).alias("f"), F.count_if(~is_final).alias("o")).first()
        if sizes["f"]:
            # exact ranking of the (bounded) distinct values of each small range
            vc = in_range(final).groupBy(*range_keys, "_v").agg(F.sum("_w").alias("c"))
            w = Window.partitionBy(*range_keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            vc = vc.withColumn("cum", F.sum("c").over(w))
            hit = final.join(vc, range_keys).filter((F.col("cum") - F.col("c") <= F.col("rank")) & (F.col("rank") < F.col("cum")))
            found.append(_stored(hit.select("_k", "t", F.col("_v").alias("v"))))
        if not sizes["o"]:
            break
        hist = (
            in_range(narrow)
            .withColumn("b", _bucket(F.col("_v"), F.col("lo"), F.col("hi"), buckets))
            .groupBy(*range_keys, "b")
            .agg(F.sum("_w").alias("c"), F.min("_v").alias("bmin"), F.max("_v").alias("bmax"))
        )
        w = Window.partitionBy(*range_keys).orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hist = hist.withColumn("cum", F.sum("c").over(w))
        open_t = _stored(
            narrow.drop("rows")
            .join(hist, range_keys)
            .filter((F.col("cum") - F.col("c") <= F.col("rank")) & (F.col("rank") < F.col("cum")))
            .select("_k", "t", (F.col("rank") - (F.col("cum") - F.col("c"))).alias("rank"),
                    F.col("bmin").alias("lo"), F.col("bmax").alias("hi"), F.col("c").alias("rows"))
        )

    values = found[0]
    for part in found[1:]:
        values = values.unionByName(part)
    return values
