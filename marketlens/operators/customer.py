"""Customer value: RFM base, standardisation, K-Means segments (A-13, A-15,
A-16, M-01, M-02, W-04, W-06, J-08, T-02).

Per-customer tables are one row per customer; the K-Means input is
checkpointed to the shared checkpoint folder, so its passes re-read a short
lineage and survive executor loss without recomputing the fact aggregation.
Only fitted parameters and <= k-row cluster profiles reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from marketlens.functions import clip, days_between, money_sum
from marketlens.operators.kmeans import assign_clusters, lloyd_step, multi_start_kmeans, point_trees
from marketlens.schemas import DATE_COLUMN, SEGMENT_LABELS
from marketlens.session import checkpoint_table, plain_plans

RFM_FEATURES = ["recency", "frequency", "monetary"]


def snapshot_date(fact: DataFrame):
    """J-09 scalar subquery: latest purchase + 1 day (evaluated once, no join)."""
    return fact.agg(F.max(DATE_COLUMN) + F.make_dt_interval(F.lit(1))).scalar()


def customer_aggregates(fact: DataFrame, extra: list | None = None) -> DataFrame:
    """A-13 core: per customer last purchase, distinct orders, revenue (+ extras)."""
    snap = snapshot_date(fact)
    base = (
        fact.filter(F.col("customer_unique_id").isNotNull())
        .groupBy("customer_unique_id")
        .agg(
            F.max(DATE_COLUMN).alias("_last"),
            F.count_distinct("order_id").alias("frequency"),
            money_sum(F.col("revenue")).alias("monetary"),
            *(extra or []),
        )
    )
    recency = F.floor(days_between(F.col("_last"), snap)).cast("long")
    return base.withColumn("recency", recency).drop("_last")


def rfm_base(fact: DataFrame) -> DataFrame:
    """A-13: customer -> recency (whole days to snapshot), frequency, monetary."""
    return customer_aggregates(fact).select("customer_unique_id", "recency", "frequency", "monetary")


def standardize(df: DataFrame, columns: list[str], suffix: str = "_z") -> DataFrame:
    """M-01: zero mean, unit *population* std (constant columns -> 0).

    One aggregate gives every mean/std; they are attached as literals."""
    return standardize_with_stats(df, columns, suffix)[0]


def standardize_with_stats(df: DataFrame, columns: list[str], suffix: str = "_z"):
    """``standardize`` plus {column: (mean, std)} and the number of rows of the input."""
    with plain_plans(df.sparkSession):
        stats = df.agg(
            F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
        ).collect()[0]
    out = {}
    for c in columns:
        mean, std = stats[f"m_{c}"] or 0.0, stats[f"s_{c}"] or 0.0
        scale = std if std > 0 else 1.0
        out[f"{c}{suffix}"] = (F.col(c).cast("double") - F.lit(mean)) / F.lit(scale)
    moments = {c: (stats[f"m_{c}"] or 0.0, stats[f"s_{c}"] or 0.0) for c in columns}
    return df.withColumns(out), moments, stats["n"]


def _clean(c: str):
    x = F.col(c).cast("double")
    return F.coalesce(F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x), F.lit(0.0))


def rfm_segments(fact: DataFrame, k: int = 4, restarts: int = 20, seed: int = 42, max_iter: int = 300,
                 labels: list[str] | None = None, tol: float = 1e-4) -> DataFrame:
    """M-02: RFM + K-Means on standardised features, labelled by cluster score.

    Score = -rank(mean recency) + rank(mean frequency) + rank(mean monetary)
    over the k cluster profiles (ranks 1..k, ties in profile order); ascending
    score maps to ``labels`` (Lost < At Risk < Loyal < Champions). With fewer
    customers than k every row is cluster 0 / the last label. ``tol`` is
    relative: total squared centre shift <= tol x mean feature variance. All
    restarts advance in one pass per step (``operators.kmeans``)."""
    return segment_customers(rfm_base(fact), k, restarts, seed, max_iter, labels, tol)


def segment_customers(rfm: DataFrame, k: int = 4, restarts: int = 20, seed: int = 42, max_iter: int = 300,
                      labels: list[str] | None = None, tol: float = 1e-4) -> DataFrame:
    """``rfm_segments`` of a customer table (customer_unique_id, recency, frequency, monetary)."""
    labels = labels or SEGMENT_LABELS
    if len(labels) != k:
        raise ValueError(f"need exactly k={k} segment labels, got {len(labels)}")
    rfm = checkpoint_table(rfm.select("customer_unique_id", *RFM_FEATURES))
    clean = rfm.withColumns({c: _clean(c) for c in RFM_FEATURES})
    scaled, moments, n = standardize_with_stats(clean, RFM_FEATURES)
    if n < k:
        return rfm.withColumns({"cluster": F.lit(0), "segment": F.lit(labels[-1])})
    # scaled features have variance 1, or 0 for a constant feature
    mean_variance = sum(1.0 if std > 0 else 0.0 for _, std in moments.values()) / len(RFM_FEATURES)
    zcols = [f"{c}_z" for c in RFM_FEATURES]
    fit = multi_start_kmeans(scaled, zcols, "customer_unique_id", k, restarts, seed, max_iter, tol, mean_variance, n)
    return label_clusters(assign_clusters(scaled, zcols, fit.centers).select("customer_unique_id", *RFM_FEATURES, "cluster"), labels)


def lloyd_steps(rfm: DataFrame, centers: list[list[float]], steps: int) -> DataFrame:
    """M-02 part: (cluster, customers, <feature>_z...) after ``steps`` Lloyd steps from given centres of the standardised features.

    ``customers`` are those nearest to the centre before the last step."""
    zcols = [f"{c}_z" for c in RFM_FEATURES]
    scaled = standardize(rfm.withColumns({c: _clean(c) for c in RFM_FEATURES}), RFM_FEATURES)
    trees = point_trees(scaled, zcols, "customer_unique_id").persist(StorageLevel.MEMORY_AND_DISK)
    own = np.array([centers], dtype=float)
    for _ in range(steps):
        own, sums = lloyd_step(trees, own)
    trees.unpersist()
    rows = [(c, int(sums.count[0, c]), *map(float, own[0, c])) for c in range(len(centers))]
    return rfm.sparkSession.createDataFrame(rows, "cluster int, customers bigint, " + ", ".join(f"{z} double" for z in zcols))


def segments_by_centers(rfm: DataFrame, centers: list[list[float]], labels: list[str] | None = None) -> DataFrame:
    """M-02 with given centres of the standardised features: nearest centre, labelled by cluster score."""
    scaled = standardize(rfm.withColumns({c: _clean(c) for c in RFM_FEATURES}), RFM_FEATURES)
    assigned = assign_clusters(scaled, [f"{c}_z" for c in RFM_FEATURES], centers)
    return label_clusters(assigned.select("customer_unique_id", *RFM_FEATURES, "cluster"), labels or SEGMENT_LABELS)


def label_clusters(assigned: DataFrame, labels: list[str]) -> DataFrame:
    """A-15, W-04, J-08: ``segment`` of every row by its cluster's rank score."""
    # k-row cluster profiles ranked on the driver (fitted parameters only).
    with plain_plans(assigned.sparkSession):
        profile = assigned.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in RFM_FEATURES]).collect()
    # Spark's cluster ids are arbitrary: renumber by (monetary, frequency, recency) so ties rank stably.
    profile.sort(key=lambda r: (r["monetary"], r["frequency"], r["recency"], r["cluster"]))

    def first_rank(col):
        order = sorted(range(len(profile)), key=lambda i: (profile[i][col], i))
        ranks = [0] * len(profile)
        for r, i in enumerate(order, start=1):
            ranks[i] = r
        return ranks

    rr, fr, mr = first_rank("recency"), first_rank("frequency"), first_rank("monetary")
    scores = [(-rr[i] + fr[i] + mr[i], i) for i in range(len(profile))]
    label_of = {profile[i]["cluster"]: labels[pos] for pos, (_, i) in enumerate(sorted(scores))}
    # J-08: cluster -> label as a literal map (k entries), no join
    mapping = F.create_map(*[x for c, lab in label_of.items() for x in (F.lit(c), F.lit(lab))])
    return assigned.withColumn("segment", mapping[F.col("cluster")])


def segment_profile(rfm: DataFrame) -> DataFrame:
    """A-15: per segment (and cluster) mean recency, frequency, monetary and size."""
    return rfm.groupBy("segment", "cluster").agg(
        F.count(F.lit(1)).alias("customers"),
        *[F.avg(c).alias(f"mean_{c}") for c in RFM_FEATURES],
    )


def segment_churn_heuristic(rfm: DataFrame) -> DataFrame:
    """A-16: per segment clip(100*(0.7*r/max r + 0.3*(1 - f/max f)), 0, 100)."""
    stats = (
        rfm.filter(F.col("segment").isNotNull())
        .groupBy("segment")
        .agg(F.avg("recency").alias("recency"), F.avg("frequency").alias("frequency"))
    )
    every = Window.partitionBy()  # <= k rows: a global window is fine here
    score = (F.col("recency") / F.nullif(F.max("recency").over(every), F.lit(0))) * 0.7 + (
        1 - F.col("frequency") / F.nullif(F.max("frequency").over(every), F.lit(0))
    ) * 0.3
    return stats.select("segment", clip(score * 100, 0.0, 100.0).alias("churn_probability")).orderBy(
        F.desc("churn_probability"), F.asc("segment")
    )


def top_customers(rfm: DataFrame, n: int = 10) -> DataFrame:
    """T-02: top-n customers by lifetime value (segment kept when present)."""
    cols = ["customer_unique_id"] + (["segment"] if "segment" in rfm.columns else []) + ["recency", "frequency"]
    return (
        rfm.orderBy(F.desc("monetary"), F.asc("customer_unique_id"))
        .limit(n)
        .select(*cols, F.col("monetary").alias("lifetime_value_brl"))
    )
