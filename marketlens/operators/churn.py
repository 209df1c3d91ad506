"""Churn features, model, metrics and drivers (A-14, A-19, A-20, M-03..M-07,
J-06, T-05, T-06).

The model is class-balanced logistic regression with an L2 penalty of C = 1
(``operators.logistic``), fitted on the customer table (one row per customer,
checkpointed before). The holdout is stratified to the row: of each class the
customers with the smallest seeded md5 (``functions.quota``).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions import area_under_roc, exact_medians, mean_days_between, smallest
from marketlens.operators.customer import customer_aggregates
from marketlens.operators.logistic import fit_logistic, margin
from marketlens.schemas import CHURN_FEATURES, DATE_COLUMN
from marketlens.session import checkpoint_table, plain_plans


def customer_features(fact: DataFrame, churn_days: int = 120, checkpoint: bool = True) -> DataFrame:
    """A-14: RFM + mean review and delivery days (item-weighted), NULL means
    imputed with the exact median, label ``recency > churn_days``."""
    base = customer_aggregates(
        fact,
        [
            F.avg("review_score").alias("avg_review_score"),
            mean_days_between(F.col(DATE_COLUMN), F.col("order_delivered_customer_date")).alias("avg_delivery_days"),
        ],
    )
    return labelled_features(base, churn_days, checkpoint)


def labelled_features(base: DataFrame, churn_days: int = 120, checkpoint: bool = True) -> DataFrame:
    """``customer_features`` of a customer table (customer_unique_id, recency, frequency, monetary, avg_review_score, avg_delivery_days)."""
    if checkpoint:
        base = checkpoint_table(base)
    medians = exact_medians(base, ["avg_review_score", "avg_delivery_days"])

    def fill(c, med):
        x = F.col(c)
        if med is not None:
            x = F.coalesce(x, F.lit(float(med)))
        x = F.when(F.abs(x) == float("inf"), 0.0).otherwise(x)
        return F.coalesce(x, F.lit(0.0))

    return base.select(
        "customer_unique_id",
        "recency",
        "frequency",
        "monetary",
        fill("avg_review_score", medians["avg_review_score"]).alias("avg_review_score"),
        fill("avg_delivery_days", medians["avg_delivery_days"]).alias("avg_delivery_days"),
        (F.col("recency") > churn_days).cast("int").alias("churned"),
    )


def class_balance(features: DataFrame) -> DataFrame:
    """A-20: rows per label."""
    return features.groupBy("churned").agg(F.count(F.lit(1)).alias("customers"))


@dataclass
class ChurnResult:
    metrics: DataFrame      # metric, value  (F1, AUC-ROC)
    predictions: DataFrame  # features + churn_probability
    drivers: DataFrame      # feature, importance, source (top 5)
    coefficients: list[float] | None = None
    intercept: float | None = None


def _metrics(spark: SparkSession, f1: float, auc: float) -> DataFrame:
    return spark.createDataFrame([("F1", float(f1)), ("AUC-ROC", float(auc))], "metric string, value double")


def _degenerate(features: DataFrame) -> ChurnResult:
    """M-06: empty or single-class input -> zeros everywhere."""
    spark = features.sparkSession
    drivers = spark.createDataFrame(
        [(f, 0.0, "none") for f in CHURN_FEATURES], "feature string, importance double, source string"
    )
    return ChurnResult(_metrics(spark, 0.0, 0.0), features.withColumn("churn_probability", F.lit(0.0)), drivers)


def holdout_quotas(counts: dict[int, int], test_fraction: float = 0.25) -> dict[int | None, int]:
    """M-03: holdout rows per class of the given sizes; under the key None for all classes together, if one has a single row.

    ceil(test_fraction * n) rows are held out. The training rows are shared
    over the classes in proportion, remainders to the largest fractions (ties:
    the smaller label); the rest of each class is held out."""
    n = sum(counts.values())
    n_test = math.ceil(test_fraction * n)
    if min(counts.values(), default=0) < 2:
        return {None: n_test}
    share = {c: (n - n_test) * k / n for c, k in counts.items()}
    train = {c: math.floor(s) for c, s in share.items()}
    spare = n - n_test - sum(train.values())
    for c in sorted(share, key=lambda c: (train[c] - share[c], c))[:spare]:
        train[c] += 1
    return {c: k - train[c] for c, k in counts.items()}


def holdout_flag(features: DataFrame, counts: dict[int, int], seed: int = 42, test_fraction: float = 0.25) -> Column:
    """M-03: flag of the held-out rows of ``features``, whose classes have ``counts`` rows."""
    quotas = holdout_quotas(counts, test_fraction)
    group = F.col("churned") if None not in quotas else F.lit(0)
    return smallest(features, "customer_unique_id", group, {0 if c is None else c: k for c, k in quotas.items()}, seed)


def churn_split(features: DataFrame, seed: int = 42) -> DataFrame:
    """M-03: (customer_unique_id, churned, is_test) of every customer."""
    counts = {r["churned"]: r["customers"] for r in class_balance(features).collect()}
    flag = holdout_flag(features, counts, seed) if counts else F.lit(False)
    return features.select("customer_unique_id", "churned", flag.alias("is_test"))


def train_churn_model(features: DataFrame, seed: int = 42, max_steps: int = 60, importance: str = "mean_abs_shap") -> ChurnResult:
    """M-04/M-05/M-07: fit, evaluate on the holdout, score every customer.

    Passes over the customer table: one aggregate (class counts, means,
    population stds), two small ones for the holdout, one per Newton step, one
    for the holdout confusion counts and the driver importances, and one for
    the AUC. ``features`` is normally the checkpointed customer table."""
    spark, label = features.sparkSession, F.col("churned")
    with plain_plans(spark):
        stats = features.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(label).alias("pos"),
            *[F.avg(c).alias(f"m_{c}") for c in CHURN_FEATURES],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in CHURN_FEATURES],
        ).collect()[0]
    n, pos = stats["n"] or 0, stats["pos"] or 0
    if n == 0 or pos in (0, n):  # empty or a single class
        return _degenerate(features)
    counts = {0: n - pos, 1: pos}
    quotas = holdout_quotas(counts)
    flag = holdout_flag(features, counts, seed)

    # M-01 with the moments from the aggregate above (constant column -> 0)
    zcols = [f"{c}_z" for c in CHURN_FEATURES]
    scaled = {}
    for c, z in zip(CHURN_FEATURES, zcols):
        mean, std = stats[f"m_{c}"] or 0.0, stats[f"s_{c}"] or 0.0
        scaled[z] = (F.col(c).cast("double") - F.lit(mean)) / F.lit(std if std > 0 else 1.0)
    data = features.withColumns(scaled).withColumn("is_test", flag).persist(StorageLevel.MEMORY_AND_DISK)
    train = data.where(~F.col("is_test"))
    if None in quotas:
        n_train, pos_train = n - quotas[None], train.where(label == 1).count()
    else:
        n_train, pos_train = n - sum(quotas.values()), pos - quotas[1]
    if pos_train in (0, n_train):  # a class missing from the training split
        data.unpersist()
        return _degenerate(features)

    # balanced class weights over the training rows (they sum to n_train)
    w_pos = n_train / (2.0 * pos_train)
    w_neg = n_train / (2.0 * (n_train - pos_train))
    fit = fit_logistic(train.withColumn("w", F.when(label == 1, w_pos).otherwise(w_neg)), zcols, "churned", "w", max_steps=max_steps)
    scored = with_probability(data, fit.coefficients, fit.intercept)
    metrics, drivers = evaluate(scored, fit.coefficients, importance)
    data.unpersist()
    predictions = scored.select(*features.columns, "churn_probability")
    return ChurnResult(metrics, predictions, drivers, fit.coefficients, fit.intercept)


def with_probability(data: DataFrame, coef: list[float], intercept: float) -> DataFrame:
    """M-04: ``churn_probability`` from standardised ``<feature>_z`` columns, a plain expression (codegen, no vector UDF)."""
    m = margin([f"{c}_z" for c in CHURN_FEATURES], coef, intercept)
    return data.withColumn("churn_probability", F.lit(1.0) / (F.lit(1.0) + F.exp(-m)))


def evaluate(scored: DataFrame, coef: list[float], importance: str = "mean_abs_shap") -> tuple[DataFrame, DataFrame]:
    """M-05, M-07: (F1 and AUC-ROC over the rows with ``is_test``, five strongest drivers).

    ``importance``: ``mean_abs_shap``, the mean |coefficient * (x - mean x)|
    over all rows (exact for a linear model), or ``abs_coefficient``."""
    spark, label = scored.sparkSession, F.col("churned")
    zcols = [f"{c}_z" for c in CHURN_FEATURES]
    prob, test = F.col("churn_probability"), F.col("is_test")
    if importance == "mean_abs_shap":  # standardised columns have mean 0, so the background mean drops out
        strength = [F.avg(F.abs(F.lit(w) * F.col(z))) for w, z in zip(coef, zcols, strict=True)]
    elif importance == "abs_coefficient":
        strength = [F.lit(abs(w)) for w in coef]
    else:
        raise ValueError(f"unknown importance: {importance}")
    with plain_plans(spark):
        summary = scored.agg(
            F.sum((test & (prob >= 0.5) & (label == 1)).cast("long")).alias("tp"),
            F.sum((test & (prob >= 0.5) & (label == 0)).cast("long")).alias("fp"),
            F.sum((test & (prob < 0.5) & (label == 1)).cast("long")).alias("fn"),
            *[s.alias(f"imp_{z}") for s, z in zip(strength, zcols, strict=True)],
        ).collect()[0]
    tp, fp, fn = summary["tp"] or 0, summary["fp"] or 0, summary["fn"] or 0
    f1 = 2.0 * tp / (2 * tp + fp + fn) if (2 * tp + fp + fn) else 0.0
    auc = area_under_roc(scored.where(test), "churn_probability", "churned")
    rows = [(f, float(summary[f"imp_{z}"] or 0.0), importance) for f, z in zip(CHURN_FEATURES, zcols)]
    rows.sort(key=lambda r: (-r[1], r[0]))
    return _metrics(spark, f1, auc or 0.0), spark.createDataFrame(rows[:5], "feature string, importance double, source string")


def churn_by_segment(predictions: DataFrame, rfm: DataFrame) -> DataFrame:
    """J-06 + A-19: mean predicted churn (%) per RFM segment, descending."""
    # both sides have a row a customer: small as files, they would else be broadcast
    joined = predictions.select("customer_unique_id", "churn_probability").join(
        rfm.select("customer_unique_id", "segment").hint("merge"), "customer_unique_id", "left"
    )
    return (
        joined.filter(F.col("segment").isNotNull())
        .groupBy("segment")
        .agg((F.avg("churn_probability") * 100).alias("churn_probability"))
        .orderBy(F.desc("churn_probability"), F.asc("segment"))
    )


def churn_scores_top(predictions: DataFrame, rfm: DataFrame | None = None, n: int = 100) -> DataFrame:
    """T-05: top-n customers by churn percent, rounded half-even to 1 place
    *before* ordering (ties by customer id)."""
    scores = predictions.select("customer_unique_id", F.bround(F.col("churn_probability") * 100, 1).alias("churn_probability"))
    if rfm is not None:
        scores = scores.join(rfm.select("customer_unique_id", "segment").hint("merge"), "customer_unique_id", "left")
    else:
        scores = scores.withColumn("segment", F.lit(None).cast("string"))
    return scores.orderBy(F.desc("churn_probability"), F.asc("customer_unique_id")).limit(n).select(
        "customer_unique_id", "segment", "churn_probability"
    )
