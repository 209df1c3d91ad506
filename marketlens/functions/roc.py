"""Area under the ROC curve as DataFrame aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.session import plain_plans


def area_under_roc(rows: DataFrame, score: str, label: str) -> float | None:
    """Share of (positive, negative) pairs that ``score`` puts in order, ties counting half; None without both labels.

    Rows of equal score are one row before anything is ordered, so ties that
    hold any share of the rows stay small. The distinct scores are range
    partitioned; a window within each range gives the negatives below, and the
    ranges (a row each) are added up in their order. Null scores and labels
    are left out."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.col(score).cast("double").alias("s"), F.col(label).cast("int").alias("y"))
    tied = own.groupBy("s").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    ranged = tied.repartitionByRange(parts, "s").withColumn("part", F.spark_partition_id())
    below = F.sum("neg").over(Window.partitionBy("part").orderBy("s"))
    placed = ranged.withColumn("won", F.col("pos") * (below - F.col("neg") / 2.0))
    with plain_plans(spark):
        found = placed.groupBy("part").agg(F.min("s").alias("s"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("won").alias("won")).collect()
    won, pos, neg = 0.0, 0, 0
    for r in sorted(found, key=lambda r: r["s"]):  # a row a range
        won += r["won"] + float(r["pos"]) * neg
        pos, neg = pos + r["pos"], neg + r["neg"]
    return won / (float(pos) * neg) if pos and neg else None
