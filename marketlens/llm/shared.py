"""Small driver-side helpers: intermediate tables and column access."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.session import checkpoint_dir

_FREE_SHUFFLE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_STORED: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts lineage like ``checkpoint()`` does, survives the loss of executors,
    and later readers still prune columns. The folder is deleted when the
    driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREE_SHUFFLE, None)
    spark.conf.set(_FREE_SHUFFLE, "true")  # the table stands for the shuffles that made it
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_FREE_SHUFFLE) if before is None else spark.conf.set(_FREE_SHUFFLE, before)
    _STORED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _STORED:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM is gone: the folder's owner cleans up
            return


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out() -> Column:
    """Rows no classifier may learn from: crc32 of doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
