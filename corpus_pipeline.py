"""Documents to training shards: toxicity, near-dedup, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and
returns the columns of ``docs``, the last one with ``shard`` and ``slot``.
Rows are told apart by doc_id and text, so documents without doc_id are
filtered like the others; rows equal in both are one document until mixing
repeats some of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.decontaminate import contained_items
from marketlens.llm.minhash import near_duplicates
from marketlens.llm.mixing import explode_copies, mix_sources
from marketlens.llm.sharding import assign_shards
from marketlens.llm.shared import store, table
from marketlens.llm.toxicity import fit, score


def _only(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` that are (left_semi) or are not (left_anti) among ``found`` (doc_id, text_md5)."""
    named = docs.withColumn("__md5", F.md5(F.col("text").cast("binary")))
    found = found.select(F.col("doc_id").alias("__id"), F.col("text_md5").alias("__text")).distinct()
    return named.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("__md5").eqNullSafe(F.col("__text")), how)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.7 by a model of the labelled documents."""
    rated = score(docs.withColumnsRenamed({"score": "__score", "predicted": "__predicted"}), fit(docs, table(spark, sf_dir, "labels")))
    return rated.where("predicted = 0").drop("score", "predicted").withColumnsRenamed({"__score": "score", "__predicted": "predicted"})


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at similarity 0.8: the smallest doc_id (nulls last), then text_md5."""
    kept = near_duplicates(docs, shingle=5, percent=80).where("kept")
    return _only(docs, kept, "left_semi").dropDuplicates(["doc_id", "__md5"]).drop("__md5")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark item."""
    return _only(docs, contained_items(docs, table(spark, sf_dir, "benchmark")), "left_anti").drop("__md5")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 3, 1, 2 over 150 % of the words; a document is repeated at most twice."""
    own = {c: f"__own_{c}" for c in ("size", "source_size", "target", "copies", "taken") if c in docs.columns}
    mixed = explode_copies(mix_sources(docs.withColumnsRenamed(own)))
    mixed = mixed.drop("size", "source_size", "target", "copies", "taken").withColumnsRenamed({b: a for a, b in own.items()})
    return mixed.select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard (0 to 39) and slot in it."""
    return assign_shards(docs, shards=40)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix),
    ("sharding", shard),
]

#: Classifier and hashes have no SQL; tests hold the stages against planted cases, near-dedup also against all pairs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
