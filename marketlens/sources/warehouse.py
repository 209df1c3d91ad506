"""Warehouse sinks and sources (S-03..S-07).

A warehouse holds versions of the star. ``publish_star`` writes all four
tables into a folder of their own and then, as the commit, one manifest that
names the version; readers take the newest manifest and stay with its version.
So a load that fails or is still running is never seen, and a reader that
opened a version goes on with it while the next one is written. Old versions
are removed by ``expire_versions``, manifest first.

The star is stored as Parquet. The fact is partitioned by ``order_month``
(a DATE derived from the purchase timestamp at write time) so that a date
range prunes whole directories; ``read_fact`` drops that column again.
Writes use a ``rebalance`` hint: AQE evens out the write tasks (splitting a
month that holds a third of all rows, merging tiny ones), so the partitioned
write neither funnels a hot month through one task nor sprays small files.
Row counts come from ``observe`` on the write itself, not a second pass.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.operators.prepare import _day, date_predicate
from marketlens.schemas import DATE_COLUMN, PIPELINE_RUNS_SCHEMA, UNKNOWN_CATEGORY, UNKNOWN_STATE
from marketlens.session import freed_shuffles, scratch_folder, size_shuffles, slices
from marketlens.sources import storage

PARTITION_COLUMN = "order_month"


def _path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def write_star(tables: dict[str, DataFrame], out_dir: str, mode: str = "errorifexists") -> dict[str, int]:
    """Write star tables into a folder; returns rows written per table.

    The tables are written as concurrent jobs, so the small dimension writes
    use the slots the fact's stages leave free instead of queueing after it.
    A fact of a large input is written in slices of its orders, each with its
    joins, and a slice's shuffle files go before the next begins: all of them
    together take some 12 times the stored input on disk."""

    def write(name: str, df: DataFrame) -> int:
        rows = 0
        for i, part in enumerate(slices(df, "order_id") if name == "fact_orders" else [df]):
            obs, counted = Observation(f"rows_{name}_{i}"), F.count(F.lit(1)).alias("n")
            # counted above the hint: a rebalance that AQE finds empty goes with all below it
            if name == "fact_orders":
                staged = part.withColumn(PARTITION_COLUMN, F.trunc(F.col(DATE_COLUMN), "month"))
                writer = staged.hint("rebalance", PARTITION_COLUMN).observe(obs, counted).write.partitionBy(PARTITION_COLUMN)
            else:
                writer = part.hint("rebalance").observe(obs, counted).write
            writer.mode("append" if i else mode).parquet(_path(out_dir, name))
            rows += int(obs.get["n"])
        return rows

    if not tables:
        return {}
    with freed_shuffles(next(iter(tables.values())).sparkSession), ThreadPoolExecutor(max_workers=len(tables)) as pool:
        futures = {name: pool.submit(write, name, df) for name, df in tables.items()}
        return {name: f.result() for name, f in futures.items()}


@dataclass(frozen=True)
class StarVersion:
    version: str
    path: str  # folder of the version's tables
    rows: dict[str, int]
    schemas: dict[str, T.StructType]  # as stored, for reads without schema inference


_MANIFESTS, _VERSIONS = "manifests", "versions"


def publish_star(tables: dict[str, DataFrame], root: str) -> StarVersion:
    """S-05: write the star as a new version of the warehouse ``root`` and make it the current one, whole or not at all.

    A failure leaves the version before it current; what it had written is deleted."""
    spark = next(iter(tables.values())).sparkSession
    version = f"{dt.datetime.now(dt.timezone.utc):%Y%m%dT%H%M%S.%f}-{uuid.uuid4().hex[:8]}"
    path = _path(_path(root, _VERSIONS), version)
    try:
        rows = write_star(tables, path)
        schemas = stored_schemas(tables)
        manifest = {"version": version, "rows": rows, "schemas": {name: s.jsonValue() for name, s in schemas.items()}}
        storage.write_text(spark, _path(_path(root, _MANIFESTS), f"{version}.json"), json.dumps(manifest))
    except Exception:
        storage.delete(spark, path)
        raise
    return StarVersion(version, path, rows, schemas)


def star_versions(spark: SparkSession, root: str) -> list[str]:
    """Published versions, oldest first."""
    return [n.removesuffix(".json") for n in storage.names(spark, _path(root, _MANIFESTS)) if n.endswith(".json") and not n.startswith(".")]


def open_star(spark: SparkSession, root: str, version: str | None = None) -> StarVersion | None:
    """A published version, by default the newest; None if there is none."""
    known = star_versions(spark, root)
    if not known or (version is not None and version not in known):
        return None
    version = version or known[-1]
    found = json.loads(storage.read_text(spark, _path(_path(root, _MANIFESTS), f"{version}.json")))
    schemas = {name: T.StructType.fromJson(s) for name, s in found["schemas"].items()}
    return StarVersion(version, _path(_path(root, _VERSIONS), version), found["rows"], schemas)


def expire_versions(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove all but the newest ``keep`` versions, and folders older than those that no manifest names; returns what went.

    Call it when no reader of the older versions is left; a load that is still
    running writes a newer folder and is not touched."""
    if keep < 1:
        raise ValueError("the current version is kept")
    known = star_versions(spark, root)
    kept = known[-keep:]
    for version in known[:-keep]:
        storage.delete(spark, _path(_path(root, _MANIFESTS), f"{version}.json"))
    gone = [v for v in storage.names(spark, _path(root, _VERSIONS)) if kept and v < kept[0]]
    for version in gone:
        storage.delete(spark, _path(_path(root, _VERSIONS), version))
    return gone


def write_star_jdbc(tables: dict[str, DataFrame], url: str, properties: dict | None = None,
                    batchsize: int = 5000, num_partitions: int | None = None) -> None:
    """S-05 to a relational database through Spark's built-in JDBC sink:
    each table is replaced, written by the executors in parallel batches.
    (Not exercised by the tests: no database is started here.)"""
    for name, df in tables.items():
        out = df.coalesce(num_partitions) if num_partitions else df
        writer = out.write.format("jdbc").option("url", url).option("dbtable", name).option("batchsize", batchsize)
        for key, value in (properties or {}).items():
            writer = writer.option(key, value)
        writer.mode("overwrite").save()


def read_table_jdbc(spark: SparkSession, url: str, name: str, properties: dict | None = None,
                    partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
                    num_partitions: int = 64) -> DataFrame:
    """S-03 from a database: a parallel JDBC scan when a numeric partition
    column and bounds are given (one range query per partition), else one
    connection. Column pruning and simple filters are pushed to the database."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    if partition_column:
        reader = (reader.option("partitionColumn", partition_column).option("lowerBound", lower)
                  .option("upperBound", upper).option("numPartitions", num_partitions))
    for key, value in (properties or {}).items():
        reader = reader.option(key, value)
    return reader.load()


def stored_schemas(tables: dict[str, DataFrame]) -> dict[str, T.StructType]:
    """Schemas the star tables have on disk (the fact with its DATE partition
    column), for reads that skip Parquet schema inference."""
    out = {name: df.schema for name, df in tables.items()}
    if "fact_orders" in out:
        out["fact_orders"] = T.StructType(out["fact_orders"].fields + [T.StructField(PARTITION_COLUMN, T.DateType(), True)])
    return out


def _reader(spark: SparkSession, schema: T.StructType | None):
    return spark.read.schema(schema) if schema is not None else spark.read


def read_table(spark: SparkSession, warehouse_dir: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """S-03: read one stored star table (``schema``: its known stored schema)."""
    df = _reader(spark, schema).parquet(_path(warehouse_dir, name))
    return df.drop(PARTITION_COLUMN) if PARTITION_COLUMN in df.columns else df


def _equals_with_default(column: str, value: str, default: str):
    """Predicate on a stored column equivalent to ``coalesce(col, default) = value``
    but written so Parquet can push it down."""
    col = F.col(column)
    return (col.isNull() | (col == value)) if value == default else (col == value)


def read_fact(spark: SparkSession, warehouse_dir: str, start=None, end=None,
              category: str = "All", state: str = "All", schema: T.StructType | None = None) -> DataFrame:
    """S-03 with pruning: a date range also bounds ``order_month`` (partition
    pruning); date, category and state predicates are pushed to Parquet."""
    df = _reader(spark, schema).parquet(_path(warehouse_dir, "fact_orders"))
    if category not in (None, "All"):
        df = df.filter(_equals_with_default("product_category", category, UNKNOWN_CATEGORY))
    if state not in (None, "All"):
        df = df.filter(_equals_with_default("customer_state", state, UNKNOWN_STATE))
    s, e = _day(start), _day(end)
    if s is not None:
        df = df.filter(F.col(PARTITION_COLUMN) >= F.lit(dt.date(s.year, s.month, 1)))
    if e is not None:
        df = df.filter(F.col(PARTITION_COLUMN) <= F.lit(dt.date(e.year, e.month, 1)))
    if s is not None or e is not None:
        df = df.filter(date_predicate(s, e))
    return df.drop(PARTITION_COLUMN)


def table_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema  # noqa: B018 - resolves the path only
        return True
    except AnalysisException:
        return False


def load_fact(spark: SparkSession, warehouse_dir: str | None = None, raw_dir: str | None = None,
              raw_format: str = "csv", start=None, end=None, category: str = "All", state: str = "All"):
    """S-04: prepared fact from the warehouse's current version, else built from raw files.

    Returns ``(prepared_fact, freshness, source)`` where freshness is the
    latest run time recorded next to the warehouse (or ``None``). A fact built
    from raw files is written once to the shared checkpoint folder, so that
    every use reads it (with pruning) instead of joining the raw tables again.
    """
    from marketlens.operators.prepare import apply_filters, prepare_fact
    from marketlens.operators.star import build_star
    from marketlens.sources.raw import load_raw

    star = open_star(spark, warehouse_dir) if warehouse_dir else None
    if star is not None:
        size_shuffles(spark, storage.total_bytes(spark, star.path))
        fact = read_fact(spark, star.path, start, end, category, state, star.schemas["fact_orders"])
        return apply_filters(prepare_fact(fact), start, end, category, state), latest_run(spark, warehouse_dir), "warehouse"
    if raw_dir:
        tables = {"fact_orders": build_star(load_raw(spark, raw_dir, raw_format))["fact_orders"]}
        path = scratch_folder(spark, "fact")
        write_star(tables, path)
        fact = read_fact(spark, path, start, end, category, state, stored_schemas(tables)["fact_orders"])
        return apply_filters(prepare_fact(fact), start, end, category, state), None, raw_format.upper()
    raise RuntimeError("No warehouse fact table and no raw data directory given")


def record_run(spark: SparkSession, warehouse_dir: str, status: str, message: str,
               run_at: dt.datetime | None = None) -> None:
    """S-06: append one run row (UTC, naive)."""
    run_at = run_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    row = spark.createDataFrame([(run_at, status, message)], PIPELINE_RUNS_SCHEMA)
    row.coalesce(1).write.mode("append").parquet(_path(warehouse_dir, "pipeline_runs"))


def read_runs(spark: SparkSession, warehouse_dir: str) -> DataFrame | None:
    path = _path(warehouse_dir, "pipeline_runs")
    if not table_exists(spark, path):
        return None
    return spark.read.schema(PIPELINE_RUNS_SCHEMA).parquet(path)


def latest_run(spark: SparkSession, warehouse_dir: str, status: str | None = None) -> dt.datetime | None:
    """S-07: latest run time over all runs (optionally one status); None if none."""
    runs = read_runs(spark, warehouse_dir)
    if runs is None:
        return None
    if status is not None:
        runs = runs.filter(F.col("status") == status)
    return runs.agg(F.max("run_at").alias("m")).first()["m"]
