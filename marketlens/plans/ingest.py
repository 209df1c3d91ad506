"""S-08: the ingest job, raw tables -> star schema -> warehouse, with a run log.

The job's contract: it never raises. Every run ends as one ``IngestResult``,
and as one row of the run log if that can be written. Readers see the star of
the last successful run until a new one is published whole.
"""

from __future__ import annotations

import datetime as dt
import logging
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from marketlens.operators.star import build_star
from marketlens.sources.raw import load_raw
from marketlens.sources.warehouse import publish_star, record_run

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class IngestResult:
    run_at: dt.datetime
    rows_per_table: dict[str, int] = field(default_factory=dict)
    error: str | None = None
    seconds: float = 0.0

    @property
    def status(self) -> str:
        return "success" if self.error is None else "failed"

    @property
    def rows_loaded(self) -> int:
        return sum(self.rows_per_table.values())

    @property
    def message(self) -> str:
        """The whole error, or the row counts by table."""
        if self.error is not None:
            return self.error
        tables = ", ".join(f"{name} {n}" for name, n in sorted(self.rows_per_table.items()))
        return f"{self.rows_loaded} rows written ({tables})"


def run_ingest(spark: SparkSession, out_dir: str, raw_dir: str | None = None, raw_format: str = "csv",
               raw: dict[str, DataFrame] | None = None) -> IngestResult:
    began, clock = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None), time.monotonic()
    rows, error = {}, None
    try:
        rows = publish_star(build_star(raw or load_raw(spark, raw_dir, raw_format)), out_dir).rows
    except Exception as exc:  # noqa: BLE001 - any failure is the run's outcome
        error = str(exc)
    result = IngestResult(began, rows, error, time.monotonic() - clock)
    _log_run(spark, out_dir, result)
    return result


def _log_run(spark: SparkSession, out_dir: str, result: IngestResult) -> None:
    try:
        record_run(spark, out_dir, result.status, result.message, result.run_at)
    except Exception:  # noqa: BLE001 - the outcome stands without its log row
        log.exception("run log of %s not written", out_dir)


def main(argv=None) -> None:
    """usage: python -m marketlens.plans.ingest --raw DIR --out DIR [--format csv|parquet]"""
    import argparse

    from marketlens.session import apply_core_conf

    ap = argparse.ArgumentParser(description="raw marketplace tables -> star-schema warehouse")
    ap.add_argument("--raw", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--format", default="csv", choices=["csv", "parquet"])
    args = ap.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    apply_core_conf(spark)
    result = run_ingest(spark, args.out, args.raw, args.format)
    print(f"{result.status}: {result.message}")


if __name__ == "__main__":
    main()
