"""Raw marketplace tables (S-01, S-02).

CSV is read with every column as text under the names of its header (no
inference pass): columns may come in any order, further ones are ignored,
missing ones are NULL. Null tokens are turned into NULL afterwards, because the CSV reader takes
a single ``nullValue``. Typed coercion happens in the star builder, so a
Parquet/typed source with the same column names goes through the same code.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions import null_tokens_to_null
from marketlens.schemas import RAW_FILES, RAW_SCHEMAS
from marketlens.session import size_shuffles
from marketlens.sources import storage

# Reviews carry free-text comments with embedded newlines.
_MULTILINE = {"reviews"}


def read_raw_csv(spark: SparkSession, data_dir: str, name: str, file_name: str | None = None) -> DataFrame:
    """Read one raw CSV table; a missing file raises ``FileNotFoundError``."""
    path = f"{data_dir.rstrip('/')}/{file_name or RAW_FILES[name]}"
    reader = (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("multiLine", name in _MULTILINE)
        .option("enforceSchema", False)
    )
    try:
        df = reader.csv(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            raise FileNotFoundError(f"Missing required CSV: {path}") from exc
        raise
    return df.select([
        (null_tokens_to_null(F.col(c)) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in RAW_SCHEMAS[name].fieldNames()
    ])


def load_raw(spark: SparkSession, data_dir: str, fmt: str = "csv", files: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Load the six raw tables from ``data_dir`` as CSV or Parquet."""
    files = files or RAW_FILES
    size_shuffles(spark, storage.total_bytes(spark, data_dir))
    if fmt == "csv":
        return {name: read_raw_csv(spark, data_dir, name, files[name]) for name in RAW_FILES}
    if fmt == "parquet":
        out = {}
        for name in RAW_FILES:
            path = f"{data_dir.rstrip('/')}/{name}.parquet"
            try:
                out[name] = spark.read.parquet(path)
            except AnalysisException as exc:
                raise FileNotFoundError(f"Missing required table: {path}") from exc
        return out
    raise ValueError(f"unsupported raw format: {fmt}")
