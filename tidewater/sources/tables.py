"""Tables kept between jobs, result files and small inline lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def save_table(df: DataFrame, path: str, partition_by: Sequence[str] = ("run_id",)) -> None:
    """Parquet, one folder per run; the runs in ``df`` replace their own folders and leave all others alone.

    The rows are written beside the table first and a run's folder is then put in place whole, so a reader finds the old
    rows of a run, for a moment none, or all the new ones. A run without rows in ``df`` keeps its old ones. Rows are
    gathered by the run before the write, in several files per run. Without any of the columns the table is replaced.
    """
    cols = [c for c in partition_by if c in df.columns]
    if not cols:
        df.write.mode("overwrite").parquet(path)
        return
    out = df.hint("rebalance", *cols).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy(*cols).parquet(path)


def load_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A saved table. ``schema`` keeps the types of the run columns, which are otherwise read off the folder names."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Result table as CSV with a header. An empty text is written as two quotes and a missing one as nothing; Spark reads both as missing."""
    df.write.mode(mode).option("header", True).csv(path)


def write_result(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Result table in place of a workbook: ``csv`` or ``parquet``."""
    if kind not in ("csv", "parquet"):
        raise ValueError(f"results are written as csv or parquet, not {kind}")
    write_csv(df, path) if kind == "csv" else df.write.mode("overwrite").parquet(path)


def lookup(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Inline table, written out in the program and so small enough to broadcast."""
    return F.broadcast(spark.createDataFrame(list(rows), schema))
