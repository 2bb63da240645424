"""Stage tables between pipeline steps, and result sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from cohortloom.operators.records import encode_nested
from cohortloom.session import settings

#: A task holds so many folders open at once; with more it sorts its rows by folder.
OPEN_FOLDERS = 4


def write_stage(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Store a stage as Parquet; nested columns stay nested. A few folders are written side by side, without a sort."""
    writer = df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by)
    with settings(df.sparkSession, {"spark.sql.maxConcurrentOutputFileWriters": OPEN_FOLDERS}):
        writer.parquet(path)


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Store results as Parquet or as CSV with a header (nested values as
    JSON text, quotes doubled)."""
    if fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    elif fmt == "csv":
        writer = encode_nested(df).write.mode("overwrite")
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        raise ValueError(f"unknown format: {fmt}")
