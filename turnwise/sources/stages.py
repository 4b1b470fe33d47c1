"""Stage tables: Parquet partitioned by the fields that used to be part of a file name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

STAGE_KEYS = ["model", "dataset", "domain", "condition"]


def save_stage(
    df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] | None = None
) -> None:
    """``mode="ignore"`` leaves an existing stage alone; partition keys default to those present."""
    keys = [k for k in STAGE_KEYS if k in df.columns] if partition_by is None else list(partition_by)
    writer = df.write.mode(mode)
    (writer.partitionBy(*keys) if keys else writer).parquet(path)


def load_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
