"""The value store: parquet partitioned by folder and node."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(values: DataFrame, path: str) -> None:
    """values(folder, node, value_id, run_id, idx, data): ids are kept."""
    values.write.partitionBy("folder", "node").mode("append").parquet(path)


def overwrite(values: DataFrame, path: str) -> None:
    """Replaces the folders and nodes that values has, and leaves the others: repeating it changes nothing."""
    values.write.partitionBy("folder", "node").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def of_node(values: DataFrame, node: str) -> DataFrame:
    """The values of a node; in a store only its partition is read."""
    return values.filter(F.col("node") == node)


def by_id(values: DataFrame, value_id: int) -> DataFrame:
    return values.filter(F.col("value_id") == value_id)


def by_path(values: DataFrame, path: str) -> DataFrame:
    return values.filter(F.col("path") == path)
