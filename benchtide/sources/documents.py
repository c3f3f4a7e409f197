"""Sources of run documents: JSON files, raw uploads, a relational store, legacy schema scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchtide.functions.jsonish import parsed
from benchtide.operators.extract import paths


def json_documents(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """One run per non-hidden *.json file of a path: run_id from the file's name, created_at, data."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
    return files.select(F.xxhash64(F.col("_metadata.file_path")).alias("run_id"), F.lit(folder).alias("folder"), F.col("_metadata.file_modification_time").alias("created_at"), F.col("value").alias("data"))


def validated(df: DataFrame, data: str = "data") -> tuple[DataFrame, DataFrame]:
    """(rows with valid JSON, rows with anything else). Null is neither."""
    # the parser takes the first value and ignores what follows; inside a list and inside an object nothing may follow
    alone = F.size(F.try_variant_get(parsed(F.concat(F.lit("["), data, F.lit("]"))), "$", "array<variant>")) == 1
    ok = F.coalesce(alone & parsed(F.concat(F.lit('{"v":'), data, F.lit("}"))).isNotNull(), F.lit(False))
    return df.filter(ok), df.filter(F.col(data).isNotNull() & ~ok)


def jdbc_runs(spark: SparkSession, url: str, table: str, test_id: int, parts: int = 16, fetch: int = 5, **options: str) -> DataFrame:
    """Runs of one test that aren't trashed, read in parallel by ranges of id. The database filters them. No such run: no rows."""
    kept = f"SELECT * FROM {table} WHERE testid = {int(test_id)} AND (trashed IS NULL OR NOT trashed)"
    least, most = spark.read.jdbc(url, f"(SELECT min(id) AS a, max(id) AS b FROM ({kept}) r) q", properties=options).first()
    return spark.read.jdbc(url, f"({kept}) q", column="id", lowerBound=least or 0, upperBound=(most or 0) + 1, numPartitions=parts, properties={"fetchsize": str(fetch), **options})


def runs_of(df: DataFrame, test_id: int, test: str = "testid", trashed: str = "trashed") -> DataFrame:
    return df.filter((F.col(test) == test_id) & ~F.coalesce(F.col(trashed), F.lit(False)))


def newest_first(df: DataFrame, limit: int = 0, offset: int = 0, key: str = "id") -> DataFrame:
    """Rows by descending key; limit 0 is all."""
    out = df.orderBy(F.col(key).desc()).offset(offset)
    return out.limit(limit) if limit else out


def schema_paths(df: DataFrame, depth: int = 3, data: str = "data", keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Every path with $schema in its name, and the value there."""
    return paths(df, depth, data, keys).filter(F.col("path").contains("$schema"))
