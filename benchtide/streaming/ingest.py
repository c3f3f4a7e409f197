"""Continuous ingest: documents arrive as files, flow through extraction, and detectors run once per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from benchtide.operators.detect import contributing
from benchtide.sources.outbox import payloads

from .blocks import Blocks


def documents(spark: SparkSession, path: str, folder: str, files: int = 100) -> DataFrame:
    """A stream of the JSON files that come into a folder."""
    raw = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", files).load(path)
    return raw.select(F.xxhash64(F.col("_metadata.file_path")).alias("run_id"), F.lit(folder).alias("folder"), F.col("value").alias("data"))


def to_store(values: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends a stream of values to the store; after a restart it goes on where it was."""
    return values.writeStream.format("parquet").partitionBy("folder").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def detecting(values: DataFrame, stored: Callable[[], DataFrame], add: Callable[[DataFrame, int], None], detect: Callable[[DataFrame], DataFrame], emit: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Each batch is stored first; then the series to which it contributed are detected anew from the store, so late values count wherever they belong. add and emit get the batch's number and may be repeated with it after a failure."""

    def batch(df: DataFrame, number: int) -> None:
        add(df, number)
        emit(detect(contributing(stored(), df)), number)

    return values.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def detecting_blocks(values: DataFrame, blocks: Blocks, detector: Callable[[DataFrame], DataFrame], before: int, checkpoint: str, **trigger) -> StreamingQuery:
    """Each batch is merged into the blocks of its series; a detector that looks back `before` rows then runs over the blocks that it hit and the one behind each. Late values count wherever they belong, and cost what they touch."""

    def batch(df: DataFrame, number: int) -> None:
        blocks.detect(blocks.merge(df, number), number, detector, before)

    return values.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def payload_sink(changes: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """One payload per folder, run and detector of each batch, in a partition of the batch's number: a batch that is written again replaces its payloads."""
    return changes.writeStream.foreachBatch(lambda df, number: write_payloads(df, number, path)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def write_payloads(changes: DataFrame, number: int, path: str) -> None:
    payloads(changes).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def distinct(values: DataFrame, time: str, wait: str = "10 minutes", keys: tuple[str, ...] = ("folder", "content_hash")) -> DataFrame:
    """A stream without documents that came before, within the wait."""
    return values.withWatermark(time, wait).dropDuplicatesWithinWatermark(list(keys))


def in_order(df: DataFrame, time: str, path: str, files: int = 4) -> None:
    """df as `files` files, the later ones written later, each in the order of time: a stream with one file a trigger reads them in this order."""
    low, high = df.agg(F.min(time), F.max(time)).first()
    if low is None:
        df.write.mode("append").parquet(path)
        return
    step = (high - low) / files
    for k in range(files):
        t = F.col(time)
        own = (t >= F.lit(low + k * step)) & ((t < F.lit(low + (k + 1) * step)) if k + 1 < files else F.lit(True))
        df.filter(own if k else own | t.isNull()).coalesce(1).sortWithinPartitions(time).write.mode("append").parquet(path)


def progress(query: StreamingQuery) -> dict[str, object]:
    """State and counts of a stream: RUNNING, COMPLETED or FAILED."""
    done = [p["numInputRows"] for p in query.recentProgress]
    return {"state": "FAILED" if query.exception() else "RUNNING" if query.isActive else "COMPLETED", "batches": len(done), "rows": sum(done)}
