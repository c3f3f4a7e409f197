"""State by run, and recovery: a log of what was begun and done, held against runs, nodes and stored values.

The log has one row per (kind, folder, run_id, node) and step: kind is ingest (node is null) or recalculation (of one node in
a folder, run_id is null); state is STARTED, COMPLETED, FAILED or REMOVED. Steps are written under a batch's name, and a batch written
again replaces itself. The last state by `step` counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from benchtide.operators.lineage import saved

LOG = "kind string, folder string, run_id long, node string, state string, step long, batch string"


def note(rows: DataFrame, path: str, state: str, batch: str, step: int | Column, kind: str = "ingest") -> None:
    """Writes a state of rows(folder, run_id or node) under a batch's name. step: its place in time, the same whenever the batch is repeated."""
    own = {c: F.col(c) if c in rows.columns else F.lit(None) for c in ("folder", "run_id", "node")}
    line = rows.select(F.lit(kind).alias("kind"), own["folder"].cast("string").alias("folder"), own["run_id"].cast("long").alias("run_id"), own["node"].cast("string").alias("node"), F.lit(state).alias("state"), (step if isinstance(step, Column) else F.lit(step)).cast("long").alias("step"))
    line.distinct().withColumn("batch", F.lit(f"{batch}-{state.lower()}")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(path)


def states(entries: DataFrame) -> DataFrame:
    """kind, folder, run_id, node, state: RUNNING, COMPLETED, FAILED or REMOVED."""
    order = F.struct("step", F.when(F.col("state") == "STARTED", 0).otherwise(1).alias("late"))
    last = entries.groupBy("kind", "folder", "run_id", "node").agg(F.max_by("state", order).alias("state"))
    return last.withColumn("state", F.when(F.col("state") == "STARTED", "RUNNING").otherwise(F.col("state")))


def expected(runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """What has to be there: folder, run_id, node of every run with every node of its folder."""
    return runs.select("folder", "run_id").join(nodes.select("folder", "node").distinct(), "folder")


def missing(runs: DataFrame, nodes: DataFrame, values: DataFrame) -> DataFrame:
    """folder, run_id, node without a value."""
    return expected(runs, nodes).join(values.select("folder", "run_id", "node").distinct(), ["folder", "run_id", "node"], "left_anti")


def progress(entries: DataFrame, runs: DataFrame, nodes: DataFrame, values: DataFrame) -> DataFrame:
    """folder, run_id, state, done, total: how many nodes of each logged run have a value, of how many."""
    total = expected(runs, nodes).groupBy("folder", "run_id").agg(F.count("*").alias("total"))
    done = values.select("folder", "run_id", "node").distinct().groupBy("folder", "run_id").agg(F.count("*").alias("done"))
    out = states(entries).filter("kind = 'ingest'").join(total, ["folder", "run_id"], "left").join(done, ["folder", "run_id"], "left")
    return out.select("folder", "run_id", "state", F.coalesce("done", F.lit(0)).alias("done"), F.coalesce("total", F.lit(0)).alias("total"))


def recover(spark: SparkSession, path: str, runs: DataFrame, nodes: DataFrame, values: Callable[[], DataFrame], compute: Callable[[DataFrame], DataFrame], add: Callable[[DataFrame], None], batch: str, step: int) -> None:
    """Ends what was begun and not done. Entries whose run, folder or node is no longer there are removed; of the others, values that are missing are computed (from folder, run_id, node) and added, and what is there is left alone; then they are completed.

    An open recalculation computes its node for every run of its folder, whether there is a value or not.
    """
    entries = saved(states(log(spark, path)).filter("state = 'RUNNING'"))
    ingests = entries.filter("kind = 'ingest'").join(runs.select("folder", "run_id").distinct().withColumn("there", F.lit(True)), ["folder", "run_id"], "left").join(nodes.select("folder").distinct().withColumn("known", F.lit(True)), "folder", "left")
    again = entries.filter("kind = 'recalculation'").join(nodes.select("folder", "node").distinct().withColumn("there", F.lit(True)), ["folder", "node"], "left")
    good = F.coalesce(F.col("there"), F.lit(False))
    both = F.coalesce(F.col("there") & F.col("known"), F.lit(False))
    live, redo = saved(ingests.filter(both).select("folder", "run_id")), saved(again.filter(good).select("folder", "node"))
    todo = missing(live, nodes, values()).unionByName(redo.join(runs.select("folder", "run_id").distinct(), "folder").select("folder", "run_id", "node")).distinct()
    add(compute(saved(todo)))
    for kind, gone, done in (("ingest", ingests.filter(~both), live), ("recalculation", again.filter(~good), redo)):
        note(gone, path, "REMOVED", f"{batch}-{kind}", step, kind)
        note(done, path, "COMPLETED", f"{batch}-{kind}", step, kind)


def tracked(docs: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], add: Callable[[DataFrame, int], None], checkpoint: str, name: str = "stream", **trigger) -> StreamingQuery:
    """A stream of run documents (folder, run_id, ...): each micro-batch is logged as started, computed and added under its number, and logged as completed. A batch that failed runs again under its number after a restart."""

    def run(df: DataFrame, number: int) -> None:
        df = df.persist()
        try:
            note(df, path, "STARTED", f"{name}-{number}", number)
            add(compute(df), number)
            note(df, path, "COMPLETED", f"{name}-{number}", number)
        finally:
            df.unpersist()

    return docs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
