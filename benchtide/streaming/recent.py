"""Recent changes: kept as state of a stream for some minutes of event time, then only in the stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remembered(lookups: DataFrame, changes: DataFrame, minutes: int = 10, wait: str = "1 minute") -> DataFrame:
    """Streams of lookups (lookup_id, run_id, asked_at) and changes (change_id, run_id, detected_at): each lookup with the changes of its run in the last minutes before it. Both sides' watermarks bound the state: a change is forgotten once no lookup can be near enough."""
    a = lookups.withWatermark("asked_at", wait).alias("a")
    b = changes.withWatermark("detected_at", wait).alias("b")
    near = (F.col("a.asked_at") >= F.col("b.detected_at")) & (F.col("a.asked_at") < F.col("b.detected_at") + F.expr(f"INTERVAL {int(minutes)} MINUTES"))
    return a.join(b, (F.col("a.run_id") == F.col("b.run_id")) & near).select("a.lookup_id", "a.run_id", "b.change_id", F.lit("recent").alias("origin"))


def answered(lookups: DataFrame, seen: DataFrame, stored: DataFrame) -> DataFrame:
    """What each lookup is told: the remembered changes of its run where there are some, else those of the stored table up to its time."""
    rest = lookups.join(seen.select("lookup_id").distinct(), "lookup_id", "left_anti")
    back = rest.join(stored.select("run_id", "change_id", "detected_at"), "run_id").filter(F.col("detected_at") <= F.col("asked_at"))
    return seen.select("lookup_id", "run_id", "change_id", "origin").unionByName(back.select("lookup_id", "run_id", "change_id", F.lit("stored").alias("origin")))
