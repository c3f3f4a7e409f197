"""Changes on their way out: routing by folder, and one payload per run and detector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def routed(changes: DataFrame, configs: DataFrame) -> DataFrame:
    """Each dispatched change with each enabled config of its folder. configs: folder, channel, enabled."""
    return changes.filter("dispatch").join(configs.filter("enabled").select("folder", "channel"), "folder")


def payloads(changes: DataFrame) -> DataFrame:
    """folder, run_id, detector, n_changes, and the changes as a JSON array in the order of their ids."""
    listed = F.sort_array(F.collect_list(F.struct("change_id", "detail")))
    return changes.groupBy("folder", "run_id", "detector").agg(F.count("*").alias("n_changes"), F.to_json(listed).alias("payload"))


def recent(changes: DataFrame, now, minutes: int = 10) -> DataFrame:
    """Changes of the last minutes; the stored table is what counts."""
    return changes.filter(F.col("detected_at") > F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(minutes)} MINUTES"))
