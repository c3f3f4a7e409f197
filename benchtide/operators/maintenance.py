"""Maintenance of value tables: which values are ephemeral, clearing them, what to recompute."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import reached

#: The kinds of nodes that watch series.
ANALYSIS = ("ft", "rd", "sd", "ed")


def is_detection(kind: str = "type"):
    return F.col(kind).isin(*ANALYSIS)


def ephemeral(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(node_id, type, mode) with a flag: DISCARD always, AUTO with a child that is no analysis, KEEP never; never roots, analyses, or sources of analyses."""
    kids = edges.select(F.col("parent_id").alias("node_id"), F.col("child_id").alias("kid")).join(nodes.select(F.col("node_id").alias("kid"), F.col("type").alias("kid_type")), "kid")
    kids = kids.groupBy("node_id").agg(F.bool_or(is_detection("kid_type")).alias("watched"), F.bool_or(~is_detection("kid_type")).alias("used"))
    flag = ((F.col("mode") == "DISCARD") | (F.col("mode") == "AUTO") & F.coalesce("used", F.lit(False))) & (F.col("type") != "root") & ~is_detection() & ~F.coalesce("watched", F.lit(False))
    return nodes.join(kids, "node_id", "left").select(*nodes.columns, flag.alias("ephemeral"))


def cleared(values: DataFrame, flagged: DataFrame) -> DataFrame:
    """values(node_id, data, ...) without the data of ephemeral nodes; rows stay."""
    flags = flagged.filter("ephemeral").select("node_id", F.lit(True).alias("_e"))
    return values.join(flags, "node_id", "left").withColumn("data", F.when(F.col("_e").isNull(), F.col("data"))).drop("_e")


def modes(nodes: DataFrame, viewed: DataFrame | None = None, discard: DataFrame | None = None) -> DataFrame:
    """AUTO nodes that views show become KEEP, those to discard DISCARD; other modes stay."""
    out = nodes
    for ids, mode in ((viewed, "KEEP"), (discard, "DISCARD")):
        if ids is not None:
            out = out.join(ids.select("node_id", F.lit(True).alias("_m")).distinct(), "node_id", "left").withColumn("mode", F.when(F.col("_m") & (F.col("mode") == "AUTO"), mode).otherwise(F.col("mode"))).drop("_m")
    return out


def to_recompute(edges: DataFrame, target: DataFrame, flagged: DataFrame) -> DataFrame:
    """(id) of the ephemeral sources, near and far, that a recalculation of target(id) needs first."""
    return reached(edges, target, up=True).join(flagged.filter("ephemeral").select(F.col("node_id").alias("id")), "id", "left_semi")


def without_folder(df: DataFrame, *folders: str, column: str = "folder") -> DataFrame:
    """What is left when folders are deleted."""
    return df.filter(~F.coalesce(F.col(column).isin(*folders), F.lit(False)))


def renamed(nodes: DataFrame, old: str, new: str) -> DataFrame:
    """A node under a new name; its id, and so its values, stay."""
    return nodes.withColumn("name", F.when(F.col("name") == old, new).otherwise(F.col("name")))
