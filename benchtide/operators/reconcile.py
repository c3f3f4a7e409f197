"""Reconciliation: two result sets against each other, upserts by path, referential checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchtide.functions.jsonish import comparable, is_stub

RESULTS = ("EXACT", "ROUNDING", "STUB", "MISMATCH", "MISSING")


def near(a: Column, b: Column) -> Column:
    """Equal within 1e-6 of the larger, or within 1e-10."""
    return (F.abs(a - b) <= 1e-6 * F.greatest(F.abs(a), F.abs(b))) | (F.abs(a - b) <= 1e-10)


def compared(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("run_id", "label")) -> DataFrame:
    """A row per left row with a value: EXACT if any right value of the key equals it, else ROUNDING, STUB, MISMATCH, or MISSING if there is none. Frames: keys, pos, value."""
    a = left.filter(F.col("value").isNotNull()).select(*keys, "pos", F.col("value").alias("left_value"))
    b = right.select(*keys, F.col("value").alias("right_value"))
    x, y = F.col("left_value"), F.col("right_value")
    numbers = near(x.try_cast("double"), y.try_cast("double"))
    rank = F.when(comparable(x) == comparable(y), 0).when(F.coalesce(numbers, F.lit(False)), 1).when(is_stub(x), 2).when(y.isNotNull(), 3).otherwise(4)
    best = a.join(b, list(keys), "left").groupBy(*keys, "pos").agg(F.min(rank).alias("rank"))
    return best.select(*keys, "pos", F.element_at(F.array(*map(F.lit, RESULTS)), F.col("rank") + 1).alias("result"))


def extra(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("run_id", "label")) -> DataFrame:
    """Keys that only the right side has."""
    return right.select(*keys).distinct().join(left.select(*keys), list(keys), "left_anti")


def resolved(wanted: DataFrame, known: DataFrame, name: str = "label") -> DataFrame:
    """Names as they are known: exact, with a digit 0-3 behind, with a small first letter, in snake case; the first that is known. Both sides are shuffled: Spark takes a row for each form for as small as the names, and would send them all through the driver."""
    n = F.col(name)
    small = F.concat(F.lower(n.substr(1, 1)), n.substr(F.lit(2), F.length(n)))
    snake = F.lower(F.regexp_replace(n, "([a-z0-9])([A-Z])", "$1_$2"))
    tries = wanted.select(name, F.posexplode(F.array(n, *[F.concat(n, F.lit(str(k))) for k in range(4)], small, snake)).alias("rank", "known"))
    found = tries.join(known.select(F.col(name).alias("known")).distinct().hint("merge"), "known")
    return found.groupBy(name).agg(F.min_by("known", "rank").alias("known"), F.min("rank").alias("rank"))


def upsert(stored: DataFrame, found: DataFrame, keys: Sequence[str] = ("run_id", "path")) -> DataFrame:
    """What to do with each path: keep, update, insert or delete."""
    a, b = stored.select(*keys, F.col("data").alias("old")), found.select(*keys, F.col("data").alias("data"))
    a, b = a.withColumn("_a", F.lit(True)), b.withColumn("_b", F.lit(True))
    action = F.when(F.col("_a").isNull(), "insert").when(F.col("_b").isNull(), "delete").when(F.col("old").eqNullSafe(F.col("data")), "keep").otherwise("update")
    return a.join(b, list(keys), "full").select(*keys, action.alias("action"), F.coalesce("data", "old").alias("data"))


def undefined(used: DataFrame, defined: DataFrame, name: str = "label") -> DataFrame:
    """Names that are used but not defined."""
    return used.select(name).distinct().join(defined.select(name), name, "left_anti")


def view_quality(columns: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each view column (header, node): whether its node is there under that name. nodes: node."""
    known = nodes.select("node", F.lit(True).alias("known")).distinct()
    return columns.join(known, "node", "left").select("header", "node", F.when(F.col("known"), "ok").otherwise("missing").alias("state"))
