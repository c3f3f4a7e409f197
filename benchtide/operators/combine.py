"""Combination of several multi-valued sources within a run into datasets.

Sources are frames (keys..., idx, value). First: a single value goes to the first combination only; All: to each.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _placed(source: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys)
    return source.select(*keys, (F.row_number().over(w.orderBy("idx")) - 1).alias("_pos"), F.count("*").over(w).alias(f"_n_{name}"), F.col("value").alias(name))


def by_length(sources: Mapping[str, DataFrame], keys: Sequence[str] = ("run_id",), scalar: str = "First") -> DataFrame:
    """Zipped by position up to the longest source; a shorter one leaves its place empty."""
    placed = {k: _placed(df, k, keys) for k, df in sources.items()}
    out = reduce(lambda a, b: a.join(b, [*keys, "_pos"], "full"), [p.drop(f"_n_{k}") for k, p in placed.items()])
    if scalar == "All":
        for k, p in placed.items():
            single = p.filter(F.col(f"_n_{k}") == 1).select(*keys, F.col(k).alias("_single"))
            out = out.join(single, list(keys), "left").withColumn(k, F.coalesce(F.col(k), F.col("_single"))).drop("_single")
    return out.select(*keys, F.col("_pos").cast("int").alias("idx"), *sources)


def crossed(sources: Mapping[str, DataFrame], keys: Sequence[str] = ("run_id",), scalar: str = "First") -> DataFrame:
    """All combinations of a run's values, the first source changing slowest."""
    out = None
    for k, df in sources.items():
        p = _placed(df, k, keys).withColumnRenamed("_pos", f"_p_{k}")
        out = p if out is None else out.join(p, list(keys))
    multi = [F.when(F.col(f"_n_{k}") > 1, F.col(f"_p_{k}")).otherwise(0) for k in sources]
    order = [F.col(f"_p_{k}") for k in sources]
    out = out.withColumn("idx", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    if scalar == "First":
        out = out.withColumns({k: F.when((F.col(f"_n_{k}") > 1) | (F.col("idx") == 0), F.col(k)) for k in sources})
    return out.select(*keys, F.col("idx").cast("int"), *sources, *[m.alias(f"{k}_pos") for k, m in zip(sources, multi, strict=True)])


def passed(sources: Mapping[str, DataFrame], keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Sources of one value each side by side; a missing one stays empty."""
    return reduce(lambda a, b: a.join(b, list(keys), "full"), [df.select(*keys, F.col("value").alias(k)) for k, df in sources.items()])


def slurped(*columns: str):
    """Several sources as one array, in source order."""
    return F.array(*[F.col(c) for c in columns])
