"""Extraction: a column or rows out of JSON documents. Every function takes and returns a DataFrame; keys are carried along."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchtide.functions import jsonish as J


def field(df: DataFrame, name: str, path: str, kind: str = "string", data: str = "data") -> DataFrame:
    """Adds the value at a path; a row without one gives no value."""
    return df.withColumn(name, J.at(J.parsed(F.col(data)), path, kind)).filter(F.col(name).isNotNull())


def iterate(df: DataFrame, name: str, array: Column) -> DataFrame:
    """One row per element of an array, with its ordinal as idx."""
    return df.select("*", F.posexplode(array).alias("idx", name))


def split(df: DataFrame, name: str, value: Column) -> DataFrame:
    """One row per element of a JSON array; any other JSON value is a row of its own."""
    return iterate(df, name, J.as_array(value))


def entries(df: DataFrame, value: Column, key: str = "key", item: str = "value") -> DataFrame:
    """One row per entry of a JSON object."""
    return df.select("*", F.explode(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))).alias("_e")).select("*", F.col("_e.key").alias(key), F.col("_e.value").alias(item)).drop("_e")


def generate(df: DataFrame, name: str, fn: Callable[..., Column], *sources: str) -> DataFrame:
    """A function that yields several values: each is a row with its ordinal."""
    return iterate(df, name, fn(*[F.col(s) for s in sources]))


def records(df: DataFrame, arrays: Mapping[str, Column], scalars: Sequence[str] = ()) -> DataFrame:
    """Parallel arrays as rows, with single values on each of them."""
    return df.select(*scalars, F.posexplode(J.zipped(**arrays)).alias("idx", "_r")).select(*scalars, "idx", *[F.col(f"_r.{k}").alias(k) for k in arrays])


def paths(df: DataFrame, depth: int = 3, data: str = "data", keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Every path down to a depth with the value there as JSON: leaves, and the containers at the limit. Array elements by index, odd keys quoted."""
    found = None
    level = df.select(*keys, F.lit("$").alias("path"), J.parsed(F.col(data)).alias("v"))
    for d in range(depth):
        inside = df.sparkSession.tvf.variant_explode(F.col("v").outer())
        deeper = level.lateralJoin(inside).select(*keys, F.col("path").alias("above"), "pos", "key", F.col("value").alias("v"))
        name = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("key").rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit('."'), "key", F.lit('"')))
        level = deeper.select(*keys, F.concat("above", name).alias("path"), "v")
        leaf = level if d == depth - 1 else level.filter(~J.kind_of(F.col("v")).isin("array", "object"))
        found = leaf if found is None else found.unionAll(leaf)
    return found.select(*keys, "path", F.to_json("v").alias("value"))


def structure(df: DataFrame, by: Sequence[str] = ("folder",), data: str = "data") -> DataFrame:
    """The merged type tree of all documents of a group."""
    return df.groupBy(*by).agg(F.schema_of_variant_agg(J.parsed(F.col(data))).alias("structure"))


def view(df: DataFrame, components: Sequence[tuple[str, str | None, int | None]]) -> DataFrame:
    """Chosen columns under their headers: (node, header or None for the node's name, order or None for the place in the list)."""
    placed = sorted((order if order and order > 0 else k, k, node, header or node) for k, (node, header, order) in enumerate(components))
    return df.select(*[F.col(f"`{node}`").alias(header) for _, _, node, header in placed])
