"""Pipeline specs as JSON: {folder, nodes: [{id, name, type, operation, sources}]}, and look-ups in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "folder string, nodes array<struct<id bigint, name string, type string, operation string, sources array<bigint>>>"
#: The kinds of nodes.
KINDS = ("root", "jq", "js", "nata", "split", "fp", "ft", "rd", "sd", "ed")


def nodes(specs: DataFrame) -> DataFrame:
    """folder, node_id, name, type, operation of each node; roots first, an unknown type is jq."""
    out = specs.select("folder", F.explode("nodes").alias("n")).select("folder", F.col("n.id").alias("node_id"), "n.name", F.when(F.col("n.type").isin(*KINDS), F.col("n.type")).otherwise("jq").alias("type"), "n.operation")
    return out.orderBy("folder", F.col("type") != "root", "node_id")


def edges(specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(folder, child_id, parent_id, idx of known sources; the same of sources that no node has)."""
    named = specs.select("folder", F.explode("nodes").alias("n"))
    out = named.select("folder", F.col("n.id").alias("child_id"), F.posexplode("n.sources").alias("idx", "parent_id"))
    known = named.select("folder", F.col("n.id").alias("parent_id")).distinct()
    return out.join(known, ["folder", "parent_id"], "left_semi"), out.join(known, ["folder", "parent_id"], "left_anti")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path, multiLine=True)


def export(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(folder, spec) as JSON: roots first, then by id."""
    sources = edges.groupBy("folder", F.col("child_id").alias("node_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "parent_id"))), lambda x: x["parent_id"]).alias("sources"))
    full = nodes.join(sources, ["folder", "node_id"], "left")
    item = F.struct((F.col("type") != "root").alias("_o"), F.col("node_id").alias("id"), "name", "type", "operation", F.coalesce("sources", F.array().cast("array<bigint>")).alias("sources"))
    listed = full.groupBy("folder").agg(F.sort_array(F.collect_list(item)).alias("xs"))
    return listed.select("folder", F.to_json(F.struct("folder", F.transform("xs", lambda x: x.dropFields("_o")).alias("nodes"))).alias("spec"))


def find(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Nodes by `17` (the id), `node`, `folder:node` or `parent:node` (all readings are returned), or `folder:original:node`, original being the folder in which the node was made. Other forms find nothing."""
    parts = name.split(":")
    own = nodes.filter(F.col("name") == parts[-1])
    if len(parts) == 1:
        return nodes.filter(F.col("node_id") == int(name)) if name.isascii() and name.isdigit() else own
    if len(parts) == 2:
        parents = nodes.filter(F.col("name") == parts[0]).select(F.col("node_id").alias("parent_id"))
        children = edges.join(parents, "parent_id", "left_semi").select(F.col("child_id").alias("node_id"))
        return own.filter(F.col("folder") == parts[0]).unionByName(own.join(children, "node_id", "left_semi")).distinct()
    return own.filter((F.col("folder") == parts[0]) & (F.col("original") == parts[1])) if len(parts) == 3 else own.limit(0)
