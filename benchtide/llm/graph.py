"""Connected components of links between nodes: local contraction, then alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges that a task contracts at once.
EDGES = 1_000_000


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of all nodes of some edges: root is the least node that the edges reach."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition's edges as stars."""
    parts = [(x["a"].to_numpy(), x["b"].to_numpy()) for x in batches if x.num_rows]
    if parts:
        node, root = roots_of(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        keep = node != root
        yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(root[keep])], ["a", "b"])


def _done(edges: DataFrame) -> bool:
    """Every edge leads from a node without another edge to a root."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionAll(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not nodes.agg(F.bool_or((F.col("out") > 1) | (F.col("out") > 0) & (F.col("into") > 0))).first()[0]


def components(links: DataFrame, most: int = EDGES) -> DataFrame:
    """(node, root) for each node of links(a, b): root is the least node of its component. links is read twice.

    Tasks contract about `most` edges each to stars. While these don't agree, rounds join every node's neighbours to the
    least of them (large and small stars in turn), which halves the way to the root; no round gathers the neighbours of a
    node in one place. The edges are checkpointed after each round.
    """
    parts = max(1, -(-links.count() // most))
    edges = cut(links.select("a", "b").coalesce(parts).mapInArrow(_contract, "a long, b long"))
    while parts > 1 and not _done(edges):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        edges = cut(small)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct().coalesce(parts))
