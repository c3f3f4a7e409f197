"""Pipelines: nodes as Python functions on columns, run over all documents at once."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchtide.functions.evaluate import generator, guarded


@dataclass(frozen=True)
class Node:
    """fn gives a Column from the columns of its sources; no fn is an alias. many: the Column is an array, each element is a value.

    kind: fn is a plain Python function of values instead, and this is the type of what it gives; rows on which it fails have
    null, and the error in a column `<name>_error`. With many, it yields values, each of which is a row.
    """

    name: str
    sources: Sequence[str] = ()
    fn: Callable[..., Any] | None = None
    many: bool = False
    kind: str | None = None


def is_identity(node: Node) -> bool:
    """Whether a node hands its only source on: it has no function, or one that returns the very column it is given."""
    if node.fn is None:
        return True
    if len(node.sources) != 1 or node.many or node.kind:
        return False
    given = F.col(f"`{node.sources[0]}`")
    return node.fn(given) is given


def bound(node: Node) -> Column:
    """Parameters bind to sources by name where all names match, else by place; one parameter for several sources gets a struct of them. A source is written as name or name#id; of sources with one name the first keeps it, and the others are name_id."""

    def column(source: str) -> Column:
        return F.col(f"`{source}`")

    if node.fn is None:
        return column(node.sources[0])
    names: list[str] = []
    for s in node.sources:
        plain, _, ident = s.rpartition(".")[2].partition("#")
        names.append(plain if plain not in names else f"{plain}_{ident}")
    given = dict(zip(names, node.sources, strict=True))
    wanted = [p.name for p in inspect.signature(node.fn).parameters.values() if p.kind is not p.VAR_POSITIONAL]
    if len(wanted) == 1 and len(names) > 1:
        return node.fn(F.struct(*[column(s).alias(n) for n, s in given.items()]))
    if wanted and set(wanted) <= set(names):
        return node.fn(*[column(given[w]) for w in wanted])
    return node.fn(*[column(s) for s in node.sources])


@dataclass
class Pipeline:
    nodes: list[Node] = field(default_factory=list)

    def ordered(self, given: Sequence[str]) -> list[Node]:
        """Nodes after their sources; an unknown source or a circle is an error."""
        left, done, out = list(self.nodes), set(given), []
        while left:
            ready = [n for n in left if set(n.sources) <= done]
            if not ready:
                raise ValueError(f"no order for {[n.name for n in left]}")
            out += ready
            done |= {n.name for n in ready}
            left = [n for n in left if n not in ready]
        return out

    def downstream(self, name: str) -> list[str]:
        """The node and all that depend on it."""
        found = [name]
        for n in self.ordered([s for n in self.nodes for s in n.sources if s not in {m.name for m in self.nodes}]):
            if set(n.sources) & set(found) and n.name not in found:
                found.append(n.name)
        return found

    def run(self, df: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
        """df with a column per node; nodes with many values multiply rows. only: the nodes to compute, the others being columns of df."""
        for n in self.ordered(df.columns):
            if only is None or n.name in only:
                if n.name in df.columns:
                    df = df.drop(n.name)
                df = evaluated(df, n)
        return df


def evaluated(df: DataFrame, node: Node) -> DataFrame:
    """df with a node's column."""
    if node.kind is None:
        return df.select("*", F.explode_outer(bound(node)).alias(node.name)) if node.many else df.withColumn(node.name, bound(node))
    sources = [F.col(f"`{s}`") for s in node.sources]
    if node.many:
        rows = df.lateralJoin(generator(node.fn, node.kind)(*sources), on=F.lit(True), how="left")
        return rows.withColumnRenamed("value", node.name).drop("ordinal")
    rows = df.withColumn("_evaluated", guarded(node.fn, node.kind)(*sources))
    return rows.withColumns({node.name: F.col("_evaluated.value"), f"{node.name}_error": F.col("_evaluated.error")}).drop("_evaluated")


#: Functions over a whole series, by name: each takes a DataFrame of series rows and returns one of changes.
SERIES: dict[str, Callable[..., DataFrame]] = {}


def series_function(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers a detector of one's own."""

    def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        SERIES[name] = fn
        return fn

    return add
