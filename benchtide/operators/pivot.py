"""Pivots: the values under a node as one row or one JSON object per group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchtide.operators.lineage import closure
from benchtide.operators.series import ranked


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    array = F.to_json(F.array(text))
    return array.substr(F.lit(2), F.length(array) - 2)


def grouped(values: DataFrame, by: Sequence[str] = ("run_id",), node: str = "node", idx: str = "idx", data: str = "data") -> DataFrame:
    """One JSON object per group, {node: value, or array by ordinal}. data holds JSON texts."""
    cells = values.groupBy(*by, node).agg(F.sort_array(F.collect_list(F.struct(idx, data))).alias("xs"))
    text = F.when(F.size("xs") == 1, F.col("xs")[0][data]).otherwise(F.concat(F.lit("["), F.array_join(F.transform("xs", lambda x: x[data]), ","), F.lit("]")))
    pair = F.concat(quoted(F.col(node)), F.lit(":"), text)
    return cells.select(*by, F.col(node).alias("_n"), pair.alias("_p")).groupBy(*by).agg(F.concat(F.lit("{"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_p"))), lambda x: x["_p"]), ","), F.lit("}")).alias("row"))


def wide(values: DataFrame, nodes: Sequence[str], by: Sequence[str] = ("run_id",), node: str = "node", idx: str = "idx", value: str = "value") -> DataFrame:
    """One row per group with a column per node: an array by ordinal. No node: no rows."""
    if not nodes:
        return values.select(*by).limit(0)
    cells = values.filter(F.col(node).isin(*nodes)).groupBy(*by).pivot(node, list(nodes)).agg(F.sort_array(F.collect_list(F.struct(idx, value))))
    return cells.select(*by, *[F.transform(F.col(f"`{n}`"), lambda x: x[value]).alias(n) for n in nodes])


def single(xs):
    """The only value of an array, null for none or several."""
    return F.when(F.size(xs) == 1, xs[0])


_NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?$"


def sort_keys(values: DataFrame, sort_node: str, by: Sequence[str] = ("run_id",), node: str = "node", data: str = "data") -> DataFrame:
    """For each group the least JSON number and the least JSON text of a node; null for groups without it. data holds JSON texts, so a string of digits is no number."""
    own = F.when(F.col(node) == sort_node, F.col(data))
    return values.groupBy(*by).agg(F.min(F.when(own.rlike(_NUMBER), own.try_cast("double"))).alias("sort_number"), F.min(own).alias("sort_text"))


def sort_order() -> list[Column]:
    """Numbers ascending, then texts; groups without the node last."""
    return [F.col("sort_number").asc_nulls_last(), F.col("sort_text").asc_nulls_last()]


def grouped_under(values: DataFrame, edges: DataFrame, ancestor: str, nodes: Sequence[str], match: Mapping[str, str] | None = None, sort_node: str | None = None, group: str = "run_id", node: str = "node", data: str = "data") -> DataFrame:
    """Grouped values as a user asks for them: those of some nodes, in the groups that are an ancestor's descendants and hold the given JSON text at each node of match, ranked by a node. values has run_id, node, idx, data; group ids are ids of the edges."""
    under = closure(edges, edges.filter(F.col("parent_id") == ancestor).select(F.col("parent_id").alias("id"))).select(F.col("id").alias(group))
    own = values.join(under, group, "left_semi")
    for k, v in (match or {}).items():
        own = own.join(values.filter((F.col(node) == k) & (F.col(data) == v)).select(group), group, "left_semi")
    rows = grouped(own.filter(F.col(node).isin(*nodes)), by=(group,))
    return rows if sort_node is None else ranked(rows.join(sort_keys(own, sort_node, by=(group,)), group), *sort_order(), group)


def table_columns(names: Sequence[str]) -> list[str]:
    """Columns of a table of grouped rows: those not starting with _, sorted without regard to case."""
    return sorted({n for n in names if not n.startswith("_")}, key=lambda n: (n.lower(), n))
