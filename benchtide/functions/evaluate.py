"""Python functions on values: evaluated row by row behind Arrow batches, where an error is data and not the end of the job; and generators as table functions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, UserDefinedTableFunction

#: Characters of an error's text that are kept.
ERROR = 500


def data_type(kind: str) -> DataType:
    """A type from its DDL text."""
    return StructType.fromDDL(f"value {kind}")["value"].dataType


def guarded(fn: Callable[..., Any], kind: str) -> Callable[..., Column]:
    """A column function of fn: struct(value, error) for each row. Where fn raises, or gives what is no value of the type, value is null and error says so; other rows are not affected. A result of None is no error."""
    from pyspark.sql.pandas.types import to_arrow_type

    out = to_arrow_type(data_type(kind))

    def one(args: tuple) -> tuple[Any, str | None]:
        try:
            value = fn(*args)
            return pa.scalar(value, out).as_py() if value is not None else None, None
        except Exception as e:  # noqa: BLE001  whatever a user's function raises
            return None, f"{type(e).__name__}: {e}"[:ERROR]

    @F.arrow_udf(f"struct<value: {kind}, error: string>")
    def run(*columns: pa.Array) -> pa.Array:
        rows = [one(args) for args in zip(*(c.to_pylist() for c in columns), strict=True)]
        return pa.StructArray.from_arrays([pa.array([v for v, _ in rows], out), pa.array([e for _, e in rows], pa.string())], ["value", "error"])

    return run


class _Generator:
    """Yields of a function as rows (ordinal, value). The first argument is the schema of a row as JSON, so one table function has many result types."""

    fn: Callable[..., Iterator[Any]]

    @staticmethod
    def analyze(schema: AnalyzeArgument, *sources: AnalyzeArgument) -> AnalyzeResult:
        if schema.value is None:
            raise ValueError("the schema has to be a constant")
        return AnalyzeResult(StructType.fromJson(json.loads(schema.value)))

    def eval(self, schema: str, *sources: Any) -> Iterator[tuple[int, Any]]:
        found = type(self).fn(*sources)
        if found is None:
            return
        yield from enumerate(found if hasattr(found, "__next__") else [found])


def generator(fn: Callable[..., Any], kind: str) -> Callable[..., Any]:
    """A table function of fn for DataFrame.lateralJoin: gets source columns (as they are, of the outer row), and gives a row (ordinal, value) for each value that fn yields, one for a function that returns, none for one that returns nothing."""
    made = type("Generator", (_Generator,), {"fn": staticmethod(fn)})
    table = UserDefinedTableFunction(made, returnType=None)
    schema = StructType().add("ordinal", IntegerType()).add("value", data_type(kind)).json()

    def call(*sources: Column):
        return table(F.lit(schema), *[s.outer() for s in sources])

    return call
