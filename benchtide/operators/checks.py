"""Checks of a folder's definitions: what is named but not there, what can't give values, views against the views they came from."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VIOLATION = ("check", "folder", "subject", "name")


def names(array: str) -> Column:
    """The strings of a JSON array; no array gives none."""
    return F.coalesce(F.from_json(array, "array<string>"), F.array().cast("array<string>"))


def constant(function: Column) -> Column:
    """Whether a function's text has an empty parameter list, so that it gives the same for every input."""
    return F.coalesce(function.rlike(r"^\s*\(\s*\)\s*=>"), F.lit(False))


def unresolved(references: Mapping[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """All referential constraints at once: name of the check -> (uses: folder, subject, name; what is there: folder, name). One anti join on (check, folder, name) finds what each check misses."""
    used = reduce(DataFrame.unionByName, [u.select(F.lit(k).alias("check"), "folder", "subject", "name") for k, (u, _) in references.items()])
    there = reduce(DataFrame.unionByName, [d.select(F.lit(k).alias("check"), "folder", "name") for k, (_, d) in references.items()])
    return used.join(there.distinct(), ["check", "folder", "name"], "left_anti").select(*VIOLATION).distinct()


def definition_violations(schemas: DataFrame, labels: DataFrame, extractors: DataFrame, folders: DataFrame, variables: DataFrame) -> DataFrame:
    """One row per violation: check, folder, subject, name.

    schemas: folder, schema, as its runs use them. labels: label_id, schema, name, function. extractors: label_id.
    folders: folder, fingerprint_labels (a JSON array of names). variables: folder, variable, labels (likewise).
    Checks: fingerprint_label and variable_label (named, but in none of the folder's schemas; the subject is the variable),
    constant_function (the subject is the function's first line), no_extractors.
    """
    own = schemas.select("folder", "schema").distinct().join(labels.select("label_id", "schema", "name", "function"), "schema")
    there = own.select("folder", "name")
    prints = folders.select("folder", F.lit("").alias("subject"), F.explode(names("fingerprint_labels")).alias("name"))
    read = variables.select("folder", F.col("variable").cast("string").alias("subject"), F.explode(names("labels")).alias("name"))
    first_line = F.trim(F.regexp_replace(F.left(F.col("function"), F.lit(80)), r"(?s)\n.*", ""))
    fixed = own.filter(constant(F.col("function"))).select(F.lit("constant_function").alias("check"), "folder", first_line.alias("subject"), "name")
    bare = own.join(extractors.select("label_id").distinct(), "label_id", "left_anti").select(F.lit("no_extractors").alias("check"), "folder", F.lit("").alias("subject"), "name")
    return unresolved({"fingerprint_label": (prints, there), "variable_label": (read, there)}).unionByName(fixed.unionByName(bare).distinct())


def view_states(wanted: DataFrame, views: DataFrame, ignored: tuple[str, ...] = ("Default",)) -> DataFrame:
    """Each wanted column (folder, view, header, labels: a JSON array whose first name counts) held against the columns of views (folder, view, header, node): state is ok, other_node, missing, view_missing; columns of views that nobody wanted are extra_view, but for those ignored. label and node tell what was wanted and what is there."""
    a = wanted.select("folder", "view", "header", F.coalesce(F.try_element_at(names("labels"), F.lit(1)), F.lit("")).alias("label"), F.lit(True).alias("_a"))
    b = views.select("folder", "view", "header", "node", F.lit(True).alias("_b"))
    whole = Window.partitionBy("folder", "view")
    both = a.join(b, ["folder", "view", "header"], "full").withColumns({"_wanted": F.max(F.coalesce("_a", F.lit(False))).over(whole), "_there": F.max(F.coalesce("_b", F.lit(False))).over(whole)})
    state = (
        F.when(~F.col("_wanted"), F.when(F.col("view").isin(*ignored), None).otherwise("extra_view"))
        .when(F.col("_a").isNull(), None)
        .when(~F.col("_there"), "view_missing")
        .when(F.col("_b").isNull(), "missing")
        .when((F.col("label") != "") & (F.col("label") != F.col("node")), "other_node")
        .otherwise("ok")
    )
    return both.select("folder", "view", "header", "label", "node", state.alias("state")).filter("state IS NOT NULL")


def view_rates(states: DataFrame) -> DataFrame:
    """For each folder, each of its views and all together: wanted columns, those that are there under any node, and their share. scope: all, folder or view."""
    s = states.filter("state <> 'extra_view'").withColumn("there", F.col("state").isin("ok", "other_node"))
    at = F.grouping_id()
    scope = F.when(at == 3, "all").when(at == 1, "folder").otherwise("view")
    return s.rollup("folder", "view").agg(scope.alias("scope"), F.count("*").alias("columns"), F.count_if("there").alias("matching"), F.count_if(F.col("state") == "other_node").alias("other_node"), F.round(F.avg(F.col("there").cast("double")), 6).alias("rate"))
