"""Lineage: closures over edge tables (child_id, parent_id), and deletion along them."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; an own one only where it names none and all runs on this machine, as in tests."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir", "")
        if not folder and sc.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="benchtide-"))
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """df as files in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What a command shuffles goes when it has ended, and not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in a new folder of the shared one: smaller and faster than a checkpoint where there are many rows, but not dealt by anything."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.select("*").write.parquet(path, compression="zstd")  # a frame keeps the setting that it was made under
    return spark.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Takes away tables that `written` has made and that nothing will read any more."""
    for df in tables:
        spark = df.sparkSession
        for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if re.fullmatch("table-[0-9a-f]{32}", name.rpartition("/")[2]):
                path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rounds of a closure after which pairs seen before are dropped, and the growth of a round's pairs above which repeats are.
LOOK_BACK, GROWTH = 8, 8


def closure(edges: DataFrame, start: DataFrame, up: bool = False, with_start: bool = False) -> DataFrame:
    """(root, id): all that is reached from each of start(id), along the edges or up against them. The edges are saved once, and each round joins the newest pairs only.

    Repeats go at the end, in one aggregation: most graphs are shallow, and a round that drops repeats or holds its pairs against
    all before costs more than the join. But where a round's pairs are GROWTH times the last one's its repeats go at once, so
    diamonds don't multiply; and every LOOK_BACK rounds pairs that were seen before go, so loops end.
    """
    a, b = ("child_id", "parent_id") if up else ("parent_id", "child_id")
    step = written(edges.select(F.col(a).alias("id"), F.col(b).alias("next")).distinct())
    first = front = written(start.select(F.col("id").alias("root"), "id").distinct())
    parts, size, rounds = [], front.count(), 0
    while True:
        rounds += 1
        front = written(front.join(step, "id").select("root", F.col("next").alias("id")))
        n = front.count()
        if n and n > GROWTH * size:
            front = written(front.distinct())
            n = front.count()
        if n and rounds % LOOK_BACK == 0:
            seen = written(reduce(DataFrame.unionAll, [first, *parts]).distinct())
            front = written(front.distinct().join(seen, ["root", "id"], "left_anti"))
            parts, n = [seen], front.count()
        if not n:
            break
        parts.append(front)
        size = n
    if with_start or not parts:
        return reduce(DataFrame.unionAll, parts, first if with_start else first.limit(0)).distinct()
    return reduce(DataFrame.unionAll, parts).filter("root <> id").distinct()  # a loop leads back to its start


#: Roots in a bundle, and rounds after which bundles lose roots that were seen before.
BUNDLE, BUNDLE_ROUNDS = 10_000, 32


def _bundled(rows: DataFrame, most: int) -> DataFrame:
    """Rows (id, roots, n: their number) of the same id in one, each root once. An id with more than `most` roots in all its rows has several, dealt by the roots' hashes."""
    many = written(rows.groupBy("id").agg(F.sum("n").alias("_n")).filter(F.col("_n") > most).select("id", F.ceil(F.col("_n") / most).alias("_parts")))
    few = rows if many.isEmpty() else rows.join(many, "id", "left_anti")
    out = few.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("roots"))).alias("roots"))
    if few is not rows:
        pairs = rows.join(many, "id").select("id", "_parts", F.explode("roots").alias("root")).distinct()
        out = out.unionByName(pairs.groupBy("id", F.pmod(F.xxhash64("root"), "_parts")).agg(F.collect_list("root").alias("roots")).select("id", "roots"))
    return out.select("id", "roots", F.size("roots").cast("long").alias("n"))


def bundled_closure(edges: DataFrame, start: DataFrame, up: bool = False, most: int = BUNDLE) -> DataFrame:
    """(root, id) as closure finds them, for graphs in which ids are reached from many starts, on many paths.

    A row is an id with an array of those starts that reach it in so many steps, so a round moves and joins ids, and repeats
    go within arrays in each round. An array has at most `most` starts: an id with more has several rows. What a start
    reaches in several numbers of steps is brought together once, at the end, and every BUNDLE_ROUNDS rounds, which ends loops.
    """
    a, b = ("child_id", "parent_id") if up else ("parent_id", "child_id")
    step = written(edges.select(F.col(a).alias("id"), F.col(b).alias("next")).distinct())
    front = start.select("id", F.array("id").alias("roots"), F.lit(1).cast("long").alias("n")).distinct()
    parts: list[DataFrame] = []
    while True:
        front = written(_bundled(front.join(step, "id").select(F.col("next").alias("id"), "roots", "n"), most))
        if parts and len(parts) % BUNDLE_ROUNDS == 0:
            seen = written(_bundled(reduce(DataFrame.unionAll, parts), most))
            new = _pairs(front).join(_pairs(seen), ["root", "id"], "left_anti")
            front, parts = written(_bundled(new.select("id", F.array("root").alias("roots"), F.lit(1).cast("long").alias("n")), most)), [seen]
        if front.isEmpty():
            break
        parts.append(front)
    return _pairs(_bundled(reduce(DataFrame.unionAll, parts), most) if parts else front).filter("root <> id")


def _pairs(bundles: DataFrame) -> DataFrame:
    return bundles.select(F.explode("roots").alias("root"), "id")


def reached(edges: DataFrame, start: DataFrame, up: bool = False) -> DataFrame:
    """(id) of all that is reached from any of start(id), by one edge or more. From where doesn't matter, so each id goes on once, and what is stored is the ids, not their pairs."""
    a, b = ("child_id", "parent_id") if up else ("parent_id", "child_id")
    step = written(edges.select(F.col(a).alias("id"), F.col(b).alias("next")))
    parts, front = [], start.select("id")
    while True:
        new = step.join(front, "id", "left_semi").select(F.col("next").alias("id")).distinct()
        if parts:
            new = new.join(reduce(DataFrame.unionAll, parts), "id", "left_anti")
        front = written(new)
        if front.isEmpty():
            return reduce(DataFrame.unionAll, parts) if parts else front
        parts.append(front)


def children(edges: DataFrame, values: DataFrame, node: object | None = None) -> DataFrame:
    """Edges with the child's columns (value_id, node), of one node on request."""
    out = edges.join(values, edges["child_id"] == values["value_id"])
    return out if node is None else out.filter(F.col("node") == F.lit(node))


def parent_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("child_id").agg(F.countDistinct("parent_id").alias("parents"))


def with_outside_parent(edges: DataFrame, doomed: DataFrame) -> DataFrame:
    """Those of doomed(id) that have a parent which is not doomed."""
    outside = edges.join(doomed.select(F.col("id").alias("parent_id")), "parent_id", "left_anti")
    return doomed.join(outside.select(F.col("child_id").alias("id")), "id", "left_semi")


def cascade(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(id) of all that goes when start(id) goes: a child goes with its last parent. A round looks at the children of what went in the round before; of children that have lost some of their parents only how many is kept. Edges and numbers of parents are stored once, as tables."""
    edges = written(edges.select("child_id", "parent_id").distinct())
    parents = written(edges.groupBy("child_id").agg(F.count("*").alias("parents")))
    first = front = written(start.select("id").distinct())
    gone, pending = [first], None
    while True:
        hit = edges.join(front.select(F.col("id").alias("parent_id")), "parent_id").groupBy("child_id").agg(F.count("*").alias("lost"))
        if pending is not None:
            hit = pending.unionAll(hit).groupBy("child_id").agg(F.sum("lost").alias("lost"))
        both = written(hit.join(parents, "child_id"))
        front = both.filter("lost = parents").select(F.col("child_id").alias("id")).join(first, "id", "left_anti")
        if front.isEmpty():
            return reduce(DataFrame.unionAll, gone)
        gone.append(front)
        pending = both.filter("lost < parents").select("child_id", "lost")


def subtree(edges: DataFrame, start: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """(id) of start(id) and its descendants, without those that have a parent outside, and without protected ones."""
    doomed = closure(edges, start, with_start=True).select("id").distinct()
    kept = with_outside_parent(edges, doomed).join(start.select("id"), "id", "left_anti")
    out = doomed.join(kept, "id", "left_anti")
    return out if protected is None else out.join(protected.select("id"), "id", "left_anti")
