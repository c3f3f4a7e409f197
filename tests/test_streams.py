"""Blocks of series, recovery, remembered changes, online anomalies, errors as data and table functions."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from benchtide.functions.evaluate import generator, guarded
from benchtide.operators import checks, detect, reports
from benchtide.plans.catalog import QUERIES
from benchtide.plans.pipeline import Node, Pipeline
from benchtide.streaming import audit, ingest, online, recent
from benchtide.streaming.blocks import Blocks

TESTDATA = "/root/testdata/sf0.001"
SERIES = "fingerprint string, value_id long, range double, domain double"


def test_blocks_equal_the_full_run(spark, tmp_path):
    """Batches that append, come late, fall between, come again, and are written twice; after each what was found is that of a run over all values, and what was read are the blocks that were hit and their neighbours."""
    rng = np.random.default_rng(2)
    blocks, every = Blocks(str(tmp_path / "b"), 40), {}
    detector = lambda df: detect.deviation(df, window=10, deviations=1.5, min_points=5)
    batches = [
        [("a", k, float(rng.normal()), float(3 * k)) for k in range(300)] + [("b", k, float(rng.normal()), float(k)) for k in range(1000, 1007)],
        [("a", 2000 + k, float(rng.normal()), 900.0 + k) for k in range(30)],
        [("a", 3000 + k, float(rng.normal()), 301.0 + k / 10) for k in range(5)],
        [("a", 4000, 9.0, -5.0), ("b", 1003, 7.0, 1003.0), ("c", 5000, 1.0, 0.0)],
        [("a", 6000 + k, float(rng.normal()), 450.5) for k in range(100)],
    ]
    read = []
    for number, rows in enumerate(batches):
        every |= {(r[0], r[1]): r for r in rows}
        for _ in range(2 if number in (0, 2) else 1):
            touched = blocks.merge(spark.createDataFrame(rows, SERIES), number)
            read.append(blocks.detect(touched, number, detector, 10))
        stored = blocks.values(spark)
        assert {(r.fingerprint, r.value_id, r.range, r.domain) for r in stored.collect()} == set(every.values()) and stored.count() == len(every)
        assert all(n < 80 or f == "a" for f, n in blocks.index(spark).select("fingerprint", "n").collect())
        assert blocks.index(spark).agg(F.max("n")).first()[0] < 80
        want = {(r.fingerprint, r.value_id) for r in detector(spark.createDataFrame([*every.values()], SERIES)).collect()}
        got = blocks.found(spark)
        assert {(r.fingerprint, r.value_id) for r in got.collect()} == want and got.count() == len(want) > 3
    assert read[2] <= 3 * 80 and read[3] <= 3 * 80 and read[0] == 307  # of 330 and more values in the store
    before = blocks.values(spark).count()
    assert blocks.vacuum(spark) > 0 and blocks.values(spark).count() == before
    with pytest.raises(ValueError):
        blocks.detect(spark.createDataFrame([("x",)], "block string"), 9, detector, 41)


def test_a_batch_that_fills_one_block(spark, tmp_path):
    """More rows than one task should order are dealt over many; blocks come out the same."""
    blocks = Blocks(str(tmp_path / "b"), 5)
    blocks.merge(spark.createDataFrame([("a", k, 1.0, float((7 * k) % 200)) for k in range(200)], SERIES), 0)
    index = blocks.index(spark).orderBy("least").collect()
    assert [r.n for r in index] == [5] * 40 and all(a.greatest < b.least for a, b in zip(index, index[1:]))
    assert [r.next for r in index[:-1]] == [r.block for r in index[1:]]


RUN = "folder string, run_id long"


def recovered(spark, tmp_path, begun, runs, nodes, values):
    """Values and states after a recovery; begun: (folder, run_id)."""
    log, store = str(tmp_path / "log"), str(tmp_path / "values")
    audit.note(spark.createDataFrame(begun, RUN), log, "STARTED", "0", 0)
    kind = "folder string, run_id long, node string, data string"
    spark.createDataFrame(values, kind).write.parquet(store)
    asked = []

    def compute(todo):
        asked.extend((r.run_id, r.node) for r in todo.collect())
        return todo.withColumn("data", F.concat(F.lit("new "), "node"))

    audit.recover(spark, log, spark.createDataFrame(runs, RUN), spark.createDataFrame(nodes, "folder string, node string"), lambda: spark.read.schema(kind).parquet(store), compute, lambda df: df.write.mode("append").parquet(store), "r", 1)
    states = {r.run_id: r.state for r in audit.states(audit.log(spark, log)).collect()}
    return sorted((r.run_id, r.node, r.data) for r in spark.read.schema(kind).parquet(store).collect()), states, sorted(asked)


@pytest.mark.parametrize(
    ("begun", "runs", "nodes", "values", "want", "states", "asked"),
    [
        ([("f", 1)], [("f", 1)], [("f", "a")], [], [(1, "a", "new a")], {1: "COMPLETED"}, [(1, "a")]),  # an interrupted upload
        ([("f", 9)], [("f", 1)], [("f", "a")], [], [], {9: "REMOVED"}, []),  # its run is gone
        ([("g", 1)], [("f", 1)], [("f", "a")], [], [], {1: "REMOVED"}, []),  # its folder is gone
        ([("f", 1)], [("f", 1)], [("f", "a"), ("f", "b")], [("f", 1, "a", "old"), ("f", 1, "b", "old")], [(1, "a", "old"), (1, "b", "old")], {1: "COMPLETED"}, []),  # all was computed
        ([("f", 1)], [("f", 1), ("f", 2)], [("f", "a"), ("f", "b"), ("f", "c")], [("f", 1, "b", "old")], [(1, "a", "new a"), (1, "b", "old"), (1, "c", "new c")], {1: "COMPLETED"}, [(1, "a"), (1, "c")]),  # several nodes, one done
    ],
)
def test_recovery(spark, tmp_path, begun, runs, nodes, values, want, states, asked):
    assert recovered(spark, tmp_path, begun, runs, nodes, values) == (want, states, asked)


def test_lookups_remember_for_some_minutes(spark, tmp_path):
    """At one second under ten minutes a change is remembered, at ten it is stored only."""
    changes = spark.sql("SELECT 1L AS change_id, 7L AS run_id, TIMESTAMP'2024-01-01 00:00:00' AS detected_at UNION ALL SELECT 2L, 8L, TIMESTAMP'2024-01-01 00:30:00'")
    lookups = spark.sql("SELECT 1L AS lookup_id, 7L AS run_id, TIMESTAMP'2024-01-01 00:09:59' AS asked_at UNION ALL SELECT 2L, 7L, TIMESTAMP'2024-01-01 00:10:00' UNION ALL SELECT 3L, 8L, TIMESTAMP'2024-01-01 00:29:59' UNION ALL SELECT 4L, 8L, TIMESTAMP'2024-01-01 00:30:00'")
    streams = []
    for name, df, time in (("l", lookups, "asked_at"), ("c", changes, "detected_at")):
        ingest.in_order(df, time, str(tmp_path / name), 3)
        streams.append(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)))
    out = str(tmp_path / "out")
    found = recent.remembered(*streams, wait="1 hour")
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    seen = spark.read.schema(found.schema).parquet(out)
    assert sorted((r.lookup_id, r.change_id, r.origin) for r in recent.answered(lookups, seen, changes).collect()) == [(1, 1, "recent"), (2, 1, "stored"), (4, 2, "recent")]


def test_online_deviation_over_micro_batches(spark, tmp_path):
    """Equals the batch detector on ordered input, whatever the batches; nulls, flat series and short ones too."""
    rng = np.random.default_rng(9)
    rows = [(fp, k, None if k == 11 else 5.0 if fp == "flat" and k < 60 else float(rng.lognormal()), k) for k in range(90) for fp in ("a", "flat", "b")] + [("one", 1, 2.0, 1)]
    df = spark.createDataFrame(rows, "fingerprint string, value_id long, range double, domain long")
    ingest.in_order(df.withColumn("at", F.timestamp_seconds("domain")), "at", str(tmp_path / "in"), 5)
    stream = spark.readStream.schema(df.withColumn("at", F.timestamp_seconds("domain")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    found = online.online_deviation(stream, window=20, deviations=2.0)
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.fingerprint, r.value_id, r.direction): r.mean for r in spark.read.schema(found.schema).parquet(out).collect()}
    want = {(r.fingerprint, r.value_id, r.direction): r["mean"] for r in detect.deviation(df, window=20, deviations=2.0).collect()}
    assert got.keys() == want.keys() and len(want) > 3 and all(math.isclose(got[k], want[k]) for k in want)


def test_errors_are_data(spark):
    df = spark.createDataFrame([(k, k % 3) for k in range(9)], "k int, d int")
    rows = df.select("k", guarded(lambda k, d: k / d if k != 7 else "no number", "double")(F.col("k"), F.col("d")).alias("x")).collect()
    got = {r.k: (r.x.value, r.x.error) for r in rows}
    assert all(got[k] == (None, "ZeroDivisionError: division by zero") for k in (0, 3, 6))
    assert got[1] == (1.0, None) and got[8] == (4.0, None) and got[7][0] is None and got[7][1].startswith("Arrow")
    nested = df.filter("k < 2").select(guarded(lambda k: {"a": [k]} if k else None, "struct<a: array<int>>")(F.col("k")).alias("x")).collect()
    assert sorted((str(r.x.value), r.x.error) for r in nested) == [("None", None), ("Row(a=[1])", None)]


def test_generators_are_table_functions(spark):
    """Several kinds yielded, nested ones, nothing, a plain result, and none; and as nodes of a pipeline."""
    df = spark.createDataFrame([(0,), (1,), (3,)], "n int")

    def counted(n):
        yield from (str(k) for k in range(n))

    rows = df.lateralJoin(generator(counted, "string")(F.col("n"))).collect()
    assert sorted((r.n, r.ordinal, r.value) for r in rows) == [(1, 0, "0"), (3, 0, "0"), (3, 1, "1"), (3, 2, "2")]
    deep = df.lateralJoin(generator(lambda n: iter([{"x": n, "y": [n, n]}]) if n else None, "struct<x: int, y: array<int>>")(F.col("n"))).collect()
    assert sorted((r.n, r.value.x, r.value.y) for r in deep) == [(1, 1, [1, 1]), (3, 3, [3, 3])]
    p = Pipeline([Node("each", ("n",), counted, many=True, kind="string"), Node("number", ("each", "n"), lambda each, n: int(each) + 1 // (n - 1), kind="int")])
    got = {(r.n, r.each, r.number, r.number_error and r.number_error.partition(":")[0]) for r in p.run(df).collect()}
    assert got == {(0, None, None, "TypeError"), (1, "0", None, "ZeroDivisionError"), (3, "0", 0, None), (3, "1", 1, None), (3, "2", 2, None)}


def test_payloads_written_twice(spark, tmp_path):
    changes = spark.createDataFrame([("f", 1, "rd", 1, "x"), ("f", 1, "rd", 2, "y")], "folder string, run_id long, detector string, change_id long, detail string")
    for number in (0, 0, 1):
        ingest.write_payloads(changes, number, str(tmp_path))
    got = spark.read.parquet(str(tmp_path)).collect()
    assert sorted(r.batch for r in got) == [0, 1] and {(r.n_changes, r.payload) for r in got} == {(2, '[{"change_id":1,"detail":"x"},{"change_id":2,"detail":"y"}]')}


def test_distinct_documents_on_a_stream(spark, tmp_path):
    """A repeat within the wait goes; one long after it stays."""
    df = spark.sql("SELECT 'f' AS folder, 'h' AS content_hash, id, timestamp_seconds(id * 300) AS at FROM range(3) UNION ALL SELECT 'f', 'h', 99, timestamp_seconds(90000)")
    later = "SELECT 'f' AS folder, 'other {0}' AS content_hash, {0}L AS id, timestamp_seconds(80000) AS at"
    for part in (df.filter("id < 3"), spark.sql(later.format(50)), spark.sql(later.format(51)), df.filter("id = 99")):  # three repeats together, documents that move the time on, the late repeat
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    ingest.distinct(stream, "at").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = [r.id for r in spark.read.schema(df.schema).parquet(out).collect()]
    assert len(got) == 4 and {50, 51, 99} < set(got)


def test_definition_checks(spark):
    schemas = spark.createDataFrame([("f", 1), ("f", 1), ("g", 2)], "folder string, schema int")
    labels = spark.createDataFrame([(1, 1, "a", " ( ) =>\n 1"), (2, 1, "b", "(x) => x"), (3, 2, "c", None), (4, 3, "d", "() => 1")], "label_id int, schema int, name string, function string")
    extractors = spark.createDataFrame([(1,), (1,), (3,)], "label_id int")
    folders = spark.createDataFrame([("f", '["a","c"]'), ("g", None), ("h", '["a"]')], "folder string, fingerprint_labels string")
    variables = spark.createDataFrame([("f", 7, '["b","x","x"]'), ("g", 8, "no json")], "folder string, variable int, labels string")
    got = {tuple(r) for r in checks.definition_violations(schemas, labels, extractors, folders, variables).collect()}
    assert got == {("fingerprint_label", "f", "", "c"), ("fingerprint_label", "h", "", "a"), ("variable_label", "f", "7", "x"), ("constant_function", "f", "( ) =>", "a"), ("no_extractors", "f", "", "b")}


def test_view_checks(spark):
    wanted = spark.createDataFrame([("f", "v", "h1", '["a","z"]'), ("f", "v", "h2", '["b"]'), ("f", "v", "h3", "[]"), ("f", "v", "h4", None), ("f", "w", "h1", '["a"]')], "folder string, view string, header string, labels string")
    views = spark.createDataFrame([("f", "v", "h1", "a"), ("f", "v", "h2", "other"), ("f", "v", "h3", "x"), ("f", "u", "h", "a"), ("f", "Default", "h", "a"), ("f", "v", "more", "a")], "folder string, view string, header string, node string")
    states = checks.view_states(wanted, views)
    assert {(r.view, r.header, r.state) for r in states.collect()} == {("v", "h1", "ok"), ("v", "h2", "other_node"), ("v", "h3", "ok"), ("v", "h4", "missing"), ("w", "h1", "view_missing"), ("u", "h", "extra_view")}
    rates = {(r.scope, r.view): (r["columns"], r.matching, r.rate) for r in checks.view_rates(states).collect()}
    assert rates == {("all", None): (5, 3, 0.6), ("folder", None): (5, 3, 0.6), ("view", "v"): (4, 3, 0.75), ("view", "w"): (1, 0, 0.0)}


def test_storage_of_files(spark, tmp_path):
    for name, n in (("raw", 50), ("made", 10)):
        spark.range(n).select(F.repeat(F.lit("x"), 100).alias("text")).repartition(2).write.parquet(str(tmp_path / name))
    got = {r.name: r for r in reports.storage_summary({n: (spark.read.parquet(str(tmp_path / n)), ["text"]) for n in ("raw", "made")}, raw=["raw"]).collect()}
    for name in ("raw", "made"):
        files = [*(tmp_path / name).glob("*.parquet")]
        assert (got[name].files, got[name].stored_bytes) == (len(files), sum(f.stat().st_size for f in files))
    assert (got["total"].n_rows, got["total"].data_bytes, got["total"].overhead) == (60, 6000, 1.2)


@pytest.mark.skipif(not os.path.isdir(TESTDATA), reason="no test tables")
def test_storage_of_tables_in_many_files(spark, tmp_path):
    """The same rows in one file and in three, and a table without rows: the query counts a table as one, as its SQL does."""
    for name in ("orders", "lineitem", "documents", "benchmark", "events"):
        d = spark.read.parquet(f"{TESTDATA}/{name}.parquet")
        (d.limit(0) if name == "events" else d.repartition(3)).write.parquet(str(tmp_path / f"{name}.parquet"))
    got, want = ({r.name: r for r in QUERIES["g10_storage_ratio"](spark, d).collect()} for d in (str(tmp_path), TESTDATA))
    for name in ("orders", "lineitem", "documents", "benchmark"):
        assert got[name] == want[name] and got[name].files == 1
    assert (got["events"].n_rows, got["events"].files, got["total"].files) == (0, 1, 5)
