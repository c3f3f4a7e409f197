"""Extraction, combination and pivots on small documents."""

from pyspark.sql import functions as F

from benchtide.functions import jsonish as J
from benchtide.operators import combine, extract, pivot
from benchtide.plans.pipeline import Node, Pipeline
from benchtide.sources import documents, spec

DOC = '{"foo":[{"name":"a","bar":{"biz":[1,2]}},{"name":"b"}],"x-y":{"k":3.0},"none":null}'


def docs(spark, *texts):
    return spark.createDataFrame([(k, "f", t) for k, t in enumerate(texts)], "run_id long, folder string, data string")


def test_missing_paths_give_no_value(spark):
    d = docs(spark, DOC, "{}", "not json", None)
    assert [r.v for r in extract.field(d, "v", "$.foo[0].name").select("v").collect()] == ["a"]
    assert [r.v for r in extract.field(d, "v", "$['x-y'].k", "double").select("v").collect()] == [3.0]


def test_split_keeps_ordinals_and_single_values(spark):
    d = docs(spark, "[5,6]", "7", '{"a":1}')
    got = extract.split(d, "v", J.parsed(F.col("data"))).select("run_id", "idx", F.to_json("v").alias("v")).collect()
    assert sorted(map(tuple, got)) == [(0, 0, "5"), (0, 1, "6"), (1, 0, "7"), (2, 0, '{"a":1}')]


def test_numeric_strings_are_no_numbers(spark):
    d = docs(spark, '{"v":"12"}', '{"v":12}', '{"v":true}')
    assert [r[0] for r in d.orderBy("run_id").select(J.number(J.parsed(F.col("data")), "$.v")).collect()] == [None, 12.0, None]


def test_fingerprints_sort_names_and_take_the_last_of_equal_ones(spark):
    fp = J.fingerprint([("b", F.lit(1)), ("a", F.lit('q"')), ("b", F.lit(2)), ("c", F.lit(None).cast("int"))])
    assert spark.range(1).select(fp).first()[0] == '{"a":"q\\"","b":2}'


def test_validation(spark):
    good, bad = documents.validated(docs(spark, DOC, '"a": 1}', "{}", "1],[2", "", None, '{"a":1} x'))
    assert good.count() == 2 and bad.count() == 4


def test_paths_down_to_a_depth(spark):
    got = {r.path: r.value for r in extract.paths(docs(spark, '{"a":{"b":{"c":{"d":1}}},"l":[1],"o k":2}'), 3).collect()}
    assert got == {"$.a.b.c": '{"d":1}', "$.l[0]": "1", '$."o k"': "2"}


def test_combinations(spark):
    def source(**values):
        return spark.createDataFrame([(1, k, v) for x in values.values() for k, v in enumerate(x)], "run_id int, idx int, value string")

    two, three, one = source(a="pq"), source(a="rst"), source(a="z")
    first = {r.idx: (r.a, r.b, r.c) for r in combine.by_length({"a": two, "b": three, "c": one}).collect()}
    assert first == {0: ("p", "r", "z"), 1: ("q", "s", None), 2: (None, "t", None)}
    every = {r.idx: (r.a, r.b, r.c) for r in combine.by_length({"a": two, "b": three, "c": one}, scalar="All").collect()}
    assert every[2] == (None, "t", "z")
    assert combine.crossed({"a": two, "b": three, "c": three}, scalar="All").count() == 18
    crossed = combine.crossed({"a": two, "b": three, "c": one}).orderBy("idx").collect()
    assert [r.c for r in crossed] == ["z", None, None, None, None, None] and [r.a for r in crossed] == list("pppqqq")


def test_grouped_values_unwrap_single_ones(spark):
    v = spark.createDataFrame([(1, "n", 0, "5"), (1, "m", 1, "7"), (1, "m", 0, "6")], "run_id int, node string, idx int, data string")
    assert pivot.grouped(v).first().row == '{"m":[6,7],"n":5}'
    assert pivot.wide(v.withColumnRenamed("data", "value"), []).count() == 0


def test_pipeline_binds_by_name_and_orders_nodes(spark):
    p = Pipeline([Node("c", ("b",)), Node("b", ("x", "y"), lambda y, x: y - x), Node("many", ("x",), lambda v: F.array(v, v + 1), many=True)])
    got = p.run(spark.createDataFrame([(1, 10)], "x int, y int")).orderBy("many").collect()
    assert [(r.many, r.b, r.c) for r in got] == [(1, 9, 9), (2, 9, 9)]
    assert p.downstream("b") == ["b", "c"]


def test_spec_round_trip(spark):
    nodes = spark.createDataFrame([("f", 1, "root", "root", None), ("f", 2, "v", "jq", ".v"), ("f", 3, "d", "odd", None)], "folder string, node_id long, name string, type string, operation string")
    edges = spark.createDataFrame([("f", 2, 1, 0), ("f", 3, 2, 0), ("f", 3, 9, 1)], "folder string, child_id long, parent_id long, idx int")
    text = spec.export(nodes, edges)
    back = text.select(F.from_json("spec", spec.SCHEMA).alias("s")).select("s.*")
    assert [(r.node_id, r.type) for r in spec.nodes(back).collect()] == [(1, "root"), (2, "jq"), (3, "jq")]
    known, unknown = spec.edges(back)
    assert known.count() == 2 and [r.parent_id for r in unknown.collect()] == [9]


def test_jdbc_runs(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/runs;create=true"
    rows = [(k, 7 if k % 3 else 8, None if k % 5 == 0 else k % 5 == 1, f'{{"k":{k}}}') for k in range(40)]
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.createDataFrame(rows, "ID long, TESTID int, TRASHED boolean, DATA string").write.jdbc(url, "run", properties=options)
    found = documents.jdbc_runs(spark, url, "run", 7, parts=4, **options)
    assert found.rdd.getNumPartitions() == 4
    assert sorted(r.id for r in found.select(F.col("id").alias("id")).collect()) == [k for k, test, trashed, _ in rows if test == 7 and not trashed]
    assert documents.jdbc_runs(spark, url, "run", 9, **options).count() == 0
