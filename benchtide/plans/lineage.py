"""Queries on lineage and maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchtide.functions.evaluate import generator
from benchtide.operators import closure_table, lineage, maintenance
from benchtide.plans.pipeline import Node, Pipeline, is_identity

from .catalog import query
from .fixtures import EDGES_SQL, NODES_SQL, node_tables, table, value_edges


def _start(edges: DataFrame, kind: str, column: str = "parent_id") -> DataFrame:
    return edges.filter(F.col(column).startswith(kind)).select(F.col(column).alias("id")).distinct()


_DOWN = "c AS (SELECT parent_id AS root, child_id AS id FROM value_edges WHERE parent_id LIKE '{k}%' UNION SELECT c.root, e.child_id FROM c JOIN value_edges e ON e.parent_id = c.id)"


@query("j6_descendants", f"WITH RECURSIVE {EDGES_SQL}, {_DOWN.format(k='n')} SELECT root, count(*) AS n, count(*) FILTER (id LIKE 'l%') AS items FROM c GROUP BY 1")
def j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lineage.written(value_edges(spark, sf_dir))
    d = lineage.closure(e, _start(e, "n"))
    return d.groupBy("root").agg(F.count("*").alias("n"), F.count_if(F.col("id").startswith("l")).alias("items"))


@query("j7_ancestors", f"WITH RECURSIVE {EDGES_SQL}, u AS (SELECT child_id AS root, parent_id AS id FROM value_edges WHERE child_id LIKE 'l%' UNION SELECT u.root, e.parent_id FROM u JOIN value_edges e ON e.child_id = u.id) SELECT root, id FROM u WHERE id LIKE 'n%'")
def j7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the nations down: an item's ancestors are many, of which one is a nation, so no pair is made that is not asked for or on the way to one."""
    e = value_edges(spark, sf_dir)
    return lineage.closure(e, _start(e, "n")).filter(F.col("id").startswith("l")).select(F.col("id").alias("root"), F.col("root").alias("id"))


@query("j8_direct_children", f"WITH {EDGES_SQL} SELECT parent_id, count(*) AS n FROM value_edges WHERE child_id LIKE 'o%' GROUP BY 1")
def j8(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = value_edges(spark, sf_dir)
    values = e.select(F.col("child_id").alias("value_id")).distinct().withColumn("node", F.substring("value_id", 1, 1))
    return lineage.children(e, values, "o").groupBy("parent_id").agg(F.count("*").alias("n"))


@query("j9_dependents", f"WITH RECURSIVE {NODES_SQL}, c AS (SELECT parent_id AS root, child_id AS id FROM edges UNION SELECT c.root, e.child_id FROM c JOIN edges e ON e.parent_id = c.id) SELECT root::BIGINT AS root, count(*) AS dependents FROM c GROUP BY 1")
def j9(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, e = node_tables(spark, sf_dir)
    d = lineage.bundled_closure(e, e.select(F.col("parent_id").alias("id")))
    return d.groupBy("root").agg(F.count("*").alias("dependents"))


@query("j6_kept_closure", f"""WITH RECURSIVE {NODES_SQL}, c AS (SELECT parent_id AS root, child_id AS id FROM edges UNION SELECT c.root, e.child_id FROM c JOIN edges e ON e.parent_id = c.id) SELECT root::BIGINT AS root, count(*) AS descendants, sum(id)::BIGINT AS total FROM c GROUP BY 1""")
def j6_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closure table of a graph in which some edges are not yet there and some are too many, then changed by these: as if computed anew."""
    _, e = node_tables(spark, sf_dir)
    e = lineage.written(e.withColumn("parent_id", F.col("parent_id").cast("long")))
    late = e.filter("child_id % 13 = 5")
    wrong = lineage.written(e.filter("child_id % 17 = 3 AND parent_id > 0").select("child_id", (F.col("parent_id") - 1).alias("parent_id")).distinct().join(e, ["child_id", "parent_id"], "left_anti"))
    before = closure_table.counted(e.filter("child_id % 13 <> 5").unionByName(wrong))
    now = closure_table.changed(before, inserted=late, deleted=wrong)
    return now.groupBy("root").agg(F.count("*").alias("descendants"), F.sum("id").alias("total"))


@query("j15_semi_anti", f"""WITH {NODES_SQL} SELECT node_id FROM nodes n WHERE EXISTS (SELECT 1 FROM edges e JOIN nodes c ON c.node_id = e.child_id WHERE e.parent_id = n.node_id AND c.type NOT IN ('ft','rd','sd','ed'))
AND NOT EXISTS (SELECT 1 FROM edges e JOIN nodes c ON c.node_id = e.child_id WHERE e.parent_id = n.node_id AND c.type IN ('ft','rd','sd','ed'))""")
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = node_tables(spark, sf_dir)
    kids = e.join(n.withColumnRenamed("node_id", "child_id"), "child_id").withColumnRenamed("parent_id", "node_id")
    return n.join(kids.filter(~maintenance.is_detection()), "node_id", "left_semi").join(kids.filter(maintenance.is_detection()), "node_id", "left_anti").select("node_id")


_DOOMED = f"{EDGES_SQL}, doomed AS (SELECT DISTINCT child_id AS id FROM value_edges WHERE parent_id LIKE 'p1%')"


@query("j16_outside_parents", f"WITH {_DOOMED} SELECT id FROM doomed WHERE EXISTS (SELECT 1 FROM value_edges e WHERE e.child_id = id AND e.parent_id NOT IN (SELECT id FROM doomed))")
def j16(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = value_edges(spark, sf_dir)
    return lineage.with_outside_parent(e, e.filter("parent_id LIKE 'p1%'").select(F.col("child_id").alias("id")).distinct())


@query("g6_parent_counts", f"WITH {EDGES_SQL}, k AS (SELECT child_id, count(DISTINCT parent_id) AS parents FROM value_edges GROUP BY 1) SELECT parents, count(*) AS n FROM k GROUP BY 1")
def g6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.parent_counts(value_edges(spark, sf_dir)).groupBy("parents").agg(F.count("*").alias("n"))


@query("m1_cascade", f"""WITH {EDGES_SQL}, g0 AS (SELECT 'r1' AS id), g1 AS (SELECT child_id AS id FROM value_edges GROUP BY 1 HAVING bool_and(parent_id IN (SELECT id FROM g0))),
g2 AS (SELECT child_id AS id FROM value_edges GROUP BY 1 HAVING bool_and(parent_id IN (SELECT id FROM g1))), g3 AS (SELECT child_id AS id FROM value_edges GROUP BY 1 HAVING bool_and(parent_id IN (SELECT id FROM g2))),
g4 AS (SELECT child_id AS id FROM value_edges GROUP BY 1 HAVING bool_and(parent_id IN (SELECT id FROM g3))) SELECT * FROM g0 UNION SELECT * FROM g1 UNION SELECT * FROM g2 UNION SELECT * FROM g3 UNION SELECT * FROM g4""")
def m1(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = value_edges(spark, sf_dir)
    return lineage.cascade(e, e.filter("parent_id = 'r1'").select(F.col("parent_id").alias("id")))


@query("m2_subtree", f"""WITH RECURSIVE {EDGES_SQL}, c AS (SELECT 'n3' AS id UNION SELECT e.child_id FROM c JOIN value_edges e ON e.parent_id = c.id)
SELECT id FROM c WHERE id = 'n3' OR NOT EXISTS (SELECT 1 FROM value_edges e WHERE e.child_id = c.id AND e.parent_id NOT IN (SELECT id FROM c))""")
def m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = value_edges(spark, sf_dir)
    return lineage.subtree(e, e.filter("child_id = 'n3'").select(F.col("child_id").alias("id")))


@query("m3_folder_deleted", "SELECT o_orderpriority AS folder, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def m3(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("folder", F.col("o_orderpriority"))
    return maintenance.without_folder(o, "1-URGENT", "2-HIGH").groupBy("folder").agg(F.count("*").alias("n"))


_EPH = f"""{NODES_SQL}, kids AS (SELECT parent_id, bool_or(c.type IN ('ft','rd','sd','ed')) AS watched, bool_or(c.type NOT IN ('ft','rd','sd','ed')) AS used FROM edges JOIN nodes c ON c.node_id = child_id GROUP BY 1),
eph AS (SELECT node_id, type, mode, (mode = 'DISCARD' OR (mode = 'AUTO' AND coalesce(used, false))) AND type NOT IN ('root','ft','rd','sd','ed') AND NOT coalesce(watched, false) AS ephemeral FROM nodes LEFT JOIN kids ON parent_id = node_id)"""


@query("m4_ephemeral", f"WITH {_EPH} SELECT node_id, ephemeral FROM eph")
def m4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.ephemeral(*node_tables(spark, sf_dir)).select("node_id", "ephemeral")


@query("f10_ephemeral_filter", f"WITH {_EPH} SELECT type, count(*) AS n FROM eph WHERE ephemeral GROUP BY 1")
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.ephemeral(*node_tables(spark, sf_dir)).filter("ephemeral").groupBy("type").agg(F.count("*").alias("n"))


@query("m5_cleared_values", f"WITH {_EPH} SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS node_id, CASE WHEN NOT ephemeral THEN l_quantity END AS data FROM lineitem JOIN eph ON l_partkey = node_id")
def m5(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("node_id"), F.col("l_quantity").alias("data"))
    return maintenance.cleared(values, maintenance.ephemeral(*node_tables(spark, sf_dir))).select("id", "line", "node_id", "data")


@query("m6_modes", f"WITH {NODES_SQL} SELECT node_id, CASE WHEN mode = 'AUTO' AND node_id % 3 = 0 THEN 'KEEP' WHEN mode = 'AUTO' AND node_id % 5 = 0 THEN 'DISCARD' ELSE mode END AS mode FROM nodes")
def m6(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, _ = node_tables(spark, sf_dir)
    return maintenance.modes(n, n.filter("node_id % 3 = 0"), n.filter("node_id % 5 = 0")).select("node_id", "mode")


@query("m7_to_recompute", f"WITH RECURSIVE {_EPH}, u AS (SELECT parent_id AS id FROM edges UNION SELECT e.parent_id FROM u JOIN edges e ON e.child_id = u.id) SELECT u.id::BIGINT AS id FROM u JOIN eph ON node_id = u.id WHERE ephemeral")
def m7(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = node_tables(spark, sf_dir)
    return maintenance.to_recompute(e, n.select(F.col("node_id").alias("id")), maintenance.ephemeral(n, e))


@query("m8_renamed", "SELECT p_partkey AS node_id, CASE WHEN p_name = 'red widget' THEN 'crimson widget' ELSE p_name END AS name FROM part")
def m8(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, _ = node_tables(spark, sf_dir)
    return maintenance.renamed(n, "red widget", "crimson widget").select("node_id", "name")


@query("u1_distinct_union", f"WITH {EDGES_SQL} SELECT substring(id, 1, 1) AS kind, count(*) AS n FROM (SELECT child_id AS id FROM value_edges UNION SELECT parent_id FROM value_edges) GROUP BY 1")
def u1(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = value_edges(spark, sf_dir)
    return e.select(F.col("child_id").alias("id")).union(e.select("parent_id")).distinct().groupBy(F.substring("id", 1, 1).alias("kind")).agg(F.count("*").alias("n"))


@query("u2_closure_of_diamonds", f"WITH RECURSIVE {NODES_SQL}, c AS (SELECT 0 AS id UNION SELECT e.child_id FROM c JOIN edges e ON e.parent_id = c.id) SELECT count(*) AS n FROM c")
def u2(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = node_tables(spark, sf_dir)
    return lineage.closure(e, n.filter("node_id = 0").select(F.col("node_id").alias("id")), with_start=True).agg(F.count("*").alias("n"))


def _pipeline() -> Pipeline:
    return Pipeline([Node("net", ("l_extendedprice", "l_discount"), lambda l_discount, l_extendedprice: l_extendedprice * (1 - l_discount)), Node("gross", ("net", "l_tax"), lambda both: both["net"] * (1 + both["l_tax"])), Node("same", ("gross",)), Node("parts", ("l_shipdate",), lambda d: F.array(F.year(d), F.month(d)), many=True)])


@query("x1_function_nodes", "SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 1) AS gross FROM lineitem")
def x1(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _pipeline().run(table(spark, sf_dir, "lineitem"), only=("net", "gross", "same"))
    return d.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.round("same", 1).alias("gross"))


@query("x2_generator_nodes", "SELECT part, count(*) AS n FROM (SELECT year(l_shipdate)::INT AS part FROM lineitem UNION ALL SELECT month(l_shipdate)::INT FROM lineitem) GROUP BY 1")
def x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pipeline().run(table(spark, sf_dir, "lineitem"), only=("parts",)).groupBy(F.col("parts").alias("part")).agg(F.count("*").alias("n"))


@query("x2_table_function", """SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, k::INT AS ordinal, CASE k WHEN 0 THEN l_quantity ELSE l_quantity * l_tax END AS value FROM lineitem, (VALUES (0), (1), (2)) v(k) WHERE k < l_linenumber % 3
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, -1, NULL FROM lineitem WHERE l_linenumber % 3 = 0""")
def x2_udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generator that yields none, one or two values a row, called laterally; rows without a value stay."""

    def yields(line: int, quantity: float, tax: float):
        for k in range(line % 3):
            yield quantity if k == 0 else quantity * tax

    li = table(spark, sf_dir, "lineitem")
    rows = li.lateralJoin(generator(yields, "double")(F.col("l_linenumber"), F.col("l_quantity"), F.col("l_tax")), on=F.lit(True), how="left")
    return rows.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.coalesce("ordinal", F.lit(-1)).alias("ordinal"), "value")


@query("x6_errors_as_data", """SELECT event_id AS run_id, CASE WHEN event_id % 4 NOT IN (0, 1) THEN 100 // (user_id % 5 + 1) + 0.5 END::DOUBLE AS half, CASE event_id % 4 WHEN 0 THEN 'RuntimeError: on ' || event_id WHEN 1 THEN 'ZeroDivisionError: by none' END AS half_error FROM events""")
def x6_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python node that fails on some rows in two ways: null and the message there, the others untouched."""

    def half(event: int, user: int) -> float:
        if event % 4 == 0:
            raise RuntimeError(f"on {event}")
        if event % 4 == 1:
            raise ZeroDivisionError("by none")
        return 100 // (user % 5 + 1) + 0.5

    p = Pipeline([Node("half", ("event_id", "user_id"), half, kind="double")])
    return p.run(table(spark, sf_dir, "events")).select(F.col("event_id").alias("run_id"), "half", "half_error")


@query("x4_identity_nodes", "SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, l_tax AS same, l_tax * 2 AS twice, 'alias,same' AS identities FROM lineitem")
def x4(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pipeline([Node("alias", ("l_tax",)), Node("same", ("alias",), lambda x: x), Node("twice", ("same",), lambda x: x * 2)])
    d = p.run(table(spark, sf_dir, "lineitem"))
    return d.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), "same", "twice", F.lit(",".join(n.name for n in p.nodes if is_identity(n))).alias("identities"))


@query("x5_same_names", "SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, l_quantity - l_tax AS left_over, '{\"score\":' || (l_linenumber + 1) || ',\"score_8\":' || (l_linenumber + 2) || '}' AS both FROM lineitem")
def x5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with one name: the second is bound with its id behind the name."""
    li = table(spark, sf_dir, "lineitem").withColumns({"score#3": F.col("l_quantity"), "score#7": F.col("l_tax"), "score#5": F.col("l_linenumber") + 1, "score#8": F.col("l_linenumber") + 2})
    p = Pipeline([Node("left_over", ("score#3", "score#7"), lambda score_7, score: score - score_7), Node("both", ("score#5", "score#8"), lambda named: F.to_json(named))])
    return p.run(li).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), "left_over", "both")


@query("t5_recalculation", "SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 1) AS gross FROM lineitem")
def t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node and its dependants again, over stored values that are out of date: equals the full run."""
    p = _pipeline()
    stored = p.run(table(spark, sf_dir, "lineitem"), only=("net", "gross", "same")).withColumns({c: F.lit(0.0) for c in ("net", "gross", "same")})
    d = p.run(stored, only=p.downstream("net"))
    return d.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.round("same", 1).alias("gross"))
