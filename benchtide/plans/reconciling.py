"""Queries that hold two result sets against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchtide.functions import jsonish as J
from benchtide.operators import checks, reconcile, reports

from .catalog import query
from .fixtures import table


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The price of each item, and the same as another system has it: rounding noise, mistakes, gaps, stubs."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.concat(F.lit("item"), "l_linenumber").alias("label"), F.col("l_partkey").alias("pos"), F.col("l_extendedprice").alias("x"), F.col("l_suppkey").alias("s"))
    left = li.select("run_id", "label", "pos", F.when(F.col("s") % 11 == 0, "TBD").otherwise(F.col("x").cast("decimal(18,2)").cast("string")).alias("value"))
    other = F.when(F.col("s") % 7 == 1, F.col("x") + 5).when(F.col("s") % 7 == 2, F.col("x") * (1 + 1e-8)).otherwise(F.col("x"))
    right = li.filter("s % 7 <> 3").select("run_id", "label", F.when(F.col("s") % 7 == 2, other.cast("decimal(28,10)").cast("string")).otherwise(other.cast("decimal(18,2)").cast("string")).alias("value"))
    return left, right


_BOTH = """li AS (SELECT l_orderkey AS run_id, 'item' || l_linenumber AS label, l_partkey AS pos, l_extendedprice AS x, l_suppkey AS s FROM lineitem),
l AS (SELECT run_id, label, pos, s % 11 = 0 AS stub, x::DECIMAL(18,2) AS v FROM li), r AS (SELECT run_id, label, s % 7 AS k, x::DECIMAL(18,2) + CASE WHEN s % 7 = 1 THEN 5 ELSE 0 END AS v FROM li WHERE s % 7 <> 3),
c AS (SELECT l.run_id, l.label, l.pos, min(CASE WHEN r.v IS NULL THEN CASE WHEN stub THEN 2 ELSE 4 END WHEN stub THEN 2 WHEN l.v = r.v AND r.k <> 2 THEN 0 WHEN abs(l.v - r.v) <= 1e-6 * greatest(abs(l.v), abs(r.v)) THEN 1 ELSE 3 END) AS k
 FROM l LEFT JOIN r ON l.run_id = r.run_id AND l.label = r.label GROUP BY 1, 2, 3),
res AS (SELECT run_id, label, pos, ['EXACT','ROUNDING','STUB','MISMATCH','MISSING'][k + 1] AS result FROM c)"""


@query("j11_reconcile", f"WITH {_BOTH} SELECT * FROM res")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.compared(*_both(spark, sf_dir))


@query("g9_match_rates", f"WITH {_BOTH} SELECT label, count(*) AS n, count(*) FILTER (result IN ('EXACT','ROUNDING')) AS matching, count(*) FILTER (result NOT IN ('EXACT','ROUNDING')) AS problems, round(avg((result IN ('EXACT','ROUNDING'))::INT), 6) AS rate FROM res GROUP BY 1")
def g9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.match_rates(reconcile.compared(*_both(spark, sf_dir)))


@query("g9_reconcile_summary", f"""WITH {_BOTH}, g AS (SELECT CASE grouping(label, pos) WHEN 3 THEN 'overall' WHEN 1 THEN 'label' ELSE 'dataset' END AS scope, CASE grouping(label, pos) WHEN 1 THEN label WHEN 2 THEN pos::VARCHAR END AS key, count(*) AS n,
count(*) FILTER (result = 'EXACT') AS exact, count(*) FILTER (result = 'ROUNDING') AS rounding, count(*) FILTER (result IN ('STUB','MISMATCH')) AS mismatched, count(*) FILTER (result = 'STUB') AS stubs, count(*) FILTER (result = 'MISSING') AS missing
FROM res GROUP BY GROUPING SETS ((), (label), (pos)))
SELECT scope, key, n, exact + rounding AS matching, exact, rounding, mismatched, stubs, missing, round(100.0 * (exact + rounding) / n, 1)::DOUBLE AS rate, CASE WHEN mismatched + missing = 0 THEN 'perfect' ELSE 'problems' END AS state FROM g""")
def g9_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.reconcile_summary(reconcile.compared(*_both(spark, sf_dir)))


@query("g9_node_counts", "SELECT n_name AS folder, t AS type, count(*) AS nodes, count(*) FILTER (t IN ('ft', 'rd', 'sd', 'ed')) AS detecting FROM (SELECT n_name, ['root', 'jq', 'js', 'ft', 'rd', 'sd', 'ed', 'fp'][(c_custkey % 8 + 1)::INT] AS t FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY GROUPING SETS ((n_name, t), (n_name))")
def g9_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("root", "jq", "js", "ft", "rd", "sd", "ed", "fp")))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("folder"))
    return reports.node_counts(table(spark, sf_dir, "customer").join(n, "c_nationkey").select("folder", F.element_at(kinds, (F.col("c_custkey") % 8 + 1).cast("int")).alias("type")))


@query("u5_extra_labels", "SELECT DISTINCT l_orderkey AS run_id, l_linenumber AS label FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def u5(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("label"))
    left = right.join(table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("run_id")), "run_id", "left_semi")
    return reconcile.extra(left, right)


@query("j12_name_resolution", """SELECT 'PartNo' || p_partkey || 'x' AS label, CASE p_partkey % 8 WHEN 0 THEN 'PartNo' || p_partkey || 'x' WHEN 1 THEN 'PartNo' || p_partkey || 'x0' WHEN 2 THEN 'PartNo' || p_partkey || 'x1' WHEN 3 THEN 'PartNo' || p_partkey || 'x2' WHEN 4 THEN 'PartNo' || p_partkey || 'x3'
WHEN 5 THEN 'partNo' || p_partkey || 'x' ELSE 'part_no' || p_partkey || 'x' END AS known, p_partkey % 8 AS rank FROM part WHERE p_partkey % 8 < 7""")
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's name, known in one of the seven forms or (of eight, the last) in none; later forms are known beside earlier ones."""
    key, form = F.concat(F.col("p_partkey").cast("string"), F.lit("x")), F.col("p_partkey") % 8
    name = F.concat(F.lit("PartNo"), key)
    forms = [name, *[F.concat(name, F.lit(str(k))) for k in range(4)], F.concat(F.lit("partNo"), key), F.concat(F.lit("part_no"), key)]
    p = table(spark, sf_dir, "part")
    known = p.select(F.explode(F.array(*[F.when((form == k) | ((F.lit(k) == 6) & (form < 6)), f) for k, f in enumerate(forms)])).alias("label")).filter("label IS NOT NULL")
    return reconcile.resolved(p.select(name.alias("label")), known).withColumn("rank", F.col("rank").cast("long"))


@query("j14_upsert", "SELECT coalesce(a.k, b.k) AS path, CASE WHEN a.k IS NULL THEN 'insert' WHEN b.k IS NULL THEN 'delete' WHEN a.v = b.v THEN 'keep' ELSE 'update' END AS action, coalesce(b.v, a.v) AS data FROM (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 5 <> 0) a FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 7 <> 0) b ON a.k = b.k")
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("data"))
    return reconcile.upsert(o.filter("path % 5 <> 0"), o.filter("path % 7 <> 0").withColumn("data", F.when(F.col("path") % 3 == 0, "X").otherwise(F.col("data"))), keys=("path",))


@query("j18_undefined_labels", "SELECT DISTINCT l_partkey AS label FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def j18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.undefined(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("label")), table(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("label")))


@query("j18_view_quality", "SELECT s_name AS header, s_nationkey AS node, CASE WHEN n_nationkey IS NULL THEN 'missing' ELSE 'ok' END AS state FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON n_nationkey = s_nationkey")
def j18_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.view_quality(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("header"), F.col("s_nationkey").alias("node")), table(spark, sf_dir, "nation").filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("node")))


def _definitions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Brands as folders, kinds of parts as schemas, parts as labels (one in nine a constant function), line items as extractors; suppliers' and orders' names of parts as the fingerprints and variables of folders."""
    p, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    function = F.when(F.col("p_partkey") % 9 == 0, F.concat(F.lit(" ( ) => "), F.col("p_size"), F.lit("\n + 0"))).when(F.col("p_partkey") % 9 == 1, "(a, b) => a").when(F.col("p_partkey") % 9 == 2, None).otherwise("v => v.x")
    label = lambda key: F.concat(F.lit("part "), key)
    labels = p.select(F.col("p_partkey").alias("label_id"), F.concat("p_brand", F.lit(" "), "p_type").alias("schema"), label(F.col("p_partkey")).alias("name"), function.alias("function"))
    schemas = p.filter("p_size > 5").select(F.col("p_brand").alias("folder"), F.concat("p_brand", F.lit(" "), "p_type").alias("schema"))
    extractors = li.filter("l_quantity > 40").select(F.col("l_partkey").alias("label_id"))
    wanted = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("folder"), "l_orderkey", "l_linenumber", "p_size", label(F.col("p_partkey") + (F.col("l_orderkey") % 2)).alias("name"))
    named = F.to_json(F.sort_array(F.collect_set("name")))
    folders = wanted.filter("l_orderkey % 10 = 0").groupBy("folder").agg(named.alias("fingerprint_labels"))
    variables = wanted.filter("l_linenumber = 1").groupBy("folder", F.col("p_size").alias("variable")).agg(named.alias("labels"))
    return schemas, labels, extractors, folders, variables


_DEFS = """lab AS (SELECT p_partkey AS id, p_brand || ' ' || p_type AS s, 'part ' || p_partkey AS name, CASE p_partkey % 9 WHEN 0 THEN '( ) => ' || p_size WHEN 2 THEN NULL ELSE 'x' END AS f FROM part),
own AS (SELECT DISTINCT p_brand AS folder, id, name, f FROM part JOIN lab ON s = p_brand || ' ' || p_type WHERE p_size > 5),
w AS (SELECT p_brand AS folder, l_orderkey AS o, l_linenumber AS l, p_size AS v, 'part ' || (p_partkey + l_orderkey % 2) AS name FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query("j18_definition_violations", f"""WITH {_DEFS}
SELECT 'fingerprint_label' AS "check", folder, '' AS subject, name FROM (SELECT DISTINCT folder, name FROM w WHERE o % 10 = 0) x WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.folder = x.folder AND own.name = x.name)
UNION ALL SELECT 'variable_label', folder, v::VARCHAR, name FROM (SELECT DISTINCT folder, v, name FROM w WHERE l = 1) x WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.folder = x.folder AND own.name = x.name)
UNION ALL SELECT DISTINCT 'constant_function', folder, f, name FROM own WHERE f LIKE '( )%'
UNION ALL SELECT DISTINCT 'no_extractors', folder, '', name FROM own WHERE id NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)""")
def j18_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.definition_violations(*_definitions(spark, sf_dir))


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as columns of views: nations' views in regions' folders; of some the label is another one, of some the column, of some nations the whole view is not there, and some are there only."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    r = F.col("s_suppkey") % 7
    view = F.when(F.col("n_nationkey") == 3, "Default").otherwise(F.col("n_name"))
    labels = F.when(r == 1, "[]").when(r == 2, None).otherwise(F.to_json(F.array(F.col("s_name"), F.lit("other"))))
    wanted = s.filter("n_nationkey % 5 NOT IN (3)").select(F.col("n_regionkey").cast("string").alias("folder"), view.alias("view"), F.col("s_suppkey").alias("header"), labels.alias("labels"))
    there = s.filter((r != 3) & (F.col("n_nationkey") % 5 != 4)).select(F.col("n_regionkey").cast("string").alias("folder"), view.alias("view"), F.col("s_suppkey").alias("header"), F.when(r == 4, "elsewhere").otherwise(F.col("s_name")).alias("node"))
    return checks.view_states(wanted, there)


_VIEWS = """vs AS (SELECT n_regionkey::VARCHAR AS folder, CASE WHEN n_nationkey = 3 THEN 'Default' ELSE n_name END AS view, s_suppkey AS header, s_suppkey % 7 AS r, n_nationkey % 5 AS k, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
seen AS (SELECT folder, view, count(*) FILTER (k <> 3) > 0 AS wanted, count(*) FILTER (r <> 3 AND k <> 4) > 0 AS there FROM vs GROUP BY 1, 2),
st AS (SELECT folder, view, header, CASE WHEN k = 3 THEN NULL WHEN r IN (1, 2) THEN '' ELSE s_name END AS label, CASE WHEN r = 3 OR k = 4 THEN NULL WHEN r = 4 THEN 'elsewhere' ELSE s_name END AS node,
CASE WHEN NOT wanted THEN CASE WHEN view <> 'Default' AND r <> 3 THEN 'extra_view' END WHEN NOT there THEN 'view_missing' WHEN r = 3 OR k = 4 THEN 'missing' WHEN r = 4 THEN 'other_node' ELSE 'ok' END AS state FROM vs JOIN seen USING (folder, view))"""


@query("j18_view_states", f"WITH {_VIEWS} SELECT * FROM st WHERE state IS NOT NULL")
def j18_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir)


@query("j18_view_rates", f"""WITH {_VIEWS} SELECT folder, view, CASE grouping(folder, view) WHEN 3 THEN 'all' WHEN 1 THEN 'folder' ELSE 'view' END AS scope, count(*) AS columns, count(*) FILTER (state IN ('ok', 'other_node')) AS matching, count(*) FILTER (state = 'other_node') AS other_node,
round(avg((state IN ('ok', 'other_node'))::INT), 6)::DOUBLE AS rate FROM st WHERE state IS NOT NULL AND state <> 'extra_view' GROUP BY ROLLUP (folder, view)""")
def j18_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.view_rates(_views(spark, sf_dir))


@query("u4_path_difference", "SELECT o_orderkey AS path FROM orders WHERE o_orderkey % 5 <> 0 EXCEPT SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0")
def u4(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"))
    return o.filter("path % 5 <> 0").join(o.filter("path % 7 <> 0"), "path", "left_anti")


@query("u6_distinct_ingest", "SELECT source AS folder, count(DISTINCT md5(text)) AS n FROM documents GROUP BY 1")
def u6(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("folder"), J.content_hash(F.col("text")).alias("hash"))
    return d.dropDuplicates(["folder", "hash"]).groupBy("folder").agg(F.count("*").alias("n"))


@query("f9_stub_values", "SELECT event_id FROM events WHERE event_id % 6 IN (1, 2, 3)")
def f9(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.array(*map(F.lit, ("5.2", '"TBD"', " N/A ", "Need to collect data", "TODOS", "ok")))
    return table(spark, sf_dir, "events").filter(J.is_stub(F.element_at(texts, (F.col("event_id") % 6 + 1).cast("int")))).select("event_id")
