"""Queries on documents: ingest, extraction, combination, functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchtide.functions import jsonish as J
from benchtide.operators import combine, extract
from benchtide.operators.detect import fingerprint_filter, fixed_threshold
from benchtide.sources import documents as docs
from benchtide.sources import spec, store

from .catalog import query
from .fixtures import ITEMS_SQL, NODES_SQL, ORDER_TYPE_SQL, event_documents, node_tables, order_documents, order_items, table, without_digits


@query("s2_validated_ingest", "SELECT event_type AS folder, count(*) AS good, count(*) FILTER (event_id % 10 = 0) AS rejected FROM events GROUP BY 1")
def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = event_documents(spark, sf_dir)
    bad = d.filter("run_id % 10 = 0").withColumn("data", F.expr("substring(data, 2)"))
    good, rejected = docs.validated(d.unionAll(bad))
    return good.groupBy("folder").agg(F.count("*").alias("good")).join(rejected.groupBy("folder").agg(F.count("*").alias("rejected")), "folder", "left").na.fill(0)


@query("s3_run_scan", "SELECT o_orderkey AS id, o_custkey AS testid, o_orderstatus = 'P' AS trashed FROM orders WHERE o_custkey % 10 = 7 AND o_orderstatus <> 'P' ORDER BY o_orderkey DESC LIMIT 100 OFFSET 20")
def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("testid"), (F.col("o_orderstatus") == "P").alias("trashed"))
    return docs.newest_first(docs.runs_of(o.withColumn("testgroup", F.col("testid") % 10), 7, "testgroup").drop("testgroup"), 100, 20)


_SPEC_SQL = f"""{NODES_SQL}, n AS (SELECT p_brand AS folder, node_id, name, CASE WHEN type IN ('root','jq','js','nata','split','fp','ft','rd','sd','ed') THEN type ELSE 'jq' END AS type FROM nodes JOIN part ON p_partkey = node_id),
e AS (SELECT n.folder, child_id, parent_id, EXISTS (SELECT 1 FROM n m WHERE m.folder = n.folder AND m.node_id = parent_id) AS known FROM edges JOIN n ON n.node_id = child_id)"""


@query("s4_spec_import", f"""WITH {_SPEC_SQL} SELECT n.folder, type, count(*) AS nodes, (SELECT count(*) FROM e WHERE e.folder = n.folder AND known) AS sources, (SELECT count(*) FROM e WHERE e.folder = n.folder AND NOT known) AS unresolved FROM n GROUP BY 1, 2""")
def s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spec for each brand, read back: nodes and unresolved sources by type."""
    specs = _specs(spark, sf_dir)
    n, (known, unknown) = spec.nodes(specs), spec.edges(specs)
    kinds = n.groupBy("folder", "type").agg(F.count("*").alias("nodes"))
    return kinds.join(known.groupBy("folder").agg(F.count("*").alias("sources")), "folder", "left").join(unknown.groupBy("folder").agg(F.count("*").alias("unresolved")), "folder", "left").na.fill(0)


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = node_tables(spark, sf_dir)
    folder = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_brand").alias("folder"))
    nodes = nodes.join(folder, "node_id").withColumn("operation", F.concat(F.lit("."), "name"))
    edges = edges.join(folder.withColumnRenamed("node_id", "child_id"), "child_id").withColumn("idx", F.row_number().over(_by_child()))
    text = spec.export(nodes, edges)
    return text.select(F.from_json("spec", spec.SCHEMA).alias("s")).select("s.*")


def _by_child():
    from pyspark.sql.window import Window

    return Window.partitionBy("child_id").orderBy("parent_id")


@query("s5_spec_export", f"""WITH {_SPEC_SQL}, s AS (SELECT child_id, string_agg(parent_id::BIGINT, ',' ORDER BY parent_id) AS sources FROM e GROUP BY 1)
SELECT folder, count(*)::INT AS nodes, string_agg(node_id || ' ' || type || ' ' || name || ' .' || name || ' [' || coalesce(sources, '') || ']', ';' ORDER BY type <> 'root', node_id) AS listed FROM n LEFT JOIN s ON child_id = node_id GROUP BY 1""")
def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the exported spec of each brand says when it is read back: every node with its kind, operation and sources, in order."""
    listed = F.transform("nodes", lambda x: F.concat_ws(" ", x["id"].cast("string"), x["type"], x["name"], x["operation"], F.concat(F.lit("["), F.array_join(x["sources"].cast("array<string>"), ","), F.lit("]"))))
    return _specs(spark, sf_dir).select("folder", F.size("nodes").alias("nodes"), F.array_join(listed, ";").alias("listed"))


@query("s7_node_scan", "SELECT l_returnflag AS node, count(*) AS n FROM lineitem GROUP BY 1")
def s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("node"))
    parts = [store.of_node(v, x).groupBy("node").agg(F.count("*").alias("n")) for x in ("A", "N", "R")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("s8_point_lookup", "SELECT event_id AS value_id, props AS data, event_type || '=' || event_id AS path FROM events WHERE event_id = 77 UNION ALL SELECT event_id, props, event_type || '=' || event_id FROM events WHERE event_type || '=' || event_id = 'click=1'")
def s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "events").select(F.col("event_id").alias("value_id"), F.col("props").alias("data"), J.value_path(F.col("event_type"), F.col("event_id")).alias("path"))
    return store.by_id(v, 77).unionAll(store.by_path(v, "click=1"))


@query("s9_catalog_lookup", f"""WITH {NODES_SQL}, n AS (SELECT *, type AS folder, mode AS original FROM nodes)
SELECT '17' AS asked, node_id, name, type, mode FROM n WHERE node_id = 17 UNION ALL SELECT 'red widget', node_id, name, type, mode FROM n WHERE name = 'red widget'
UNION ALL SELECT 'jq:red widget', node_id, name, type, mode FROM n WHERE name = 'red widget' AND folder = 'jq' UNION ALL SELECT 'jq:AUTO:red widget', node_id, name, type, mode FROM n WHERE name = 'red widget' AND folder = 'jq' AND original = 'AUTO'
UNION ALL SELECT 'blue widget:red widget', node_id, name, type, mode FROM n WHERE name = 'red widget' AND node_id IN (SELECT child_id FROM edges e JOIN n p ON p.node_id = e.parent_id WHERE p.name = 'blue widget')""")
def s9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every form of a name: an id, a node, a folder's node, a folder's node of another origin, and a parent's node."""
    nodes, edges = node_tables(spark, sf_dir)
    nodes = nodes.withColumns({"folder": F.col("type"), "original": F.col("mode")})
    found = [spec.find(nodes, edges, x).select(F.lit(x).alias("asked"), "node_id", "name", "type", "mode") for x in ("17", "red widget", "jq:red widget", "jq:AUTO:red widget", "blue widget:red widget")]
    return reduce(DataFrame.unionAll, found)


@query("s10_schema_paths", "SELECT event_id AS run_id, '.\"$schema\"' AS path, '\"urn:' || event_type || '\"' AS value FROM events")
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.to_json(F.struct(F.concat(F.lit("urn:"), "event_type").alias("$schema"), "value")).alias("data"))
    return docs.schema_paths(d).withColumn("path", F.expr("substring(path, 2)"))


@query("w1_fixed_threshold", """SELECT event_id AS run_id, '{"k":' || (props::JSON->>'k') || ',"type":"' || event_type || '"}' AS fingerprint, value AS range, CASE WHEN value < 2 THEN 2.0 ELSE 30.0 END AS bound,
CASE WHEN value < 2 THEN 'below' ELSE 'above' END AS direction FROM events WHERE value < 2 OR value > 30""")
def w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents -> validation -> extraction -> fingerprint -> thresholds. No shuffle."""
    good, _ = docs.validated(event_documents(spark, sf_dir))
    v = J.parsed(F.col("data"))
    d = good.withColumn("v", v).select("run_id", J.number(F.col("v"), "$.value").alias("range"), J.at(F.col("v"), "$.meta.type", "string").alias("type"), J.at(F.col("v"), "$.props.k", "int").alias("k"))
    d = d.select("run_id", J.fingerprint({"type": F.col("type"), "k": F.col("k")}).alias("fingerprint"), "range").filter(F.col("range").isNotNull())
    return fixed_threshold(d, 2.0, 30.0)


@query("p1_field_path", "SELECT event_id AS run_id, user_id AS user FROM events")
def p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.field(event_documents(spark, sf_dir), "user", "$.meta['user-id']", "bigint").select("run_id", "user")


@query("p2_iterate", f"WITH {ITEMS_SQL} SELECT l_orderkey AS run_id, idx::INT AS idx, l_partkey AS part FROM items")
def p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.iterate(order_items(spark, sf_dir), "item", F.col("items")).select("run_id", "idx", F.col("item.part").alias("part"))


@query("p3_collect_path", f"WITH {ITEMS_SQL} SELECT l_orderkey AS run_id, string_agg(l_partkey::VARCHAR, ',' ORDER BY idx) AS parts, 0 AS missing FROM items GROUP BY 1")
def p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = J.parsed(F.col("data"))
    parts = F.transform(J.at(v, "$.items", "array<variant>"), lambda x: J.at(x, "$.part", "bigint"))
    none = F.coalesce(J.at(v, "$.nothing", "array<variant>"), F.array())
    return order_documents(spark, sf_dir).select("run_id", F.array_join(parts, ",").alias("parts"), F.size(none).alias("missing"))


@query("p4_entries", """WITH o AS (SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
SELECT 'status' AS key, o_orderstatus AS text, NULL::DOUBLE AS number, count(*) AS n FROM o GROUP BY 2
UNION ALL SELECT 'total-price', NULL, o_totalprice::DOUBLE, count(*) FROM o GROUP BY 3 UNION ALL SELECT 'cust', NULL, o_custkey::DOUBLE, count(*) FROM o GROUP BY 3""")
def p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All keys, and how often each has each value."""
    e = extract.entries(order_documents(spark, sf_dir), J.at(J.parsed(F.col("data")), "$.order", "variant"))
    number = F.try_variant_get("value", "$", "double")
    text = F.when(number.isNull(), F.try_variant_get("value", "$", "string"))
    return e.groupBy("key", text.alias("text"), number.alias("number")).agg(F.count("*").alias("n"))


@query("p5_element_filter", f"WITH {ITEMS_SQL} SELECT l_orderkey AS run_id, count(*) FILTER (l_quantity > 25 AND l_returnflag <> 'N') AS n, count(*) FILTER (regexp_matches(l_returnflag, '^[ar]', 'i')) AS m FROM items GROUP BY 1")
def p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(F.filter("items", lambda x: (x["qty"] > 25) & (x["flag"] != "N"))).cast("long")
    m = F.size(F.filter("items", lambda x: x["flag"].rlike("(?i)^[ar]"))).cast("long")
    return order_items(spark, sf_dir).select("run_id", n.alias("n"), m.alias("m"))


@query("p6_length_last", f"WITH {ITEMS_SQL} SELECT l_orderkey AS run_id, count(*) AS n, arg_max(l_partkey, idx) AS last FROM items GROUP BY 1")
def p6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_items(spark, sf_dir).select("run_id", F.size("items").cast("long").alias("n"), F.element_at("items", -1)["part"].alias("last"))


@query("p7_bounded_descent", """SELECT event_id AS run_id, '$.value' AS path, value AS number, NULL AS text FROM events UNION ALL SELECT event_id, '$.meta.type', NULL, '"' || event_type || '"' FROM events
UNION ALL SELECT event_id, '$.meta."user-id"', user_id, NULL FROM events UNION ALL SELECT event_id, '$.props.k', (props::JSON->>'k')::DOUBLE, NULL FROM events""")
def p7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that lies within two steps of the root."""
    number = F.col("value").try_cast("double")
    return extract.paths(event_documents(spark, sf_dir), depth=2).select("run_id", "path", number.alias("number"), F.when(number.isNull(), F.col("value")).alias("text"))


@query("p8_type_dispatch", "SELECT event_id AS run_id, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS n FROM events")
def p8(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    data = F.when(F.col("event_id") % 2 == 0, F.to_json(F.array("value", "value"))).otherwise(F.to_json(F.struct("value")))
    return e.select(F.col("event_id").alias("run_id"), F.size(J.as_array(J.parsed(data))).alias("n"))


@query("p9_string_ops", "SELECT p_partkey AS id, p_name || '-it' AS joined, array_to_string(string_split(p_name, ' ')[1:2], '.') AS dotted, array_to_string(string_split(p_type, ' ')[1:1], '.') AS head FROM part")
def p9(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit("-it")).alias("joined"), F.array_join(F.slice(F.split("p_name", " "), 1, 2), ".").alias("dotted"), F.array_join(F.slice(F.split("p_type", " "), 1, 1), ".").alias("head"))


@query("p10_arithmetic", "SELECT o_orderkey AS id, floor(o_totalprice / 1000)::BIGINT AS thousands, round(o_totalprice * 2, 1) AS double_price, try_cast(replace(o_orderpriority[1:1], 'x', '') AS DOUBLE) AS level FROM orders")
def p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.floor(F.col("o_totalprice") / 1000).alias("thousands"), F.round(F.col("o_totalprice") * 2, 1).alias("double_price"), F.substring("o_orderpriority", 1, 1).try_cast("double").alias("level"))


@query("p11_slurp", "SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, round(greatest(l_quantity, l_tax, l_discount), 4) AS most, round(l_quantity + l_tax + l_discount, 4) AS total FROM lineitem")
def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    xs = combine.slurped("l_quantity", "l_tax", "l_discount")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.round(F.array_max(xs), 4).alias("most"), F.round(J.total(xs), 4).alias("total"))


@query("p12_inputs", "SELECT s_suppkey AS id, s_name || '|' || s_nationkey::VARCHAR AS all_inputs FROM supplier")
def p12(spark: SparkSession, sf_dir: str) -> DataFrame:
    xs = F.array("s_name", F.col("s_nationkey").cast("string"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.aggregate(xs, F.lit(""), lambda a, x: F.when(a == "", x).otherwise(F.concat(a, F.lit("|"), x))).alias("all_inputs"))


@query("p13_single_source", "SELECT event_id AS run_id, CASE WHEN (props::JSON->>'k')::INT > 50 THEN props::JSON->>'k' ELSE 'null' END AS result FROM events")
def p13(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = J.at(J.parsed(F.col("props")), "$.k", "int")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.coalesce(F.when(k > 50, k.cast("string")), F.lit("null")).alias("result"))


@query("p14_aggregates", f"WITH {ITEMS_SQL} SELECT l_orderkey AS run_id, round(sum(l_extendedprice), 2) AS total, round(avg(l_quantity), 6) AS average, count(*) AS n FROM items GROUP BY 1")
def p14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_items(spark, sf_dir).select("run_id", F.round(J.total(F.col("items.price")), 2).alias("total"), F.round(J.mean(F.col("items.qty")), 6).alias("average"), F.size("items").cast("long").alias("n"))


@query("p15_split", f"WITH {ITEMS_SQL} SELECT l_orderkey AS run_id, idx::INT AS idx, l_suppkey AS supp FROM items")
def p15(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = extract.split(order_documents(spark, sf_dir), "value", J.at(J.parsed(F.col("data")), "$.items", "variant"))
    return d.select("run_id", "idx", J.at(F.col("value"), "$.supp", "bigint").alias("supp"))


@query("p16_fingerprint", """SELECT '{"flag":"' || l_returnflag || '","status":"' || l_linestatus || '"}' AS fingerprint, count(*) AS n FROM lineitem GROUP BY 1""")
def p16(spark: SparkSession, sf_dir: str) -> DataFrame:
    fp = J.fingerprint([("status", F.col("l_returnflag")), ("flag", F.col("l_returnflag")), ("status", F.col("l_linestatus")), ("none", F.lit(None).cast("string"))])
    return table(spark, sf_dir, "lineitem").groupBy(fp.alias("fingerprint")).agg(F.count("*").alias("n"))


@query("p17_structure", f"SELECT o_orderpriority AS folder, {ORDER_TYPE_SQL} AS structure FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def p17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.structure(order_documents(spark, sf_dir)).select("folder", without_digits(F.col("structure")).alias("structure"))


@query("p18_json_path", f"WITH {ITEMS_SQL} SELECT l_orderkey AS run_id, string_agg(l_partkey::VARCHAR, ',' ORDER BY idx) FILTER (l_returnflag = 'R') AS every, count(*) AS n FROM items GROUP BY 1")
def p18(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = J.at(J.parsed(F.col("data")), "$.items", "array<variant>")
    every = F.transform(F.filter(v, lambda x: J.at(x, "$.flag", "string") == "R"), lambda x: J.at(x, "$.part", "string"))
    return order_documents(spark, sf_dir).select("run_id", F.when(F.size(every) > 0, F.array_join(every, ",")).alias("every"), F.size(v).cast("long").alias("n"))


@query("p19_path_enumeration", """SELECT event_id AS run_id, '$.value' AS path, NULL AS text, value::DOUBLE AS number FROM events
UNION ALL SELECT event_id, '$.meta.type', event_type, NULL FROM events UNION ALL SELECT event_id, '$.meta."user-id"', NULL, user_id::DOUBLE FROM events
UNION ALL SELECT event_id, '$.props.k', NULL, json_extract_string(props, '$.k')::DOUBLE FROM events""")
def p19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paths to depth 3 with what is there: a number, or a text without its quotes."""
    p = extract.paths(event_documents(spark, sf_dir))
    number = F.col("value").try_cast("double")
    text = F.when(number.isNull(), F.from_json(F.concat(F.lit('{"v":'), "value", F.lit("}")), "v string")["v"])
    return p.select("run_id", "path", text.alias("text"), number.alias("number"))


@query("p20_first_valid", "SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, CASE WHEN l_linenumber % 3 <> 0 AND l_linenumber % 2 <> 0 THEN l_quantity::VARCHAR ELSE l_returnflag END AS value FROM lineitem")
def p20(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    new = F.when(F.col("l_linenumber") % 3 != 0, F.when(F.col("l_linenumber") % 2 == 0, F.lit(float("nan"))).otherwise(q)).cast("string")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), J.first_valid(new, F.lit("NaN"), F.col("l_returnflag")).alias("value"))


@query("p21_merged_outputs", f"WITH {ITEMS_SQL} SELECT run_id, part FROM (SELECT l_orderkey AS run_id, l_partkey AS part FROM items UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM items))")
def p21(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = order_items(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), "o_custkey"), "run_id")
    return d.select("run_id", F.explode(J.merged(F.col("items.part"), F.array("o_custkey"))).alias("part"))


@query("p22_zip_records", f"WITH {ITEMS_SQL} SELECT l_orderkey AS run_id, idx::INT AS idx, l_partkey AS part, l_quantity AS qty, o_orderstatus AS status, CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE 'kept' END AS kind FROM items JOIN orders ON l_orderkey = o_orderkey")
def p22(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = extract.records(order_items(spark, sf_dir), {"part": F.col("items.part"), "qty": F.col("items.qty"), "flag": F.col("items.flag")}, ["run_id", "status"])
    return d.select("run_id", "idx", "part", "qty", "status", F.when(F.col("flag") == "R", "returned").otherwise("kept").alias("kind"))


@query("p23_derived_scalars", f"""WITH {ITEMS_SQL} SELECT l_orderkey AS run_id, round(any_value(o_totalprice) / 1000, 2) AS scaled, round(avg(l_quantity), 6) AS mean_qty, round(avg(l_discount) * 100, 6) AS guarded,
CASE WHEN any_value(o_orderstatus) = 'F' THEN round(avg(l_quantity), 6) END AS mean_f, max(l_quantity) AS most, min(l_quantity) AS least, round(max(l_extendedprice), 1) AS top, floor(any_value(o_totalprice))::BIGINT AS whole FROM items JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def p23(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("items.qty")
    return order_items(spark, sf_dir).select(
        "run_id",
        J.scaled(F.col("total"), 1000, 2).alias("scaled"),
        F.round(J.mean(q), 6).alias("mean_qty"),
        J.guarded_mean(F.col("items.disc"), 100, 6).alias("guarded"),
        F.round(J.mean_if(q, F.col("status"), "F"), 6).alias("mean_f"),
        F.array_max(q).alias("most"),
        F.array_min(q).alias("least"),
        J.greatest_of(F.col("items"), lambda x: x["price"], 1).alias("top"),
        J.whole(F.col("total").cast("string")).alias("whole"),
    )


@query("p24_number_rendering", "SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, l_quantity::BIGINT::VARCHAR AS qty FROM lineitem")
def p24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), J.js_result(J.js_number(F.col("l_quantity")), F.lit(True)).alias("qty"))


@query("p25_base64", "SELECT item_id, base64(encode(text)) AS b64, text FROM benchmark")
def p25(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.base64(F.encode("text", "UTF-8"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace(b, "\\s", "").alias("b64"), F.decode(F.unbase64(b), "UTF-8").alias("text"))


@query("p26_content_hash", "SELECT doc_id, md5(text) AS hash FROM documents")
def p26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", J.content_hash(F.col("text")).alias("hash"))


@query("p27_value_path", f"WITH {ITEMS_SQL} SELECT 'item=' || idx || ',order=0' AS path, l_orderkey AS run_id FROM items")
def p27(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = extract.iterate(order_items(spark, sf_dir), "item", F.col("items"))
    return d.select(J.value_path("item", F.col("idx"), J.value_path("order", F.lit(0))).alias("path"), "run_id")


@query("p28_view_projection", 'SELECT o_orderpriority AS "Priority", o_orderkey AS "Run", o_totalprice FROM orders')
def p28(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.view(table(spark, sf_dir, "orders"), [("o_orderkey", "Run", 2), ("o_totalprice", None, 3), ("o_orderpriority", "Priority", 1)])


@query("p29_row_preview", "SELECT doc_id, CASE WHEN text IS NULL THEN '(no data)' WHEN length(text) > 60 THEN substring(text, 1, 57) || '...' ELSE text END AS preview FROM documents")
def p29(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", J.preview(F.col("text")).alias("preview"))


@query("p32_sanitised_names", "SELECT doc_id, regexp_replace(lang || '/' || source || ' x', '[^a-zA-Z0-9_$]', '_', 'g') AS name FROM documents")
def p32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", J.sanitised(F.concat("lang", F.lit("/"), "source", F.lit(" x"))).alias("name"))


@query("p33_comparable_values", "SELECT item_id, CASE WHEN length(trim(text)) > 200 THEN 'HASH:' || md5(trim(text)) ELSE trim(text) END AS value FROM benchmark")
def p33(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", J.comparable(F.concat(F.lit('"'), "text", F.lit('"'))).alias("value"))


def _sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("idx"), "role", F.length("text").cast("double").alias("value"))
    return {"ask": c.filter("role = 'user'").drop("role"), "answer": c.filter("role = 'assistant'").drop("role"), "first": c.filter("idx = 0").drop("role")}


_J_SQL = """a AS (SELECT conv_id AS run_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, length(text) AS ask, count(*) OVER (PARTITION BY conv_id) AS na FROM conversations WHERE role = 'user'),
b AS (SELECT conv_id AS run_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, length(text) AS answer, count(*) OVER (PARTITION BY conv_id) AS nb FROM conversations WHERE role = 'assistant'),
f AS (SELECT conv_id AS run_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, length(text) AS first, count(*) OVER (PARTITION BY conv_id) AS nf FROM conversations WHERE turn = 0)"""


@query("j1_length_combination", f"WITH {_J_SQL} SELECT run_id, p::INT AS idx, ask::DOUBLE AS ask, answer::DOUBLE AS answer, first::DOUBLE AS first FROM a FULL JOIN b USING (run_id, p) FULL JOIN f USING (run_id, p)")
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combine.by_length(_sources(spark, sf_dir))


@query("j1_length_combination_all", f"""WITH {_J_SQL}, j AS (SELECT * FROM a FULL JOIN b USING (run_id, p) FULL JOIN f USING (run_id, p)),
sa AS (SELECT run_id, ask AS x FROM a WHERE na = 1), sb AS (SELECT run_id, answer AS y FROM b WHERE nb = 1), sf AS (SELECT run_id, first AS z FROM f WHERE nf = 1)
SELECT run_id, p::INT AS idx, coalesce(ask, x)::DOUBLE AS ask, coalesce(answer, y)::DOUBLE AS answer, coalesce(first, z)::DOUBLE AS first FROM j LEFT JOIN sa USING (run_id) LEFT JOIN sb USING (run_id) LEFT JOIN sf USING (run_id)""")
def j1_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combine.by_length(_sources(spark, sf_dir), scalar="All")


@query("j2_cross_combination", f"WITH {_J_SQL} SELECT run_id, (row_number() OVER (PARTITION BY run_id ORDER BY a.p, b.p, f.p) - 1)::INT AS idx, ask::DOUBLE AS ask, answer::DOUBLE AS answer, first::DOUBLE AS first FROM a JOIN b USING (run_id) JOIN f USING (run_id)")
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combine.crossed(_sources(spark, sf_dir), scalar="All").select("run_id", "idx", "ask", "answer", "first")


@query("j3_pass_through", "SELECT o_orderkey AS run_id, o_totalprice AS total, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS priority FROM orders")
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("run_id", F.col("o_orderkey"))
    return combine.passed({"total": o.select("run_id", F.col("o_totalprice").alias("value")), "priority": o.filter("o_orderstatus = 'F'").select("run_id", F.col("o_orderpriority").alias("value"))})


@query("f1_fingerprint_filter", "SELECT event_id AS run_id, event_type AS type FROM events WHERE event_type <> 'click'")
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.to_json(F.struct("event_type")).alias("fingerprint"), F.col("event_type").alias("type"))
    d = fingerprint_filter(d, "get_json_object(fingerprint, '$.event_type') <> 'click'")
    return fingerprint_filter(fingerprint_filter(d, " "), "get_json_object(fingerprint, '$.nothing') = 'x'").select("run_id", "type")
