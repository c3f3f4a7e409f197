"""Queries on pivots, sorted lists and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchtide.operators import detect, extract, lineage, maintenance, pivot, reports
from benchtide.sources import documents as docs
from benchtide.sources import outbox

from .catalog import query
from .fixtures import EDGES_SQL, ITEMS_SQL, ORDER_TYPE_SQL, event_series, order_documents, order_items, table, value_edges, without_digits


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, node, idx, value (as text): items of orders as nodes part, qty and flag."""
    d = extract.iterate(order_items(spark, sf_dir), "item", F.col("items"))
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("node"), F.col(f"item.{n}").cast("string").alias("value")) for n in ("part", "supp", "flag")])).alias("c")
    return d.select("run_id", "idx", cells).select("run_id", "c.node", "idx", "c.value")


_VALUES = f"""{ITEMS_SQL}, v AS (SELECT l_orderkey AS run_id, 'part' AS node, idx, l_partkey::VARCHAR AS value FROM items UNION ALL SELECT l_orderkey, 'supp', idx, l_suppkey::VARCHAR FROM items UNION ALL SELECT l_orderkey, 'flag', idx, l_returnflag FROM items)"""


@query("g1_grouped_values", f"""WITH {_VALUES}, c AS (SELECT run_id, node, CASE WHEN count(*) = 1 THEN '"' || any_value(value) || '"' ELSE '[' || string_agg('"' || value || '"', ',' ORDER BY idx) || ']' END AS t FROM v GROUP BY 1, 2)
SELECT run_id, '{{' || string_agg('"' || node || '":' || t, ',' ORDER BY node) || '}}' AS row FROM c GROUP BY 1""")
def g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _values(spark, sf_dir).withColumn("data", F.concat(F.lit('"'), "value", F.lit('"')))
    return pivot.grouped(v)


def _json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with data as JSON: numbers for part, texts of digits for supp, texts for flag."""
    return _values(spark, sf_dir).withColumn("data", F.when(F.col("node") == "part", F.col("value")).otherwise(pivot.quoted(F.col("value"))))


_JSON = f"""{_VALUES}, j AS (SELECT *, CASE WHEN node = 'part' THEN value ELSE '"' || value || '"' END AS data FROM v)"""


@query("g1_grouped_under", f"""WITH {_JSON}, own AS (SELECT * FROM j WHERE run_id IN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3) AND run_id IN (SELECT run_id FROM j WHERE node = 'flag' AND data = '"R"')),
c AS (SELECT run_id, node, CASE WHEN count(*) = 1 THEN any_value(data) ELSE '[' || string_agg(data, ',' ORDER BY idx) || ']' END AS t FROM own WHERE node IN ('part', 'flag') GROUP BY 1, 2),
k AS (SELECT run_id, min(CASE WHEN node = 'part' THEN data::DOUBLE END) AS a, min(CASE WHEN node = 'part' THEN data END) AS b FROM own GROUP BY 1), g AS (SELECT run_id, '{{' || string_agg('"' || node || '":' || t, ',' ORDER BY node) || '}}' AS row FROM c GROUP BY 1)
SELECT 'o' || run_id AS run_id, row, row_number() OVER (ORDER BY a, b, 'o' || run_id) AS rank FROM g JOIN k USING (run_id)""")
def g1_under(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In one call: what lies under a nation, of two nodes, where a flag is R, in the order of the parts."""
    values = _json_values(spark, sf_dir).withColumn("run_id", F.concat(F.lit("o"), F.col("run_id").cast("string")))
    return pivot.grouped_under(values, value_edges(spark, sf_dir), "n3", ("part", "flag"), {"flag": '"R"'}, "part").select("run_id", "row", "rank")


@query("g2_label_values", f"""WITH {_VALUES}, c AS (SELECT run_id, node, CASE WHEN count(*) = 1 THEN any_value(value) ELSE '[' || string_agg(value, ',' ORDER BY idx) || ']' END AS t FROM v WHERE node IN ('part', 'supp') GROUP BY 1, 2)
SELECT run_id, '{{' || string_agg('"' || node || '":' || t, ',' ORDER BY node) || '}}' AS row FROM c GROUP BY 1""")
def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _values(spark, sf_dir).filter(F.col("node").isin("part", "supp")).withColumn("data", F.col("value"))
    return pivot.grouped(v)


@query("g3_view_data", f"WITH {_VALUES} SELECT run_id, string_agg(value, ',' ORDER BY idx) FILTER (node = 'part') AS \"Parts\", string_agg(value, ',' ORDER BY idx) FILTER (node = 'flag') AS \"Flags\" FROM v GROUP BY 1")
def g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = pivot.wide(_values(spark, sf_dir), ["part", "flag"])
    w = w.select("run_id", F.array_join("part", ",").alias("part"), F.array_join("flag", ",").alias("flag"))
    return extract.view(w, [("run_id", None, None), ("flag", "Flags", 3), ("part", "Parts", 2)])


@query("p30_table_form", f"WITH {_VALUES} SELECT run_id, count(*) FILTER (node = 'flag') AS flag, count(*) FILTER (node = 'part') AS part, count(*) FILTER (node = 'supp') AS supp FROM v GROUP BY 1")
def p30(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = pivot.wide(_values(spark, sf_dir), pivot.table_columns(["supp", "part", "_hidden", "flag", "part"]))
    return w.select("run_id", *[F.size(c).cast("long").alias(c) for c in w.columns[1:]])


@query("g4_upload_counts", "SELECT c_custkey AS folder, count(o_orderkey) AS uploads FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.upload_counts(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("folder")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("folder")))


_DASH = """SELECT c_custkey AS folder, count(DISTINCT o_orderkey) AS uploads, count(DISTINCT o_orderpriority) AS nodes, count(DISTINCT CASE WHEN o_totalprice > 400000 THEN o_orderkey END) AS changes,
epoch(max(o_orderdate))::DOUBLE AS last_upload, epoch(max(CASE WHEN o_totalprice > 400000 THEN o_orderdate END))::DOUBLE AS last_change FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"""


def _dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("folder", F.col("o_custkey"))
    runs = o.select("folder", F.col("o_orderkey").alias("run_id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double").alias("created_at"))
    nodes = o.select("folder", F.col("o_orderpriority").alias("node_id"))
    changes = o.filter("o_totalprice > 400000").select("folder", F.col("o_orderkey").alias("change_id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double").alias("changed_at"))
    return reports.dashboard(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("folder")), runs, nodes, changes)


@query("g5_dashboard", _DASH)
def g5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dashboard(spark, sf_dir)


@query("j10_dashboard_joins", f"SELECT count(*) AS folders, sum(uploads)::BIGINT AS uploads, sum(changes)::BIGINT AS changes, max(last_upload) AS newest FROM ({_DASH})")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dashboard(spark, sf_dir).agg(F.count("*").alias("folders"), F.sum("uploads").alias("uploads"), F.sum("changes").alias("changes"), F.max("last_upload").alias("newest"))


@query("g7_merged_structure", f"SELECT 'all' AS all, {ORDER_TYPE_SQL} AS structure FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def g7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.structure(order_documents(spark, sf_dir).withColumn("all", F.lit("all")), by=("all",)).select("all", without_digits(F.col("structure")).alias("structure"))


@query("g8_sort_keys", f"""WITH {_JSON}, n AS (SELECT unnest(['part', 'supp', 'flag', 'none']) AS by_node), g AS (SELECT DISTINCT run_id FROM j)
SELECT by_node, g.run_id, min(CASE WHEN node = 'part' THEN data::DOUBLE END) AS sort_number, min(data) AS sort_text FROM g CROSS JOIN n LEFT JOIN j ON j.run_id = g.run_id AND node = by_node GROUP BY 1, 2""")
def g8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By numbers, by texts of digits, by texts, and by a node that no group has."""
    v = _json_values(spark, sf_dir)
    parts = [pivot.sort_keys(v, n).select(F.lit(n).alias("by_node"), "run_id", "sort_number", "sort_text") for n in ("part", "supp", "flag", "none")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query("o1_sorted_pivot", f"""WITH {_JSON}, k AS (SELECT run_id, min(CASE WHEN data[1] = '"' THEN data END) FILTER (node = 'flag' AND data <> '"N"') AS b FROM j GROUP BY 1) SELECT run_id, row_number() OVER (ORDER BY b NULLS LAST, run_id) AS rank FROM k""")
def o1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of a pivot in the order of a node; those without it come last."""
    v = _json_values(spark, sf_dir).withColumn("node", F.when((F.col("node") == "flag") & (F.col("value") == "N"), "other").otherwise(F.col("node")))
    return pivot.ranked(pivot.sort_keys(v, "flag"), *pivot.sort_order(), "run_id").select("run_id", "rank")


#: The text columns of each table.
_TEXTS = {
    "region": ["r_name"],
    "nation": ["n_name"],
    "customer": ["c_name", "c_mktsegment"],
    "supplier": ["s_name"],
    "part": ["p_name", "p_brand", "p_type"],
    "orders": ["o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_returnflag", "l_linestatus"],
    "events": ["event_type", "props"],
    "documents": ["text", "lang", "source"],
    "embeddings": [],
    "pages": ["url", "html"],
    "benchmark": ["text"],
    "labels": [],
    "conversations": ["role", "text"],
}


@query("g10_storage_profile", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows, coalesce(sum({' + '.join(f'coalesce(strlen({c}), 0)' for c in columns) or '0'}), 0)::BIGINT AS data_bytes FROM {t}" for t, columns in _TEXTS.items()))
def g10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.storage_profile({n: (table(spark, sf_dir, n), c) for n, c in _TEXTS.items()}).orderBy(F.col("data_bytes").desc())


_COMPUTED = ("orders", "lineitem", "events", "documents", "benchmark")


@query("g10_storage_ratio", "WITH p AS (" + " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows, coalesce(sum({' + '.join(f'coalesce(strlen({c}), 0)' for c in _TEXTS[t])}), 0)::BIGINT AS data_bytes, 1 AS files FROM {t}" for t in _COMPUTED) + """)
SELECT coalesce(name, 'total') AS name, sum(n_rows)::BIGINT AS n_rows, sum(data_bytes)::BIGINT AS data_bytes, sum(files)::BIGINT AS files, CASE WHEN name IS NULL THEN round(sum(data_bytes) / sum(data_bytes) FILTER (name IN ('documents', 'benchmark')), 1)::DOUBLE END AS overhead FROM p GROUP BY GROUPING SETS ((name), ())""")
def g10_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL sees a table as one file, a folder of many too; numbers and sizes of what is in it are held against the files in the tests."""
    return reports.storage_summary({n: (table(spark, sf_dir, n), _TEXTS[n]) for n in _COMPUTED}, raw=("documents", "benchmark"), whole=True).drop("stored_bytes")


@query("u3_union_of_profiles", "SELECT count(*) AS tables, sum(n)::BIGINT AS n_rows FROM (SELECT count(*) AS n FROM region UNION ALL SELECT count(*) FROM nation UNION ALL SELECT count(*) FROM customer UNION ALL SELECT count(*) FROM supplier)")
def u3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.storage_profile({n: (table(spark, sf_dir, n), []) for n in ("region", "nation", "customer", "supplier")}).agg(F.count("*").alias("tables"), F.sum("n_rows").alias("n_rows"))


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """folder, run_id, change_id, detector, detail, dispatch, detected_at: violations of two thresholds on events."""
    e = table(spark, sf_dir, "events").withColumn("range", F.col("value"))
    c = detect.fixed_threshold(e, 1.0, 20.0)
    return c.select(
        F.col("event_type").alias("folder"), F.col("user_id").alias("run_id"), F.col("event_id").alias("change_id"), F.col("direction").alias("detector"), F.concat("direction", F.lit(" "), F.format_string("%.2f", "value")).alias("detail"), (F.col("event_id") % 3 != 0).alias("dispatch"), F.col("ts").alias("detected_at")
    )


_CH = """ch AS (SELECT event_type AS folder, user_id AS run_id, event_id AS change_id, CASE WHEN value < 1 THEN 'below' ELSE 'above' END AS detector, CASE WHEN value < 1 THEN 'below' ELSE 'above' END || ' ' || printf('%.2f', value) AS detail, event_id % 3 <> 0 AS dispatch, ts AS detected_at FROM events WHERE value < 1 OR value > 20)"""


_LINES = """lines AS (SELECT user_id AS run_id, event_type || '-limit (FIXED_THRESHOLD): value=' || value || ' ' || CASE WHEN value < 1 THEN 'below' ELSE 'above' END || ' bound ' || CASE WHEN value < 1 THEN 1.0::DOUBLE ELSE 20.0::DOUBLE END
|| CASE WHEN event_id % 2 = 0 THEN ', fingerprint={"event_type":"' || event_type || '"}' ELSE '' END AS detail FROM events WHERE value < 1 OR value > 20)"""


@query("g11_change_summary", f"""WITH {_LINES} SELECT u.run_id, count(detail) AS n_changes, CASE count(detail) WHEN 0 THEN 'No changes detected.' WHEN 1 THEN '1 change detected:' || chr(10) || '  ' || min(detail) ELSE count(detail) || ' changes detected:' || chr(10) || '  ' || string_agg(detail, chr(10) || '  ' ORDER BY detail) END AS details
FROM (SELECT DISTINCT user_id AS run_id FROM events) u LEFT JOIN lines USING (run_id) GROUP BY 1""")
def g11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of each user's events; users without one are told so."""
    e = table(spark, sf_dir, "events").withColumns({"range": F.col("value"), "run_id": F.col("user_id")})
    fp = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"event_type":"'), F.col("event_type"), F.lit('"}')))
    text = reports.change_text(F.concat("event_type", F.lit("-limit")), F.lit("ft"), {"value": F.col("value"), "bound": F.col("bound"), "direction": F.col("direction")}, fp)
    return reports.change_summary(e, detect.fixed_threshold(e, 1.0, 20.0).withColumn("detail", text))


@query("p31_change_text", """SELECT event_id, event_type || CASE WHEN event_id % 11 = 0 THEN ' (' || ['FIXED_THRESHOLD', 'RELATIVE_DIFFERENCE', 'STDDEV_ANOMALY', 'EDIVISIVE', 'jq', 'unknown'][(event_id % 6 + 1)::INT] || '): no data'
WHEN event_id % 6 = 0 THEN ' (FIXED_THRESHOLD): value=' || value || ' above bound 20.0' WHEN event_id % 6 = 1 THEN ' (RELATIVE_DIFFERENCE): ratio=' || printf('%.1f', value) || '%' WHEN event_id % 6 = 2 THEN ' (STDDEV_ANOMALY): above (' || value || ' deviations)'
WHEN event_id % 6 = 3 THEN ' (EDIVISIVE): magnitude=' || printf('%.2f', value) || ', p-value=0.0500' ELSE CASE event_id % 6 WHEN 4 THEN ' (jq): ' ELSE ' (unknown): ' END || CASE WHEN strlen(j) > 80 THEN left(j, 80) || '...' ELSE j END END || CASE WHEN event_id % 3 = 0 THEN ', fingerprint={"user":' || user_id || '}' ELSE '' END AS detail
FROM (SELECT event_id, event_type, user_id, floor(value * 2) / 2 AS value, '{"type":"' || event_type || '","user":' || user_id || ',"note":"' || repeat('ab', (event_id % 40)::INT) || '"}' AS j FROM events)""")
def p31(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds, of a detector, of another node and of none, over objects short and long and over what is no object."""
    e = table(spark, sf_dir, "events").withColumn("value", F.floor(F.col("value") * 2) / 2)
    kind = F.element_at(F.array(*map(F.lit, ("ft", "rd", "sd", "ed", "jq", None))), (F.col("event_id") % 6 + 1).cast("int"))
    x = F.col("value")
    details = {"value": x, "bound": F.lit(20.0), "direction": F.lit("above"), "ratio": x, "deviations": x, "magnitude": x, "pvalue": F.lit(0.05)}
    fp = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.col("user_id").alias("user"))))
    json = F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user"), F.repeat(F.lit("ab"), (F.col("event_id") % 40).cast("int")).alias("note")))
    data = F.when(F.col("event_id") % 22 == 0, F.lit("[1]")).when(F.col("event_id") % 11 != 0, json)
    return e.select("event_id", reports.change_text(F.col("event_type"), kind, details, fp, data).alias("detail"))


@query("g12_shown", "SELECT count(*) AS n, least(count(*), 50) AS showing FROM orders")
def g12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.shown(table(spark, sf_dir, "orders"), 50)


@query("o2_newest_shown_in_order", "SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 30) ORDER BY 1")
def o2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.newest_first(table(spark, sf_dir, "orders").select("o_orderkey"), 30, key="o_orderkey").orderBy("o_orderkey")


@query("o3_newest_run", "SELECT o_custkey AS folder, max(o_orderkey) AS run_id, arg_max(o_totalprice, o_orderkey) AS total FROM orders GROUP BY 1")
def o3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("folder")).agg(F.max("o_orderkey").alias("run_id"), F.max_by("o_totalprice", "o_orderkey").alias("total"))


@query("o4_limit", "SELECT (SELECT count(*) FROM orders) AS n_all, least(25, (SELECT count(*) FROM orders)) AS n_some")
def o4(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    a, b = docs.newest_first(o, 0, key="o_orderkey").agg(F.count("*").alias("n_all")), docs.newest_first(o, 25, key="o_orderkey").agg(F.count("*").alias("n_some"))
    return a.crossJoin(b)


@query("o7_ordinal_order", f"WITH {ITEMS_SQL} SELECT l_orderkey AS run_id, string_agg(l_suppkey::VARCHAR, ',' ORDER BY idx) AS supps FROM items GROUP BY 1")
def o7(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _values(spark, sf_dir).filter("node = 'supp'")
    return v.groupBy("run_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "value"))), lambda x: x["value"]), ",").alias("supps"))


@query("o8_by_name", "SELECT n_name AS name, row_number() OVER (ORDER BY n_name) AS place FROM nation")
def o8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot.ranked(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), "name", rank="place")


@query("f2_node_filter", "SELECT l_returnflag AS node, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1")
def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin("A", "R")).groupBy(F.col("l_returnflag").alias("node")).agg(F.count("*").alias("n"))


@query("f3_fingerprint_match", "SELECT o_orderkey AS run_id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 7)")
def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs in which every (node, value) pair is found."""
    li = table(spark, sf_dir, "lineitem").withColumn("run_id", F.col("l_orderkey"))
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"))
    for pair in (F.col("l_returnflag") == "R", F.col("l_linenumber") == 7):
        runs = runs.join(li.filter(pair).select("run_id"), "run_id", "left_semi")
    return runs


@query("f4_descendants_of", f"WITH RECURSIVE {EDGES_SQL}, c AS (SELECT child_id AS id FROM value_edges WHERE parent_id = 'n3' UNION SELECT e.child_id FROM c JOIN value_edges e ON e.parent_id = c.id) SELECT o_orderkey AS run_id FROM orders WHERE 'o' || o_orderkey IN (SELECT id FROM c)")
def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that descend from a nation, however far."""
    e = value_edges(spark, sf_dir)
    under = lineage.closure(e, e.filter("child_id = 'n3'").select(F.col("child_id").alias("id"))).select("id")
    orders = table(spark, sf_dir, "orders").withColumn("id", F.concat(F.lit("o"), F.col("o_orderkey").cast("string")))
    return orders.join(under, "id", "left_semi").select(F.col("o_orderkey").alias("run_id"))


@query("f5_detection_only", "SELECT event_id FROM events WHERE CASE event_type WHEN 'click' THEN 'ft' WHEN 'view' THEN 'jq' ELSE 'sd' END IN ('ft', 'rd', 'sd', 'ed')")
def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "ft").when(F.col("event_type") == "view", "jq").otherwise("sd")
    return table(spark, sf_dir, "events").withColumn("type", kind).filter(maintenance.is_detection()).select("event_id")


@query("f6_changes_of_run", f"WITH {_CH} SELECT change_id, detail FROM ch WHERE run_id = 8 AND detector = 'above'")
def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).filter((F.col("run_id") == 8) & (F.col("detector") == "above")).select("change_id", "detail")


@query("f7_enabled_only", f"WITH {_CH} SELECT folder, count(*) AS n FROM ch WHERE dispatch GROUP BY 1")
def f7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).filter("dispatch").groupBy("folder").agg(F.count("*").alias("n"))


@query("s11_change_outbox", f"""WITH {_CH} SELECT folder, run_id, detector, count(*) AS n_changes, '[' || string_agg('{{"change_id":' || change_id || ',"detail":"' || detail || '"}}', ',' ORDER BY change_id) || ']' AS payload FROM ch GROUP BY 1, 2, 3""")
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbox.payloads(_changes(spark, sf_dir))


@query("j13_notification_routing", f"WITH {_CH}, cfg AS (SELECT DISTINCT event_type AS folder, 'ch' || (user_id % 4) AS channel, user_id % 4 < 3 AS enabled FROM events) SELECT change_id, channel FROM ch JOIN cfg USING (folder) WHERE dispatch AND enabled")
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    configs = e.select(F.col("event_type").alias("folder"), F.concat(F.lit("ch"), F.col("user_id") % 4).alias("channel"), (F.col("user_id") % 4 < 3).alias("enabled")).distinct()
    return outbox.routed(_changes(spark, sf_dir), configs).select("change_id", "channel")


@query("t7_recent_changes", f"WITH {_CH} SELECT change_id FROM ch WHERE detected_at > (SELECT max(ts) FROM events) - INTERVAL 6 HOUR")
def t7(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    return outbox.recent(_changes(spark, sf_dir), now, 360).select("change_id")


@query("t6_change_events", f"WITH {_CH} SELECT run_id, detector, count(*) AS n, count(*) FILTER (dispatch) AS dispatched FROM ch GROUP BY 1, 2")
def t6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).groupBy("run_id", "detector").agg(F.count("*").alias("n"), F.count_if("dispatch").alias("dispatched"))


@query("x3_series_function", """WITH j AS (SELECT event_type, event_id, abs(value - lag(value) OVER (PARTITION BY event_type ORDER BY epoch_us(ts), event_id)) AS jump FROM events WHERE value IS NOT NULL)
SELECT '{"event_type":"' || event_type || '"}' AS fingerprint, arg_max(event_id, struct_pack(j := jump, i := event_id)) AS value_id, max(jump) AS jump FROM j WHERE jump IS NOT NULL GROUP BY 1""")
def x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector of one's own from the registry: of each series the value that is furthest from the one before it."""
    from pyspark.sql.window import Window

    from benchtide.operators.series import order

    from .pipeline import SERIES, series_function

    if "largest_jump" not in SERIES:

        @series_function("largest_jump")
        def largest_jump(df: DataFrame) -> DataFrame:
            line = Window.partitionBy("fingerprint").orderBy(*order())
            jumps = df.filter("range IS NOT NULL").withColumn("jump", F.abs(F.col("range") - F.lag("range").over(line))).filter("jump IS NOT NULL")
            return jumps.groupBy("fingerprint").agg(F.max_by("value_id", F.struct("jump", "value_id")).alias("value_id"), F.max("jump").alias("jump"))

    return SERIES["largest_jump"](event_series(spark, sf_dir))
