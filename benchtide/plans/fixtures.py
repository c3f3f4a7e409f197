"""The given tables in the roles of the data model: run documents, series, values and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEMS = "array<struct<line int, part bigint, supp bigint, qty double, price double, disc double, flag string, status string>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, folder, created_at, data: one JSON document per event."""
    e = table(spark, sf_dir, "events")
    data = F.to_json(F.struct(F.col("value"), F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user-id")).alias("meta"), F.from_json("props", "k int").alias("props")))
    return e.select(F.col("event_id").alias("run_id"), F.col("event_type").alias("folder"), F.col("ts").alias("created_at"), data.alias("data"))


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, folder, created_at, data: one JSON document per order with its items, by line, part and price."""
    li = table(spark, sf_dir, "lineitem")
    item = F.struct(
        F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("price"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("qty"), F.col("l_discount").alias("disc"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")
    )
    items = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    data = F.to_json(F.struct(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total-price"), F.col("o_custkey").alias("cust")).alias("order"), F.col("items")))
    o = table(spark, sf_dir, "orders").join(items, "o_orderkey")
    return o.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("folder"), F.col("o_orderdate").alias("created_at"), data.alias("data"))


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, total, items: the same as columns of declared types."""
    d = order_documents(spark, sf_dir)
    parsed = F.from_json("data", f"`order` struct<status string, `total-price` double, cust bigint>, items {ITEMS}")
    return d.select("run_id", "folder", parsed.alias("d")).select("run_id", "folder", F.col("d.order.status").alias("status"), F.col("d.order.`total-price`").alias("total"), F.col("d.items").alias("items"))


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fingerprint, value_id, range, domain: the values of each type of event in the order of time."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit('{"event_type":"'), F.col("event_type"), F.lit('"}')).alias("fingerprint"), F.col("event_id").alias("value_id"), F.col("value").alias("range"), F.unix_micros(F.col("ts").cast("timestamp")).alias("domain"), F.col("user_id"))


def value_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """child_id, parent_id of region -> nation -> customer -> order, and of line items under orders, parts and suppliers."""
    n, c, o, li = (table(spark, sf_dir, x) for x in ("nation", "customer", "orders", "lineitem"))

    def ident(kind: str, column: str):
        return F.concat(F.lit(kind), F.col(column).cast("string"))

    item = F.concat_ws("-", ident("l", "l_orderkey"), F.col("l_linenumber").cast("string"))
    pairs = [
        n.select(ident("n", "n_nationkey"), ident("r", "n_regionkey")),
        c.select(ident("c", "c_custkey"), ident("n", "c_nationkey")),
        o.select(ident("o", "o_orderkey"), ident("c", "o_custkey")),
        li.select(item, ident("o", "l_orderkey")),
        li.select(item, ident("p", "l_partkey")),
        li.select(item, ident("s", "l_suppkey")),
    ]
    out = pairs[0]
    for p in pairs[1:]:
        out = out.unionAll(p)
    return out.toDF("child_id", "parent_id").distinct()


def node_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes: node_id, name, type, mode; edges: child_id, parent_id): a graph over the parts, with two sources for most."""
    p = table(spark, sf_dir, "part")
    kinds = F.array(*[F.lit(x) for x in ("jq", "js", "split", "fp", "ft", "rd", "sd", "jq", "js")])
    modes = F.array(*[F.lit(x) for x in ("AUTO", "DISCARD", "KEEP", "AUTO")])
    kind = F.when(F.col("p_partkey") == 0, "root").otherwise(F.element_at(kinds, (F.col("p_size") % 9 + 1).cast("int")))
    nodes = p.select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("name"), kind.alias("type"), F.element_at(modes, (F.col("p_partkey") % 4 + 1).cast("int")).alias("mode"))
    some = p.filter("p_partkey > 0")
    edges = some.select(F.col("p_partkey").alias("child_id"), F.floor((F.col("p_partkey") - 1) / 2).alias("parent_id")).unionAll(some.select(F.col("p_partkey"), F.floor(F.col("p_partkey") / 3))).distinct()
    return nodes, edges


#: The same as SQL.
NODES_SQL = """nodes AS (SELECT p_partkey AS node_id, p_name AS name,
  CASE WHEN p_partkey = 0 THEN 'root' ELSE ['jq','js','split','fp','ft','rd','sd','jq','js'][p_size % 9 + 1] END AS type,
  ['AUTO','DISCARD','KEEP','AUTO'][p_partkey % 4 + 1] AS mode FROM part),
edges AS (SELECT p_partkey AS child_id, (p_partkey - 1) // 2 AS parent_id FROM part WHERE p_partkey > 0
  UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 0)"""

EDGES_SQL = """value_edges AS (
  SELECT 'n' || n_nationkey AS child_id, 'r' || n_regionkey AS parent_id FROM nation
  UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders
  UNION SELECT 'l' || l_orderkey || '-' || l_linenumber, 'o' || l_orderkey FROM lineitem
  UNION SELECT 'l' || l_orderkey || '-' || l_linenumber, 'p' || l_partkey FROM lineitem
  UNION SELECT 'l' || l_orderkey || '-' || l_linenumber, 's' || l_suppkey FROM lineitem)"""

ITEMS_SQL = """items AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS idx
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))"""

_ITEM = {"disc": "l_discount", "flag": "l_returnflag", "line": "l_linenumber", "part": "l_partkey", "price": "l_extendedprice", "qty": "l_quantity", "status": "l_linestatus", "supp": "l_suppkey"}
_ORDER = {"cust": "o_custkey", "status": "o_orderstatus", "`total-price`": "o_totalprice"}


def _types_sql(fields: dict[str, str]) -> str:
    """The fields' types as SQL finds them in the rows' JSON."""
    kind = "CASE max(json_type(to_json({c}))) WHEN 'VARCHAR' THEN 'STRING' WHEN 'DOUBLE' THEN 'DECIMAL' ELSE 'BIGINT' END"
    return " || ', ' || ".join(f"'{name}: ' || {kind.format(c=c)}" for name, c in fields.items())


#: SQL for the merged type of order documents in a group of lineitem joined with orders, without the digits of its numbers.
ORDER_TYPE_SQL = f"'OBJECT<items: ARRAY<OBJECT<' || {_types_sql(_ITEM)} || '>>, order: OBJECT<' || {_types_sql(_ORDER)} || '>>'"


def without_digits(structure: Column) -> Column:
    """How many digits a number has depends on the rows."""
    return F.regexp_replace(structure, r"\([0-9]+,[0-9]+\)", "")
