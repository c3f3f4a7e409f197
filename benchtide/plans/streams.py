"""Queries that run the given tables through streams to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from benchtide.functions import jsonish as J
from benchtide.operators import detect
from benchtide.operators.lineage import shared_folder
from benchtide.streaming import audit, ingest, online, recent
from benchtide.streaming.blocks import Blocks

from .catalog import query
from .fixtures import table


def _folder(spark: SparkSession, what: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_as_folder(spark, sf_dir))


def _as_folder(spark: SparkSession, sf_dir: str) -> str:
    """The events as several files, which a stream reads one after the other."""
    path = _folder(spark, "events")
    table(spark, sf_dir, "events").repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
    return path


def _in_order(spark: SparkSession, sf_dir: str, df: DataFrame, time: str = "ts", files: int = 4) -> DataFrame:
    """df as a stream of several micro-batches in the order of time."""
    path = _folder(spark, "ordered")
    ingest.in_order(df, time, path, files)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _values(e: DataFrame) -> DataFrame:
    v = J.parsed(F.col("props"))
    return e.select(F.col("event_type").alias("folder"), F.col("event_type").alias("fingerprint"), F.col("event_id").alias("value_id"), F.col("value").alias("range"), F.unix_micros(F.col("ts").cast("timestamp")).alias("domain"), J.at(v, "$.k", "int").alias("k"))


@query("t1_continuous_ingest", "SELECT event_id AS value_id, (props::JSON->>'k')::INT AS k FROM events")
def t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "store")
    q = ingest.to_store(_values(_events(spark, sf_dir)), out, _folder(spark, "state"))
    q.awaitTermination()
    return spark.read.parquet(out).select("value_id", "k")


def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' values as a stream of four micro-batches, of which the later ones hold what belongs between and before the earlier ones' values."""
    e = _values(table(spark, sf_dir, "events")).filter("range IS NOT NULL")
    path = _folder(spark, "late")
    part = (F.col("value_id") % 50 == 7, (F.col("value_id") % 50 != 7) & (F.col("value_id") % 3 == 0), (F.col("value_id") % 50 != 7) & (F.col("value_id") % 3 == 1), (F.col("value_id") % 50 != 7) & (F.col("value_id") % 3 == 2))
    for k in (1, 3, 2, 0):
        e.filter(part[k]).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("t2_t3_cascade_detection", """WITH s AS (SELECT event_type AS t, event_id AS value_id, value AS x, avg(value) OVER b AS m, count(*) OVER b AS n FROM events WHERE value IS NOT NULL WINDOW b AS (PARTITION BY event_type ORDER BY epoch_us(ts), event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT value_id, CASE WHEN x / m < 0.5 THEN 'below' ELSE 'above' END AS direction FROM s WHERE n = 5 AND (x / m < 0.5 OR x / m > 1.5)""")
def t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches are stored by blocks, then a detector with a window runs over the blocks that they hit: the same as over all values at once."""
    blocks = Blocks(_folder(spark, "blocks"), 2_000)
    ingest.detecting_blocks(_late(spark, sf_dir), blocks, lambda df: detect.relative_difference(df, threshold=0.5), 5, _folder(spark, "state")).awaitTermination()
    return blocks.found(spark).select("value_id", F.when(F.col("ratio") < 0, "below").otherwise("above").alias("direction"))


NODES = ("kind", "k", "user")


def _computed(todo: DataFrame, docs: DataFrame) -> DataFrame:
    """The values of nodes for (folder, run_id, node)."""
    data = {"kind": F.col("folder"), "k": F.col("k").cast("string"), "user": F.col("user_id").cast("string")}
    value = F.coalesce(*[F.when(F.col("node") == n, x) for n, x in data.items()])
    return todo.join(docs.select("run_id", "k", "user_id"), "run_id").select("folder", "run_id", "node", value.alias("data"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("folder"), F.col("event_id").alias("run_id"), "user_id", J.at(J.parsed(F.col("props")), "$.k", "int").alias("k"), "ts")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("folder")).distinct().select("folder", F.explode(F.array(*map(F.lit, NODES))).alias("node"))


VALUE = "folder string, run_id long, node string, data string, batch string"


def _add(path: str, batch: str, df: DataFrame) -> None:
    df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def _interrupted(spark: SparkSession, sf_dir: str) -> tuple[str, str, DataFrame, DataFrame]:
    """Runs as crashes leave them, by run_id % 7: begun without values (0), with some (1), with all (2), completed (3), gone (4), of a folder that is gone (5), not begun (6); and a node whose recalculation was begun, and one that is gone. (log, store, runs, nodes)"""
    docs, nodes = _docs(spark, sf_dir), _nodes(spark, sf_dir)
    log, store = _folder(spark, "log"), _folder(spark, "values")
    kind = F.col("run_id") % 7
    here = docs.withColumn("folder", F.when(kind == 5, "no such folder").otherwise(F.col("folder")))
    audit.note(here.filter(kind < 6), log, "STARTED", "first", 0)
    audit.note(here.filter(kind == 3), log, "COMPLETED", "first", 0)
    audit.note(docs.select("folder").distinct().withColumn("node", F.lit("user")), log, "STARTED", "again", 1, "recalculation")
    audit.note(docs.select("folder").distinct().withColumn("node", F.lit("no such node")), log, "STARTED", "gone", 1, "recalculation")
    todo = audit.expected(docs, nodes)
    _add(store, "first", _computed(todo.filter(kind.isin(2, 3) | (kind == 1) & (F.col("node") == "k")), docs))
    return log, store, docs.filter(~kind.isin(4, 6)), nodes


def _recover(spark: SparkSession, sf_dir: str) -> tuple[str, str, DataFrame, DataFrame]:
    log, store, runs, nodes = _interrupted(spark, sf_dir)
    docs, stored = _docs(spark, sf_dir), lambda: spark.read.schema(VALUE).parquet(store).filter("batch = 'first'")
    for _ in range(2):  # a recovery that is repeated changes nothing
        audit.recover(spark, log, runs, nodes, stored, lambda todo: _computed(todo, docs), lambda df: _add(store, "recovered", df), "recovery", 2)
    return log, store, runs, nodes


@query("t8_progress", """SELECT CASE WHEN event_id % 7 = 5 THEN 'no such folder' ELSE event_type END AS folder, CASE event_id % 7 WHEN 3 THEN 'COMPLETED' ELSE 'RUNNING' END AS state, count(*) AS runs,
sum(CASE event_id % 7 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 3 ELSE 0 END)::BIGINT AS done, sum(CASE WHEN event_id % 7 IN (4, 5) THEN 0 ELSE 3 END)::BIGINT AS total FROM events WHERE event_id % 7 < 6 GROUP BY 1, 2""")
def t8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State and progress of interrupted runs."""
    log, store, runs, nodes = _interrupted(spark, sf_dir)
    found = audit.progress(audit.log(spark, log), runs, nodes, spark.read.schema(VALUE).parquet(store))
    return found.groupBy("folder", "state").agg(F.count("*").alias("runs"), F.sum("done").alias("done"), F.sum("total").alias("total"))


@query("t9_recovery", """WITH e AS (SELECT event_type AS folder, event_id AS run_id, (props::JSON->>'k') AS k, user_id, event_id % 7 AS r FROM events)
SELECT folder, run_id, 'kind' AS node, folder AS data FROM e WHERE r IN (0, 1, 2, 3) UNION ALL SELECT folder, run_id, 'k', k FROM e WHERE r IN (0, 1, 2, 3) AND k IS NOT NULL UNION ALL SELECT folder, run_id, 'user', user_id::VARCHAR FROM e WHERE r IN (0, 1, 2, 3, 5)""")
def t9_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values after recovery: each run that was begun has all of them once, what was there is not computed anew; the recalculated node has a value for every run that is there."""
    return spark.read.schema(VALUE).parquet(_recover(spark, sf_dir)[1]).select("folder", "run_id", "node", "data").distinct().filter("data IS NOT NULL")


@query("t9_states", """SELECT 'ingest' AS kind, CASE event_id % 7 WHEN 4 THEN 'REMOVED' WHEN 5 THEN 'REMOVED' ELSE 'COMPLETED' END AS state, count(*) AS n FROM events WHERE event_id % 7 < 6 GROUP BY 1, 2
UNION ALL SELECT 'recalculation', s, count(DISTINCT event_type) FROM events, (VALUES ('COMPLETED'), ('REMOVED')) v(s) GROUP BY 1, 2""")
def t9_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log after recovery: nothing runs, and what had no run, folder or node is removed."""
    return audit.states(audit.log(spark, _recover(spark, sf_dir)[0])).groupBy("kind", "state").agg(F.count("*").alias("n"))


@query("t9_restart", """SELECT node, count(*) AS n, count(DISTINCT run_id) AS runs, 'COMPLETED' AS state FROM (SELECT event_id AS run_id, unnest(['kind', 'k', 'user']) AS node FROM events) GROUP BY 1""")
def t9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of several micro-batches that fails in its second after the values were added, then is started again: nothing is lost or there twice."""
    docs, nodes = _docs(spark, sf_dir), _nodes(spark, sf_dir)
    log, store, state = _folder(spark, "log"), _folder(spark, "values"), _folder(spark, "state")
    source, failed = _folder(spark, "ordered"), []
    ingest.in_order(docs, "ts", source)

    def add(df: DataFrame, number: int) -> None:
        _add(store, str(number), df)
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("interrupted")

    for _ in range(2):
        stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(source)
        q = audit.tracked(stream, log, lambda df: _computed(audit.expected(df, nodes), df), add, state)
        try:
            q.awaitTermination()
        except StreamingQueryException:
            if not failed:
                raise
    v = spark.read.schema(VALUE).parquet(store)
    done = audit.states(audit.log(spark, log)).agg(F.max("state").alias("state"))
    return v.groupBy("node").agg(F.count("*").alias("n"), F.count_distinct("run_id").alias("runs")).crossJoin(done)  # one row


@query("t10_online_deviation", """WITH s AS (SELECT event_type AS t, event_id AS value_id, value AS x, epoch_us(ts) AS d FROM events WHERE value IS NOT NULL),
f AS (SELECT *, avg(x) OVER w AS m, stddev_samp(x) OVER w AS raw, count(x) OVER w AS n FROM s WINDOW w AS (PARTITION BY t ORDER BY d, value_id ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, CASE WHEN raw = 0 THEN greatest(abs(m) * 0.001, 1e-10) ELSE raw END AS sd FROM f WHERE n + 1 >= 10)
SELECT value_id, CASE WHEN x > m + 3 * sd THEN 'above' ELSE 'below' END AS direction FROM g WHERE x > m + 3 * sd OR x < m - 3 * sd""")
def t10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several micro-batches in the order of time; what is held between them is the window."""
    out = _folder(spark, "anomalies")
    e = table(spark, sf_dir, "events").orderBy("ts", "event_id")
    found = online.online_deviation(_values(_in_order(spark, sf_dir, e)), deviations=3.0)
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", _folder(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(out).select("value_id", "direction")


@query("s1_json_scan", "SELECT n_nationkey AS nation, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON file per nation, each a document, read back as runs."""
    from benchtide.sources.documents import json_documents

    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    counts = n.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey").agg(F.count("c_custkey").alias("customers"))
    path = _folder(spark, "documents")
    counts.select(F.col("n_nationkey").alias("nation"), "customers", F.col("n_nationkey").alias("part")).repartition("part").write.partitionBy("part").json(path)
    v = J.parsed(F.col("data"))
    return json_documents(spark, path, "nations").select(J.at(v, "$.nation", "int").alias("nation"), J.at(v, "$.customers", "bigint").alias("customers"))


@query("s6_value_sink", "SELECT l_returnflag AS node, count(*) AS n, sum(l_quantity)::BIGINT AS total FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1 UNION ALL SELECT 'N', count(*), sum(l_quantity + 1)::BIGINT FROM lineitem WHERE l_returnflag = 'N'")
def s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values appended by node; then one node's partition is overwritten, twice, and the others stay."""
    from benchtide.sources import store

    path = _folder(spark, "values")
    v = table(spark, sf_dir, "lineitem").select(F.lit("items").alias("folder"), F.col("l_returnflag").alias("node"), F.col("l_orderkey").alias("run_id"), F.col("l_quantity").alias("data"))
    store.append(v, path)
    for _ in range(2):
        store.overwrite(v.filter("node = 'N'").withColumn("data", F.col("data") + 1), path)
    return store.read(spark, path).groupBy("node").agg(F.count("*").alias("n"), F.sum("data").cast("long").alias("total"))


@query("t4_late_data", """WITH s AS (SELECT event_type AS t, event_id AS value_id, value AS x, epoch_us(ts) AS d FROM events WHERE value IS NOT NULL),
f AS (SELECT *, avg(x) OVER w AS m, stddev_samp(x) OVER w AS raw, count(x) OVER w AS n FROM s WINDOW w AS (PARTITION BY t ORDER BY d, value_id ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, CASE WHEN raw = 0 THEN greatest(abs(m) * 0.001, 1e-10) ELSE raw END AS sd FROM f WHERE n + 1 >= 10)
SELECT value_id FROM g WHERE x > m + 3 * sd OR x < m - 3 * sd""")
def t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that come in four batches, the later ones between and before the earlier ones': after each, only the blocks that it hits are detected anew."""
    blocks = Blocks(_folder(spark, "blocks"), 2_000)
    ingest.detecting_blocks(_late(spark, sf_dir), blocks, lambda df: detect.deviation(df, deviations=3.0), 40, _folder(spark, "state")).awaitTermination()
    return blocks.found(spark).select("value_id")


_CHANGED = "SELECT user_id AS run_id, event_id AS change_id, ts AS detected_at FROM events WHERE value < 1 OR value > 20"


@query("t7_recent_stream", f"""WITH ch AS ({_CHANGED}), q AS (SELECT event_id AS lookup_id, user_id AS run_id, ts AS asked_at FROM events WHERE event_id % 11 = 0),
r AS (SELECT lookup_id, q.run_id, change_id FROM q JOIN ch ON q.run_id = ch.run_id AND asked_at >= detected_at AND asked_at < detected_at + INTERVAL 10 MINUTE)
SELECT *, 'recent' AS origin FROM r UNION ALL SELECT lookup_id, q.run_id, change_id, 'stored' FROM q JOIN ch ON q.run_id = ch.run_id AND detected_at <= asked_at WHERE lookup_id NOT IN (SELECT lookup_id FROM r)""")
def t7_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups on a stream beside the changes: a change is remembered for ten minutes of event time, then found in the stored table only."""
    e = table(spark, sf_dir, "events")
    changes = e.filter("value < 1 OR value > 20").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("change_id"), F.col("ts").cast("timestamp").alias("detected_at"))
    lookups = e.filter("event_id % 11 = 0").select(F.col("event_id").alias("lookup_id"), F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("asked_at"))
    out = _folder(spark, "remembered")
    found = recent.remembered(_in_order(spark, sf_dir, lookups, "asked_at"), _in_order(spark, sf_dir, changes, "detected_at"), wait="1 day")
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", _folder(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return recent.answered(lookups, spark.read.schema(found.schema).parquet(out), changes)


@query("s11_outbox_stream", """SELECT event_type AS folder, user_id AS run_id, CASE WHEN value < 1 THEN 'below' ELSE 'above' END AS detector, event_id AS change_id, CASE WHEN value < 1 THEN 'below' ELSE 'above' END || ' ' || printf('%.2f', value) AS detail FROM events WHERE value < 1 OR value > 20""")
def s11_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of a stream whose batches are each written twice, as after a failure: every change is in one payload."""
    out = _folder(spark, "outbox")

    def twice(df: DataFrame, number: int) -> None:
        for _ in range(2):
            ingest.write_payloads(df, number, out)

    e = table(spark, sf_dir, "events").withColumn("range", F.col("value"))
    changes = detect.fixed_threshold(e, 1.0, 20.0).select(F.col("event_type").alias("folder"), F.col("user_id").alias("run_id"), F.col("direction").alias("detector"), F.col("event_id").alias("change_id"), F.concat("direction", F.lit(" "), F.format_string("%.2f", "value")).alias("detail"), "ts")
    _in_order(spark, sf_dir, changes).drop("ts").writeStream.foreachBatch(twice).option("checkpointLocation", _folder(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    listed = F.explode(F.from_json("payload", "array<struct<change_id bigint, detail string>>")).alias("c")
    return spark.read.parquet(out).select("folder", "run_id", "detector", listed).select("folder", "run_id", "detector", "c.change_id", "c.detail")


@query("u6_distinct_stream", """SELECT event_type AS folder, user_id, count(*) AS n FROM (SELECT *, lag(ts) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL GROUP BY 1, 2""")
def u6_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents repeated in one micro-batch and in later ones, within the wait: each is there once."""
    out = _folder(spark, "distinct")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("folder"), "user_id", F.md5(F.col("user_id").cast("string")).alias("content_hash"), F.col("ts").cast("timestamp").alias("ts"))
    ingest.distinct(_in_order(spark, sf_dir, e), "ts", "400 days").writeStream.format("parquet").option("path", out).option("checkpointLocation", _folder(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(e.schema).parquet(out).groupBy("folder", "user_id").agg(F.count("*").alias("n"))


@query("x6_errors_give_no_value", "SELECT event_id AS run_id FROM events WHERE event_id % 4 <> 0")
def x6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node whose evaluation fails on some rows has no value there; the others are not affected."""
    from .pipeline import Node, Pipeline

    p = Pipeline([Node("text", ("event_id", "value"), lambda event_id, value: F.when(event_id % 4 == 0, F.lit("broken")).otherwise(value.cast("string"))), Node("number", ("text",), lambda t: t.try_cast("double"))])
    return p.run(table(spark, sf_dir, "events")).filter("number IS NOT NULL").select(F.col("event_id").alias("run_id"))
