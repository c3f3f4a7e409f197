"""Queries on series: retrieval, windows, change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchtide.operators import detect, series

from .catalog import query
from .fixtures import event_series, table

_S = "s AS (SELECT event_type AS t, event_id AS value_id, value AS x, epoch_us(ts) AS d FROM events)"


@query("j4_series_join", """SELECT o_orderpriority AS fingerprint, l_orderkey AS run_id, l_linenumber AS line, l_partkey AS part, l_extendedprice AS range, epoch(o_orderdate)::BIGINT AS domain FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    fp = o.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("fingerprint"))
    rng = li.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("range"))
    dom = o.select(F.col("o_orderkey").alias("run_id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("domain"))
    return series.matched(fp, rng, dom).select("fingerprint", "run_id", "line", "part", "range", "domain")


def _around_sql(op: str, way: str) -> str:
    return f"""WITH {_S}, p AS (SELECT t, min(d) + 86400000000 * 5 AS pivot_at FROM s GROUP BY t UNION ALL SELECT t, max(d) - 86400000000 FROM s GROUP BY t),
r AS (SELECT t, pivot_at, value_id, row_number() OVER (PARTITION BY t, pivot_at ORDER BY d {way}, value_id {way}) AS rank FROM s JOIN p USING (t) WHERE d {op} pivot_at) SELECT t AS type, pivot_at, value_id, rank FROM r WHERE rank <= 7"""


def _around(spark: SparkSession, sf_dir: str, preceding: bool) -> DataFrame:
    s = event_series(spark, sf_dir)
    s = s.withColumn("fingerprint", F.get_json_object("fingerprint", "$.event_type"))
    ends = s.groupBy("fingerprint").agg(F.min("domain").alias("a"), F.max("domain").alias("b"))
    pivots = ends.select("fingerprint", F.explode(F.array(F.col("a") + 86_400_000_000 * 5, F.col("b") - 86_400_000_000)).alias("pivot"))
    return series.around(s, pivots, 7, preceding).select(F.col("fingerprint").alias("type"), F.col("pivot").alias("pivot_at"), "value_id", F.col("rank").cast("long").alias("rank"))


@query("j5_preceding", _around_sql("<=", "DESC"))
def j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _around(spark, sf_dir, True)


@query("j5_following", _around_sql(">=", "ASC"))
def j5_following(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _around(spark, sf_dir, False)


@query("j17_domain_at_change", f"WITH {_S} SELECT value_id, d AS domain FROM s WHERE x > 25")
def j17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.fixed_threshold(event_series(spark, sf_dir), most=25, most_inclusive=True).select("value_id", "domain")


_RD = """WITH s AS (SELECT event_type AS t, event_id AS value_id, value AS x, epoch_us(ts) AS d FROM events),
f AS (SELECT t, value_id, d, count(x) OVER a AS n, avg(x) OVER b AS m, {one}(x) OVER c AS v, list(x) OVER e AS old FROM s
 WINDOW a AS (PARTITION BY t ORDER BY d, value_id ROWS BETWEEN {last} PRECEDING AND CURRENT ROW), b AS (PARTITION BY t ORDER BY d, value_id ROWS BETWEEN {last} PRECEDING AND {w} PRECEDING),
 c AS (PARTITION BY t ORDER BY d, value_id ROWS BETWEEN {w1} PRECEDING AND CURRENT ROW), e AS (PARTITION BY t ORDER BY d, value_id ROWS BETWEEN {last} PRECEDING AND {p} PRECEDING))
SELECT value_id, d AS domain, old[{w}] AS previous, coalesce(list_filter(list_reverse(old), lambda z: CASE WHEN v / m < 1 THEN z < m ELSE z > m END)[1], old[1]) AS last, round(v, 6) AS value, round(100 * (v / m - 1), 6) AS ratio
FROM f WHERE n = {last} + 1 AND (v / m < 1 - {t} OR v / m > 1 + {t})"""


def _rd(spark: SparkSession, sf_dir: str, **config) -> DataFrame:
    d = detect.relative_difference(event_series(spark, sf_dir), **config)
    return d.select("value_id", "domain", "previous", "last", F.round("value", 6).alias("value"), F.round("ratio", 6).alias("ratio"))


@query("w2_relative_difference", _RD.format(one="avg", last=5, w=1, w1=0, p=5, t=0.2))
def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rd(spark, sf_dir)


@query("w3_change_localisation", _RD.format(one="max", last=11, w=5, w1=4, p=7, t=0.5))
def w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rd(spark, sf_dir, filter="max", window=5, min_previous=7, threshold=0.5)


@query("w4_cool_down", f"""WITH RECURSIVE p AS (SELECT event_type AS t, event_id AS value_id, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts), event_id) AS place FROM events),
r AS (SELECT t, value_id, domain, place, ratio FROM p JOIN ({_RD.format(one="avg", last=5, w=1, w1=0, p=5, t=0.5)}) USING (value_id)),
k AS (SELECT t, min(place) AS place FROM r GROUP BY 1 UNION ALL SELECT k.t, min(r.place) FROM k JOIN r ON r.t = k.t AND r.place >= k.place + 6 GROUP BY 1)
SELECT '{{"event_type":"' || t || '"}}' AS fingerprint, value_id, domain, place, ratio FROM r JOIN k USING (t, place)""")
def w4(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series.placed(event_series(spark, sf_dir))
    d = detect.relative_difference(s, threshold=0.5).select("fingerprint", "value_id", "domain", F.col("place").cast("long").alias("place"), F.round("ratio", 6).alias("ratio"))
    return detect.cool_down(d, 5)


@query("w5_deviation", """WITH s AS (SELECT event_type AS t, event_id AS value_id, value AS x, epoch_us(ts) AS d FROM events WHERE value IS NOT NULL),
f AS (SELECT *, avg(x) OVER w AS m, stddev_samp(x) OVER w AS raw, count(x) OVER w AS n FROM s WINDOW w AS (PARTITION BY t ORDER BY d, value_id ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, CASE WHEN raw = 0 THEN greatest(abs(m) * 0.001, 1e-10) ELSE raw END AS sd FROM f WHERE n + 1 >= 10 AND n >= 2)
SELECT value_id, round(m, 6) AS mean, round(sd, 6) AS stddev, CASE WHEN x > m + 3 * sd THEN 'above' ELSE 'below' END AS direction, round(abs(x - m) / sd, 6) AS deviations FROM g WHERE x > m + 3 * sd OR x < m - 3 * sd""")
def w5(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detect.deviation(event_series(spark, sf_dir), deviations=3.0)
    return d.select("value_id", F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"), "direction", F.round("deviations", 6).alias("deviations"))


@query("w6_change_points")
def w6(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_series(spark, sf_dir)
    users = s.withColumn("fingerprint", F.to_json(F.struct("fingerprint", (F.col("user_id") % 50).alias("user_group")))).withColumn("domain", F.col("domain").cast("string"))
    return detect.e_divisive(users, window=30, most_p=0.05)


_LEVELS = """k AS (SELECT c_custkey, c_custkey % 4 AS kind, 100 + c_custkey % 50 AS level FROM customer), n AS (SELECT range AS i FROM range(30)),
v AS (SELECT c_custkey, kind, i, level * CASE WHEN kind = 3 AND i >= 20 THEN 0.5 WHEN kind >= 2 AND i >= 10 THEN 2.0 ELSE 1.0 END + i % 3 AS x FROM k, n),
s AS (SELECT c_custkey, kind, i // 10 AS part, avg(x) AS m FROM v WHERE kind >= 2 GROUP BY 1, 2, 3)"""


@query("w6_known_changes", f"""WITH {_LEVELS} SELECT b.c_custkey::VARCHAR AS fingerprint, b.part * 10 AS index, round(CASE WHEN a.kind = 2 AND b.part = 1 THEN a.m ELSE a.m END, 6) AS mean_before,
round(CASE WHEN b.kind = 2 THEN (SELECT avg(x) FROM v WHERE v.c_custkey = b.c_custkey AND i >= 10) ELSE b.m END, 6) AS mean_after FROM s a JOIN s b ON a.c_custkey = b.c_custkey AND b.part = a.part + 1 WHERE b.kind = 3 OR b.part = 1""")
def w6_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series for each customer, flat, with too few values, with one step or with two, at places that are known."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("fingerprint"), (F.col("c_custkey") % 4).alias("kind"), (100 + F.col("c_custkey") % 50).alias("level"), F.explode(F.sequence(F.lit(0), F.lit(29))).alias("domain"))
    factor = F.when((F.col("kind") == 3) & (F.col("domain") >= 20), 0.5).when((F.col("kind") >= 2) & (F.col("domain") >= 10), 2.0).otherwise(1.0)
    s = c.filter("kind <> 1 OR domain < 3").select("fingerprint", (F.col("level") * factor + F.col("domain") % 3).cast("double").alias("range"), "domain", F.col("domain").cast("long").alias("value_id"))
    return detect.e_divisive(s, window=5, most_p=0.001).select("fingerprint", F.col("index").cast("long").alias("index"), F.round("mean_before", 6).alias("mean_before"), F.round("mean_after", 6).alias("mean_after"))


@query("w7_hazard", "SELECT o_orderpriority AS p, round(ln(avg(o_totalprice) FILTER (o_orderstatus = 'F') / avg(o_totalprice) FILTER (o_orderstatus = 'O')), 9) AS hazard FROM orders GROUP BY 1")
def w7(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("p")).agg(F.avg(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))).alias("a"), F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("b"))
    return g.select("p", F.round(detect.hazard(F.col("a"), F.col("b")), 9).alias("hazard"))


@query("w8_most_recent", f"WITH {_S}, r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY d DESC, value_id DESC) AS k FROM s), m AS (SELECT * FROM r WHERE k <= 50) SELECT value_id, row_number() OVER (PARTITION BY t ORDER BY k DESC) AS place FROM m")
def w8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.newest(event_series(spark, sf_dir), 50).select("value_id", F.col("place").cast("long").alias("place"))


def _changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored changes, those found by a later pass with another bound, and its scope."""
    s = event_series(spark, sf_dir).select("fingerprint", "value_id", "range", "domain", "user_id")
    return detect.fixed_threshold(s, most=20), detect.fixed_threshold(s, most=25), s.filter("user_id % 2 = 0")


@query("w9_stale_removed", "SELECT event_id AS value_id FROM events WHERE value > 20 AND NOT (user_id % 2 = 0 AND value <= 25)")
def w9(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, found, scope = _changes(spark, sf_dir)
    return detect.without_stale(stored, found.filter("user_id % 2 = 0"), scope, ("fingerprint", "value_id")).select("value_id")


@query("w10_replaced_at_domain", "SELECT event_id AS value_id, CASE WHEN user_id % 2 = 0 THEN 25.0 ELSE 20.0 END AS bound FROM events WHERE CASE WHEN user_id % 2 = 0 THEN value > 25 ELSE value > 20 END")
def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, found, scope = _changes(spark, sf_dir)
    return detect.replaced(stored, found.filter("user_id % 2 = 0"), scope, ("fingerprint", "domain", "value_id", "user_id")).select("value_id", "bound")  # several events may have one domain


@query("w11_window_replaced", f"""WITH {_S}, r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY d DESC, value_id DESC) AS k FROM s) SELECT value_id, CASE WHEN k <= 100 THEN 25.0 ELSE 20.0 END AS bound FROM r WHERE CASE WHEN k <= 100 THEN x > 25 ELSE x > 20 END""")
def w11(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_series(spark, sf_dir).drop("user_id")
    recent = series.newest(s, 100).drop("place")
    return detect.replaced(detect.fixed_threshold(s, most=20), detect.fixed_threshold(recent, most=25), recent, ("value_id",)).select("value_id", "bound")


@query("w12_contributing_series", "SELECT event_type AS type, count(*) AS n FROM events WHERE event_type IN (SELECT event_type FROM events WHERE user_id = 8) GROUP BY 1")
def w12(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_series(spark, sf_dir)
    return detect.contributing(s, s.filter("user_id = 8")).groupBy(F.get_json_object("fingerprint", "$.event_type").alias("type")).agg(F.count("*").alias("n"))


@query("f8_numeric_only", "WITH s AS (SELECT event_type AS t, event_id AS value_id, CASE WHEN event_id % 7 <> 0 THEN value END AS x, epoch_us(ts) AS d FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY d DESC, value_id DESC) AS k FROM s) SELECT value_id, x AS range FROM r WHERE k <= 30 AND x IS NOT NULL")
def f8(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_series(spark, sf_dir).withColumn("range", F.when(F.col("value_id") % 7 != 0, F.col("range")))
    return series.newest(s, 30).filter("range IS NOT NULL").select("value_id", "range")


@query("o5_domain_page", f"WITH {_S}, r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY d, value_id) AS place FROM s) SELECT value_id, place FROM r WHERE place > 10 AND place <= 25")
def o5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.page(event_series(spark, sf_dir), 15, 10).select("value_id", F.col("place").cast("long").alias("place"))


@query("o6_created_order", "WITH r AS (SELECT o_orderkey AS value_id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS place FROM orders) SELECT * FROM r WHERE place <= 20")
def o6(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("fingerprint"), F.col("o_orderkey").alias("value_id"), F.col("o_orderdate").alias("created_at"))
    return series.page(o, 20, 0, domain=None).select("value_id", F.col("place").cast("long").alias("place"))
