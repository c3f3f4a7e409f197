"""Exact dedup by a heavy-hitter split, in DataFrame functions only.

Misra-Gries counters find the digests that may belong to a large share of the rows. Their winners, verified by an
exact count, are few by construction and are broadcast, so the rows of large groups are settled where they are read.
All other digests meet in an ordinary shuffle, whose groups are smaller than `support` of the rows.

Defined results: a null text equals an empty text. Of rows with equal texts the one with the largest doc_id stays; a
null doc_id counts as the smallest, and of repeated rows with that doc_id exactly one stays. An empty table gives an
empty result. Other columns of the input play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import cut, fresh, table

#: Misra-Gries keeps 1/SUPPORT counters; every digest with more than SUPPORT of the rows is found, so at most 1/SUPPORT winners are broadcast.
SUPPORT = 0.0005
#: Keys of rows that go, in a broadcast: 16 MB of them.
LOSERS = 1_000_000


def digest(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)


def winners(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Of digests(doc_id, digest, row): the verified frequent digests with the row that stays and their number of rows; at most 1/support rows."""
    candidates = digests.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    best = F.max(F.struct("doc_id", "row")).alias("best")
    return digests.join(F.broadcast(candidates), "digest").groupBy("digest").agg(best, F.count("*").alias("n")).filter("n > 1")


def _digests(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), digest(text).alias("digest"), F.monotonically_increasing_id().alias("row"))


def decisions(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", support: float = SUPPORT) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = cut(_digests(docs, text, doc_id))  # so that the row numbers are the same wherever they are read
    frequent = F.broadcast(winners(rows, support))
    hot = rows.join(frequent, "digest")
    cold = rows.join(frequent, "digest", "left_anti")
    group = W.Window.partitionBy("digest")
    cold = cold.select("*", F.max(F.struct("doc_id", "row")).over(group).alias("best"), F.count("*").over(group).alias("n"))
    return hot.unionByName(cold).select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("best.row") == F.col("row")).alias("kept"), F.col("digest").alias("text_sha256"))


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", support: float = SUPPORT, most: int = LOSERS) -> DataFrame:
    """The rows of docs that stay, with docs' own columns. Only digests and ids are shuffled; rows of large groups go by the broadcast winners, others by keys of 128 bits of (digest, doc_id), broadcast up to `most` of them and joined by a shuffle beyond. Rows repeated with the doc_id that stays meet in a shuffle, with their texts; no other row does."""
    d, id_, a, b = (fresh(docs, n) for n in ("digest", "own_id", "key_a", "key_b"))
    own = F.col(f"`{doc_id}`")
    marked = docs.select("*", digest(f"`{text}`").alias(d), own.alias(id_))
    each = marked.groupBy(d, id_).agg(F.count("*").alias("n"))
    candidates = marked.stat.freqItems([d], support).select(F.explode(f"{d}_freqItems").alias(d))
    most_id = F.max(F.struct(F.col(id_), "n")).alias("best")
    hot = cut(marked.join(F.broadcast(candidates), d).groupBy(d, id_).agg(F.count("*").alias("n")).groupBy(d).agg(most_id, F.sum("n").alias("rows")).filter("rows > 1").select(d, "best").repartition(1))  # 1/support rows at most
    keys = [F.xxhash64(d, id_, F.col(id_).isNull()).alias(a), F.conv(F.left(F.col(d), F.lit(15)), 16, 10).cast("long").alias(b)]
    cold = each.join(F.broadcast(hot.select(d)), d, "left_anti")
    cold = cold.select(d, id_, "n", F.max(F.struct(F.col(id_), "n")).over(W.Window.partitionBy(d)).alias("best"))
    stays = F.col(id_).eqNullSafe(F.col("best")[id_])
    settled = cut(cold.filter(~stays | (F.col("n") > 1)).select(*keys, stays.alias("again")))
    losers, again = settled.filter("NOT again").select(a, b), settled.filter("again").select(a, b)
    again = again.unionAll(hot.filter("best.n > 1").select(d, F.col("best")[id_].alias(id_)).select(*keys))
    best = F.broadcast(hot.select(F.col(d), F.col("best")[id_].alias("best"), F.lit(True).alias("hot")))
    left = marked.alias("m").join(best.alias("w"), d, "left").filter(F.col("w.hot").isNull() | F.col(f"m.{id_}").eqNullSafe(F.col("w.best"))).select("m.*", *keys)
    left = left.join(F.broadcast(losers) if losers.count() <= most else losers, [a, b], "left_anti")
    repeats = again.count()
    if repeats:
        again = F.broadcast(again) if repeats <= most else again
        left = left.join(again, [a, b], "left_anti").unionByName(left.join(again, [a, b], "left_semi").dropDuplicates([a, b]))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
