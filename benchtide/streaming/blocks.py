"""Series kept in blocks, so that late values cost what they touch and not the whole store.

A series is a row of blocks in the order (domain, value_id); each has `size` to 2 * size rows, or is its series' only one. An
index tells of each block its least and greatest place and how many rows it has. A batch of values, late or not, is joined
with the index by range; only the blocks that it hits are read, merged, split where they have grown too large, and written
under the batch's number. A detector that looks back `before` rows is then run over the hit blocks and the one behind each,
with the one before for its window; what it found there replaces what was found before.

Tables below `path`: values (by version and block), index, found and judged, of which the entries with a block's greatest
version count. A batch written again under its number replaces itself, so it may be repeated after a failure. Versions
that no longer count are left until `vacuum`. Frames: fingerprint, value_id, range, domain; a value_id that comes again
replaces its row where it lies in the same block.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from benchtide.operators.lineage import saved
from benchtide.operators.series import placed

#: Blocks' worth of rows in one block up to which one task orders them.
MANY = 16
PLACE = "struct<domain: double, value_id: bigint>"


@dataclass(frozen=True)
class Blocks:
    path: str
    size: int = 10_000

    def _read(self, spark: SparkSession, table: str, kind: str) -> DataFrame:
        """A table below path, empty before anything was written."""
        jvm = spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return spark.createDataFrame([], kind)
        return spark.read.schema(kind).parquet(f"{self.path}/{table}")

    def _write(self, df: DataFrame, table: str, batch: int, *by: str) -> None:
        df.withColumn("version", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", *by).parquet(f"{self.path}/{table}")

    def index(self, spark: SparkSession, below: int | None = None) -> DataFrame:
        """fingerprint, block, version, least, greatest, n of each block, and previous and next: its neighbours. below: as it was before that batch."""
        log = self._read(spark, "index", f"fingerprint string, block string, least {PLACE}, greatest {PLACE}, n bigint, version int")
        if below is not None:
            log = log.filter(F.col("version") < below)
        now = log.groupBy("block").agg(F.max_by(F.struct("fingerprint", "version", "least", "greatest", "n"), "version").alias("e")).select("block", "e.*")
        line = Window.partitionBy("fingerprint").orderBy("least")
        return now.withColumns({"previous": F.lag("block").over(line), "next": F.lead("block").over(line), "until": F.lead("least").over(line)})

    def _rows(self, spark: SparkSession, entries: DataFrame) -> DataFrame:
        """The rows of some blocks (block, version); only their folders are read."""
        rows = self._read(spark, "values", "fingerprint string, value_id bigint, range double, domain double, version int, block string")
        return rows.join(F.broadcast(entries.select("block", "version")), ["block", "version"]).drop("version")

    def merge(self, new: DataFrame, batch: int) -> DataFrame:
        """Adds a batch of values; gives the blocks that it wrote: block, rows read for it."""
        spark = new.sparkSession
        place = F.struct(F.col("domain").cast("double").alias("domain"), F.col("value_id").cast("bigint").alias("value_id"))
        new = saved(new.select("fingerprint", F.col("value_id").cast("bigint").alias("value_id"), F.col("range").cast("double").alias("range"), F.col("domain").cast("double").alias("domain")).dropDuplicates(["fingerprint", "value_id"]))
        index = saved(self.index(spark, batch))
        at = (F.col("n.fingerprint") == F.col("i.fingerprint")) & (F.col("i.previous").isNull() | (F.col("n.place") >= F.col("i.least"))) & (F.col("i.until").isNull() | (F.col("n.place") < F.col("i.until")))
        own = F.coalesce(F.col("i.block"), F.hex(F.xxhash64("n.fingerprint")))
        dealt = saved(new.withColumn("place", place).alias("n").join(index.alias("i"), at, "left").select("n.fingerprint", "n.value_id", "n.range", "n.domain", own.alias("block")))
        hit = index.join(dealt.select("block").distinct(), "block", "left_semi")
        old = self._rows(spark, hit)
        both = old.join(dealt.select("fingerprint", "block", "value_id"), ["fingerprint", "block", "value_id"], "left_anti").unionByName(dealt)
        sizes = saved(both.groupBy("block").agg(F.count("*").alias("_n")))
        if sizes.filter(F.col("_n") > MANY * self.size).isEmpty():
            lined = both.withColumn("place", F.row_number().over(Window.partitionBy("fingerprint", "block").orderBy("domain", "value_id")))
        else:  # a batch that fills one block many times over is ordered in many tasks
            lined = placed(both, ("fingerprint", "block"))
        part = F.least(F.expr(f"(place - 1) div {self.size}"), F.greatest(F.expr(f"_n div {self.size}") - 1, F.lit(0)))
        part = F.when(F.col("_n") < 2 * self.size, 0).otherwise(part)
        cut = lined.join(sizes, "block").withColumn("block", F.when(part == 0, F.col("block")).otherwise(F.concat_ws("-", "block", F.lit(batch), part))).select("fingerprint", "value_id", "range", "domain", "block")
        self._write(cut, "values", batch, "block")
        entry = self._rows_of(spark, batch).groupBy("block").agg(F.first("fingerprint").alias("fingerprint"), F.min(place).alias("least"), F.max(place).alias("greatest"), F.count("*").alias("n"))
        self._write(entry, "index", batch)
        return saved(self._read(spark, "index", f"fingerprint string, block string, least {PLACE}, greatest {PLACE}, n bigint, version int").filter(F.col("version") == batch).select("block")).crossJoin(hit.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_read")))  # one row

    def _rows_of(self, spark: SparkSession, batch: int) -> DataFrame:
        return self._read(spark, "values", "fingerprint string, value_id bigint, range double, domain double, version int, block string").filter(F.col("version") == batch)

    def detect(self, touched: DataFrame, batch: int, detector: Callable[[DataFrame], DataFrame], before: int) -> int:
        """Runs a detector over touched blocks and the one behind each, and stores what it finds; gives the number of rows it read. detector keeps the columns it is given."""
        if before > self.size:
            raise ValueError("a window has to fit into one block")
        spark = touched.sparkSession
        index = saved(self.index(spark, batch + 1))
        own = index.join(touched.select("block").distinct(), "block", "left_semi")
        targets = saved(own.select("block").union(own.select("next").filter("next IS NOT NULL")).distinct())
        ahead = index.join(targets, "block", "left_semi").select(F.col("previous").alias("block")).filter("block IS NOT NULL").distinct().join(targets, "block", "left_anti")
        entries = saved(index.join(targets.withColumn("own", F.lit(True)).unionAll(ahead.withColumn("own", F.lit(False))), "block").select("block", "version", "n", "own"))
        rows = self._rows(spark, entries).join(F.broadcast(entries.select("block", "own")), "block")
        found = detector(rows).filter("own").drop("own")
        self._write(found, "found", batch, "block")
        self._write(targets, "judged", batch)
        return entries.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def values(self, spark: SparkSession) -> DataFrame:
        return self._rows(spark, self.index(spark))

    def found(self, spark: SparkSession) -> DataFrame:
        """What the detector has found last in each block."""
        judged = self._read(spark, "judged", "block string, version int").groupBy("block").agg(F.max("version").alias("version"))
        return spark.read.parquet(f"{self.path}/found").join(judged, ["block", "version"]).drop("block", "version")

    def vacuum(self, spark: SparkSession) -> int:
        """Deletes the folders of versions of blocks that no longer count; gives their number. To be run between batches."""
        now = {(r.version, r.block) for r in self.index(spark).select("version", "block").toLocalIterator()}  # names of blocks only
        jvm, gone = spark._jvm, 0
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/values")
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        for version in fs.listStatus(root):
            if version.isDirectory():
                number = int(version.getPath().getName().rpartition("=")[2])
                for block in fs.listStatus(version.getPath()):
                    if block.isDirectory() and (number, block.getPath().getName().rpartition("=")[2]) not in now:
                        gone += fs.delete(block.getPath(), True)
        return gone
