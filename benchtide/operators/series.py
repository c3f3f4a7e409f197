"""Series: the values of a node by fingerprint, in the order of a domain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from benchtide.operators.lineage import saved

#: Rows in a block of a series, and rows of a series up to which one task takes it whole; see in_blocks.
BLOCK, HOT = 10_000, 1_000_000
#: Keys of hot series that may be broadcast.
FEW = 100_000


def order(domain: str | None = "domain", ident: str = "value_id", created: str = "created_at", descending: bool = False) -> list[Column]:
    """Sort columns: the domain's number (nulls last), its text, then the id; without a domain the time of creation."""
    if domain is None:
        keys = [F.col(created), F.col(ident)]
    else:
        number = F.col(domain).try_cast("double")
        keys = [number, F.when(number.isNull(), F.col(domain).cast("string")), F.col(ident)]
    return [k.desc_nulls_last() if descending else k.asc_nulls_last() for k in keys]


def matched(fingerprints: DataFrame, ranges: DataFrame, domains: DataFrame | None, group: Sequence[str] = ("run_id",)) -> DataFrame:
    """All series at once: each range value with every fingerprint, and the domain values, of the same group. Frames: group keys and fingerprint; value_id, range; domain."""
    out = fingerprints.join(ranges, list(group))
    return out if domains is None else out.join(domains, list(group), "left")


def ranked(df: DataFrame, *order: Column | str, rank: str = "rank") -> DataFrame:
    """df with each row's place in an order, from 1. Ranges are sorted side by side; what leaves the executors is one count for each range."""
    placed = saved(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(rank, F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_m", "_part", "_before")


def placed(df: DataFrame, by: Sequence[str] = ("fingerprint",), domain: str | None = "domain", ident: str = "value_id") -> DataFrame:
    """place: each row's place in its series, from 1. However long, no series is sorted in one task."""
    rows = ranked(df, *by, *order(domain, ident), rank="_rank")
    ahead = rows.groupBy(*by).agg((F.min("_rank") - 1).alias("_ahead"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    joined = rows.alias("a").join(ahead.alias("b"), same)
    return joined.select("a.*", (F.col("_rank") - F.col("_ahead")).alias("place")).drop("_rank")


def hot(df: DataFrame, by: Sequence[str], most: int) -> DataFrame:
    """The keys of series with more than `most` rows."""
    return df.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(*by)


def in_blocks(df: DataFrame, before: int, by: Sequence[str] = ("fingerprint",), domain: str | None = "domain", ident: str = "value_id", block: int = BLOCK, most: int = HOT) -> DataFrame:
    """df for windows that look back `before` rows at most: windows go by (by..., _block) in the series' order, and where _own is false a row is there to be looked at only.

    Series of up to `most` rows are one block each, and one shuffle by the window is all they cost. A longer one, of which
    one task would hold too much, goes by blocks of `block` places in its order, so it is many groups of a bounded size; the
    last `before` rows of a block stand at the head of the next one too.
    """
    keys = hot(df, by, most)
    if keys.isEmpty():
        return df.withColumns({"_block": F.lit(0).cast("long"), "_own": F.lit(True)})
    keys = saved(keys)
    keys = F.broadcast(keys) if keys.count() <= FEW else keys
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    long, short = (df.alias("a").join(keys.alias("b"), same, how) for how in ("left_semi", "left_anti"))
    size = max(block, before, 1)
    rows = ranked(long, *by, *order(domain, ident), rank="_place")
    home, late = F.expr(f"(_place - 1) div {size}"), F.expr(f"(_place - 1) % {size}") >= size - before
    both = rows.withColumn("_block", F.explode(F.when(late, F.array(home, home + 1)).otherwise(F.array(home))))
    both = both.withColumn("_own", F.col("_block") == home).drop("_place")
    return both.unionByName(short.withColumns({"_block": F.lit(-1).cast("long"), "_own": F.lit(True)}))


def around(df: DataFrame, pivots: DataFrame, n: int, preceding: bool = True, by: Sequence[str] = ("fingerprint",), domain: str = "domain", ident: str = "value_id") -> DataFrame:
    """For each pivot (by..., pivot) the n nearest rows with a domain up to it, or from it on; ties with it belong to them. rank counts from the pivot.

    One pass in the order of each series gives rows their places and pivots theirs among them; then each pivot looks up the n
    places next to its own. So the work is rows and pivots times n, not rows times pivots.
    """
    by = list(by)
    rows = df.filter(F.col(domain).isNotNull())
    kind = df.schema[domain].dataType
    marks = pivots.select(*by, "pivot").distinct()
    every = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_all")
    line = rows.select(*by, F.col(domain).alias("_d"), F.col(ident).alias("_i"), F.lit(True).alias("_row"), F.lit(None).cast(pivots.schema["pivot"].dataType).alias("pivot"), every)
    line = line.unionByName(marks.select(*by, F.col("pivot").cast(kind).alias("_d"), F.lit(None).cast(df.schema[ident].dataType).alias("_i"), F.lit(False).alias("_row"), "pivot", F.lit(None).cast(df.schema).alias("_all")))
    first = F.col("_row").desc() if preceding else F.col("_row").asc()  # of rows and pivots at one place
    w = Window.partitionBy(*by).orderBy("_d", first, "_i").rowsBetween(Window.unboundedPreceding, 0)
    lined = line.withColumn("_at", F.sum(F.col("_row").cast("long")).over(w))
    step = F.sequence(F.lit(0), F.lit(n - 1)) if n > 0 else F.array().cast("array<int>")
    near = lined.filter("NOT _row").select(*by, "pivot", F.col("_at").alias("_p"), F.explode(step).alias("_k"))
    near = near.select(*by, "pivot", (F.col("_k") + 1).alias("rank"), (F.col("_p") - F.col("_k") if preceding else F.col("_p") + F.col("_k") + 1).alias("_at"))
    return lined.filter("_row").select(*by, "_at", "_all").join(near, [*by, "_at"]).select("_all.*", "pivot", "rank")


def newest(df: DataFrame, n: int, by: Sequence[str] = ("fingerprint",), domain: str | None = "domain", ident: str = "value_id") -> DataFrame:
    """The last n rows of each series, with their place from the oldest of them on."""
    down = F.row_number().over(Window.partitionBy(*by).orderBy(*order(domain, ident, descending=True)))
    kept = df.withColumn("_down", down).filter(F.col("_down") <= n)
    up = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_down").desc()))
    return kept.withColumn("place", up).drop("_down")


def page(df: DataFrame, limit: int, offset: int, by: Sequence[str] = ("fingerprint",), domain: str | None = "domain", ident: str = "value_id", descending: bool = False) -> DataFrame:
    """Rows offset+1 to offset+limit of each series."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order(domain, ident, descending=descending)))
    return df.withColumn("place", place).filter((F.col("place") > offset) & (F.col("place") <= offset + limit))
