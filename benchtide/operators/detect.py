"""Change detection over series: fixed thresholds, relative difference, standard deviation, change points."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import saved
from .series import BLOCK, FEW, HOT, hot, in_blocks, order, placed


def fingerprint_filter(df: DataFrame, predicate: Column | str | None) -> DataFrame:
    """Rows whose fingerprint passes. No predicate passes, and so does one that gives null (as try_ functions do on errors)."""
    if predicate is None or isinstance(predicate, str) and not predicate.strip():
        return df
    return df.filter(F.coalesce(F.expr(predicate) if isinstance(predicate, str) else predicate, F.lit(True)))


def fixed_threshold(df: DataFrame, least: float | None = None, most: float | None = None, least_inclusive: bool = True, most_inclusive: bool = True, value: str = "range") -> DataFrame:
    """Violations with bound and direction; the lower bound is tested first. Nothing is shuffled."""
    x = F.col(value)
    below = F.lit(False) if least is None else x < least if least_inclusive else x <= least
    above = F.lit(False) if most is None else x > most if most_inclusive else x >= most
    direction = F.when(below, "below").when(above, "above")
    bound = F.when(below, F.lit(least).cast("double")).when(above, F.lit(most).cast("double"))
    return df.withColumns({"bound": bound, "direction": direction}).filter(F.col("direction").isNotNull())


def relative_difference(df: DataFrame, filter: str = "mean", threshold: float = 0.2, window: int = 1, min_previous: int = 5, by: Sequence[str] = ("fingerprint",), domain: str | None = "domain", value: str = "range", ident: str = "value_id", block: int = BLOCK, most: int = HOT) -> DataFrame:
    """Every point whose window differs from the baseline before it by more than the threshold.

    The frame is the last window + P values up to the point, P = max(window, min_previous); the baseline is the mean of
    the first P. last is the first of the frame's oldest `window` entries, from the newer to the older, on the changed side
    of the baseline, or the oldest; previous is entry window-1. Without a domain there is no result; an unknown filter sums.
    """
    if domain is None:
        return df.limit(0).select("*", *[F.lit(None).cast("double").alias(c) for c in ("previous", "last", "value", "ratio")])
    previous = max(window, min_previous)
    w = Window.partitionBy(*by, "_block").orderBy(*order(domain, ident))
    base, test = w.rowsBetween(-(previous + window - 1), -window), w.rowsBetween(-(window - 1), 0)
    one = {"min": F.min, "max": F.max, "mean": F.avg}.get(filter, F.sum)
    out = in_blocks(df, previous + window - 1, by, domain, ident, block, most).withColumns(
        {
            "_n": F.count(value).over(w.rowsBetween(-(previous + window - 1), 0)),
            "_mean": F.avg(value).over(base),
            "value": one(value).over(test),
            "_old": F.collect_list(value).over(w.rowsBetween(-(previous + window - 1), -previous)),
        }
    ).filter(F.col("_own") & (F.col("_n") == previous + window))
    out = out.withColumn("_ratio", F.col("value") / F.col("_mean")).filter((F.col("_ratio") < 1 - threshold) | (F.col("_ratio") > 1 + threshold))
    changed = F.filter(F.reverse("_old"), lambda x: F.when(F.col("_ratio") < 1, x < F.col("_mean")).otherwise(x > F.col("_mean")))
    out = out.withColumns({"previous": F.element_at("_old", window), "last": F.coalesce(F.try_element_at(changed, F.lit(1)), F.element_at("_old", 1)), "ratio": 100 * (F.col("_ratio") - 1)})
    return out.drop("_n", "_mean", "_old", "_ratio", "_block", "_own")


def cool_down(changes: DataFrame, points: int, by: Sequence[str] = ("fingerprint",), place: str = "place", most: int = HOT) -> DataFrame:
    """After a change the next `points` places of its series are skipped, from the first change on. Places are whole numbers, each once in its series.

    Of series with up to `most` changes a task passes over them in order and remembers one place. A longer one is many tasks:
    each change knows the next one that would be kept after it, at most points + 1 changes on, and pointers that double in
    length reach from the first kept change to all others in as many rounds as their number has binary digits.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, free = None, -math.inf
        for batch in batches:
            kept = []
            for *key, at in zip(*(batch[c].to_pylist() for c in (*by, place)), strict=True):
                if key != now:
                    now, free = key, -math.inf
                kept.append(at >= free)
                if at >= free:
                    free = at + points + 1
            yield batch.filter(pa.array(kept, pa.bool_()))

    def passed(df: DataFrame) -> DataFrame:
        return df.repartition(*by).sortWithinPartitions(*by, place).mapInArrow(keep, df.schema)

    keys = hot(changes, by, most)
    if keys.isEmpty():
        return passed(changes)
    keys = saved(keys)
    keys = F.broadcast(keys) if keys.count() <= FEW else keys
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    long, short = (changes.alias("a").join(keys.alias("b"), same, how) for how in ("left_semi", "left_anti"))
    return passed(short).unionByName(_leaping(long, points, by, place))


def _leaping(changes: DataFrame, points: int, by: Sequence[str], place: str, block: int = BLOCK) -> DataFrame:
    """The kept changes of long series, by doubling pointers over (by, change's number)."""
    moved = changes.withColumnRenamed(place, "_at")
    rows = saved(placed(moved, by, "_at", "_at").withColumnRenamed("place", "_nth").withColumnRenamed("_at", place))
    size = max(block, points + 1)
    home, early = F.expr(f"_nth div {size}"), F.expr(f"_nth % {size}") <= points
    spread = rows.select(*by, "_nth", F.col(place).alias("_p")).withColumn("_block", F.explode(F.when(early, F.array(home, home - 1)).otherwise(F.array(home)))).withColumn("_own", F.col("_block") == home)
    ahead = Window.partitionBy(*by, "_block").orderBy("_nth").rowsBetween(1, points + 1)
    later = F.filter(F.collect_list(F.struct(F.col("_p"), F.col("_nth").alias("n"))).over(ahead), lambda x: x["_p"] > F.col("_p") + points)
    links = saved(spread.withColumn("_next", F.try_element_at(later, F.lit(1))["n"]).filter("_own").select(*by, "_nth", "_next", (F.col("_nth") == 1).alias("_on")))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    longest = rows.agg(F.max("_nth")).first()[0] or 1
    for _ in range(max(1, longest.bit_length())):
        a, b = links.alias("a"), links.alias("b")
        reached = a.filter("_on AND _next IS NOT NULL").select(*by, F.col("_next").alias("_nth")).withColumn("_hit", F.lit(True))
        doubled = a.join(b, [*same, F.col("a._next") == F.col("b._nth")], "left").select(*[F.col(f"a.{c}") for c in by], "a._nth", F.col("b._next").alias("_next"), "a._on")
        on = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in (*by, "_nth")]
        links = saved(doubled.alias("x").join(reached.alias("y"), on, "left").select(*[F.col(f"x.{c}") for c in by], "x._nth", "x._next", (F.col("x._on") | F.coalesce(F.col("y._hit"), F.lit(False))).alias("_on")))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "_nth")]
    return rows.alias("a").join(links.filter("_on").alias("b"), on, "left_semi").select(*[F.col(f"`{c}`") for c in changes.columns])


def deviation(df: DataFrame, window: int = 40, deviations: float = 4.0, direction: str = "BOTH", min_points: int = 10, by: Sequence[str] = ("fingerprint",), domain: str | None = "domain", value: str = "range", ident: str = "value_id", block: int = BLOCK, most: int = HOT) -> DataFrame:
    """Values further than `deviations` sample standard deviations from the mean of the `window` values before them. Rows without a number don't count."""
    before = Window.partitionBy(*by, "_block").orderBy(*order(domain, ident)).rowsBetween(-window, -1)
    out = in_blocks(df.filter(F.col(value).isNotNull()), window, by, domain, ident, block, most).withColumns({"mean": F.avg(value).over(before), "stddev": F.stddev_samp(value).over(before), "_n": F.count(value).over(before)})
    out = out.filter(F.col("_own") & (F.col("_n") + 1 >= min_points) & (F.col("_n") >= 2))
    out = out.withColumn("stddev", F.when(F.col("stddev") == 0, F.greatest(F.abs("mean") * 0.001, F.lit(1e-10))).otherwise(F.col("stddev")))
    high, low = F.col("mean") + deviations * F.col("stddev"), F.col("mean") - deviations * F.col("stddev")
    side = F.when((F.col(value) > high) & F.lit(direction in ("UPPER", "BOTH")), "above").when((F.col(value) < low) & F.lit(direction in ("LOWER", "BOTH")), "below")
    out = out.withColumns({"direction": side, "threshold": F.when(side == "above", high).otherwise(low), "deviations": F.abs(F.col(value) - F.col("mean")) / F.col("stddev")})
    return out.filter(F.col("direction").isNotNull()).drop("_n", "_block", "_own")


def hazard(before: Column, after: Column) -> Column:
    """ln(after / before) where that exists."""
    return F.ln(F.when((before != 0) & (after > 0), after / before))


def _beta_fractions(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fractions of incomplete beta functions (Lentz), side by side; those that have converged stand still."""
    tiny, out, on = 1e-300, np.empty(len(x)), np.arange(len(x))
    c, d = np.ones(len(x)), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) > tiny, d, tiny)
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) > tiny, d, tiny)
            c = 1 + num / np.where(np.abs(c) > tiny, c, tiny)
            h = h * c * d
        done = np.abs(c * d - 1) < 1e-12
        out[on] = h
        if done.any():
            on, a, b, x, c, d, h = (z[~done] for z in (on, a, b, x, c, d, h))
        if not len(on):
            break
    return out


def student_tails(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """The two-sided tail probabilities of Student's t."""
    with np.errstate(all="ignore"):
        x = dof / (dof + t * t)
        a, b = dof / 2, np.full(len(t), 0.5)
        log = np.array([math.lgamma(p + 0.5) - math.lgamma(p) - math.lgamma(0.5) if p > 0 else math.nan for p in a.tolist()])
        front = np.exp(log + a * np.log(x) + b * np.log1p(-x))
        low = x < (a + 1) / (a + b + 2)
        a, b, y = np.where(low, a, b), np.where(low, b, a), np.where(low, x, 1 - x)
        part = front * _beta_fractions(a, b, y) / a
    return np.where(np.isinf(t), 0.0, np.where(x >= 1, 1.0, np.where(low, part, 1 - part)))


def student_tail(t: float, dof: float) -> float:
    """The two-sided tail probability of Student's t."""
    return float(student_tails(np.array([float(t)]), np.array([float(dof)]))[0])


def _groups(codes: np.ndarray) -> Iterator[np.ndarray]:
    """The places of each code."""
    order = np.argsort(codes, kind="stable")
    return iter(np.split(order, np.flatnonzero(np.diff(codes[order])) + 1)) if len(order) else iter(())


def welch(x: np.ndarray, s: np.ndarray, a: np.ndarray, k: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """p-values of Welch's t-test between x[s, a:k] and x[s, k:b] of each (s, a, k, b), and both means; equal constants give 1, different ones 0."""
    p, before, after = np.ones(len(s)), np.empty(len(s)), np.empty(len(s))
    t, dof = np.full(len(s), np.nan), np.full(len(s), np.nan)
    for at in _groups((k - a) * (x.shape[1] + 1) + b - k):
        m, n = (k - a)[at[0]], (b - k)[at[0]]
        y, z = x[s[at, None], a[at, None] + np.arange(m)], x[s[at, None], k[at, None] + np.arange(n)]
        with np.errstate(all="ignore"):
            before[at], after[at] = y.mean(1), z.mean(1)
            if m > 1 and n > 1:
                vy, vz = y.var(1, ddof=1) / m, z.var(1, ddof=1) / n
                t[at] = np.abs((before[at] - after[at]) / np.sqrt(vy + vz))
                dof[at] = (vy + vz) ** 2 / (vy**2 / (m - 1) + vz**2 / (n - 1))
                p[at] = np.where(vy + vz == 0, np.where(before[at] == after[at], 1.0, 0.0), np.nan)
    open_ = np.isnan(p)
    p[open_] = student_tails(t[open_], dof[open_])
    return p, before, after


def split_statistic(x: np.ndarray) -> np.ndarray:
    """The energy statistic of each split x[:k], x[k:] of each row of x, k from 1 on: nA nB / (nA + nB) (2 E|A-B| - E|A-A'| - E|B-B'|)."""
    rows, n = x.shape
    d = np.abs(x[:, :, None] - x[:, None, :])
    s = np.zeros((rows, n + 1, n + 1))
    s[:, 1:, 1:] = d.cumsum(1).cumsum(2)
    k = np.arange(1, n)
    aa, whole, cross = s[:, k, k], s[:, n, n, None], s[:, k, n] - s[:, k, k]
    bb = whole - aa - 2 * cross
    return k * (n - k) / n * (2 * cross / (k * (n - k)) - aa / k**2 - bb / (n - k) ** 2)


#: Pairs of values that are compared at once.
PAIRS = 500_000


def change_points(x: np.ndarray, window: int, most_p: float, least_magnitude: float) -> list[list[tuple[int, float]]]:
    """Indexes where each series, a row of x, changes, with p-values: split at the largest energy statistic within windows, as long as Welch's test rejects; then weak points are merged, the weakest first. All rows go side by side."""
    rows, n = x.shape
    step = max(1, window // 2)
    spans = sorted({(a, min(n, a + max(window, 4))) for a in range(0, max(1, n - window + step), step)} | {(0, n)})
    s, (a, b) = np.repeat(np.arange(rows), len(spans)), np.tile(np.array(spans).T, rows)
    points, seen = np.zeros((rows, n + 1), bool), np.zeros(0, np.int64)
    while len(s):
        code = np.unique((s * (n + 1) + a) * (n + 1) + b)  # a part that two windows come to is searched once
        code = code[~np.isin(code, seen)]
        seen = np.concatenate([seen, code])
        s, a, b = code // (n + 1) ** 2, code // (n + 1) % (n + 1), code % (n + 1)
        s, a, b = (z[b - a >= 4] for z in (s, a, b))
        k = np.empty_like(a)
        for at in _groups(b - a):
            length = (b - a)[at[0]]
            for part in np.array_split(at, -(-len(at) * int(length) ** 2 // PAIRS)):
                with np.errstate(all="ignore"):
                    k[part] = a[part] + 1 + np.argmax(split_statistic(x[s[part, None], a[part, None] + np.arange(length)]), 1)
        hit = welch(x, s, a, k, b)[0] < most_p
        s, a, k, b = (z[hit] for z in (s, a, k, b))
        points[s, k] = True
        s, a, b = np.concatenate([s, s]), np.concatenate([a, k]), np.concatenate([k, b])
    found: list[list[tuple[int, float]]] = [[] for _ in range(rows)]
    left = {int(i): np.flatnonzero(points[i]).tolist() for i in np.flatnonzero(points.any(1))}
    while left:
        at = [(i, *e) for i, ks in left.items() for e in zip([0, *ks[:-1]], ks, [*ks[1:], n], strict=True)]
        p, before, after = welch(x, *np.array(at).T)
        with np.errstate(all="ignore"):
            magnitude = np.abs(after - before) / np.maximum(np.abs(before), 1e-300)
        p, magnitude, first = p.tolist(), magnitude.tolist(), 0
        for i, ks in [*left.items()]:
            weak = [(-p[j], magnitude[j], j - first) for j in range(first, first + len(ks)) if p[j] >= most_p or magnitude[j] < least_magnitude]
            if not weak:
                found[i] = [*zip(ks, p[first : first + len(ks)], strict=True)]
            first += len(ks)
            if not weak or len(ks) == 1:
                del left[i]
            else:
                left[i] = ks[: (at_ := min(weak)[2])] + ks[at_ + 1 :]
    return found


def e_divisive(df: DataFrame, window: int = 50, most_p: float = 0.001, least_magnitude: float = 0.0, longest: int = 500, by: str = "fingerprint", domain: str = "domain", value: str = "range", ident: str = "value_id", at_once: int = 100_000) -> DataFrame:
    """Change points of the most recent `longest` values of each series, of which a task holds no more, whatever its length. Series of a task are searched side by side, as many as have some `at_once` values."""
    down = F.row_number().over(Window.partitionBy(by).orderBy(*order(domain, ident, descending=True)))
    recent = df.select(by, domain, value, ident).withColumn("_down", down).filter(F.col("_down") <= longest)
    kind = f"{by} string, index int, pvalue double, mean_before double, mean_after double, std_before double, std_after double, magnitude double, hazard double, range_value_id long, domain string"
    names = [x.split(" ")[0] for x in kind.split(", ")]
    types = [pa.string(), pa.int32(), *[pa.float64()] * 7, pa.int64(), pa.string()]

    def searched(held: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        """What is found in the series that begin at starts[:-1]; the last of starts is where they end."""
        keys, idents, domains = (held[c] for c in (by, ident, domain))
        values, places = held[value].to_numpy().astype(float), held["_down"].to_numpy()
        by_length: dict[int, list[np.ndarray]] = {}
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if b - a >= window:
                at = a + np.argsort(-places[a:b])  # from the oldest on
                at = at[~np.isnan(values[at])]
                if len(at) >= max(window, 1):
                    by_length.setdefault(len(at), []).append(at)
        rows: list[tuple] = []
        for n, several in by_length.items():
            at = np.array(several)
            x = values[at]
            for i, found in enumerate(change_points(x, window, most_p, least_magnitude)):
                edges = [0, *[k for k, _ in found], n]
                for (k, p), left, right in zip(found, edges[:-2], edges[2:], strict=True):
                    y, z = x[i, left:k], x[i, k:right]
                    before, after = float(y.mean()), float(z.mean())
                    sd = [float(w.std(ddof=1)) if len(w) > 1 else 0.0 for w in (y, z)]
                    hazard = math.log(after / before) if before and after / before > 0 and after > 0 else None
                    row = int(at[i, k])
                    rows.append((keys[row].as_py(), k, p, before, after, *sd, abs(after - before) / abs(before) if before else math.inf, hazard, idents[row].as_py(), str(domains[row].as_py())))
        columns = [*zip(*rows, strict=True)] if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
            if held and (batch is None or sum(map(len, held)) >= at_once):
                rows = pa.Table.from_batches(held).combine_chunks()
                codes = rows[by].combine_chunks().dictionary_encode(null_encoding="encode")
                codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
                starts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [len(rows)]])
                if batch is not None:  # the last series may go on
                    starts = starts[:-1]
                yield searched(rows, starts)
                held = rows.slice(int(starts[-1])).to_batches()

    together = recent.repartition(F.col(by)).sortWithinPartitions(by)  # as the window has left them: no shuffle or sort of their own
    return together.mapInArrow(find, kind)


def without_stale(stored: DataFrame, found: DataFrame, scope: DataFrame, keys: Sequence[str] = ("fingerprint", "domain"), only_if_found: bool = True) -> DataFrame:
    """Stored changes without those in scope that weren't found again. only_if_found: a pass that found nothing removes nothing."""
    keys = list(keys)
    stale = stored.join(scope.select(*keys).distinct(), keys, "left_semi").join(found.select(*keys).distinct(), keys, "left_anti").select(*keys).distinct()
    if only_if_found:
        stale = stale.join(found.limit(1).select(F.lit(1).alias("_any")), F.lit(True), "left_semi")
    return stored.join(stale, keys, "left_anti")


def replaced(stored: DataFrame, found: DataFrame, scope: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored changes with those in scope replaced by what was found; the others stay. A null key equals another."""
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return stored.alias("a").join(scope.select(*keys).distinct().alias("b"), same, "left_anti").unionByName(found)


def contributing(df: DataFrame, run: DataFrame, by: Sequence[str] = ("fingerprint",)) -> DataFrame:
    """Only series to which a run has contributed."""
    return df.join(run.select(*by).distinct(), list(by), "left_semi")
