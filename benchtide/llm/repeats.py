"""Suffix-array dedup: byte windows that repeat anywhere, by a depth-limited radix sort.

Two windows of WINDOW bytes are equal exactly if their suffixes agree to that depth, so suffixes are ordered only that
far, most significant digits first, and a suffix that is alone with its digits so far leaves. To keep most suffixes out
from the start, each window is represented by the ANCHOR bytes in it with the least hash (of equal ones the leftmost):
equal windows have the same anchor at the same place. Neighbouring windows share an anchor, so the first digit is dealt
once for a run of windows.

Digits: (1) the anchor. Runs that are equal as a whole are settled here, and one run of each kind stands for them.
(2) For STEP windows in a row, the bytes that all of them hold (the core). (3) Of each window, the few bytes to the left
and right of the core. Equal groups after the last digit are exactly the repeated windows. All groups are counted by
partial aggregation, and what belongs to them is found by joins, so a frequent string is gathered in no one place.

Defined results: a null text counts as empty; nothing of a text shorter than WINDOW is removed. Repeated rows repeat each
other's windows, so they lose them all. An empty table gives an empty result. Other columns play no part. Anchors and
cores are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

STEP = 16
WINDOW, ANCHOR = 400, 128
_PLACE = np.uint64((1 << 31) - 1)


def sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n numbers in a row."""
    if len(x) < n:
        return x[:0]
    wide = -(-len(x) // n) * n
    y = np.full(wide, ~np.uint64(0), np.uint64)
    y[: len(x)] = x
    y = y.reshape(-1, n)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: len(x) - n + 1], ahead[n - 1 : len(x)])


class Hashed:
    """Bytes with hashes of any piece of them."""

    def __init__(self, data: np.ndarray):
        up, self.down = C._powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(C._BYTE[data] * up[: len(data)], out=self.total[1:])

    def piece(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return C.mix((self.total[end] - self.total[start]) * self.down[start])

    def all(self, n: int) -> np.ndarray:
        """Of every n bytes in a row."""
        k = len(self.total) - n
        return C.mix((self.total[n:] - self.total[:-n]) * self.down[:k])


def runs(data: np.ndarray, at: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[Hashed, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (hashes, text, first window, last window, place of the anchor, hash of the anchor); places are in the whole of data."""
    h = Hashed(data)
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return h, none, none, none, none, none.astype(np.uint64)
    g = h.all(anchor)
    least = sliding_least((g & ~_PLACE) | np.arange(len(g), dtype=np.uint64), window - anchor + 1)
    place = (least & _PLACE).astype(np.int64)
    text = np.searchsorted(at, np.arange(len(least)), "right") - 1
    whole = np.arange(len(least)) + window <= at[1:][text]
    edge = np.ones(len(least) + 1, bool)
    edge[1:-1] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(edge[:-1] & whole)
    last = np.flatnonzero(edge[1:] & whole)
    return h, text[first], first, last, place[first], g[place[first]]


def _pack(place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A run as one number: the anchor's place, how far before it the first window begins, and how many windows follow that one."""
    return place << 20 | (place - first) << 10 | (last - first)


def _runs(window: int, anchor: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.blocks(batches, most=1 << 20):
            data, at = C.flat(C.texts_of(batch["text"]))
            h, text, first, last, place, key = runs(data, at, window, anchor)
            own = C.mix(h.piece(first, last + window) + C.mix(_pack(place - first, 0 * place, last - first).astype(np.uint64))) if len(first) else key
            kind = C.mix(own + C.mix(key))
            base = at[text]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(kind.view(np.int64)), batch["row"].take(pa.array(text)), pa.array(_pack(place - base, first - base, last - base))], ["anchor", "kind", "row", "run"]
            )

    return find


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.blocks(batches):
        yield pa.RecordBatch.from_arrays([batch["row"], batch["doc_id"], pa.array([zlib.compress(x.as_py() or b"", 1) for x in batch["text"].cast(pa.large_binary())], pa.binary())], ["row", "doc_id", "z"])


def _cores(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the asked runs of each text, for every STEP windows: core, left, right (the bytes beside it), low, high (the windows that the run has of them), row, base (the core's place)."""
        for batch in batches:
            for z, row, asked in zip(batch["z"], batch["row"].to_pylist(), batch["runs"], strict=True):
                raw = zlib.decompress(z.as_py())
                h = Hashed(np.frombuffer(raw, np.uint8))
                run = np.unique(asked.values.to_numpy())
                place, before, more = run >> 20, run >> 10 & 1023, run & 1023
                least, most = before - more, before  # how far before the anchor the run's windows begin
                group = np.repeat(np.arange(len(run)), most // STEP - least // STEP + 1)
                j = np.arange(len(group)) - np.repeat(np.concatenate([[0], np.cumsum(most // STEP - least // STEP + 1)[:-1]]), most // STEP - least // STEP + 1) + (least // STEP)[group]
                base = place[group] - STEP * j
                low, high = np.maximum(least[group] - STEP * j, 0), np.minimum(most[group] - STEP * j, STEP - 1)
                size = window - STEP + 1
                core = C.mix(h.piece(base, base + size) + C.mix(j.astype(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(core.view(np.int64)),
                        pa.array([raw[max(0, x - STEP + 1) : x] for x in base.tolist()], pa.binary()),
                        pa.array([raw[x + size : x + window] for x in base.tolist()], pa.binary()),
                        pa.array(low, pa.int32()),
                        pa.array(high, pa.int32()),
                        pa.array([row] * len(core), pa.int64()),
                        pa.array(base, pa.int64()),
                    ],
                    ["core", "left", "right", "low", "high", "row", "base"],
                )

    return cut


def _remove(window: int, with_text: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What is left of each text. spans: first << 32 | last of repeated windows."""
        for batch in batches:
            rows = []
            for z, spans in zip(batch["z"], batch["spans"], strict=True):
                raw = zlib.decompress(z.as_py())
                if not spans.is_valid or not len(spans.values):
                    rows.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), raw))
                    continue
                x = spans.values.to_numpy()
                change = np.zeros(len(raw) + 1, np.int32)
                np.add.at(change, x >> 32, 1)
                np.add.at(change, (x & 0xFFFFFFFF) + window, -1)
                gone = np.cumsum(change[:-1]) > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                rows.append((len(raw), int(gone.sum()), int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])), hashlib.sha256(kept).hexdigest(), kept))
            n, removed, many, sha, kept = zip(*rows, strict=True) if rows else ((),) * 5
            columns = [batch["doc_id"], *(pa.array(x, pa.int64()) for x in (n, removed, many)), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * with_text, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)

    return remove


def spans(rows: DataFrame, texts: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(row, spans): first << 32 | last of runs of repeated windows, of each text that has some. rows: row, text; texts: row, doc_id, z."""
    every = rows.mapInArrow(_runs(window, anchor), "anchor long, kind long, row long, run long")
    several = every.groupBy("anchor").agg(F.count("*").alias("k")).filter("k > 1").select(C.apart("anchor"))
    again = C.cut(every.withColumn("apart", C.apart("anchor")).join(several, "apart", "left_semi").drop("apart"))
    kinds = C.cut(again.groupBy("kind").agg(F.min("anchor").alias("anchor"), F.count("*").alias("k"), F.min(F.struct("row", "run")).alias("one")))
    # equal runs
    first, last = F.col("place") - F.col("before"), F.col("place") - F.col("before") + F.col("more")
    parts = [F.shiftright("run", 20).alias("place"), (F.shiftright("run", 10).bitwiseAND(F.lit(1023))).alias("before"), F.col("run").bitwiseAND(F.lit(1023)).alias("more")]
    equal = again.withColumn("apart", C.apart("kind")).join(kinds.filter("k > 1").select(C.apart("kind")), "apart", "left_semi")
    whole = equal.select("row", *parts).select("row", F.shiftleft(first, 32).bitwiseOR(last).alias("span"))
    # runs that are equal in part
    mixed = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1").select(C.apart("anchor"))
    asked = kinds.withColumn("apart", C.apart("anchor")).join(mixed, "apart", "left_semi").select("one.*").groupBy("row").agg(F.collect_list("run").alias("runs"))
    cores = texts.join(asked, "row").select("row", "z", "runs").mapInArrow(_cores(window), "core long, left binary, right binary, low int, high int, row long, base long")
    cores = C.cut(cores.withColumn("piece", F.xxhash64("core", "left", "right", "low", "high")))
    pieces = cores.groupBy("core", "piece").agg(F.first("left").alias("left"), F.first("right").alias("right"), F.first("low").alias("low"), F.first("high").alias("high"), F.count("*").alias("k"))
    shared = cores.groupBy("core").agg((F.min("piece") != F.max("piece")).alias("mixed")).filter("mixed").select(C.apart("core"))
    inner = pieces.withColumn("apart", C.apart("core")).join(shared, "apart", "left_semi").select("core", "piece", "left", "right", F.explode(F.sequence("low", "high")).alias("i"))
    key = F.xxhash64("core", "i", F.expr("substring(left, length(left) - i + 1, i)"), F.expr(f"substring(right, 1, {STEP - 1} - i)"))
    inner = inner.select("piece", "i", key.alias("key"))
    repeated = inner.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select(C.apart("key"))
    partly = inner.withColumn("apart", C.apart("key")).join(repeated, "apart", "left_semi").select("piece", "i")
    fully = cores.groupBy("piece").agg(F.count("*").alias("k"), F.first("low").alias("low"), F.first("high").alias("high")).filter("k > 1").select("piece", F.explode(F.sequence("low", "high")).alias("i"))
    marks = partly.unionAll(fully).groupBy("piece").agg(F.bit_or(F.expr("shiftleft(1, i)")).alias("mask"))
    start = F.col("base") - F.col("i")
    some = cores.select("piece", "row", "base").join(marks, "piece").select("row", "base", F.explode(F.expr(f"filter(sequence(0, {STEP - 1}), i -> (shiftright(mask, i) & 1) = 1)")).alias("i")).select("row", F.shiftleft(start, 32).bitwiseOR(start).alias("span"))
    return whole.unionAll(some).groupBy("row").agg(F.collect_set("span").alias("spans"))


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row, and the kept bytes on request."""
    if not STEP <= anchor <= window - STEP or window > 1000:
        raise ValueError("the anchor is shorter than the window, which has 1,000 bytes at most")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    texts = rows.mapInArrow(_shrink, "row long, doc_id long, z binary")
    found = spans(rows.select("row", "text"), texts, window, anchor)
    return texts.join(found, "row", "left").select("doc_id", "z", "spans").mapInArrow(_remove(window, with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and: repeats, whether bytes are removed; partly, whether others stay (a copy loses all, a document with a shared passage only that); text, what is left, with cut characters as U+FFFD."""
    left = dedup(C.table(spark, sf_dir, "documents"), with_text=True)
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("repeats"), F.expr("n_removed > 0 AND n_removed < n_bytes").alias("partly"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
