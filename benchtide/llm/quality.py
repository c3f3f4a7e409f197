"""Quality classifier by importance resampling.

Two generative models over hashed n-grams are estimated: one of all raw texts, one of the target texts (labelled good
and not toxic). A text's log importance weight is the sum, over its n-grams, of the log ratio of the two models. The
texts that stay are drawn without replacement in proportion to their weights to the power 1/temperature: Gumbel noise is
added to the log weights divided by the temperature and the k largest sums win (Gumbel top-k). At the default temperature
of 1 texts are drawn by their weights.

Tokens are words, in lower case, and runs of other characters; n-grams are tokens and pairs of token shapes (case,
digits, the marks themselves, and how many times in a row a word stands there). Each counts once for a text.

The target model shrinks to the raw one by what its counts can tell. A bucket is either like the raw texts, so that its
target count is Poisson around what the raw count lets expect, or has a rate of its own (a gamma prior of shape BROAD);
the share of the latter is learned from all buckets by expectation-maximisation. The target model mixes both estimates by
their posterior. So few labels give ratios near 1, many give sharp ones, and nothing switches in between.

By default k is the expected number of texts whose noisy weights lie above the bound that best parts good and other
labelled texts held out from the target model, by the mean of the two expected hit rates. Where no bound parts them by
more than chance (KS, 5 %), all texts stay.

What is bounded: the labelled rows used, LABELS of them at most in expectation, dealt by a hash of doc_id; the models,
BUCKETS numbers each. Counts, weights and the choice cover every row.

Defined results: a null or empty text has weight 0. The noise is a hash of doc_id and text, so repeated rows stay or go
together, as do ties at the k-th weight. Labels repeated for a doc_id count as bad if one of them does; a null quality
leaves a label out. Without labelled rows of either class, and where nothing parts them, all texts stay. An empty table
gives an empty result. Texts are read whole, whatever their length.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

BITS = 20
BUCKETS, LABELS, CHUNK, LANES = 1 << BITS, 50_000, 1 << 14, 1024
#: Shape of the prior of buckets with a rate of their own (Jeffreys'), rounds of expectation-maximisation, and the share it starts from.
BROAD, ROUNDS, SHARE, TEMPERATURE = 0.5, 30, 0.01, 1.0

_KIND = np.full(256, 2, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x5F, *range(0x80, 0x100)]] = 1
_UPPER, _SMALL, _DIGIT = (np.isin(np.arange(256), [*map(ord, x)]) for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"))


def _share(flag: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag)])
    return total[end] - total[start]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each n-gram of the texts, an n-gram once for a text, and the text of each. (What one long text repeats says as much as what stands there once.)"""
    data, at = C.flat(texts)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[data]
    start, end = C.runs(kind, at)
    h = C.hashes(C._LOWER[data], start, end)
    doc = np.searchsorted(at, start, "right") - 1
    word = kind[start] == 1
    upper, small, digit = (_share(x[data], start, end) for x in (_UPPER, _SMALL, _DIGIT))
    size = end - start
    shape = (np.where(upper >= 2, np.where(small == 0, 3, 4), upper) + np.where(digit > 0, np.where(digit == size, 8, 16), 0)).astype(np.uint64)
    w = np.flatnonzero(word)
    again = np.zeros(len(w), bool)  # a word that repeats the word before it, with or without a mark between
    again[1:] = (h[w[1:]] == h[w[:-1]]) & (doc[w[1:]] == doc[w[:-1]])
    place = np.arange(len(w))
    row = place - np.maximum.accumulate(np.where(again, 0, place))  # how many times in a row by now
    shape[w[again]] = 32 + np.minimum(np.log2(row[again]).astype(np.uint64), 6)
    shape = np.where(word, shape, h)
    pair = doc[1:] == doc[:-1]
    form = C.mix(C.mix(shape[:-1] + np.uint64(7)) * np.uint64(0xD6E8FEB86659FD93) + shape[1:])[pair]
    both = np.concatenate([doc, doc[:-1][pair]]).astype(np.uint64) << np.uint64(BITS) | np.concatenate([C.mix(h + np.uint64(1)), form]) >> np.uint64(64 - BITS)
    both.sort()
    both = both[np.concatenate([[True], both[1:] != both[:-1]])].astype(np.int64)
    return both & (BUCKETS - 1), both >> BITS


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the partition's n-grams in all and in target texts, by chunks of buckets."""
    from pyspark import TaskContext

    counts = np.zeros((2, BUCKETS), np.int64)
    for batch in C.blocks(batches):
        bucket, doc = features(C.texts_of(batch["text"]))
        target = batch["target"].to_numpy(zero_copy_only=False).astype(bool)
        counts[0] += np.bincount(bucket, minlength=BUCKETS)
        if target.any():
            counts[1] += np.bincount(bucket[target[doc]], minlength=BUCKETS)
    if counts[0].any():
        lane = TaskContext.get().partitionId() % LANES
        yield _rows(range(BUCKETS // CHUNK), lane, counts)


def _rows(chunks: range, lane: int, counts: np.ndarray) -> pa.RecordBatch:
    pieces = [counts[:, k * CHUNK : (k + 1) * CHUNK] for k in range(len(chunks))]
    return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array([lane] * len(chunks), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in pieces], pa.binary())], ["chunk", "lane", "counts"])


def _add(t: pa.Table) -> pa.Table:
    total = np.zeros(2 * CHUNK, np.int64)
    for x in t["counts"]:
        total += np.frombuffer(x.as_py(), "<i8")
    return pa.Table.from_batches([_rows(range(t["chunk"][0].as_py(), t["chunk"][0].as_py() + 1), 0, total.reshape(2, CHUNK))])


def models(rows: DataFrame) -> np.ndarray:
    """Counts over rows(text, target) as an array of 2 x BUCKETS, whatever the input's size."""
    kind = "chunk int, lane int, counts binary"
    parts = rows.select("text", "target").mapInArrow(_count, kind)
    parts = parts.groupBy("chunk", "lane").applyInArrow(_add, kind)
    counts = np.zeros((2, BUCKETS), np.int64)
    for r in parts.groupBy("chunk").applyInArrow(_add, kind).toLocalIterator():
        counts[:, r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.counts, "<i8").reshape(2, CHUNK)
    return counts


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function by Stirling's series, six places up."""
    y = x + 6
    out = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3)
    for k in range(6):
        out = out - np.log(x + k)
    return out


def ratios(counts: np.ndarray, broad: float = BROAD, rounds: int = ROUNDS) -> np.ndarray:
    """log(target model / raw model) for each bucket, 0 for all without target texts. counts: of raw and of target texts."""
    raw, target = counts.astype(float)
    if not target.any():
        return np.zeros(len(raw), np.float32)
    seen = np.flatnonzero(raw)
    t, e = target[seen], raw[seen] * (target.sum() / raw.sum())
    like = t * np.log(e) - e  # Poisson and negative binomial, without what they share
    own = _log_gamma(t + broad) - math.lgamma(broad) + broad * np.log(broad / (broad + e)) + t * np.log(e / (broad + e))
    share = SHARE
    for _ in range(rounds):
        odds = np.clip(own - like + math.log(share / (1 - share)), -700, 700)
        posterior = 1 / (1 + np.exp(-odds))
        share = float(np.clip(posterior.mean(), 1e-6, 0.5))
    out = np.zeros(len(raw), np.float32)
    out[seen] = np.log1p(posterior * ((t + broad) / (e + broad) - 1))
    return out


def weights(bucket: np.ndarray, doc: np.ndarray, ratio: np.ndarray, n: int) -> np.ndarray:
    """Log importance weights of n texts."""
    return np.bincount(doc, ratio[bucket], n) if len(doc) else np.zeros(n)


def scorer(spread):
    """A column function: the log importance weight of each text. spread: the ratios, as a broadcast of fixed size."""

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text], ["text"])
        found = [weights(*features(C.texts_of(x["text"])), spread.value, x.num_rows) for x in C.blocks(iter([batch]))]
        return pa.array(np.concatenate(found) if found else np.zeros(0))

    return score


def drawn_above(bound: float, log_weight: np.ndarray, temperature: float) -> np.ndarray:
    """The probability that a text's noisy weight lies above a bound."""
    return -np.expm1(-np.exp(np.clip(log_weight / temperature - bound, -700, 700)))


def parting(log_weight: np.ndarray, good: np.ndarray, temperature: float = TEMPERATURE) -> float | None:
    """The bound of noisy weights that best parts good and other labelled texts in expectation; None where none parts them by more than chance."""
    n, m = int(good.sum()), int((~good).sum())
    if not n or not m:
        return None
    places = np.unique(np.quantile(log_weight / temperature, np.linspace(0, 1, 200)))
    bounds = np.unique(np.concatenate([places + x for x in (-1, 0, 1, 2, 3)]))
    parts = [(p[good].mean() - p[~good].mean()) for p in (drawn_above(c, log_weight, temperature) for c in bounds)]
    best = int(np.argmax(parts))
    return float(bounds[best]) if parts[best] > 1.36 * math.sqrt((n + m) / (n * m)) else None


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest of column key, by histograms that narrow down; only counts of 4,096 bins leave the executors."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    while high > low:
        width = (high - low) / 4096
        inside = keys.filter((F.col("key") >= low) & (F.col("key") <= high))
        bins = sorted(inside.groupBy(F.least(F.floor((F.col("key") - low) / width), F.lit(4095)).alias("bin")).agg(F.count("*"), F.min("key"), F.max("key")).collect(), reverse=True)
        for _, n, least, most in bins:
            if n >= k:
                low, high = (least, most) if (least, most) != (low, high) else (most, most)
                break
            k -= n
    return low


class Fit(NamedTuple):
    """score: the weight of a text column. weights: doc_id, log_weight and key (weight with noise) of every row, as a table in the shared folder. cut: rows with a key of at least this stay."""

    score: Callable[[Column], Column]
    weights: DataFrame
    cut: float


def _key(score: Column, doc_id: Column, text: Column, temperature: float, seed: int | Column) -> Column:
    u = (F.pmod(F.xxhash64(doc_id, text, F.lit(seed)), F.lit((1 << 52) - 1)) + 1) / F.lit(float(1 << 52))
    return score / temperature - F.log(-F.log(u))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int | None = None, most_labels: int = LABELS, temperature: float = TEMPERATURE, seed: int = 7) -> Fit:
    """Both models, the weights of all rows, and where the k largest noisy weights begin. k: by default as many as the bound lets expect that best parts labels."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), ((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).alias("good")).na.drop()
    n = labels.count()
    part = F.pmod(F.xxhash64("doc_id", F.lit("labels")), F.lit(1 << 20))
    sample = labels.filter(part < (1 << 20) * min(1.0, most_labels / max(1, n))).groupBy("doc_id").agg(F.min("good").alias("good"))
    sample = sample.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 1)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).join(F.broadcast(sample), "doc_id", "left")
    counts = models(rows.select("text", F.coalesce(~F.col("held") & F.col("good"), F.lit(False)).alias("target")))
    score = scorer(docs.sparkSession.sparkContext.broadcast(ratios(counts)))
    out = rows.withColumn("log_weight", score("text"))
    out = C.stored(out.select("doc_id", "good", "held", "log_weight", _key(F.col("log_weight"), F.col("doc_id"), F.col("text"), temperature, seed).alias("key")))
    total = out.count()
    if k is None:
        k = total
        seen = out.filter("held").select("log_weight", "good").toArrow()  # of the sample of labels
        bound = parting(seen["log_weight"].to_numpy(), seen["good"].to_numpy().astype(bool), temperature)
        if bound is not None:
            above = F.col("log_weight") / temperature - bound
            k = max(1, round(out.agg(F.sum(-F.expm1(-F.exp(F.greatest(F.least(above, F.lit(700.0)), F.lit(-700.0)))))).first()[0]))
    k = min(k, total)
    cut = float("-inf") if k == total else float("inf") if k <= 0 else kth_largest(out, k)
    return Fit(score, out.select("doc_id", "log_weight", "key"), cut)


def resample(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", temperature: float = TEMPERATURE, seed: int = 7, **more) -> DataFrame:
    """The rows of docs that are drawn, with docs' own columns. No text is shuffled or stored: texts are weighed once more as they are read."""
    found = fit(docs, labels, text, doc_id, temperature=temperature, seed=seed, **more)
    words = F.col(f"`{text}`").cast("string")
    return docs.filter(_key(found.score(words), F.col(f"`{doc_id}`").cast("long"), words, temperature, seed) >= found.cut)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stay, with their weights."""
    found = fit(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
    return found.weights.filter(F.col("key") >= found.cut)
