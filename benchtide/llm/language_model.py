"""LM scoring by deleted interpolation.

The model is a mixture of maximum-likelihood estimates: P(w | v) = a2 c(v w) / c(v) + a1 c(w) / N + a0 / (V + 1), where
the weights a depend on how frequent the context v is (one bucket for each power of two). They are learned by
expectation-maximisation on deleted data: a part of the training texts whose tokens are predicted with the counts of the
others. The scores then use the counts of all training texts.

How it runs. Texts are dealt into batches by a hash. A batch asks for each of its distinct n-grams once, with its own
counts (aggregation before the shuffle); requests are packed by ranges of the n-grams' hashes, summed over all batches
there, and the sums go back to the batches that asked. So the counts of the corpus never meet in one place, and a
frequent n-gram is one number per batch. Batches of deleted texts are kept apart: they alone take part in the
expectation-maximisation, whose steps exchange a few sums per bucket.

Tokens: words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case, then one end. n-grams are told apart by 63-bit hashes.

Defined results: a null text counts as empty and has the end as its only token. A null doc_id is dealt like the text
"". Repeated rows count and are scored each on its own. An empty table gives an empty result; without training texts
each token has the probability 1/3, the share of the uniform part. Other columns play no part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Bytes of text in a batch; one deleted training text of DELETED; steps of expectation-maximisation; buckets of context frequency.
BATCH, DELETED, STEPS, LEVELS, FLOOR = 8 << 20, 10, 12, 24, 1e-6
_START, _END = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A47)


class Tokens:
    """The tokens of a batch of texts. keys: its distinct n-grams in order (the last bit is 1 for pairs); token, context, pair: their places there for each position; a context of -1 is the start of a text."""

    def __init__(self, texts: list[bytes]):
        parts, sizes = [], []
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_binary())], ["text"])
        for x in C.blocks(iter([batch])):
            w = C.words(x["text"].view(pa.large_string()))
            parts.append(w.hash)
            sizes.append(np.diff(w.first))
        words = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.text = np.repeat(np.arange(len(size)), size + 1)
        self.size = size + 1
        last = np.cumsum(self.size) - 1
        h = np.empty(len(self.text), np.uint64)
        inner = np.ones(len(h), bool)
        inner[last] = False
        h[inner], h[last] = words, _END
        before = np.empty_like(h)
        before[1:], before[last - size] = h[:-1], _START
        one = h & ~np.uint64(1)
        two = C.mix(before * np.uint64(0xD6E8FEB86659FD93) + h) | np.uint64(1)
        self.keys, place = np.unique(np.concatenate([one, two]), return_inverse=True)
        self.token, self.pair = place[: len(h)], place[len(h) :]
        self.context = np.empty(len(h), np.int64)
        self.context[1:], self.context[last - size] = self.token[:-1], -1


def level(count: np.ndarray) -> np.ndarray:
    """The bucket of a context frequency: 0 for none, then one for each power of two."""
    return np.where(count > 0, np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64) + 1, LEVELS - 1), 0)


def small(x: np.ndarray) -> bytes:
    """Counts in a byte each; 255 stands for a larger one, which follows behind all bytes."""
    return np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].astype("<i8").tobytes()


def unsmall(b: bytes, n: int) -> np.ndarray:
    x = np.frombuffer(b, np.uint8, n).astype(np.int64)
    x[x == 255] = np.frombuffer(b, "<i8", offset=n)
    return x


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.blocks(batches):
        yield pa.RecordBatch.from_arrays(
            [*(batch[c] for c in ("batch", "doc_id", "train", "deleted")), pa.array([zlib.compress(x.as_py() or b"", 1) for x in batch["text"].cast(pa.large_binary())], pa.binary())],
            ["batch", "doc_id", "train", "deleted", "z"],
        )


def _unzip(column: pa.ChunkedArray) -> list[bytes]:
    return [zlib.decompress(x.as_py()) for x in column]


def _edges(keys: np.ndarray, ranges: int) -> np.ndarray:
    return np.searchsorted((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1))


def _ask(ranges: int):
    def ask(t: pa.Table) -> pa.Table:
        """The batch's n-grams with its training counts, by ranges of keys."""
        x = Tokens(_unzip(t["z"]))
        train = t["train"].to_numpy().astype(bool)[x.text]
        counts = np.bincount(x.token[train], minlength=len(x.keys)) + np.bincount(x.pair[train], minlength=len(x.keys))
        edge = _edges(x.keys, ranges)
        own = np.flatnonzero(np.diff(edge))
        return pa.table(
            {
                "range": pa.array(own, pa.int32()),
                "batch": pa.array(np.full(len(own), t["batch"][0].as_py()), pa.int64()),
                "deleted": pa.array(np.full(len(own), t["deleted"][0].as_py()), pa.bool_()),
                "keys": pa.array([C.planes(x.keys[edge[k] : edge[k + 1]]) for k in own], pa.binary()),
                "counts": pa.array([small(counts[edge[k] : edge[k + 1]]) for k in own], pa.binary()),
            }
        )

    return ask


def _answer(t: pa.Table) -> pa.Table:
    """Sums over all batches: for each asking batch those of its keys, in order. batch -1: distinct words, training tokens, and those of texts that aren't deleted."""
    keys = [C.unplanes(x.as_py(), np.uint64) for x in t["keys"]]
    counts = [unsmall(x.as_py(), len(k)) for x, k in zip(t["counts"], keys, strict=True)]
    at = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    deleted = t["deleted"].to_numpy().astype(bool)
    every_count = np.bincount(place, np.concatenate(counts), len(every)).astype(np.int64)
    kept = np.bincount(place, np.concatenate([np.where(d, 0, c) for d, c in zip(deleted, counts, strict=True)]), len(every)).astype(np.int64)
    one = (every & np.uint64(1)) == 0
    none = b""
    rows = [(-1, none, none, int((one & (every_count > 0)).sum()), int(every_count[one].sum()), int(kept[one].sum()))]
    for k, b in enumerate(t["batch"].to_pylist()):
        own = place[at[k] : at[k + 1]]
        rows.append((b, small(every_count[own]), small(kept[own]) if deleted[k] else none, 0, 0, 0))
    batch, all_, kept_, words, tokens, kept_tokens = zip(*rows, strict=True)
    return pa.table(
        {"batch": pa.array(batch, pa.int64()), "range": pa.array([t["range"][0].as_py()] * len(rows), pa.int32()), "every": pa.array(all_, pa.binary()), "kept": pa.array(kept_, pa.binary())}
        | {c: pa.array(x, pa.int64()) for c, x in (("words", words), ("tokens", tokens), ("kept_tokens", kept_tokens))}
    )


def _counts(x: Tokens, answers: pa.Table, column: str, ranges: int) -> np.ndarray:
    """The answers for x.keys."""
    edge = _edges(x.keys, ranges)
    size = np.diff(edge)
    found = sorted((r, b.as_py()) for r, b in zip(answers["range"].to_pylist(), answers[column], strict=True))
    return np.concatenate([unsmall(b, int(size[r])) for r, b in found]) if found else np.zeros(0, np.int64)


def _estimates(x: Tokens, count: np.ndarray, texts: int, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each position: bucket, pair estimate, word estimate, count of the word. texts: training texts, the count of their start."""
    c = np.where(x.context >= 0, count[x.context], texts)
    one, two = count[x.token], count[x.pair]
    return level(c), two / np.maximum(c, 1), one / max(1, tokens), one


def _evidence(ranges: int, texts: int, tokens: int):
    def evidence(docs: pa.Table, answers: pa.Table) -> pa.Table:
        """What the deleted texts of a batch say: equal (bucket, estimates) with how many tokens have them."""
        found = []
        if docs.num_rows:
            x = Tokens(_unzip(docs["z"]))
            b, two, one, _ = _estimates(x, _counts(x, answers, "kept", ranges), texts, tokens)
            rows, n = np.unique(np.rec.fromarrays([b, two, one]), return_counts=True)
            found.append((rows["f0"].astype(np.int32).tobytes(), rows["f1"].tobytes(), rows["f2"].tobytes(), n.astype(np.int64).tobytes()))
        return pa.table({c: pa.array([f[k] for f in found], pa.binary()) for k, c in enumerate(("bucket", "two", "one", "n"))})

    return evidence


def _expect(weights: np.ndarray, unknown: float):
    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many tokens each part of the mixture accounts for, by bucket."""
        total = np.zeros((LEVELS, 3))
        for batch in batches:
            for b, two, one, n in zip(*(batch[c].to_pylist() for c in ("bucket", "two", "one", "n")), strict=True):
                b, n = np.frombuffer(b, np.int32), np.frombuffer(n, np.int64)
                part = weights[b] * np.stack([np.frombuffer(two), np.frombuffer(one), np.full(len(b), unknown)], axis=1)
                part *= (n / part.sum(axis=1))[:, None]
                for k in range(3):
                    total[:, k] += np.bincount(b, part[:, k], LEVELS)
        yield pa.RecordBatch.from_arrays([pa.array(range(LEVELS), pa.int32()), *(pa.array(total[:, k]) for k in range(3))], ["bucket", "two", "one", "none"])

    return expect


def mixture(evidence: DataFrame, words: int, steps: int = STEPS) -> np.ndarray:
    """Mixture weights (pair, word, uniform) of each bucket, by expectation-maximisation. Buckets without evidence have equal weights."""
    weights = np.full((LEVELS, 3), 1 / 3)
    for _ in range(steps):
        sums = evidence.mapInArrow(_expect(weights, 1 / (words + 1)), "bucket int, two double, one double, none double").groupBy("bucket").agg(F.sum("two"), F.sum("one"), F.sum("none")).collect()
        new = weights.copy()
        for b, *x in sums:
            if sum(x) > 0:
                y = np.maximum(np.array(x) / sum(x), FLOOR)
                new[b] = y / y.sum()
        done, weights = np.abs(new - weights).max() < 1e-4, new
        if done:
            break
    return weights


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(ranges: int, texts: int, tokens: int, words: int, weights: np.ndarray):
    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        n = docs.num_rows
        x = Tokens(_unzip(docs["z"]) if n else [])
        b, two, one, c = _estimates(x, _counts(x, answers, "every", ranges), texts, tokens)
        w = weights[b]
        p = w[:, 0] * two + w[:, 1] * one + w[:, 2] / (words + 1)
        base = np.log10((c + 1) / (tokens + words + 1))
        return pa.table(
            {
                "doc_id": docs["doc_id"],
                "held_out": pa.array(~docs["train"].to_numpy().astype(bool)),
                "n_tokens": pa.array(x.size, pa.int64()),
                "n_known": pa.array(np.bincount(x.text, c > 0, n).astype(np.int64)),
                "train_tokens": pa.array(np.full(n, tokens), pa.int64()),
                "base_score": pa.array(np.bincount(x.text, base, n)),
                "score": pa.array(np.bincount(x.text, np.log10(p), n)),
            }
        )

    return score


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", train=None, batch: int = BATCH, steps: int = STEPS) -> DataFrame:
    """One row per row of docs. train: a boolean column of docs, true for training texts; by default those whose crc32(doc_id as text) mod 7 is not 2."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.col(doc_id).cast("long")
    train = F.coalesce(F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(7)) != 2 if train is None else train, F.lit(False))
    rows = docs.select(key.alias("doc_id"), F.col(text).cast("string").alias("text"), train.alias("train"))
    rows = rows.withColumn("deleted", F.col("train") & (F.pmod(F.xxhash64("doc_id", F.lit("deleted")), F.lit(DELETED)) == 0))
    size, texts, kept = rows.agg(F.sum(F.octet_length("text")), F.count_if("train"), F.count_if(F.col("train") & ~F.col("deleted"))).first()
    many = max(1, math.ceil((size or 0) / batch))
    few = max(1, math.ceil(many / DELETED))
    spread = F.xxhash64("doc_id", "text")
    dealt = F.when(F.col("deleted"), many + F.pmod(spread, F.lit(few))).otherwise(F.pmod(spread, F.lit(many)))
    dealt = rows.withColumn("batch", dealt).mapInArrow(_shrink, "batch long, doc_id long, train boolean, deleted boolean, z binary")
    ranges = max(4 * parts, many)
    asked = dealt.groupBy("batch").applyInArrow(_ask(ranges), "range int, batch long, deleted boolean, keys binary, counts binary")
    answers = C.cut(asked.groupBy("range").applyInArrow(_answer, "batch long, range int, every binary, kept binary, words long, tokens long, kept_tokens long"))
    words, tokens, kept_tokens = (x or 0 for x in answers.filter("batch = -1").agg(F.sum("words"), F.sum("tokens"), F.sum("kept_tokens")).first())
    deleted = dealt.filter("deleted").groupBy("batch").cogroup(answers.filter(F.col("batch") >= many).select("batch", "range", "kept").groupBy("batch"))
    evidence = C.cut(deleted.applyInArrow(_evidence(ranges, kept, kept_tokens), "bucket binary, two binary, one binary, n binary"))
    weights = mixture(evidence, words, steps)
    both = dealt.groupBy("batch").cogroup(answers.filter("batch >= 0").select("batch", "range", "every").groupBy("batch"))
    return both.applyInArrow(_score(ranges, texts, tokens, words, weights), _SCORES)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(C.table(spark, sf_dir, "documents"))
