"""What the operators share: the checkpoint folder, free column names and hashed words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from benchtide.operators.lineage import saved, shared_folder

#: Texts are worked on in blocks of about so many bytes; one longer text makes a block of its own.
BLOCK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df as files in the shared checkpoint folder."""
    return saved(df)


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in a new folder of the shared one, so that later reads take only the columns they need."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever its letters' case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def apart(column: str) -> Column:
    """A join key in place of a column by which one side has been dealt already. Both sides are then dealt for the join alone, which lets Spark split a partition that one frequent value fills."""
    return F.xxhash64(column).alias("apart")


def texts_of(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """One large_string array without nulls: a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column.cast(pa.large_string()).fill_null("")


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of at most `most` bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum([0, *(len(x.as_buffer()) if x.is_valid else 0 for x in batch[text].cast(pa.large_binary()))])
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


#: Rows of an Arrow batch while texts are read; Spark's own 10,000 are some 50 MB of texts in the executor and again in its worker.
BATCH_ROWS = 2000


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Within it, plans that run get Arrow batches of at most `rows` rows; the session's own number comes back afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(old)) if int(old) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `least` bytes or more, but the last."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= least:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


class Words(NamedTuple):
    """hash: of each word in order. first: where each text's words begin; its last entry is their number. start, end: bytes in the block."""

    hash: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: A random odd number for each byte value; fixed, so that all tasks and runs agree.
_BYTE = np.random.default_rng(20240601).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for k, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(max(n, BLOCK_BYTES + 4096), base, np.uint64)
            x[0] = 1
            _POWERS[k] = np.multiply.accumulate(x)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts end to end, and where each begins (with the end)."""
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def runs(kind: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """start and end of each run of bytes of one kind; kind 0 belongs to none, and no run crosses a text's end. at: where each text begins, with the end."""
    n = len(kind)
    edge = np.ones(n + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    edge[at] = True
    start = np.flatnonzero(edge[:n] & (kind != 0))
    end = np.flatnonzero(edge[1:] & (kind != 0)) + 1
    return start, end


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of pieces of data: equal pieces have equal hashes, in every task and run."""
    up, down = _powers(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def words(texts: pa.Array, lower: bool = True) -> Words:
    """The words `[^\\x20\\x09-\\x0D]+` of each text, A-Z in lower case, as hashes."""
    data, at = flat(texts)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none.astype(np.uint64), np.zeros(len(at), np.int64), none, none, data)
    if lower:
        data = _LOWER[data]
    start, end = runs((~_SPACE[data]).view(np.uint8), at)
    return Words(hashes(data, start, end), np.searchsorted(start, at), start, end, data)


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each text, and where each text's begin. A text of fewer words, but some, has its whole sequence as one."""
    counts = np.diff(w.first)
    many = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(many)])
    if not first[-1]:
        return np.zeros(0, np.uint64), first
    total = len(w.hash)
    h = np.zeros(total, np.uint64)
    for k in range(n):
        h[: total - k] = mix(h[: total - k] * np.uint64(0xD6E8FEB86659FD93) + w.hash[k:]) if total > k else h
    doc = np.repeat(np.arange(len(counts)), many)
    at = w.first[:-1][doc] + (np.arange(first[-1]) - first[:-1][doc])
    out = h[at]
    for d in np.flatnonzero((counts > 0) & (counts < n)):
        x = np.zeros(1, np.uint64)
        for v in w.hash[w.first[d] : w.first[d + 1]]:
            x = mix(x * np.uint64(0xD6E8FEB86659FD93) + v)
        out[first[d]] = mix(x + np.uint64(counts[d]))[0]
    return out, first


def planes(x: np.ndarray) -> bytes:
    """Sorted numbers as planes of bytes, the high ones first: these repeat, so the shuffle's compression removes them."""
    return np.ascontiguousarray(x.astype(x.dtype.newbyteorder(">"), copy=False).view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes()


def unplanes(b: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    n = len(b) // size
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, n).T).view(np.dtype(dtype).newbyteorder(">")).reshape(n).astype(dtype)
