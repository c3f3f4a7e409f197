"""Benchmark decontamination by greedy string tiling.

Karp-Rabin fingerprints of TILE consecutive tokens, shared by a document and a benchmark item, are the seeds. Where the
seeds of a pair could cover enough of the item, the tiling runs: the longest match whose tokens are all unmarked becomes
a tile and is marked, what overlaps it is cut down, until no match of TILE tokens is left. Tiles may lie in any order, so
reordered passages count. A document is contaminated by an item if tiles cover COVERAGE of the item's tokens or more.

Tokens are runs of letters, digits and underscores in lower case. The benchmark is a stated query set: it is sent to the
executors in blocks of bounded size, and every block meets every whole text. Nothing is shuffled.

Defined results: null and empty texts are never contaminated. An item with fewer than TILE tokens (or a null text)
contaminates nothing. Repeated rows give repeated rows. An empty benchmark or table gives an empty result, and keeps all
documents. Other columns play no part.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

TILE, COVERAGE = 4, 0.5
#: Bytes of benchmark text that are broadcast at once.
BLOCK = 16 << 20

_WORD = np.zeros(256, np.uint8)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x5F, *range(0x80, 0x100)]] = 1
_SIEVE_BITS = 22


def tokens(texts: pa.Array) -> C.Words:
    data, at = C.flat(pc.utf8_lower(texts))
    if not len(data):
        return C.words(texts)
    start, end = C.runs(_WORD[data], at)
    return C.Words(C.hashes(data, start, end), np.searchsorted(start, at), start, end, data)


def prints(w: C.Words, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of the tile tokens from each token on, and whether they lie in one text."""
    n = len(w.hash)
    h = np.zeros(max(0, n - tile + 1), np.uint64)
    for k in range(tile):
        h = C.mix(h * np.uint64(0x9E3779B97F4A7C15) + w.hash[k : k + len(h)])
    text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    return h, text[: len(h)] == text[tile - 1 :] if len(h) else np.zeros(0, bool)


class Items:
    """Benchmark items with an index of their seeds."""

    def __init__(self, ids: list[int], texts: list[str], tile: int = TILE):
        w = tokens(C.texts_of(pa.array(texts, pa.large_string())))
        h, whole = prints(w, tile)
        at = np.flatnonzero(whole)
        order = np.argsort(h[at], kind="stable")
        self.ids, self.tile, self.first = ids, tile, w.first
        self.seed, self.place = h[at][order], at[order]
        self.item = np.searchsorted(w.first, self.place, "right") - 1
        self.sieve = np.zeros(1 << _SIEVE_BITS, bool)
        self.sieve[self.seed >> np.uint64(64 - _SIEVE_BITS)] = True

    def matches(self, texts: pa.Array, coverage: float) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, tokens of the item in tiles, tiles, tokens of the longest tile) for each pair that reaches the coverage."""
        w = tokens(texts)
        h, whole = prints(w, self.tile)
        at = np.flatnonzero(whole & self.sieve[h >> np.uint64(64 - _SIEVE_BITS)]) if len(h) else np.zeros(0, np.int64)
        low, high = np.searchsorted(self.seed, h[at], "left"), np.searchsorted(self.seed, h[at], "right")
        at, low, high = (x[high > low] for x in (at, low, high))
        if not len(at):
            return
        n = high - low
        hit = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())  # every place of the seed in the items
        doc_at, item, item_at = np.repeat(at, n), self.item[hit], self.place[hit] - self.first[self.item[hit]]
        text = np.searchsorted(w.first, doc_at, "right") - 1
        order = np.lexsort((item, text))
        doc_at, item, item_at, text = (x[order] for x in (doc_at, item, item_at, text))
        edge = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1])]))
        for a, b in zip(edge, [*edge[1:], len(text)], strict=True):
            t, i = int(text[a]), int(item[a])
            size = int(self.first[i + 1] - self.first[i])
            within = np.zeros(size + 1, np.int32)
            np.add.at(within, item_at[a:b], 1)
            np.add.at(within, item_at[a:b] + self.tile, -1)
            if np.count_nonzero(np.cumsum(within)[:-1] > 0) < coverage * size:
                continue  # all seeds together don't cover enough
            tiles = tiling(doc_at[a:b] - w.first[t], item_at[a:b], self.tile)
            covered = sum(n for _, _, n in tiles)
            if covered >= coverage * size:
                yield t, i, covered, len(tiles), max(n for _, _, n in tiles)


def tiling(doc_at: np.ndarray, item_at: np.ndarray, tile: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the document, in the item, length) from the places of all seeds of a pair. Of equal lengths the first in the item, then in the document, is taken."""
    order = np.lexsort((item_at, doc_at - item_at))
    d, j = doc_at[order], item_at[order]
    edge = np.flatnonzero(np.concatenate([[True], (np.diff(d) != 1) | (np.diff(j) != 1)]))
    length = np.diff([*edge, len(d)]) + tile - 1  # seeds on one diagonal, one after the other, are one match
    heap = [(-int(n), int(b), int(a)) for n, b, a in zip(length, j[edge], d[edge], strict=True)]
    heapq.heapify(heap)
    used_d, used_j, tiles = set(), set(), []
    while heap:
        n, b, a = heapq.heappop(heap)
        free = [a + k not in used_d and b + k not in used_j for k in range(-n)]
        if all(free):
            tiles.append((a, b, -n))
            used_d.update(range(a, a - n))
            used_j.update(range(b, b - n))
            continue
        k = 0
        while k < -n:  # what is left of it, where long enough, waits for its turn
            run = k
            while run < -n and free[run]:
                run += 1
            if run - k >= tile:
                heapq.heappush(heap, (k - run, b + k, a + k))
            k = max(run, k) + 1
    return tiles


def blocks_of_items(benchmark: DataFrame, text: str, item_id: str, tile: int, block: int) -> Iterator[Items]:
    """The benchmark in blocks of about `block` bytes, one at a time on the driver."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).na.drop()
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / block))
    for k in range(n):
        own = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        yield Items(own["item_id"].to_pylist(), own["text"].to_pylist(), tile)


_FOUND = "doc_id long, item_id long, coverage double, covered_tokens long, item_tokens long, tiles long, longest_tile long"


def _find(spread, coverage: float):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = spread.value
        for batch in C.blocks(batches):
            rows = list(items.matches(C.texts_of(batch["text"]), coverage))
            if rows:
                t, i, covered, tiles, longest = (np.array(x, np.int64) for x in zip(*rows, strict=True))
                size = items.first[i + 1] - items.first[i]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(pa.array(t)), pa.array(np.array(items.ids, np.int64)[i]), pa.array(covered / size), *(pa.array(x, pa.int64()) for x in (covered, size, tiles, longest))],
                    ["doc_id", "item_id", "coverage", "covered_tokens", "item_tokens", "tiles", "longest_tile"],
                )

    return find


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", tile: int = TILE, coverage: float = COVERAGE, block: int = BLOCK) -> DataFrame:
    """One row for each pair of a document and an item whose tiles reach the coverage."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    spread = docs.sparkSession.sparkContext.broadcast
    out = None
    for items in blocks_of_items(benchmark, item_text, item_id, tile, block):
        found = rows.mapInArrow(_find(spread(items), coverage), _FOUND)
        out = found if out is None else out.unionAll(found)
    return out


def _hit(spread, coverage: float):
    @F.arrow_udf("boolean")
    def hit(column: pa.Array) -> pa.Array:
        out = []
        for x in C.blocks(iter([pa.RecordBatch.from_arrays([column], ["text"])])):
            bad = np.zeros(x.num_rows, bool)
            bad[[t for t, *_ in spread.value.matches(C.texts_of(x["text"]), coverage)]] = True
            out.append(bad)
        return pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    return hit


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", tile: int = TILE, coverage: float = COVERAGE, block: int = BLOCK) -> DataFrame:
    """The rows of docs that no item contaminates, with docs' own columns."""
    for items in blocks_of_items(benchmark, item_text, item_id, tile, block):
        docs = docs.filter(~_hit(docs.sparkSession.sparkContext.broadcast(items), coverage)(F.col(text).cast("string")))
    return docs


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
