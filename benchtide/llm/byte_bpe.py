"""Byte-level BPE encoding and decoding by a rank file.

A text is split by a pattern into parts; each part is encoded on its own. New parts are put, by length, into padded
matrices of tokens, a part a row. In each round every row merges its leftmost pair of least rank. Pairs are looked up in
a hash table of open addresses, whole columns at once: of a merge only the two new neighbours have to be looked up. Then
the row closes the gap and finished rows leave the matrix. A worker encodes a distinct part once while it stays in a
bounded cache. Decoding puts the bytes of all ids of a block together at once.

A pair's rank is that of its two tokens' bytes together, and a part that is a token itself is that token, as in the
public library tiktoken. A matrix as wide as a very long part would need as many rounds as the part has bytes, so parts
of more than WIDE bytes merge the same pairs in the same order by a heap.

Defined results: a null or empty text has no ids and decodes to no bytes; an unknown id is an error. Repeated rows are
encoded each on its own; a null doc_id stays null; an empty table gives an empty result. Other input columns play no
part, whatever their names. The strings of special tokens are ordinary text. Memory: a block of texts (2 MB, or one text),
their ids, and the cache.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Longest part for a matrix, cells of a matrix, parts in a worker's cache.
WIDE, CELLS, CACHE = 512, 1 << 19, 200_000
_NONE = np.int32(2**31 - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Pairs:
    """The ranks of pairs of tokens in a hash table of open addresses."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(4, int(len(rank) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int32)
        key = left.astype(np.int64) << 32 | right
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = todo[self.keys[slot[todo]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.ranks[slot[won]] = key[won], rank[won]
            todo = todo[self.keys[slot[todo]] != key[todo]]
            slot[todo] = slot[todo] + 1 & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * _ODD >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or _NONE; a negative token makes no pair."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        out = np.full(len(key), _NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        slot = self._slot(key[todo])
        while len(todo):
            found = self.keys[slot]
            same = found == key[todo]
            out[todo[same]] = self.ranks[slot[same]]
            on = ~same & (found >= 0)
            todo, slot = todo[on], slot[on] + 1 & self.mask
        return out


class Codec(dict):
    """Parts (as text) to their ids, as bytes of little-endian 32-bit numbers; a part not seen before is absent until `learn`."""

    def __init__(self, path: str, pattern: str, most: int = CACHE):
        import regex

        super().__init__()
        self.split, self.most = regex.compile(pattern).findall, most
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        made = [(self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        self.pairs = Pairs(*np.array(made, np.int64).reshape(-1, 3).T)
        size = np.zeros(max(self.ranks.values()) + 1, np.int64)
        for token, rank in self.ranks.items():
            size[rank] = len(token)
        self.size, self.at = size, np.cumsum(size) - size
        self.bytes = np.frombuffer(b"".join(sorted(self.ranks, key=self.ranks.get)), np.uint8)

    def _matrix(self, parts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """(place in parts, ids) of each of some parts of at most WIDE bytes."""
        size = np.array([len(p) for p in parts])
        table = np.full((len(parts), size.max()), -1, np.int32)
        table[np.arange(table.shape[1]) < size[:, None]] = self.byte[np.frombuffer(b"".join(parts), np.uint8)]
        rank = self.pairs(table[:, :-1].ravel(), table[:, 1:].ravel()).reshape(len(parts), -1)
        row = np.arange(len(parts))
        while len(row):
            if not rank.shape[1]:
                least, at = np.full(len(row), _NONE), np.zeros(len(row), np.int64)
            else:
                at = rank.argmin(1)  # the leftmost of the least
                least = rank[np.arange(len(row)), at]
            done = least == _NONE
            if done.any():
                for k, ids, n in zip(row[done].tolist(), table[done], size[done], strict=True):
                    yield k, ids[:n]
                on = ~done
                wide = max(1, int(size[on].max(initial=1)))  # the matrix grows narrower with its longest row
                table, rank, row, size, at, least = table[on, :wide], rank[on, : wide - 1], row[on], size[on], at[on], least[on]
                if not len(row):
                    break
            place, own = np.arange(table.shape[1] - 1), np.arange(len(row))
            table[own, at] = least  # a token's id is its rank
            table[:, :-1] = np.take_along_axis(table, place + (place > at[:, None]), 1)
            rank[:, :-1] = np.take_along_axis(rank, place[:-1] + (place[:-1] > at[:, None]), 1)
            table[:, -1], rank[:, -1], size = -1, _NONE, size - 1
            rank[own, at] = self.pairs(table[own, at], table[own, at + 1])
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.pairs(table[left, at[left] - 1], table[left, at[left]])

    def _heap(self, part: bytes) -> np.ndarray:
        """The ids of one long part: the pairs wait in a heap by rank, then place."""
        token = self.byte[np.frombuffer(part, np.uint8)].tolist()
        n, of = len(token), self.ranks.get
        end = [*range(1, n + 1)]  # of the token that begins here; 0 where none begins
        before = [*range(-1, n - 1)]
        first = self.pairs(np.array(token[:-1], np.int32), np.array(token[1:], np.int32))
        heap = [(int(first[k]), k, k + 2) for k in np.flatnonzero(first != _NONE).tolist()]
        heapq.heapify(heap)
        while heap:
            rank, a, c = heapq.heappop(heap)
            b = end[a]
            if not b or b >= n or end[b] != c or c - a != self.size[rank]:
                continue  # one of the two has been merged since
            token[a], end[a], end[b] = rank, c, 0
            if c < n:
                before[c] = a
                if (r := of(part[a : end[c]])) is not None:
                    heapq.heappush(heap, (r, a, end[c]))
            if (p := before[a]) >= 0 and (r := of(part[p:c])) is not None:
                heapq.heappush(heap, (r, p, c))
        return np.array([token[k] for k in range(n) if end[k]], np.int32)

    def learn(self, parts: set[str]) -> None:
        """Encodes parts, by lengths that differ little, and keeps them."""
        left = []
        for p in parts:
            raw = p.encode()
            if (own := self.ranks.get(raw)) is not None:
                self[p] = own.to_bytes(4, "little")
            elif len(raw) > WIDE:
                self[p] = self._heap(raw).astype("<i4").tobytes()
            else:
                left.append((raw, p))
        left.sort(key=lambda x: len(x[0]))
        at = 0
        while at < len(left):
            to, least = at, len(left[at][0])
            while to < len(left) and len(left[to][0]) <= least + least // 4 and (to - at) * len(left[to][0]) < CELLS:
                to += 1
            for k, ids in self._matrix([raw for raw, _ in left[at:to]]):
                self[left[at + k][1]] = ids.astype("<i4").tobytes()
            at = to

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self) > self.most:
            self.clear()
        split = [self.split(t) for t in texts]
        new = {p for parts in split for p in parts if p not in self}
        if new:
            self.learn(new)
        return [np.frombuffer(b"".join([self[p] for p in parts]), "<i4") for parts in split]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes of the ids, end to end, and where each text's begin. first: where each text's ids begin, with their number."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size) or not self.size[ids].all()):
            raise ValueError("an id is not in the rank file")
        size = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.bytes[np.repeat(self.at[ids] - ends[:-1], size) + np.arange(ends[-1])], ends[first]


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One for each worker process."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, ids. Nothing is shuffled."""
    path, split = ranks or default_ranks(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(path, split)
        for batch in C.blocks(batches):
            found = code.encode([str(x, "utf-8", "replace") for x in C.texts_of(batch["text"]).cast(pa.large_binary()).to_pylist()])
            at = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(found), pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, ids: str = "ids", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """coded with a column `decoded`, the bytes of its ids; null ids count as none."""
    path, split = ranks or default_ranks(), pattern or default_pattern()
    if C.fresh(coded, "decoded") != "decoded":
        raise ValueError("coded has a column decoded already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(path, split)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                piece = batch.slice(k, 256)
                own = piece[ids].cast(pa.large_list(pa.int32()))
                sizes = np.array(own.value_lengths().fill_null(0))
                data, at = code.decode(np.array(own.flatten()), np.concatenate([[0], np.cumsum(sizes)]))
                out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([*piece.columns, out.cast(pa.binary())], [*piece.schema.names, "decoded"])

    return coded.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in coded.schema)}, decoded binary")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = decode(encode(C.table(spark, sf_dir, "documents")))
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
