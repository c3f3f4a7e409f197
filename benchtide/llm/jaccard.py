"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersections, connected components.

A text is the set of its distinct shingles of `words` words (WORDS = 4 in the query). Texts with equal sets are one node.
Nodes link when the Jaccard similarity of their sets is percent/100 or more (PERCENT = 85 in the query).

Tiles. Two linked sets of at most U shingles differ in d = 2U(1-t)/(1+t) shingles at most. If the hash space is cut into
p > d ranges, they have the same shingles in p - d ranges at least. Of these, the one with the most shingles (ties by hash)
has p - d - 1 smaller ones beside it in either set. So every node is put into a tile for each range but its p - d - 1
smallest: the key is a hash of the size band, the range and the shingles there, and all links lie within tiles. Bands grow by GROWTH; a
node also enters the tiles of each larger band that sets it may link with lie in. A shared passage brings texts together only
where it fills a whole range, so frequent passages make few false tiles. Empty ranges make a tile only for nodes that
have p - d of them or more: linked nodes that agree nowhere else have so many both.

Links. Each member of a tile is compared with the tile's first member, and the links found join nodes to components. Where a
batch of texts has more than PIECE nodes in a tile, they are a piece with a first member of its own, and only that one
meets the rest of the tile: so no task gathers a large tile. Only
members of tiles that are still in several components are compared further: those outside the tile's largest component
with all members, block by block; first for a few pairs that would connect them, then for every pair that is left. All
comparisons first bound the intersection by the bits of hashed bitmaps, whose width follows the set's size, and what passes
is decided by the exact intersection of sorted arrays. No pair is skipped unless both ends are connected already, so the
components are those of all links.

Defined results: a null text, an empty one or one without words has an empty set, links with nothing and is its own
component. A text of fewer than `words` words has its whole sequence as its one shingle. Repeated rows are equal texts. A
null doc_id is not chosen as a component's id unless nothing else is there. An empty table gives an empty result. Other
columns play no part. Shingles and nodes are told apart by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WORDS, PERCENT, GROWTH, SLACK = 4, 85, 1.5, 0.4
TILE_BLOCK = 1024  # members of a tile that are compared with others at once
FEW = 250_000  # pairs whose nodes (two numbers a pair) may be broadcast; more are joined by a shuffle
PIECE = 16  # of a tile with more nodes in one batch, that batch's nodes are a piece of their own
A_FILE, LINKS_A_FILE = 500_000, 200_000  # shingles of the input, and links, for each file of a checkpoint

_K = np.uint64(0xD6E8FEB86659FD93)


@lru_cache
def bands(percent: int = PERCENT, growth: float = GROWTH, most: int = 1 << 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each size band: its largest size, the most differences d of two linked sets up to that size, and the number p of ranges."""
    upper = [1]
    while upper[-1] < most:
        upper.append(max(upper[-1] + 1, int(upper[-1] * growth)))
    u = np.array(upper, np.int64)
    d = 2 * u * (100 - percent) // (100 + percent)
    return u, d, np.where(d == 0, 1, d + 1 + np.ceil(SLACK * d).astype(np.int64))


def sets(texts: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, end to end, and where each text's begin."""
    g, first = C.grams(C.words(texts), n)
    for a, b in zip(first[:-1], first[1:], strict=True):
        g[a:b].sort()
    if not len(g):
        return g, first
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    new[first[:-1][np.diff(first) > 0]] = True
    at = np.concatenate([[0], np.cumsum(new)])
    return g[new], at[first]


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums (mod 2^64) of the pieces of x that begin at first; empty pieces have 0."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])
    return total[first[1:]] - total[first[:-1]]


def nodes(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A number for each set; equal sets have equal numbers."""
    return C.mix(_sums(C.mix(g ^ _K), first) + C.mix(np.diff(first).astype(np.uint64)))


def tiles(g: np.ndarray, first: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the tiles of each set, and which set it is."""
    upper, differ, ranges = bands(percent)
    size = np.diff(first)
    own = np.searchsorted(upper, size)
    most = size * 100 // percent  # the largest set that each may link with
    keys, whose = [], []
    inner = C.mix(g + np.uint64(0x5851F42D4C957F2D))
    for step in range(int((np.searchsorted(upper, most) - own).max(initial=0)) + 1):  # the own band, and larger ones for sets that may link with sets there
        band = np.minimum(own + step, len(upper) - 1)
        takes = (size > 0) & (differ[band] > 0)
        if step:
            takes &= most > upper[band - 1]
        p = np.where(takes, ranges[band], 0)
        base = np.concatenate([[0], np.cumsum(p)])
        doc = np.repeat(np.arange(len(size)), np.where(takes, size, 0))
        if not len(doc):
            continue
        use = np.repeat(takes, size)
        part = ((g[use] >> np.uint64(32)) * p[doc].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        group = base[doc] + part  # never falls, as a set is sorted
        edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        total = np.add.reduceat(inner[use], edge)
        d, k = doc[edge], part[edge]
        key = C.mix(C.mix(total) + C.mix((band[d].astype(np.uint64) << np.uint64(40)) + k.astype(np.uint64)))
        full = np.bincount(d, minlength=len(size))
        empty = p - full
        order = np.lexsort((key, np.diff(np.append(edge, len(doc))), d))
        place = np.arange(len(d)) - (np.cumsum(full) - full)[d]  # within the set, the smallest first; d never falls
        kept = order[place >= (p - differ[band] - 1 - empty)[d]]
        keys.append(key[kept])
        whose.append(d[kept])
        for x in np.flatnonzero(takes & (empty >= p - differ[band]) & (empty > 0)):
            gone = np.setdiff1d(np.arange(p[x]), k[d == x]).astype(np.uint64)
            keys.append(C.mix((np.uint64(band[x]) << np.uint64(40)) + gone))
            whose.append(np.full(len(gone), x))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(whose)


def bits_of(n: int) -> int:
    """Width of the bitmap of a set of n shingles: a power of two, so that at most a quarter of the bits are set whatever the size."""
    return max(1024, 1 << (4 * n - 1).bit_length() if n else 0)


def bitmaps(g: np.ndarray, first: np.ndarray) -> list[bytes]:
    """The bits that each set's shingles name by their hashes."""
    out, h = [], C.mix(g)
    for a, b in zip(first[:-1], first[1:], strict=True):
        bits = np.zeros(bits_of(int(b - a)), np.uint8)
        bits[(h[a:b] & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
        out.append(np.packbits(bits).tobytes())
    return out


def folded(bits: list[bytes], width: int | None = None) -> np.ndarray:
    """Bitmaps as rows of one width in bytes, by default the least: a wider one is folded, which gives the bitmap of that width."""
    width = width or min(map(len, bits))
    return np.stack([np.bitwise_or.reduce(np.frombuffer(x, np.uint8).reshape(-1, width), axis=0) for x in bits])


def may_link(na: np.ndarray, a: np.ndarray, nb: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """False where sizes or bits show that sets can't link: each bit that only one set has stands for a shingle that only that set has, which bounds the intersection from above."""
    a, b = (np.ascontiguousarray(x).view(np.uint64) for x in (a, b))
    most = np.minimum(na - np.bitwise_count(a & ~b).sum(-1, dtype=np.int64), nb - np.bitwise_count(b & ~a).sum(-1, dtype=np.int64))
    return (100 + percent) * most >= percent * (na + nb)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Exact, of two sorted arrays without repeats."""
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(both) - common)


def _marks(words: int):
    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.blocks(batches):
            g, first = sets(C.texts_of(batch["text"]), words)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row"], pa.array(np.diff(first), pa.int64()), pa.array(nodes(g, first).view(np.int64))], ["doc_id", "row", "n", "node"])

    return marks


def _postings(buckets: int, words: int, percent: int):
    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.blocks(C.gathered(batches, 8 * C.BLOCK_BYTES), most=4 * C.BLOCK_BYTES):
            keys, who = [], []
            for part in C.blocks(iter([batch])):
                g, first = sets(C.texts_of(part["text"]), words)
                k, whose = tiles(g, first, percent)
                keys.append(k)
                who.append(nodes(g, first)[whose])
            k, v = np.concatenate(keys), np.concatenate(who)
            if not len(k):
                continue
            order = np.lexsort((v, k))
            k, v = k[order], v[order]
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])])
            k, v = k[new], v[new]
            edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            size = np.diff(np.append(edge, len(k)))
            large = np.repeat(size > PIECE, size)
            lone = ~large
            lone[edge] = True
            parts = [(_spread(k, buckets), k, v, lone)]
            if large.any():
                parts.append((buckets + _spread(C.mix(k + np.repeat(v[edge], size).view(np.uint64)), buckets), k, v, large))
            for bucket, *kv, own in parts:
                bucket, kk, vv = bucket[own], kv[0][own], kv[1][own]
                order = np.lexsort((vv, kk, bucket))
                bucket, kk, vv = bucket[order], kk[order], vv[order]
                at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                ends = [*at[1:], len(bucket)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[at], pa.int64()), pa.array([C.planes(kk[x:y]) for x, y in zip(at, ends, strict=True)], pa.binary()), pa.array([vv[x:y].tobytes() for x, y in zip(at, ends, strict=True)], pa.binary())],
                    ["bucket", "keys", "nodes"],
                )

    return postings


def _spread(k: np.ndarray, buckets: int) -> np.ndarray:
    return ((k >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _members(buckets: int):
    def members(t: pa.Table) -> pa.Table:
        """The members of the bucket's tiles with several nodes: tile, first (the least node of the tile, or of the piece), node. From `buckets` on there are pieces of large tiles, each complete in one row."""
        rows = [(C.unplanes(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.int64)) for x, y in zip(t["keys"], t["nodes"], strict=True)]
        if t["bucket"][0].as_py() < buckets:
            rows = [tuple(np.concatenate(x) for x in zip(*rows, strict=True))]
        out = []
        for k, v in rows:
            order = np.lexsort((v, k))
            k, v = k[order], v[order]
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])])
            k, v = k[new], v[new]
            edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            size = np.diff(np.append(edge, len(k)))
            keep = np.repeat(size, size) > 1
            out.append((k[keep].view(np.int64), np.repeat(v[edge], size)[keep], v[keep]))
        tile, first, node = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"tile": tile, "first": first, "node": node})

    return members


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.blocks(batches):
        yield pa.RecordBatch.from_arrays([batch["row"], pa.array([zlib.compress(x.as_py() or b"", 1) for x in batch["text"].cast(pa.large_binary())], pa.binary())], ["row", "z"])


def _unzipped(batches: Iterator[pa.RecordBatch], most: int = C.BLOCK_BYTES) -> Iterator[pa.Array]:
    """The zipped texts in blocks of at most `most` bytes as they are unzipped, or of one text. (A block that is measured zipped can be a thousand times as large.)"""
    texts, size = [], 0
    for batch in batches:
        for z in batch["z"]:
            x = zlib.decompress(z.as_py())
            if texts and size + len(x) > most:
                yield pa.array(texts, pa.large_binary()).view(pa.large_string())
                texts, size = [], 0
            texts.append(x)
            size += len(x)
    if texts:
        yield pa.array(texts, pa.large_binary()).view(pa.large_string())


def _info(words: int):
    def info(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _unzipped(batches):
            g, first = sets(texts, words)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes(g, first).view(np.int64)), pa.array(np.diff(first), pa.int64()), pa.array(bitmaps(g, first), pa.binary()), pa.array([g[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)], pa.binary())],
                ["node", "n", "bits", "shingles"],
            )

    return info


def _bounded(percent: int):
    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = []
            for na, p, nb, q in zip(*(x[c].to_pylist() for c in ("n_a", "bits_a", "n_b", "bits_b")), strict=True):
                two = folded([p, q])
                keep.append(bool(may_link(na, two[0], nb, two[1], percent)))
            yield x.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return bounded


def _exact(percent: int):
    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            keep = [linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a, b in zip(x["shingles_a"].to_pylist(), x["shingles_b"].to_pylist(), strict=True)]
            yield x.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return exact


def _links(pairs: DataFrame, info: DataFrame, percent: int, files: int, bounded: bool = False) -> DataFrame:
    """The linked ones of pairs(a, b), in checkpoints: first by the bounds (in `files` files at most), unless that is done, then exactly. Sets are fetched for nodes of pairs that pass the bounds only."""

    def joined(pairs: DataFrame, info: DataFrame) -> DataFrame:
        for x in ("b", "a"):
            pairs = pairs.join(info.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in info.columns if c != "node")), x)
        return pairs

    near = pairs if bounded else joined(pairs, info.select("node", "n", "bits")).mapInArrow(_bounded(percent), "a long, b long")
    near = C.cut(near.coalesce(files))
    n = near.count()
    asked = near.select(F.col("a").alias("node")).unionAll(near.select("b")).distinct()
    asked = F.broadcast(asked) if n <= FEW else asked
    found = joined(near, info.select("node", "shingles").join(asked, "node", "left_semi")).mapInArrow(_exact(percent), "a long, b long")
    return C.cut(found.repartition(max(1, -(-n // LINKS_A_FILE))))


def _cells(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows with equal keys, which follow one another, as one table each."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        k = np.stack([t[c].to_numpy() for c in keys])
        edge = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
        at = 0
        for to in edge.tolist():
            yield t.slice(at, to - at)
            at = to
        rest = t.slice(at)
    if rest is not None:
        yield rest


def _compare(percent: int, spanning: bool):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of a guest (a member outside the tile's largest component) and a member of another component that may link, of each cell of a tile.

        spanning: only pairs that would connect what no pair before them in the cell would, so their number doesn't exceed that of the members.
        """
        for t in _cells(batches, ("tile", "i", "o")):
            node, first, root, n = (t[c].to_numpy() for c in ("node", "first", "root", "n"))
            outer, guest = (t[c].to_numpy(zero_copy_only=False) for c in ("outer", "guest"))
            bits = folded(t["bits"].to_pylist())
            x, inner = np.flatnonzero(guest), np.flatnonzero(~guest)
            whose, mine = root[inner], root[x]  # components as they would be if all pairs linked
            out = []
            for k, i in enumerate(x):
                # other components; of two guests once; not with the first member, that is done
                near = (whose != mine[k]) & (~outer[inner] | (node[inner] > node[i])) & (node[inner] != first[i]) & (first[inner] != node[i])
                y = inner[near]
                if not len(y):
                    continue
                ok = may_link(n[i], bits[i][None], n[y], bits[y], percent)
                if not ok.any():
                    continue
                y = y[ok]
                if spanning:
                    meets, at = np.unique(whose[near][ok], return_index=True)
                    y, own = y[at], mine[k]
                    whose[np.isin(whose, meets)] = own
                    mine[np.isin(mine, meets)] = own
                out.append(np.stack([np.minimum(node[i], node[y]), np.maximum(node[i], node[y])]))
            if out:
                a, b = np.unique(np.concatenate(out, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), t["tile"][0].as_py())), pa.array(a), pa.array(b)], ["tile", "a", "b"])

    return compare


def _unconnected(members: DataFrame, roots: DataFrame, info: DataFrame, percent: int, tile_block: int, spanning: bool) -> DataFrame:
    """(tile, a, b): pairs of members of a tile but of several components that may link. Of tiles with the same members one stands for all.

    A tile's members are dealt into blocks, and so are those outside its largest component; each pair of blocks is a cell, so a cell is small whatever the tile's size.
    """
    rooted = members.join(roots, "node", "left").select("tile", "first", "node", F.coalesce("root", "node").alias("root"))
    mark = F.xxhash64("node", "first")
    low, high = (F.pmod(x, F.lit(1 << 40)) for x in (mark, F.shiftright(mark, 24)))
    sizes = rooted.groupBy("tile", "root").agg(F.count("*").alias("k"), F.try_sum(low).alias("low"), F.try_sum(high).alias("high"))
    split = sizes.groupBy("tile").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.max("k").alias("most"), F.sum("k").alias("size"), F.count("*").alias("roots"), *(F.coalesce(F.try_sum(c), "tile").alias(c) for c in ("low", "high"))).filter("roots > 1 AND size > 2")
    split = split.groupBy("size", "low", "high").agg(F.min(F.struct("tile", "main", "most")).alias("one")).select("one.*", "size")
    blocks, outers = F.ceil(F.col("size") / tile_block).alias("blocks"), F.ceil((F.col("size") - F.col("most")) / tile_block).alias("outers")
    found = rooted.select("*", C.apart("tile")).join(split.select(C.apart("tile"), "main", blocks, outers), "apart").select("tile", "first", "node", "root", (F.col("root") != F.col("main")).alias("outer"), "blocks", "outers")
    found = found.join(info.select("node", "n", "bits"), "node")
    i, o = F.pmod(F.xxhash64("node"), "blocks"), F.pmod(F.xxhash64("node"), "outers")
    home = F.transform(F.sequence(F.lit(0).cast("long"), F.col("outers") - 1), lambda x: F.struct(i.alias("i"), x.alias("o"), F.lit(False).alias("guest")))
    away = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.struct(x.alias("i"), o.alias("o"), F.lit(True).alias("guest")))
    cells = found.withColumn("cell", F.explode(F.when(F.col("outer"), F.concat(home, away)).otherwise(home))).select("tile", "cell.*", "first", "node", "root", "outer", "n", "bits")
    return cells.repartition("tile", "i", "o").sortWithinPartitions("tile", "i", "o").mapInArrow(_compare(percent, spanning), "tile long, a long, b long")


def _row(doc_id: str, text: str):
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("string"))


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT, tile_block: int = TILE_BLOCK, words: int = WORDS) -> DataFrame:
    """(doc_id, row, n, node, root) of each row, as read from checkpoints. row: a hash of doc_id and text. root: the component's least node.

    A checkpoint has as many files as its size asks for, and not one for each shuffle partition: on a file system without
    native code an executor starts a process for each file that it creates.
    """
    with C.small_batches(docs.sparkSession):
        return _classes(docs, text, doc_id, percent, tile_block, words)


def _classes(docs: DataFrame, text: str, doc_id: str, percent: int, tile_block: int, words: int) -> DataFrame:
    from .graph import components

    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _row(doc_id, text).alias("row"), F.col(text).cast("string").alias("text"))
    marks = C.cut(rows.mapInArrow(_marks(words), "doc_id long, row long, n long, node long"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = marks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(8 * parts, total // 2_000_000)  # about 600,000 keys in each at most, however large the input
    files = max(2 * spark.sparkContext.defaultParallelism, total // A_FILE)
    postings = rows.select("text").mapInArrow(_postings(buckets, words, percent), "bucket long, keys binary, nodes binary")
    members = C.cut(postings.groupBy("bucket").applyInArrow(_members(buckets), "tile long, first long, node long").coalesce(files))
    chosen = marks.join(members.select("node").distinct(), "node").groupBy("node").agg(F.min("row").alias("row")).select("row")
    packed = rows.select("row", "text").mapInArrow(_shrink, "row long, z binary")
    text_rows = packed.join(chosen.hint("shuffle_hash"), "row", "left_semi").groupBy("row").agg(F.first("z").alias("z"))
    info = C.cut(text_rows.select("z").mapInArrow(_info(words), "node long, n long, bits binary, shingles binary").coalesce(files))
    stars = members.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    roots = C.cut(components(_links(stars, info, percent, files)))
    within = members
    for spanning in (True, False):  # few pairs first, which connect most of what links; then every pair that is left
        pairs = C.cut(_unconnected(within, roots, info, percent, tile_block, spanning).coalesce(files))
        links = _links(pairs.select("a", "b").distinct(), info, percent, files, True)
        if not links.isEmpty():
            roots = C.cut(components(links.unionAll(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))))
        # where each pair that was looked at links, those that were left out for it are connected
        unsure = pairs.join(links, ["a", "b"], "left_anti").select("tile").distinct()
        if not spanning or unsure.isEmpty():
            break
        within = members.withColumn("apart", C.apart("tile")).join(unsure.select(C.apart("tile")), "apart", "left_semi").drop("apart")
    return marks.join(roots, "node", "left").select("doc_id", "row", "n", "node", F.coalesce("root", "node").alias("root"))


def components_of(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id of the component) of each row."""
    found = classes(docs, text, doc_id, percent, words=words)
    least = found.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    out = found.withColumn("apart", C.apart("root")).join(least.select(C.apart("root"), "least"), "apart", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """The rows of docs without their near duplicates: of each component the row with the smallest doc_id stays, and every row with an empty set. docs' own columns."""
    found = classes(docs, text, doc_id, percent, words=words)
    group = F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("row"))
    r, place = C.fresh(docs, "row"), C.fresh(docs, "place")
    stay = found.groupBy(group.alias("group"), (F.col("n") > 0).alias("full")).agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias(r)).select(r, F.col("full").alias(place))
    out = docs.withColumn(r, _row(doc_id, text)).join(stay.hint("merge"), r)
    from pyspark.sql.window import Window

    once = F.row_number().over(Window.partitionBy(r).orderBy(r))
    return out.withColumn(C.fresh(out, "once"), once).filter(~F.col(place) | (F.col(C.fresh(out, "once")) == 1)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(C.table(spark, sf_dir, "documents"))
