"""Packing by power-of-two decomposition.

A document's token ids, with the end id, are cut into pieces whose lengths are powers of two (the binary digits of its
length, at most `most` each). Every piece is a sequence of its own, so no sequence crosses documents and none has
padding; pieces of equal length form the buckets from which batches are drawn.

Ids come from a public tokenizer file. Its normaliser and splitter never join characters across ASCII white space, so a
text's ids are those of its white-space separated parts in order; a worker encodes a distinct part once while it stays
in a bounded cache, not once per occurrence.

Defined results: a null or empty text has the end id only (one piece of length 1). Repeated rows are packed each on its
own, with the same doc_id. A null doc_id stays null. An empty table gives no pieces. Other input columns play no part.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MOST, END_ID, CACHE = 4096, 2, 400_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def lengths(n: int, most: int = MOST) -> list[int]:
    """Powers of two, at most `most`, the largest first, that add up to n. `most` is a power of two."""
    return [most] * (n // most) + [1 << k for k in reversed(range(most.bit_length() - 1)) if n % most >> k & 1]


#: Marks that end a word without being joined to it by the splitter (an apostrophe may begin a contraction).
_MARKS = b".,;:!?%#$&*"


class Encoder(dict):
    """White-space separated parts (bytes, A-Z in lower case) to little-endian 32-bit ids, by the tokenizer at `path`."""

    def __init__(self, path: str, most: int = CACHE):
        from tokenizers import Tokenizer

        super().__init__()
        self.of, self.most = Tokenizer.from_file(path), most
        self.model = self.of.model

    def __missing__(self, part: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        core = part.rstrip(_MARKS)
        if core != part and core[-1:].isalnum():
            ids = self[core] + self[part[len(core) :]]
        elif part.isalpha() and part.islower():  # one word of a-z: nothing to normalise or to split
            ids = array("I", [t.id for t in self.model.tokenize(part.decode())]).tobytes()
        else:
            ids = array("I", self.of.encode(part.decode(), add_special_tokens=False).ids).tobytes()
        self[part] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        # a special token's string is one only as it is written
        return b"".join([self[x] for x in (text if b"<|" in text else text.lower()).split()])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    import os

    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a worker on each core
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _pieces(path: str, end_id: int, most: int, with_ids: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, end = encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            doc, start, length, crc, whole, ids = [], [], [], [], [], []
            for i, text in enumerate(batch["text"].cast(pa.large_binary())):
                raw = code.encode(text.as_py()) + end if text.is_valid else end
                view, at, n = memoryview(raw), 0, len(raw) // 4
                for k in lengths(n, most):
                    doc.append(i)
                    start.append(at)
                    length.append(k)
                    crc.append(zlib.crc32(view[4 * at : 4 * (at + k)]))
                    whole.append(n)
                    if with_ids:
                        ids.append(np.frombuffer(view[4 * at : 4 * (at + k)], "<u4").astype(np.int32))
                    at += k
            columns = [pc.take(batch["doc_id"], pa.array(doc, pa.int64())).cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (start, length, crc, whole))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return pack


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, end_id: int = END_ID, most: int = MOST, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (log2 of the length), and the ids on request.

    Each piece is a whole sequence, so offset is 0. sequence_id numbers the pieces in the order of the input's partitions. Nothing is shuffled.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("most has to be a power of two")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    made = rows.mapInArrow(_pieces(tokenizer or default_tokenizer(), end_id, most, with_ids), PIECES + ", ids array<int>" * with_ids)
    own = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return made.select(*own, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.log2("length").cast("int").alias("bucket"), *["ids"] * with_ids)


def buckets(pieces: DataFrame) -> DataFrame:
    """How many sequences and ids each bucket of equal lengths has."""
    return pieces.groupBy("bucket", "length").agg(F.count("*").alias("sequences"), F.sum("length").alias("ids"))


def write_buckets(pieces: DataFrame, path: str, files: int = 64) -> None:
    """One folder for each length, so that a reader draws batches of equal lengths. A bucket is dealt over up to `files` files."""
    pieces.repartition("bucket", F.pmod("sequence_id", F.lit(files))).write.partitionBy("bucket").parquet(path)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
