"""Fill-in-the-middle by block rotation in place.

A text is cut in three: prefix, middle, suffix. A scan of its bytes finds where the cuts' code points begin; the three
sentinels are inserted in a bytearray; then neighbouring blocks change places by three reversals, within the array. With
the suffix before the middle the order is psm, with it before the prefix spm. To restore, the sentinels are found again,
the blocks are turned back by the inverse rotation, and the sentinels go.

The cuts and the form are drawn by a digest of doc_id, so they are the same in every run and whatever the partitions.

Defined results: a null text counts as empty. An empty text, one that holds a sentinel and one of ten others stay plain: as
they are. Cuts may coincide, so parts may be empty. Repeated rows have equal results; a null doc_id draws as the text
`null` would. An empty table gives an empty result. Other input columns play no part, whatever their names. A text is worked on
whole, whatever its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of a hundred texts so many are transformed, and of a hundred of these so many become spm.
CHANGED, SPM = 90, 20


def rotate(data: bytearray, a: int, b: int, c: int) -> None:
    """data[a:b] and data[b:c] change places, by three reversals."""
    for low, high in ((a, b), (b, c), (a, c)):
        view = np.frombuffer(memoryview(data)[low:high], np.uint8)
        half = (high - low) // 2
        head = view[:half].copy()
        view[:half] = view[::-1][:half]
        view[high - low - half :] = head[::-1]


def begins(data: bytes) -> np.ndarray:
    """Where each code point of UTF-8 data begins, and the end."""
    raw = np.frombuffer(data, np.uint8)
    return np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))


def draws(doc_id: int | None, salt: str = "1:") -> tuple[int, int, int, int]:
    """Four numbers below 2^32 for a document."""
    h = hashlib.sha256(f"{salt}{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[k : k + 8], 16) for k in (0, 8, 16, 24))


def transform_one(data: bytes, doc_id: int | None, changed: int = CHANGED, spm: int = SPM) -> tuple[int, str, int | None, int | None, bytes]:
    """(number of code points, form, those of the prefix and of the middle, output)."""
    at = begins(data)
    n = len(at) - 1
    h1, h2, h3, h4 = draws(doc_id)
    if not n or h3 % 100 >= changed or any(s in data for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, data
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    out = bytearray(data)
    a, b = int(at[first]), int(at[last])
    for place, mark in ((b, SUFFIX), (a, MIDDLE), (0, PREFIX)):
        out[place:place] = mark
    a, b = a + len(PREFIX), b + len(PREFIX) + len(MIDDLE)  # where <M> and <S> stand
    if h4 % 100 < spm:
        rotate(out, 0, b, len(out))
        return n, "spm", first, last - first, bytes(out)
    rotate(out, a, b, len(out))
    return n, "psm", first, last - first, bytes(out)


def restore_one(data: bytes, form: str) -> bytes:
    """The text that `transform_one` made into data. No part holds a sentinel, and none can arise where parts meet, so the first of each is the one inserted."""
    if form == "plain":
        return data
    out = bytearray(data)
    p, s, m = (data.index(x) for x in (PREFIX, SUFFIX, MIDDLE))
    if form == "spm":
        rotate(out, 0, p, len(out))  # the suffix was as long as what is before <P>
        b = len(data) - p
        a = m - p
    else:
        rotate(out, s, m, len(out))
        a, b = s, len(data) - m + s
    for place, mark in ((b, SUFFIX), (a, MIDDLE), (0, PREFIX)):
        del out[place : place + len(mark)]
    return bytes(out)


def transform(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", changed: int = CHANGED, spm: int = SPM) -> DataFrame:
    """One row per row of docs: doc_id, n, form, prefix_chars, middle_chars, output. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.blocks(batches):
            ids, texts = batch["doc_id"].to_pylist(), C.texts_of(batch["text"]).cast(pa.large_binary()).to_pylist()
            n, form, prefix, middle, out = zip(*(transform_one(t, i, changed, spm) for t, i in zip(texts, ids, strict=True)), strict=True)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form"):
    """The exact text of each output of `transform`, as a column."""

    @F.arrow_udf("string")
    def back(data: pa.Array, form: pa.Array) -> pa.Array:
        return pa.array([restore_one(x, f) for x, f in zip(data.cast(pa.binary()).to_pylist(), form.to_pylist(), strict=True)], pa.binary()).cast(pa.string())

    return back(F.col(output), F.col(form))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(C.table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
g AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b,
             ('0x' || substr(h, 17, 8))::BIGINT % 100 AS c, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS e FROM d),
f AS (SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form,
             substr(t, 1, least(a, b)) AS p, substr(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS m, substr(t, greatest(a, b) + 1) AS s FROM g)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(a, b) END AS prefix_chars, CASE WHEN form <> 'plain' THEN greatest(a, b) - least(a, b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM f
"""
