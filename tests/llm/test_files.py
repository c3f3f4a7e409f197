"""What checkpoints and blocks are made of where texts are few, or zip well."""

import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from test_llm import prose, table

from benchtide.llm import common, jaccard
from benchtide.operators.lineage import shared_folder


def test_checkpoints_of_the_join_follow_their_size(spark):
    """Not the number of shuffle partitions: each file of a checkpoint is a process that an executor starts where Hadoop has no native code."""
    r = np.random.default_rng(5)
    texts = [prose(r, 60) for _ in range(40)]
    texts += [f"{x} {prose(r, 1)}" for x in texts[:20]]
    parts = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in parts}
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.rglob("part-*"))
    try:
        for k, v in parts.items():
            spark.conf.set(k, v)
        kept = {x.doc_id for x in jaccard.dedup(table(spark, texts)).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert kept == set(range(40))
    per = [len([x for x in d.iterdir() if x.name.startswith("part-")]) for d in {x.parent for x in set(folder.rglob("part-*")) - before}]
    assert len(per) > 4 and max(per) <= 2 * spark.sparkContext.defaultParallelism


def test_blocks_of_zipped_texts_are_bounded_as_they_are_unzipped():
    """Sixteen texts of a quarter of a block each, a few hundred bytes zipped."""
    text = b"one common line " * (common.BLOCK_BYTES // 64)
    batch = pa.RecordBatch.from_arrays([pa.array([zlib.compress(text, 1)] * 16, pa.binary())], ["z"])
    out = list(jaccard._info(4)(iter([batch])))
    assert [x.num_rows for x in out] == [4] * 4
    assert len({x for b in out for x in b["node"].to_pylist()}) == 1 and not list(jaccard._info(4)(iter([])))


def test_arrow_batches_are_small_only_while_the_join_runs(spark, monkeypatch):
    """Also where it fails."""
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    old = spark.conf.get(key)

    def stop(*_):
        seen.append(int(spark.conf.get(key)))
        raise RuntimeError

    monkeypatch.setattr(jaccard, "_classes", stop)
    with pytest.raises(RuntimeError):
        jaccard.classes(table(spark, ["a b"]))
    assert seen == [common.BATCH_ROWS] and spark.conf.get(key) == old
    parts = [pa.RecordBatch.from_pydict({"a": [k]}) for k in range(5)]
    assert [x["a"].to_pylist() for x in common.gathered(iter(parts), 16)] == [[0, 1], [2, 3], [4]]
