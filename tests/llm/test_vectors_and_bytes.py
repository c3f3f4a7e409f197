"""Whitening, fill-in-the-middle and byte-level BPE against slow versions, on odd tables too."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from test_llm import SCHEMA, odd, prose, table  # noqa: F401

from benchtide.llm import byte_bpe, fill_in_middle, whitening

VECTORS = "vec_id long, embedding array<float>, x string, n int, label int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], VECTORS).repartition(3)


def slow_whitening(rows, components):
    """Each distinct whole-number vector once, the covariance in full."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    usual = max(Counter(len(x) for _, x in kept).items(), key=lambda t: (t[1], t[0]))[0]
    kept = [(i, x) for i, x in kept if len(x) == usual]
    own = sorted({tuple(x) for _, x in kept})
    n, sums = len(own), [sum(c) for c in zip(*own, strict=True)]
    z = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in own])
    values, turn = np.linalg.eigh(z.T @ z / n)
    values, turn = values[::-1][:components], turn[:, ::-1][:, :components]
    some = values > 1e-12 * values[0]
    values, turn = values[some], turn[:, some]
    out = []
    for i, x in kept:
        far = [n * a - s for a, s in zip(x, sums, strict=True)]
        out.append((i, n, sum(f * f for f in far), (np.array(far) / n) @ turn / np.sqrt(values)))
    return out, values / np.trace(z.T @ z / n)


@pytest.mark.parametrize("d", [3, 40])
def test_whitening(spark, d):
    rng = np.random.default_rng(d)
    own = (rng.standard_normal((160, d)) * np.linspace(3, 0.5, d)).astype(np.float32).tolist()
    rows = [*enumerate(own), (None, own[0]), (3, own[3]), *((500 + k, own[1]) for k in range(60))]
    rows += [(900, None), (901, []), (902, [None] * d), (903, [float("nan")] * d), (904, [float("inf"), *own[0][1:]]), (905, own[0][:-1]), (906, [*own[0], 1.0])]
    want, explained = slow_whitening(rows, 16)
    got = whitening.whiten(vectors(spark, rows)).collect()
    key = lambda r: (-1 if r[0] is None else r[0], r[2])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [(r.vec_id, r.n, r.deviation) for r in got] == [w[:3] for w in want]
    a, b = np.array([r.whitened for r in got]), np.array([w[3] for w in want])
    assert a.shape == b.shape == (len(want), min(16, d))
    sign = np.sign((a * b).sum(0))
    assert np.abs(a * sign - b).max() < 1e-9
    assert all(r.explained == pytest.approx(explained.tolist(), rel=1e-9) for r in got) and max(r.identity_error for r in got) < 1e-10


def test_sums_of_many_tasks_meet_in_groups(spark, monkeypatch):
    """Where the tasks' sums are too large for the driver at once they are added in groups first: the same components."""
    rng = np.random.default_rng(1)
    df = vectors(spark, enumerate((rng.standard_normal((200, 6)) * np.linspace(3, 1, 6)).astype(np.float32).tolist()))
    a = whitening.fit(whitening.whole(df, "embedding", "vec_id"))
    monkeypatch.setattr(whitening, "DIRECT", 0)
    b = whitening.fit(whitening.whole(df, "embedding", "vec_id"))
    assert a.n == b.n == 200 and a.sums.tolist() == b.sums.tolist() and a.values == pytest.approx(b.values, rel=1e-12)
    assert np.abs(np.abs((a.components * b.components).sum(0)) - 1).max() < 1e-12 and whitening.identity_error(b) < 1e-12


def test_whitening_of_few_vectors(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None)])).count() == 0
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.n, r.deviation, r.whitened) for r in one] == [(1, 0, [])] * 2
    flat = whitening.whiten(vectors(spark, [(k, [float(k), 5.0, 2.0 * k]) for k in range(9)])).collect()  # one independent dimension
    assert all(len(r.whitened) == 1 and r.explained == pytest.approx([1.0]) for r in flat)
    assert sum(r.whitened[0] ** 2 for r in flat) / 9 == pytest.approx(1)
    far = whitening.whiten(vectors(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0])])).collect()
    assert [r.deviation for r in far] == [None, None] and all(abs(r.whitened[0]) == pytest.approx(1) for r in far)


@pytest.mark.parametrize(("d", "k"), [(1, 16), (5, 3), (64, 16), (150, 16), (300, 8)])
def test_leading_components(d, k):
    """Jacobi-Davidson against the whole decomposition; in the widest case the space restarts."""
    rng = np.random.default_rng(d)
    z = rng.standard_normal((2 * d + 9, d)) * np.linspace(2, 1, d)
    a = z.T @ z / len(z)
    vectors, values, residual = whitening.leading(lambda v: a @ v, d, k)
    w, q = np.linalg.eigh(a)
    w, q = w[::-1][: len(values)], q[:, ::-1][:, : len(values)]
    assert residual < 1e-13 and np.abs(values - w).max() < 1e-13 * w[0] and len(values) == min(d, k)
    assert np.abs(1 - np.abs((vectors * q).sum(0))).max() < 1e-12


def test_equal_eigenvalues():
    vectors, values, _ = whitening.leading(lambda v: np.diag([5.0, 5, 5, 5, 1, 1, 1, 0, 0, 0]) @ v, 10, 6)
    assert values == pytest.approx([5, 5, 5, 5, 1, 1]) and np.abs(vectors.T @ vectors - np.eye(6)).max() < 1e-14


def slow_middle(text, doc_id):
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not n or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, odd):  # noqa: F811
    texts = [*odd, "é😀x̂" * 50, "<P> inside", "ends with <", "<S", "S>", "<", "a", "\x00b", *(f"{'<é>'[k % 3]}{'x' * k}<" for k in range(200))]
    ids = [None, 5, 5, *range(10, 10 + len(texts) - 3)]
    made = fill_in_middle.transform(table(spark, texts, ids))
    got = [tuple(r) for r in made.select("*", fill_in_middle.restored().alias("back")).collect()]
    want = [(i, *slow_middle(t or "", i), t or "") for i, t in zip(ids, texts, strict=True)]
    assert Counter(got) == Counter(want)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.transform(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(("a", "b", "c"), [(0, 0, 0), (0, 3, 3), (2, 2, 9), (1, 4, 6), (0, 5, 11), (3, 8, 9)])
def test_rotation(a, b, c):
    data = bytearray(range(12))
    fill_in_middle.rotate(data, a, b, c)
    assert [*data] == [*range(a), *range(b, c), *range(a, b), *range(c, 12)]
    fill_in_middle.rotate(data, a, a + c - b, c)
    assert [*data] == [*range(12)]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    code = byte_bpe.codec(byte_bpe.default_ranks(), byte_bpe.default_pattern())
    return tiktoken.Encoding("own", pat_str=byte_bpe.default_pattern(), mergeable_ranks=code.ranks, special_tokens={})


def test_byte_bpe(spark, odd, library):  # noqa: F811
    rng = np.random.default_rng(5)
    letters = [*"etaoinshr", "é", "ж", "中", "😀", " "]
    texts = [*odd, "x" * 5000, "é" * 700, "<|endoftext|> it's  I'LL \x1c\x85\n\n \t9²x", *("".join(letters[k] for k in rng.integers(0, 14, n)) for n in rng.integers(1, 1500, 80))]
    ids = [None, 5, 5, *range(10, 10 + len(texts) - 3)]
    docs = table(spark, texts, ids)
    got = byte_bpe.decode(byte_bpe.encode(docs)).collect()
    want = Counter((i, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in zip(ids, texts, strict=True))
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got) == want
    assert byte_bpe.decode(byte_bpe.encode(spark.createDataFrame([], SCHEMA))).count() == 0
    assert [bytes(r.decoded) for r in byte_bpe.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>")).collect()] == [b"", b""]


def test_small_cache_and_long_parts(library):
    """A cache that is emptied between blocks, and the heap of long parts on parts that a matrix takes as well."""
    code = byte_bpe.Codec(byte_bpe.default_ranks(), byte_bpe.default_pattern(), most=3)
    rng = np.random.default_rng(6)
    for k in range(1, 60):
        text = "".join("theanos"[i] for i in rng.integers(0, 7, 8 * k))
        assert code.encode([text])[0].tolist() == library.encode_ordinary(text)
        if text.encode() not in code.ranks:
            assert code._heap(text.encode()).tolist() == library.encode_ordinary(text)
    with pytest.raises(ValueError):
        code.decode(np.array([60_000]), np.array([0, 1]))


def test_queries_of_the_smallest_tables(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    import duckdb

    documents = duckdb.sql("SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = duckdb.sql(fill_in_middle.OP12_SQL).fetchall()
    made = fill_in_middle.op12_fill_in_middle(spark, "/root/testdata/sf0.001")
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert Counter(map(tuple, made.collect())) == Counter(want)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    coded = {r.doc_id: r for r in byte_bpe.op13_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    texts = {i: t or "" for i, t in documents.select("doc_id, text").fetchall()}
    code = byte_bpe.codec(byte_bpe.default_ranks(), byte_bpe.default_pattern())
    for (i, t), ids in zip(texts.items(), code.encode([*texts.values()]), strict=True):
        r = coded[i]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids.tolist())).encode()), sha(t.encode()))
    rows = whitening.op11_embedding_whitening(spark, "/root/testdata/sf0.001")
    n = len(duckdb.sql("SELECT vec_id FROM '/root/testdata/sf0.001/embeddings.parquet'").fetchall())
    assert rows.count() == 16 * n and rows.filter("abs(identity_error) > 1e-9 OR component < 1 OR component > 16").count() == 0
