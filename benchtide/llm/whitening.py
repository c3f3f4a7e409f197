"""Embedding whitening: the leading components of the covariance by a Jacobi-Davidson iteration that never forms it.

The covariance is used only through products with a few directions: each task centres its vectors, multiplies and sums,
and sums of d x k numbers leave the executors. A search space starts from random directions. Rayleigh-Ritz in it gives
approximate components; for those not yet exact the projected correction equations are solved by some steps of MINRES,
all at once so that a step is one pass over the data, and the corrections widen the space. Components whose residual has
reached double precision are locked in falling order and left out of the space. A space that has grown to MOST_SPACE
times what is asked for restarts from its best directions. A last product gives the residuals of all, checked again.

The fit is over distinct vectors: repeats are dropped by a partial aggregation before the shuffle, then vectors lie in
blocks of bytes in the shared checkpoint folder. Vectors are whole numbers, floor(scale * entry) + shift, so that sums,
distances and centring are exact before the one division.

Defined results: rows whose vector is null or empty, or holds a null or non-finite entry, are dropped, and so are those not of the
most frequent length (of equally frequent ones the greater). Numbers beyond 2^52 count as 2^52. A component whose
eigenvalue is not above rounding (of a constant or dependent dimension) can't be whitened and is left out, so fewer
vectors than dimensions give fewer components, and one distinct vector none. Repeated rows have a result each; a null
vec_id stays null. An empty table gives an empty result. A deviation above 2^63 - 1 is null. Other input columns play no
part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
#: Vectors in a block of the fit list; MINRES steps for a correction; how far the search space may grow; rounds before the iteration counts as stuck.
ROWS, STEPS, MOST_SPACE, ROUNDS = 2048, 3, 5, 200
#: A residual of so much times the largest eigenvalue is as small as rounding lets it be.
EXACT = 64 * np.finfo(float).eps
LANES, DIRECT = 64, 8 << 20
_FAR = float(1 << 52)

Product = Callable[[np.ndarray], np.ndarray]


def whole(df: DataFrame, vector: str, ident: str, scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id and x, the whole-number vector, of the rows that remain."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.select(F.col(ident).cast("long").alias("vec_id"), x.alias("x")).filter((F.size("x") > 0) & finite)
    number = F.transform("x", lambda c: F.floor(F.greatest(F.least(c * float(scale), F.lit(_FAR)), F.lit(-_FAR))) + shift)
    rows = rows.select("vec_id", number.alias("x"))
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).select("d").first()
    return rows.filter(F.size("x") == (usual.d if usual else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten()).reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: list[np.ndarray] = []
    rows = 0

    def block() -> pa.RecordBatch:
        m = np.concatenate(waiting)
        return pa.RecordBatch.from_arrays([pa.array([len(m)], pa.int32()), pa.array([m.astype("<i8").tobytes()], pa.binary())], ["rows", "x"])

    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            waiting.append(_matrix(batch["x"].slice(k, ROWS)))
            rows += len(waiting[-1])
            if rows >= ROWS:
                yield block()
                waiting, rows = [], 0
    if rows:
        yield block()


class Fit(NamedTuple):
    """The distinct vectors in blocks, their number and per-dimension sums; components as columns, the covariance's eigenvalues and trace, and the largest residual over the largest eigenvalue."""

    blocks: DataFrame
    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    passes: int


def _gather(blocks: DataFrame, per_block: Callable[[np.ndarray], np.ndarray], like: np.ndarray) -> np.ndarray:
    """The sum of per_block(vectors of a block) over all blocks. A task sums its own; many tasks' sums meet in LANES groups before they come to the driver."""
    dtype, shape = like.dtype, like.shape

    def row(lane: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lane], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["lane", "total"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, some = np.zeros(shape, dtype), False
        for batch in batches:
            for n, x in zip(batch["rows"].to_pylist(), batch["x"], strict=True):
                total += per_block(np.frombuffer(x.as_buffer(), "<i8").reshape(n, -1))
                some = True
        if some:
            yield row(TaskContext.get().partitionId() % LANES, total)

    def meet(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, lane = np.zeros(shape, dtype), 0
        for batch in groups:
            for lane, x in zip(batch["lane"].to_pylist(), batch["total"], strict=True):  # noqa: B007
                total += np.frombuffer(x.as_buffer(), dtype).reshape(shape)
        yield row(lane, total)

    kind = "lane int, total binary"
    parts = blocks.mapInArrow(sums, kind)
    if blocks.rdd.getNumPartitions() * like.nbytes > DIRECT:
        parts = parts.groupBy("lane").applyInArrow(meet, kind)
    total = np.zeros(shape, dtype)
    for r in parts.collect():  # at most DIRECT bytes, or LANES rows
        total += np.frombuffer(r.total, dtype).reshape(shape)
    return total


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n, rounded once: the difference is taken in whole numbers."""
    return (n * x - sums) / n


def product(blocks: DataFrame, n: int, sums: np.ndarray) -> Product:
    """Directions (columns) to the covariance times them: one pass over the vectors."""

    def times(v: np.ndarray) -> np.ndarray:
        def one(x: np.ndarray) -> np.ndarray:
            z = centred(x, n, sums)
            return z.T @ (z @ v)

        return _gather(blocks, one, np.zeros(v.shape)) / n

    return times


def minres(times: Product, shift: np.ndarray, basis: np.ndarray, right: np.ndarray, steps: int, enough: float = 1e-3) -> np.ndarray:
    """Approximate t, orthogonal to basis, with (1 - QQ')(A - shift)(1 - QQ') t = right, for each column with its own shift: some steps of MINRES, side by side."""

    def off(v: np.ndarray) -> np.ndarray:
        v = v - basis @ (basis.T @ v)
        return v - basis @ (basis.T @ v)

    def divided(v: np.ndarray, by: np.ndarray) -> np.ndarray:
        return np.divide(v, by, out=np.zeros_like(v), where=by > 0)

    r = off(right)
    beta = np.linalg.norm(r, axis=0)
    start = beta.copy()
    v, before = divided(r, beta), np.zeros_like(r)
    t, w, w_before = np.zeros_like(r), np.zeros_like(r), np.zeros_like(r)
    c, c_before, s, s_before, rest = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta), beta.copy()
    beta = np.zeros_like(beta)
    for _ in range(steps):
        on = np.abs(rest) > enough * start
        if not on.any():
            break
        av = np.zeros_like(v)
        av[:, on] = off(times(v[:, on]) - v[:, on] * shift[on])
        alpha = np.sum(v * av, axis=0)
        following = av - v * alpha - before * beta
        following -= v * np.sum(v * following, axis=0)
        beta_next = np.linalg.norm(following, axis=0)
        beta_next[beta_next < 1e-14 * np.abs(alpha)] = 0
        # the column of the tridiagonal matrix, turned by the two rotations before and a new one
        third, delta = s_before * beta, c_before * beta
        second, diagonal = c * delta + s * alpha, c * alpha - s * delta
        size = np.hypot(diagonal, beta_next)
        c_new, s_new = divided(diagonal, size), divided(beta_next, size)
        w_new = divided(v - w * second - w_before * third, size)
        t[:, on] += (w_new * (c_new * rest))[:, on]
        rest = np.where(on, -s_new * rest, 0)
        v, before, beta = divided(following, beta_next), v, beta_next
        w, w_before, c_before, s_before, c, s = w_new, w, c, s, c_new, s_new
    return off(t)


def orthonormal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal base of what new adds to basis."""
    size = np.linalg.norm(new, axis=0)
    new = new[:, size > 0] / size[size > 0]
    for _ in range(2):
        new = new - basis @ (basis.T @ new)
        if not new.size:
            return new
        u, s, _ = np.linalg.svd(new, full_matrices=False)
        new = u[:, s > 1e-10 * max(1.0, s[0])] if s[0] > 1e-10 else u[:, :0]
    return new - basis @ (basis.T @ new)


def leading(times: Product, d: int, wanted: int, steps: int = STEPS, most_space: int = MOST_SPACE, rounds: int = ROUNDS, exact: float = EXACT, seed: int = 11) -> tuple[np.ndarray, np.ndarray, float]:
    """The `wanted` leading components (columns) and eigenvalues of a symmetric positive operator on d dimensions, by Jacobi-Davidson, and the largest residual over the largest eigenvalue."""
    rng = np.random.default_rng(seed)
    wanted = min(wanted, d)
    most = min(d, max(most_space * wanted, wanted + 8))
    locked = np.zeros((d, 0))
    space = orthonormal(rng.standard_normal((d, min(d, wanted + 4))), locked)
    images, best, idle = times(space), np.inf, 0
    top = 0.0
    for _ in range(rounds):
        h = space.T @ images
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        space, images = space @ turn, images @ turn
        top = max(top, float(values[0]) if len(values) else 0.0)
        left = wanted - locked.shape[1]
        residual = images[:, :left] - space[:, :left] * values[:left]
        residual -= locked @ (locked.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        whole_space = locked.shape[1] + space.shape[1] == d
        open_at = np.flatnonzero(size > exact * top)
        done = left if whole_space or not len(open_at) else int(open_at[0])  # locked in falling order only
        worst = float(size.max(initial=0.0))
        idle = idle + 1 if worst > best / 2 else 0
        best = min(best, worst)
        if not done and idle >= 8 and best <= 1e-10 * top:
            done = left  # as near as sums of these data come
        if done:
            locked = np.concatenate([locked, space[:, :done]], 1)
            space, images, values, residual, size = space[:, done:], images[:, done:], values[done:], residual[:, done:], size[done:]
            best, idle = np.inf, 0
        if locked.shape[1] == wanted:
            break
        if space.shape[1] >= most - locked.shape[1] and not whole_space:
            keep = min(space.shape[1], wanted - locked.shape[1] + 8)
            space, images = space[:, :keep], images[:, :keep]
        open_now = np.flatnonzero(size > exact * top)
        ritz = space[:, : wanted - locked.shape[1]]
        t = minres(times, values[open_now], np.concatenate([locked, ritz], 1), -residual[:, open_now], steps)
        new = orthonormal(t, np.concatenate([locked, space], 1))
        if not new.shape[1]:
            new = orthonormal(rng.standard_normal((d, 1)), np.concatenate([locked, space], 1))
        space, images = np.concatenate([space, new], 1), np.concatenate([images, times(new)], 1) if new.shape[1] else images
    else:
        raise RuntimeError(f"{locked.shape[1]} of {wanted} components after {rounds} rounds")
    locked = np.linalg.qr(locked)[0]
    images = times(locked)
    values, turn = np.linalg.eigh((locked.T @ images + images.T @ locked) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    locked, images = locked @ turn, images @ turn
    return locked, values, float(np.linalg.norm(images - locked * values, axis=0).max(initial=0.0)) / max(top, np.finfo(float).tiny)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """The components of rows(x), each distinct vector once; None without any."""
    kept = rows.select("x").distinct()
    blocks = C.cut(kept.mapInArrow(_blocks, "rows int, x binary"))
    first = blocks.first()
    if first is None:
        return None
    d = len(first.x) // 8 // first.rows
    total = _gather(blocks, lambda x: np.append(x.sum(0), len(x)), np.zeros(d + 1, np.int64))
    n, sums = int(total[d]), total[:d]
    trace = float(_gather(blocks, lambda x: np.square(centred(x, n, sums)).sum(0), np.zeros(d)).sum() / n)
    passes = [0]
    plain = product(blocks, n, sums)

    def times(v: np.ndarray) -> np.ndarray:
        passes[0] += 1
        return plain(v)

    if not trace:
        return Fit(blocks, n, sums, np.zeros((d, 0)), np.zeros(0), 0.0, 0.0, 0)
    vectors, values, residual = leading(times, d, min(components, d, max(1, n - 1)))
    sound = values > d * np.finfo(float).eps * 8 * values[0]
    return Fit(blocks, n, sums, vectors[:, sound], values[sound], trace, residual, passes[0])


def identity_error(found: Fit) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, by passes over the vectors."""
    n, sums, turn = found.n, found.sums, found.components / np.sqrt(found.values)
    k = turn.shape[1]
    if not k:
        return 0.0
    mean = _gather(found.blocks, lambda x: (centred(x, n, sums) @ turn).sum(0), np.zeros(k)) / n

    def squares(x: np.ndarray) -> np.ndarray:
        w = centred(x, n, sums) @ turn - mean
        return w.T @ w

    return float(np.abs(_gather(found.blocks, squares, np.zeros((k, k))) / n - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """The exact sum of (n * x - sums)^2 of each row."""
    far = n * x - sums
    if not len(far) or float(np.abs(far.astype(float)).max()) ** 2 * far.shape[1] < 2.0**62:
        return np.square(far).sum(1).tolist()
    found = (sum(v * v for v in (n * int(a) - s for a, s in zip(row, sums.tolist(), strict=True))) for row in x)
    return [v if v < 1 << 63 else None for v in found]


def whiten(df: DataFrame, vector: str = "embedding", ident: str = "vec_id", components: int = COMPONENTS, scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """One row per remaining row: vec_id, n, deviation, whitened (an array by component), explained (likewise), identity_error."""
    kind = "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    rows = whole(df, vector, ident, scale, shift)
    found = fit(rows, components)
    if found is None:
        return df.sparkSession.createDataFrame([], kind)
    n, sums, turn = found.n, found.sums, found.components / np.sqrt(found.values)
    explained, error = found.values / found.trace if found.trace else found.values, identity_error(found)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = turn.shape[1]
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _matrix(batch["x"])
            many = pa.array(np.arange(m + 1, dtype=np.int32) * k)
            columns = [batch["vec_id"], pa.array([n] * m, pa.int64()), pa.array(deviations(x, n, sums), pa.int64()), pa.ListArray.from_arrays(many, pa.array((centred(x, n, sums) @ turn).ravel())), pa.ListArray.from_arrays(many, pa.array(np.tile(explained, m))), pa.array([error] * m, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, kind)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = whiten(C.table(spark, sf_dir, "embeddings"))
    each = made.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "both"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("both.whitened").alias("whitened"), F.col("both.explained").alias("explained"), "identity_error")
