"""Embedding whitening (13): principal components by a tall-skinny QR, without a covariance matrix.

Vectors become integers, so their sums are exact, and rows are centred as n * x - S, exactly, before anything is
rounded. Each partition folds its centred rows into one triangular factor, block by block; factors are merged
along a tree, a bounded number at a time; the singular value decomposition of the last factor gives the right singular
vectors, which are the covariance's eigenvectors, and the eigenvalues as squared singular values over n. Squares of
singular values are never summed up first, so small eigenvalues keep their digits. Only the sums and one factor of
(dimensions)^2 numbers reach the driver, whatever the rows; executors hold two such factors and a block.

Defined results: vectors that are null or hold null or non-finite entries take no part; vectors must have one
length: that of most rows counts (ties: the shorter), others take no part; each row is its own row, so
repeated ids and vectors count as often as they stand there; components without variance (singular values at rounding
level, as with fewer rows than dimensions) are left out; other columns are ignored; an empty table, or one without usable
vectors, gives an empty result. Sums are exact while n * |x| stays below 2^63; a row's deviation that doesn't fit a long is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = 4096


@dataclass(frozen=True)
class Whitening:
    """n fitted rows, sums by dimension, components as columns by falling eigenvalue, and their shares of the variance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray


def integers(embedding: str = "embedding", factor: int = 64, offset: int = 1_000_000) -> Column:
    """floor(factor * x) + offset of each component as a double; null unless all are finite."""
    x = F.col(embedding)
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))
    return F.when(F.forall(x, finite), F.transform(x, lambda v: F.floor(v.cast("double") * factor).cast("long") + offset))


def _blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of the batches with their vectors as a matrix."""
    for batch in batches:
        for at in range(0, batch.num_rows, _BLOCK):
            part = batch.slice(at, _BLOCK)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def _merged(parts: DataFrame, merge: Callable[[list[bytes]], bytes], fan: int, levels: int = 4) -> bytes | None:
    """One value from one for each partition (columns part, value): ``fan`` at a time, by neighbouring partitions."""

    def step(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        return pa.table({"part": pa.array([group["up"][0].as_py()], pa.int64()), "value": pa.array([merge(group["value"].to_pylist())], pa.binary())})

    for level in range(levels):
        up = (F.col("part") / fan).cast("long") if level < levels - 1 else F.lit(0).cast("long")
        parts = parts.withColumn("up", up).groupBy("up").applyInArrow(step, "part long, value binary")
    last = parts.first()
    return None if last is None else bytes(last["value"])


def _each(rows: DataFrame, fold: Callable, column: str) -> DataFrame:
    """A value of each partition that has rows: ``fold(so far, matrix)``, None at first; the values are float arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = None
        for _, x in _blocks(batches, column):
            so_far = fold(so_far, x)
        if so_far is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "value": pa.array([so_far.tobytes()], pa.binary())})

    return rows.select(column).mapInArrow(run, "part long, value binary")


def fit(vectors: DataFrame, vector: str = "x", most: int = 32) -> Whitening | None:
    """The ``most`` first components of a column of integer arrays; None without rows or entries.

    Rows are read three times: for their length, for the sums, and for the factors.
    """
    rows = vectors.select(F.col(vector).alias("x")).where("x IS NOT NULL AND NOT exists(x, v -> v IS NULL)")
    shape = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if shape is None or shape["d"] == 0:
        return None
    dim = shape["d"]
    rows = rows.where(F.size("x") == dim)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dim, np.int64)
        for part, x in _blocks(batches, "x"):
            n, sums = n + part.num_rows, sums + x.sum(0)
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "s": pa.array([sums], pa.list_(pa.int64()))})

    by_dim = rows.mapInArrow(totals, "n long, s array<long>").select("n", F.posexplode("s")).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("col").alias("s")).orderBy("pos").collect()  # a row for each dimension
    n, sums = by_dim[0]["n"], np.array([r["s"] for r in by_dim], np.int64)

    def factor(r: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        centred = (n * x - sums) / n
        return np.linalg.qr(centred if r is None else np.vstack([r, centred]), mode="r")

    def stacked(values: list[bytes]) -> bytes:
        return np.linalg.qr(np.vstack([np.frombuffer(v).reshape(-1, dim) for v in values]), mode="r").tobytes()

    # 64 factors of 64 dimensions, fewer of larger ones: 32 MB in a task, two factors at least.
    r = np.frombuffer(_merged(_each(rows, factor, "x"), stacked, fan=max(2, min(64, (1 << 22) // dim**2)))).reshape(-1, dim)
    _, s, right = np.linalg.svd(r, full_matrices=False)
    rank = int((s > s[0] * max(n, dim) * np.finfo(float).eps).sum()) if s[0] > 0 else 0
    v = right[: min(rank, most)].T
    v = v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
    values = s**2 / n
    return Whitening(n, sums, v, values[: v.shape[1]], values[: v.shape[1]] / max(values.sum(), np.finfo(float).tiny))


def _project(model: Whitening, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    exact = model.n * x - model.sums
    return exact, (exact / model.n) @ model.components / np.sqrt(model.eigenvalues)


def whiten(vectors: DataFrame, model: Whitening, vector: str = "x", prefix: str = "") -> DataFrame:
    """The rows of the model's length with ``deviation`` and the array ``whitened``, instead of the vector."""
    dim = len(model.sums)
    kept = [c for c in vectors.columns if c != vector]
    rows = vectors.where(F.col(vector).isNotNull() & (F.size(vector) == dim) & ~F.exists(vector, lambda v: v.isNull()))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.select(*[F.col(f"`{c}`") for c in kept]).schema] + [f"`{prefix}deviation` long", f"`{prefix}whitened` array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, vector):
            exact, w = _project(model, x)
            fits = (exact.astype(float) ** 2).sum(1) < 2.0**62
            far = (np.where(fits[:, None], exact, 0) ** 2).sum(1)
            at = pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32())
            arrays = [part.column(c) for c in kept] + [pa.array(far, pa.int64(), mask=~fits), pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(w).ravel(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, f"{prefix}deviation", f"{prefix}whitened"])

    return rows.select(*[F.col(f"`{c}`") for c in kept], F.col(vector)).mapInArrow(run, schema)


def identity_error(vectors: DataFrame, model: Whitening, vector: str = "x") -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, from the rows themselves.

    Moments of the projections, (components)^2 for each partition, are merged along the tree.
    """
    dim, k = len(model.sums), model.components.shape[1]
    rows = vectors.select(vector).where(F.col(vector).isNotNull() & (F.size(vector) == dim) & ~F.exists(vector, lambda v: v.isNull()))

    def moments(so_far: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        w = np.column_stack([np.ones(len(x)), _project(model, x)[1]])
        return w.T @ w if so_far is None else so_far + w.T @ w

    def added(values: list[bytes]) -> bytes:
        return sum(np.frombuffer(v).reshape(k + 1, k + 1) for v in values).tobytes()

    merged = _merged(_each(rows, moments, vector), added, fan=64)
    if merged is None or not k:
        return 0.0
    m = np.frombuffer(merged).reshape(k + 1, k + 1)
    mean = m[0, 1:] / m[0, 0]
    return float(np.abs(m[1:, 1:] / m[0, 0] - np.outer(mean, mean) - np.eye(k)).max())


def components(whitened: DataFrame, model: Whitening, error: float, prefix: str = "") -> DataFrame:
    """A row for each row and component: component, n, deviation, whitened, explained and identity_error beside the other columns."""
    kept = [c for c in whitened.columns if c not in (f"{prefix}deviation", f"{prefix}whitened")]
    shares = F.array(*[F.lit(float(e)) for e in model.explained]).cast("array<double>")
    long = whitened.select(*[F.col(f"`{c}`") for c in kept], F.col(f"{prefix}deviation").alias("deviation"), F.posexplode(f"{prefix}whitened").alias("_component", "whitened"))
    return long.select(
        *[F.col(f"`{c}`") for c in kept],
        (F.col("_component") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(shares, F.col("_component") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
