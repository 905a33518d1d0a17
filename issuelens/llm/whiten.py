"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

The different vectors are written as blocks of rows and held by the executors. Each step takes two passes over the blocks,
each a sum of d + step numbers over tasks:

    p = X v          and how much of p lies along each earlier left vector
    w = X' u         for u = p less those parts, and how far u is from orthogonal to the earlier ones

where X are the centred rows. Right vectors, of d numbers, are orthogonalised against all earlier ones on the driver.
Left vectors have a number for each row, so they stay distributed: a task has its rows' left vectors as X C, C being the
small matrix (d x steps) of the combinations that made them. What rounding leaves between left vectors is measured in the
second pass and taken out again, in C and in w alike. Where a new vector vanishes, the next starts afresh at random,
orthogonal to all before, so equal deviations are found as often as they occur. The singular value decomposition of the
small bidiagonal matrix gives components and deviations. All d steps are taken unless fewer are asked for.

Defined cases: a vector that is null or holds a null, NaN or infinite entry takes no part and has no row; shorter vectors
have zeros behind; a row without vec_id, and rows that repeat, count as rows, while equal vectors count once in the fit;
components whose deviation vanishes (constant or dependent dimensions, a single vector) aren't returned; an empty table, or
one without any deviation, gives an empty result; entries are held to 2^62 after scaling; deviation is exact,
and null where it doesn't fit a long; other columns pass through whitened() and aren't looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Rows of a block.
BLOCK = 4096
#: Sums of so many tasks are added up by one.
FAN = 256
#: A vector shorter than this share of the largest deviation is rounding.
VANISHED = 1e-11


class Whitening(NamedTuple):
    """n different vectors with sums S; components as columns, deviations (roots of the eigenvalues), trace and the measured identity error."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    deviations: np.ndarray
    trace: float
    identity_error: float


def whole(column: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> Column:
    """floor(scale * x) + shift for each component x as double; held to 2^62 either way."""
    held = lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale).cast("long"), F.lit(-(1 << 62))), F.lit(1 << 62))
    return F.transform(F.col(column), lambda x: held(x) + shift)


def _padded(rows: pa.ChunkedArray | pa.Array, width: int, fill: int) -> np.ndarray:
    """Lists of longs as a matrix, short ones filled."""
    flat, start = rows.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(rows.value_lengths().to_numpy(zero_copy_only=False))])
    size = np.diff(start)
    if (size == width).all():
        return flat.reshape(-1, width)
    out = np.full((len(rows), width), fill, np.int64)
    at = np.repeat(np.arange(len(size)), size)
    out[at, np.arange(len(flat)) - start[at]] = flat
    return out


def _blocks(vectors: DataFrame, width: int, fill: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([_padded(batch.column(0).slice(i, BLOCK), width, fill).tobytes()], pa.binary())], ["block"])

    return vectors.mapInArrow(run, "block binary")


class _Rows:
    """Sums over the rows of blocks, by tasks."""

    def __init__(self, blocks: DataFrame, width: int, fan: int = FAN):
        self.blocks, self.width, self.fan = blocks, width, fan
        self.parts = max(1, blocks.rdd.getNumPartitions())

    def total(self, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum of of(rows) over all blocks; rows are longs, a row a vector."""
        width = self.width

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = None
            for batch in batches:
                for block in batch["block"]:
                    now = of(np.frombuffer(block, np.int64).reshape(-1, width))
                    found = now if found is None else found + now
            if found is not None:
                yield pd.DataFrame({"x": [found]})

        def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = [np.asarray(x) for batch in batches for x in batch["x"]]
            if found:
                yield pd.DataFrame({"x": [np.sum(found, axis=0)]})

        kind = "array<double>"
        sums, parts = self.blocks.mapInPandas(part, f"x {kind}"), self.parts
        while parts > self.fan:
            parts = -(-parts // self.fan)
            sums = sums.repartition(parts).mapInPandas(added, f"x {kind}")
        return np.sum([np.asarray(r.x) for r in sums.collect()], axis=0)


def bidiagonal(rows: _Rows, n: int, sums: np.ndarray, steps: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Right vectors (columns) and the bidiagonal matrix, by rows u and columns v, of the centred rows."""
    d, rng = len(sums), np.random.default_rng(seed)
    mean_of = lambda x: (x * n - sums) / n  # noqa: E731  exact until the division
    v_all, c_all, w_all = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))
    b, scale = np.zeros((steps, steps)), 0.0

    def fresh() -> np.ndarray:
        v = rng.standard_normal(d)
        for _ in range(2):
            v -= v_all @ (v_all.T @ v)
        return v / np.linalg.norm(v)

    v = fresh()
    for j in range(steps):
        c_old = c_all

        def along(x: np.ndarray, v: np.ndarray = v, c: np.ndarray = c_old) -> np.ndarray:
            y = mean_of(x)
            p = y @ v
            return np.append((y @ c).T @ p, p @ p)

        *parts, length = rows.total(along)
        parts = np.asarray(parts)
        left = v - c_old @ parts  # in terms of X: p less what lies along earlier left vectors
        alpha = np.sqrt(max(length - parts @ parts, 0.0))
        scale = max(scale, np.sqrt(length))
        v_all = np.column_stack([v_all, v])
        if j:
            b[j - 1, j] = parts[j - 1]
        if alpha <= VANISHED * scale or not scale:
            u, w = np.zeros(d), np.zeros(d)
        else:

            def across(x: np.ndarray, left: np.ndarray = left / alpha, c: np.ndarray = c_old) -> np.ndarray:
                y = mean_of(x)
                u = y @ left
                return np.concatenate([y.T @ u, (y @ c).T @ u, [u @ u]])

            got = rows.total(across)
            w, off, square = got[:d], got[d:-1], got[-1]
            norm = np.sqrt(max(square - off @ off, 0.0))
            u, w = (left / alpha - c_old @ off) / norm, (w - w_all @ off) / norm
            alpha = alpha * norm
        b[j, j] = alpha if w.any() else 0.0
        c_all, w_all = np.column_stack([c_all, u]), np.column_stack([w_all, w])
        if j + 1 == steps:
            break
        following = w - b[j, j] * v
        for _ in range(2):
            following = following - v_all @ (v_all.T @ following)
        beta = np.linalg.norm(following)
        v = following / beta if beta > VANISHED * scale else fresh()
    return v_all, b


def fit(vectors: DataFrame, k: int = COMPONENTS, steps: int | None = None, fill: int = SHIFT) -> Whitening | None:
    """The whitening of the different vectors (column x, array<long>); None without any."""
    shape = vectors.agg(F.max(F.size("x"))).first()[0]
    if not shape:
        return None
    width = int(shape)
    padded = vectors.select(F.concat("x", F.array_repeat(F.lit(fill).cast("long"), F.greatest(F.lit(0), F.lit(width) - F.size("x")))).alias("x"))
    blocks = _blocks(written(padded.distinct()), width, fill).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = _Rows(blocks, width)
        # Sums of longs in two halves are exact as doubles up to 2^53 for each half.
        low = (1 << 20) - 1
        got = rows.total(lambda x: np.concatenate([[len(x)], (x & low).sum(0, dtype=np.int64), (x >> 20).sum(0, dtype=np.int64)]).astype(np.float64))
        n, sums = int(got[0]), got[1 : 1 + width].astype(np.int64) + (got[1 + width :].astype(np.int64) << 20)
        trace = float(rows.total(lambda x: np.array([(((x * n - sums) / n) ** 2).sum()]))[0]) / n
        if not trace > 0:
            return Whitening(n, sums, np.zeros((width, 0)), np.zeros(0), 0.0, 0.0)
        v, b = bidiagonal(rows, n, sums, min(width, steps or width))
        _, values, right = np.linalg.svd(b)
        found = values[:k] > VANISHED * values[0]
        components = (v @ right.T)[:, :k][:, found]
        components *= np.where(components[np.abs(components).argmax(0), np.arange(components.shape[1])] < 0, -1.0, 1.0)
        deviations = values[:k][found] / np.sqrt(n)
        m = len(deviations)

        def covariance(x: np.ndarray) -> np.ndarray:
            z = ((x * n - sums) / n) @ components / deviations
            return np.append((z.T @ z).ravel(), z.sum(0))

        got = rows.total(covariance) / n
        error = np.abs(got[: m * m].reshape(m, m) - np.outer(got[m * m :], got[m * m :]) - np.eye(m)).max()
        return Whitening(n, sums, components, deviations, trace, float(error))
    finally:
        blocks.unpersist()


def whitened(rows: DataFrame, of: Whitening | None, fill: int = SHIFT) -> DataFrame:
    """rows (with x) without x, with deviation long and whitened array<double>."""
    kept = [f for f in rows.schema.fields if f.name != "x"]
    shape = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["deviation long", "whitened array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _padded(batch.column("x"), len(of.sums), fill)
            centred = x * of.n - of.sums
            square = (centred.astype(np.float64) ** 2).sum(1)
            deviation = pa.array((centred * centred).sum(1), mask=square > 9.2e18)
            y = (centred / of.n) @ of.components / of.deviations
            arrays = [batch.column(f.name) for f in kept] + [deviation, pa.array(list(y), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in kept] + ["deviation", "whitened"])

    if of is None or not len(of.deviations):
        return rows.drop("x").withColumns({"deviation": F.lit(None).cast("long"), "whitened": F.lit(None).cast("array<double>")}).limit(0)
    return rows.select(*[f"`{f.name}`" for f in kept], "x").mapInArrow(run, shape)

