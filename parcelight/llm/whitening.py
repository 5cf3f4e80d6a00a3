"""Whitening of embeddings by their first principal components.

Entries become integers, floor(256 * c).  Every different vector counts once in the statistics.  A randomised range finder
starts from a random block of a few more columns than components, passes over all centred rows again and again (each pass
multiplies the block by the covariance) and takes the components from the covariance within the block (Rayleigh-Ritz).
Residuals over gaps bound the error of each component.  Where the spectrum is too flat for them to fall to ``tolerance``
within ``max_passes``, the block becomes the whole space: one more pass gives the covariance itself.
No pass moves rows: a task sends one matrix of at most dimension x dimension entries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, take

LONG = 2**63
#: Rows of a partial matrix that travel in one record.
SLAB = 256


@dataclass
class Whitener:
    n: int
    sums: list[int]
    components: np.ndarray  # (dimension, k), unit columns
    eigenvalues: np.ndarray  # falling
    trace: float
    passes: int
    whole: bool  # the block was expanded to the full dimension
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def quantized(rows: DataFrame, vectors: str = "embedding") -> DataFrame:
    """vec_id and x, the array of floor(256 * c) as longs, of every usable row.

    A vector that is null or empty, or that holds a null, a non-finite entry or one beyond a long, takes no part.  Vectors of
    several lengths cannot meet: those of the most frequent length take part, of equally frequent ones the longest.
    """
    df = take(rows, "vec_id", vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(vectors, lambda c: 256 * c.cast("double")).alias("y"))
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float(LONG)))
    df = df.where((F.size("y") > 0) & F.forall("y", fits))
    length = df.groupBy(F.size("y").alias("size")).count().agg(F.max(F.struct("count", "size"))["size"]).first()[0]
    return df.where(F.size("y") == F.lit(length or 0)).select("vec_id", F.transform("y", lambda c: F.floor(c)).alias("x"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each dimension.  High and low halves are added apart, so no sum wraps."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for b in batches:
            x = _matrix(b.column(0))
            n += len(x)
            high = high + (x >> 32).sum(0).astype(object)
            low = low + (x & 0xFFFFFFFF).sum(0).astype(object)
        if n:
            total = [str(int(h) * 2**32 + int(v)) for h, v in zip(high, low, strict=True)]
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "n": pa.array([n] * len(total), pa.int64()), "s": pa.array(total)})

    parts = fit.select("x").mapInArrow(add, "i int, n long, s string")
    got = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    return (got[0]["n"] if got else 0), [int(r["s"]) for r in got]


def summed(fit: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``f(x)`` over blocks ``x`` of rows.  Partial matrices meet in two rounds, in slabs of rows, so that neither
    a task nor the driver holds one for each task of a large table."""
    spread = max(1, round(fit.rdd.getNumPartitions() ** 0.5))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for b in batches:
            if b.num_rows:
                y = f(_matrix(b.column(0)))
                total = y if total is None else total + y
        if total is not None:
            slabs = range(0, len(total), SLAB)
            salt = TaskContext.get().partitionId() % spread
            yield pa.RecordBatch.from_pydict({"slab": pa.array(slabs, pa.int32()), "salt": pa.array([salt] * len(slabs), pa.int32()), "v": pa.array([np.ascontiguousarray(total[i : i + SLAB]).tobytes() for i in slabs], pa.binary())})

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v) for v in pdf["v"])
        return pd.DataFrame({"slab": [pdf["slab"][0]], "salt": [0], "v": [total.tobytes()]})

    schema = "slab int, salt int, v binary"
    once = fit.select("x").mapInArrow(part, schema).groupBy("slab", "salt").applyInPandas(meet, schema)
    got = once.groupBy("slab").applyInPandas(meet, schema).orderBy("slab").collect()
    return np.concatenate([np.frombuffer(r["v"]) for r in got])


def fit_whitener(fit: DataFrame, k: int = 4, oversample: int = 8, max_passes: int = 24, tolerance: float = 1e-10, seed: int = 1) -> Whitener | None:
    """The first ``k`` components of the rows' covariance (divisor n); fewer where it has fewer than ``k`` positive
    eigenvalues, None without rows.  ``fit`` holds each vector once, in column x."""
    n, sums = exact_sums(fit)
    if not n:
        return None
    model = Whitener(n, sums, np.zeros((len(sums), 0)), np.zeros(0), 0.0, 0, False)
    mean, d = model.mean, len(sums)

    def times(block: np.ndarray) -> tuple[np.ndarray, float]:
        """Covariance times ``block``, and the trace: one pass over all centred rows."""

        def f(x: np.ndarray) -> np.ndarray:
            c = x - mean
            return np.hstack([c.T @ (c @ block), (c * c).sum(0)[:, None]])

        got = summed(fit, f).reshape(d, -1) / n
        return got[:, :-1], float(got[:, -1].sum())

    width = min(d, k + oversample)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    last = np.inf
    for model.passes in range(1, max_passes + 1):
        z, model.trace = times(q)
        inner = q.T @ z
        values, turn = _falling(inner)
        # error of a component: its residual over its distance from the next eigenvalue
        residual = np.linalg.norm((z - q @ inner) @ turn, axis=0)[:k]
        gaps = np.abs(np.diff(values))
        gap = np.minimum(np.append(np.inf, gaps)[: len(residual)], np.append(gaps, np.inf if width == d else 0.0)[: len(residual)])
        error = float(np.max(residual / np.maximum(gap, 1e-300))) if model.trace else 0.0
        if error <= tolerance:
            return _finished(model, fit, q @ turn[:, :k], values[:k])
        rate = error / last
        if width == d or model.passes > 3 and (rate >= 1 or error * rate ** (max_passes - model.passes) > tolerance):
            break
        last, q = error, np.linalg.qr(z)[0]
    model.whole = True
    model.passes += 1
    v, model.trace = times(np.eye(d))
    values, turn = _falling(v)
    return _finished(model, fit, turn[:, :k], values[:k])


def _falling(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    return values[::-1], vectors[:, ::-1]


def _finished(model: Whitener, fit: DataFrame, vectors: np.ndarray, values: np.ndarray) -> Whitener:
    """The model with the components that vary at all, and how far from the identity whitened rows' covariance is."""
    keep = values > 1e-13 * max(model.trace, 1e-300)
    model.components, model.eigenvalues = vectors[:, keep], values[keep]
    k, mean, scale = int(keep.sum()), model.mean, model.components / np.sqrt(model.eigenvalues)
    if k:

        def f(x: np.ndarray) -> np.ndarray:
            y = (x - mean) @ scale
            return np.vstack([y.T @ y, y.sum(0)])

        got = summed(fit, f).reshape(k + 1, k) / model.n
        model.identity_error = float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())
    return model


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum over dimensions of (n * x - S) squared of each row; None beyond a long."""
    most = n * int(max(abs(int(x.min())), abs(int(x.max())))) + max(map(abs, sums)) if x.size else 0
    if len(sums) * most * most < LONG:
        return ((n * x - np.array(sums, "int64")) ** 2).sum(1).tolist()
    d = n * x.astype(object) - np.array(sums, object)
    return [int(v) if v < LONG else None for v in (d * d).sum(1)]


def whiten(rows: DataFrame, k: int = 4, vectors: str = "embedding", **settings) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each usable row and component.

    Usable rows: :func:`quantized`.  Rows that repeat an id or a vector, or have no id, are returned each; repeated vectors count
    once in the statistics.  A component without variance is not returned, so a table of one vector, and an empty one,
    gives no row.  ``deviation`` is null where it is beyond a long.  Components have either sign, the same for all rows.
    """
    given = quantized(rows, vectors)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit_whitener(stored(given.select("x").distinct(), "whitening"), k, **settings)
    if model is None or not len(model.eigenvalues):
        return rows.sparkSession.createDataFrame([], schema)
    mean, scale, share = model.mean, model.components / np.sqrt(model.eigenvalues), model.eigenvalues / model.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, parts = _matrix(b.column(1)), len(share)
            at = np.repeat(np.arange(len(x)), parts)
            columns = {
                "vec_id": b.column(0).take(pa.array(at)), "component": pa.array(np.tile(np.arange(1, parts + 1, dtype="int32"), len(x))), "n": pa.array(np.full(len(at), model.n)),
                "deviation": pa.array(deviations(x, model.n, model.sums), pa.int64()).take(pa.array(at)), "whitened": pa.array(((x - mean) @ scale).ravel()),
                "explained": pa.array(np.tile(share, len(x))), "identity_error": pa.array(np.full(len(at), model.identity_error)),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return given.mapInArrow(project, schema)
