"""Whitening of embeddings (operator 12).

The statistics are one scan: each partition's iterator folds its vectors into (n, sums,
centred second moments) by Welford's rank-one updates, and partitions' results are merged
by the parallel update formula, first in a bounded number of tasks, then on the driver.
The updates of a block of rows, each (k - 1) / k times the square of the difference to
the mean of the rows before it, are one matrix product; sums are of integers and
exact, so that means and differences do not depend on how rows are dealt.  The driver
holds matrices of dimension by dimension only; their eigenvectors come from Householder's
reduction and symmetric QR steps.  A second scan projects each vector, and the moments
of what comes out are gathered in the same way, as the check of the whole.

Entries c become floor(scale * c) + shift, as whole numbers.

Defined cases: rows whose vector is null or empty, or holds null or non-finite entries, are
dropped; vectors of different lengths are an error; repeated rows count each; components
without variance (one vector, equal vectors, a constant dimension) have a null ``whitened``
and ``explained`` 0, and null where there is no variance at all; of equal eigenvalues any
orthogonal components are taken; an empty table gives an empty result; other columns are ignored; entries and
deviations past 64 bits are an error.  A text column has no part in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, stage, work_dir

COMPONENTS = 8
#: The fit is of floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Bytes of numbers that one matrix product takes.
BLOCK_BYTES = 4 << 20
#: Tasks that merge the partitions' moments; so many rows reach the driver at most.
MERGERS = 32


class Moments(NamedTuple):
    """Of n vectors: their sums, and the sum of squares of what is left without the mean."""

    n: int
    sums: np.ndarray
    centred: np.ndarray

    @property
    def covariance(self) -> np.ndarray:
        return self.centred / self.n


def no_moments(dim: int, kind) -> Moments:
    return Moments(0, np.zeros(dim, kind), np.zeros((dim, dim)))


def add_rows(m: Moments, x: np.ndarray) -> Moments:
    """One rank-one update a row: centred += (k - 1) / k * d d', d the row less the mean of the k - 1 rows before it."""
    for at in range(0, len(x), step := max(1, BLOCK_BYTES // (8 * max(x.shape[1], 1)))):
        rows = x[at : at + step]
        before = m.sums + np.cumsum(rows, axis=0) - rows
        k = m.n + np.arange(1, len(rows) + 1)
        d = (rows - before / np.maximum(k - 1, 1)[:, None]) * np.sqrt((k - 1) / k)[:, None]
        m = Moments(m.n + len(rows), m.sums + rows.sum(axis=0), m.centred + d.T @ d)
    return m


def merge(a: Moments, b: Moments) -> Moments:
    """The parallel update formula."""
    if not a.n or not b.n:
        return a if a.n else b
    d = b.sums / b.n - a.sums / a.n
    return Moments(a.n + b.n, a.sums + b.sums, a.centred + b.centred + np.outer(d, d) * (a.n / (a.n + b.n) * b.n))


# --------------------------------------------------------------------------
# Symmetric QR
# --------------------------------------------------------------------------


def _tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, beside it, q) of q' a q, by Householder's reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size == 0.0 or not v[1:].any():
            continue
        v[0] += size if v[0] >= 0 else -size
        v /= np.linalg.norm(v)
        a[k + 1 :, :] -= 2 * np.outer(v, v @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of a symmetric matrix, by QR steps with Wilkinson's shift."""
    n = len(a)
    d, e, q = _tridiagonal((a + a.T) / 2)
    qt, hi = np.ascontiguousarray(q.T), n - 1
    while hi > 0:
        small = np.abs(e[:hi]) <= np.finfo(float).eps * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1]))
        e[:hi][small] = 0.0
        if e[hi - 1] == 0.0:
            hi -= 1
            continue
        zero = np.flatnonzero(e[:hi] == 0.0)
        lo = int(zero[-1]) + 1 if len(zero) else 0
        # The eigenvalue of the last two by two that is nearer to its last entry.
        half, off = (d[hi - 1] - d[hi]) / 2, e[hi - 1]
        shift = d[hi] - off * off / (half + np.copysign(np.hypot(half, off), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            a0, a1, b = d[k], d[k + 1], e[k]
            d[k] = c * c * a0 + 2 * c * s * b + s * s * a1
            d[k + 1] = s * s * a0 - 2 * c * s * b + c * c * a1
            e[k] = c * s * (a1 - a0) + (c * c - s * s) * b
            if k + 1 < hi:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            qt[[k, k + 1]] = np.array([[c, s], [-s, c]]) @ qt[[k, k + 1]]
    order = np.argsort(-d, kind="stable")
    return d[order], qt[order].T


# --------------------------------------------------------------------------
# On Spark
# --------------------------------------------------------------------------


def whole_numbers(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """(identifiers, vectors as rows of whole numbers) of the rows whose vector can be used."""
    lists = batch.column("v")
    lists, ids = lists.filter(lists.is_valid()), batch.column("vec_id").filter(lists.is_valid())
    flat, n = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    # A null entry becomes not-a-number.
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    ends = np.cumsum(n)
    good = (n > 0) & (bad[ends] == bad[ends - n])
    sizes = np.unique(n[good])
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sizes.tolist()}")
    x = np.floor(SCALE * values[np.repeat(good, n)]) + SHIFT
    if len(x) and np.abs(x).max() >= 2.0**53:
        raise OverflowError("an entry is too large")
    return ids.filter(pa.array(good)), x.astype(np.int64).reshape(int(good.sum()), int(sizes[0]) if len(sizes) else 0)


_MOMENTS = "source long, dim long, n long, sums binary, centred binary"


def _as_batch(source: int, m: Moments) -> pa.RecordBatch:
    columns = [pa.array([source]), pa.array([len(m.sums)]), pa.array([m.n]), pa.array([m.sums.tobytes()]), pa.array([m.centred.tobytes()])]
    return pa.RecordBatch.from_arrays(columns, names=["source", "dim", "n", "sums", "centred"])


def _from_row(row, kind) -> Moments:
    d = row["dim"]
    return Moments(row["n"], np.frombuffer(row["sums"], kind), np.frombuffer(row["centred"], np.float64).reshape(d, d))


def _merged(found: list[Moments]) -> Moments | None:
    total = None
    for m in found:
        if total is not None and len(total.sums) != len(m.sums):
            raise ValueError(f"vectors of different lengths: {sorted((len(total.sums), len(m.sums)))}")
        total = m if total is None else merge(total, m)
    return total


def moments(rows: DataFrame, take, kind=np.int64) -> Moments | None:
    """Moments of the vectors that ``take(batch)`` gives; None where there are none."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = take(batch)
            if len(x):
                if total is not None and x.shape[1] != len(total.sums):
                    raise ValueError(f"vectors of different lengths: {sorted((x.shape[1], len(total.sums)))}")
                total = add_rows(no_moments(x.shape[1], kind) if total is None else total, x)
        if total is not None:
            yield _as_batch(TaskContext.get().partitionId(), total)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _merged([_from_row(r, kind) for batch in batches for r in batch.to_pylist()])
        if total is not None:
            yield _as_batch(TaskContext.get().partitionId(), total)

    parts = rows.mapInArrow(fold, _MOMENTS)
    few = parts.repartition(MERGERS, "source").sortWithinPartitions("source").mapInArrow(join, _MOMENTS)
    return _merged([_from_row(r, kind) for r in sorted(few.collect(), key=lambda r: r["source"])])  # MERGERS rows


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row a vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    ready(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    schema = "vec_id long, deviation long, whitened array<double>"
    result = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = moments(rows, lambda batch: whole_numbers(batch)[1])
    if fit is None:
        return spark.createDataFrame([], result)
    n, sums = fit.n, fit.sums
    values, axes = symmetric_qr(fit.covariance)
    trace = float(np.trace(fit.covariance))
    keep = min(components, len(values))
    # What rounding alone leaves is no variance.
    some = values[:keep] > len(values) * np.finfo(float).eps * max(float(values[0]), 0.0)
    scaled = axes[:, :keep][:, some] / np.sqrt(values[:keep][some])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = whole_numbers(batch)
            if not len(x):
                continue
            # n * x - S is exact as long as its squares' sum is below 2**63.
            if n * float(np.abs(x).max()) + float(np.abs(sums).max()) >= 2.0**63:
                raise OverflowError("deviations go past 64 bits")
            off = n * x - sums
            if (np.square(off.astype(np.float64)).sum(axis=1) >= 2.0**63 * (1 - 1e-9)).any():
                raise OverflowError("deviations go past 64 bits")
            deviation = np.square(off).sum(axis=1)
            out = np.full((len(x), keep), np.nan)
            out[:, some] = (off / n) @ scaled
            flat = pa.array(out.ravel(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * keep), flat)
            yield pa.RecordBatch.from_arrays([ids, pa.array(deviation), lists], names=["vec_id", "deviation", "whitened"])

    done = stage(rows.mapInArrow(project, schema), f"{work_dir(spark, 'whitening')}/projected")
    n_some = int(some.sum())

    def projected(batch: pa.RecordBatch) -> np.ndarray:
        flat = batch.column("whitened").flatten().to_numpy(zero_copy_only=False).reshape(-1, keep)
        return flat[:, some]

    error = None
    if n_some:
        white = moments(done, projected, np.float64).covariance
        error = float(np.abs(white - np.eye(n_some)).max())
    explained = [float(v) / trace if ok else 0.0 for v, ok in zip(values[:keep], some, strict=True)] if trace > 0 else [None] * keep
    share = F.array(*(F.lit(x).cast("double") for x in explained))
    each = done.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return each.select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(share, F.col("k") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
