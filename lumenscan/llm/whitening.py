"""Whitening of embeddings by a cyclic Jacobi eigendecomposition.

Rows become integer vectors x = floor(64 * c) + 1000000. The fit list is each distinct x once (a hot vector is combined
before the shuffle). Sums are exact integers; the scatter of the centred vectors is summed in the tasks and added up by
cell, so what reaches the driver is one d * d matrix whatever the rows. There symmetric rotations zero every pair of
dimensions in turn, sweep after sweep, until no off-diagonal entry counts, which keeps small eigenvalues accurate. The
sorted, scaled eigenvectors, d * k numbers, go back to the tasks.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped, and so are rows that hold an
entry of 2^53 / 64 or more in size (no exact integer), or that have another number of dimensions than most of the
vectors left (of equally frequent numbers the larger). A null vec_id is kept, repeated rows give repeated results.
Components whose eigenvalue is not above 1e-12 of the largest are left out, as nothing can be scaled by them; a table
whose vectors are all equal, or an empty one, gives no rows. A `deviation` beyond a long is null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import discard, materialize

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Eigenvalues up to this share of the largest count as zero.
TINY = 1e-12
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integer_vectors(rows: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """vec_id and x (array of long) of every usable row of any length."""
    c = F.col("c")
    usable = c.isNotNull() & F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float(1 << 53) / SCALE)) & (F.size("c") > 0)
    entries = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("c"))
    return entries.filter(usable).select("vec_id", F.transform("c", lambda v: F.floor(v * SCALE) + SHIFT).alias("x"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """The vectors of a batch, a row each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _cells(fit: DataFrame, d: int, width: int, of) -> dict[int, float]:
    """Sums over the fit list of `of(x)`, an array with `width` numbers: one row a cell and task, then one a cell."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(width), False
        for batch in batches:
            if batch.num_rows:
                total += of(matrix(batch.column(0), d))
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], names=["cell", "part"])

    sums = fit.select("x").mapInArrow(partial, "cell int, part double").groupBy("cell").agg(F.sum("part").alias("total"))
    return {r["cell"]: r["total"] for r in sums.collect()}  # width rows


def _square(cells: dict[int, float], d: int) -> np.ndarray:
    """A symmetric matrix from the cells of its upper triangle."""
    out = np.zeros((d, d))
    out[np.triu_indices(d)] = [cells.get(k, 0.0) for k in range(d * (d + 1) // 2)]
    return out + np.triu(out, 1).T


def jacobi(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors (columns) of a symmetric matrix. A sweep meets each pair of dimensions once; the pairs of
    a round share no dimension, so their rotations are applied together. Ends when no entry counts beside its diagonal ones."""
    n = len(a)
    a, vectors = a.astype(float).copy(), np.eye(n)
    seats = np.arange(n + n % 2)  # a seat beyond the last dimension rests
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            p, q = np.sort(np.stack([seats[: len(seats) // 2], seats[: len(seats) // 2 - 1 : -1]]), axis=0)
            p, q = p[q < n], q[q < n]
            off, gap = a[p, q], a[q, q] - a[p, p]
            counts = np.abs(off) > np.finfo(float).eps * np.sqrt(np.abs(a[p, p] * a[q, q]))
            if counts.any():
                turned = True
                p, q, off, gap = p[counts], q[counts], off[counts], gap[counts]
                theta = gap / (2 * off)
                t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(theta, 1))
                c = 1 / np.hypot(t, 1)
                s = t * c
                for m, axis in ((a, 0), (a, 1), (vectors, 1)):
                    x, y = (m[p], m[q]) if axis == 0 else (m[:, p], m[:, q])
                    cc, ss = (c[:, None], s[:, None]) if axis == 0 else (c, s)
                    left, right = cc * x - ss * y, ss * x + cc * y
                    if axis == 0:
                        m[p], m[q] = left, right
                    else:
                        m[:, p], m[:, q] = left, right
                a[p, q] = a[q, p] = 0
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if not turned:
            break
    return np.diag(a).copy(), vectors


def whiten(rows: DataFrame, components: int = COMPONENTS, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """One row per usable vector and component, components by falling eigenvalue."""
    spark = rows.sparkSession
    nothing = spark.createDataFrame([], OUT)
    xs = integer_vectors(rows, vector_col, id_col)
    lengths = xs.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not lengths:
        return nothing
    d = lengths[0]["d"]
    xs = xs.filter(F.size("x") == d)
    fit = materialize(xs.select("x").distinct(), "fit-list")
    exact = fit.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).collect()  # d rows
    n, sums = exact[0]["n"], np.array([int(r["s"]) for r in sorted(exact, key=lambda r: r["at"])], object)
    # n * x - S = n * (x - base) - rest, small enough for exact 64-bit integers while n is below 2^63 / (spread of x)
    base = np.array([int(s // n) for s in sums], np.int64)
    rest = np.array([int(s - n * int(b)) for s, b in zip(sums, base)], np.int64)
    upper = np.triu_indices(d)

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - base) - rest / n

    def scatter(x: np.ndarray) -> np.ndarray:
        y = centred(x)
        return (y.T @ y)[upper]

    v = _square(_cells(fit, d, len(upper[0]), scatter), d) / n
    values, vectors = jacobi(v)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > TINY * max(values.max(), 0)][:components]
    if not len(order):
        return nothing
    k, trace = len(order), float(np.trace(v))
    turn = vectors[:, order] / np.sqrt(values[order])
    pairs = np.triu_indices(k)

    def spread(x: np.ndarray) -> np.ndarray:
        y = centred(x) @ turn
        return np.concatenate([(y.T @ y)[pairs], y.sum(axis=0)])

    cells = _cells(fit, d, len(pairs[0]) + k, spread)
    discard(fit)
    means = np.array([cells[len(pairs[0]) + j] for j in range(k)]) / n
    error = float(np.abs(_square(cells, k) / n - np.outer(means, means) - np.eye(k)).max())
    explained = values[order] / trace

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1), d)
            steps = x - base
            rough = (n * steps.astype(float) - rest) ** 2
            whole = n * steps - rest
            fits = (rough.sum(axis=1) < 2.0**62) & (np.abs(steps).max(axis=1) < 2.0**62 / n)
            deviation = pa.array(np.where(fits, (whole * whole).sum(axis=1), 0), mask=~fits)
            each = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), n)), deviation.take(pa.array(each)),
                    pa.array((centred(x) @ turn).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(each), error)),
                ],
                names=[f.split()[0] for f in OUT.split(", ")],
            )

    return xs.mapInArrow(rotate, OUT)
