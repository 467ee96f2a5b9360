"""Whitening of embeddings along the components of largest variance.

Vectors become integers, so the sums that make the covariance are exact whatever the order of tasks: every task sums its
vectors and, in a second pass, the products of their differences from the rounded mean, both as integers, and Spark adds
the tasks' sums up per dimension. The driver sees a matrix with a row per dimension, never rows of the table.

Its eigenvectors are found in mixed precision: float32 eigenvectors are corrected by Ogita and Aishima's iteration, which
consists of matrix products in float64. Eigenvalues that the iteration cannot tell apart form clusters; the vectors of
a cluster are rotated by the eigenvectors of the small matrix the cluster spans, and iterated again. Components go by falling
eigenvalue; of a vector and its opposite the one whose largest entry is positive is taken.

Edge cases: rows whose vector is null or holds null or non-finite entries, or entries so large that 1024 times them passes
2**52, take no part; neither do vectors whose length is not the commonest (of equally common lengths, the longest). A table
without a vector, with one, or with equal ones only has no components and gives no rows; components of no variance are left
out. A deviation too large for a long is null. Rows that repeat an id or a vector all count. Null ids stay. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
LARGEST = 2.0 ** 52 / SCALE
ROWS_AT_ONCE = 4096
_SAFE = 1 << 62


def remaining(table: DataFrame) -> DataFrame:
    """vec_id and x, the vector as integers, of the rows that take part."""
    raw = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("c"))
    real = raw.where("c is not null").where(
        ~F.exists("c", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > LARGEST)))
    lengths = real.groupBy(F.size("c").alias("d")).agg(F.count("*").alias("n"))
    usual = lengths.agg(F.max(F.struct("n", "d")).alias("m")).first()["m"]
    d = usual["d"] if usual else 0
    return real.where(F.size("c") == d).select(
        "vec_id", F.transform("c", lambda c: F.floor(c * SCALE) + OFFSET).alias("x"))


def matrices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray]]:
    """The vectors of a batch as integer matrices of a bounded number of rows, each with its first row's number."""
    for low in range(0, batch.num_rows, ROWS_AT_ONCE):
        lists = batch.column(column).slice(low, ROWS_AT_ONCE)
        yield low, lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def added(rows: DataFrame, measure, width: int) -> tuple[int, np.ndarray]:
    """The number of rows and the sum over all of them of measure(matrix), an integer matrix with `width` rows. A task
    gives its sum once, as a row per row of the matrix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            for _, x in matrices(batch, 0):
                n += len(x)
                own = measure(x).astype(object)  # whole numbers of any size
                total = own if total is None else total + own
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()),
                 pa.array([[str(v) for v in line] for line in total], pa.list_(pa.string()))], ["i", "n", "line"])

    lines = rows.select("x").mapInArrow(run, "i int, n long, line array<string>")
    sums = (lines.select("i", "n", F.posexplode("line").alias("j", "v")).groupBy("i", "j")
            .agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
            .groupBy("i").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("j", "v"))).alias("line")))
    told = sums.orderBy("i").collect()
    if not told:
        return 0, np.zeros((width, 0), dtype=object)
    return told[0]["n"], np.array([[int(e["v"]) for e in r["line"]] for r in told], dtype=object)


def _products(z: np.ndarray) -> np.ndarray:
    """z.T @ z of integers, exact: as floats if no sum can pass 2**53, as two digits to a large base otherwise."""
    top = int(np.abs(z).max(initial=0))
    if top * top * len(z) < 1 << 53:
        return (z.T.astype(float) @ z).astype(np.int64)
    digits, base = [], 1 << 19  # 19 + 19 bits and up to 4,096 rows stay below 2**53
    while np.any(z):
        low = (z + (base >> 1)) % base - (base >> 1)
        digits.append(low.astype(float))
        z = (z - low) // base
    total = np.zeros((digits[0].shape[1],) * 2, dtype=object)
    for i, a in enumerate(digits):
        for j, b in enumerate(digits):
            total = total + (a.T @ b).astype(np.int64).astype(object) * base ** (i + j)
    return total


class Moments(NamedTuple):
    """Number of vectors, their sums per dimension, and their covariance with divisor n."""

    n: int
    sums: np.ndarray
    covariance: np.ndarray


def moments(rows: DataFrame) -> Moments:
    n, sums = added(rows, lambda x: x.sum(axis=0, keepdims=True), 1)
    if not n:
        return Moments(0, sums[0], np.zeros((0, 0)))
    center = np.array([int(s) // n for s in sums[0]], dtype=np.int64)
    _, products = added(rows, lambda x: _products(x - center), len(center))
    rest = sums[0] - center.astype(object) * n  # n times the mean of what is left after centring, less than n
    exact = products * n - np.outer(rest, rest)
    return Moments(n, sums[0], np.array([[int(v) / (n * n) for v in line] for line in exact]).reshape(len(center), -1))


def clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Places of values, grouped where neighbours by size are no more than gap apart."""
    order = np.argsort(values)
    return np.split(order, np.flatnonzero(np.diff(values[order]) > gap) + 1) if len(order) else []


def gap_of(error: float, values: np.ndarray) -> float:
    """How far apart eigenvalues must be for a step to tell them apart without spoiling digits that are right."""
    return max(error, np.finfo(float).eps ** 0.5 * np.abs(values).max())


def refine(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One Ogita-Aishima step for approximate eigenvectors x of a: (better x, eigenvalues, bound of the error x had).
    Eigenvalues closer than `gap_of` the error are told apart by the caller."""
    r, s = np.eye(len(a)) - x.T @ x, x.T @ a @ x
    r, s = (r + r.T) / 2, (s + s.T) / 2  # so that the step keeps x orthogonal where eigenvalues are close
    values = np.diag(s) / (1 - np.diag(r))
    error = 2 * (np.linalg.norm(s - np.diag(values), 2) + np.abs(values).max() * np.linalg.norm(r, 2))
    apart = values[None, :] - values[:, None]
    far = np.abs(apart) > gap_of(error, values)
    step = np.where(far, (s + values[None, :] * r) / np.where(far, apart, 1), r / 2)
    return x + x @ step, values, error


def eigenvectors(a: np.ndarray, steps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of a symmetric matrix, to double precision."""
    if not len(a):
        return np.zeros(0), np.zeros((0, 0))
    size = np.abs(a).max() or 1.0
    a = (a + a.T) / (2 * size)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    for _ in range(steps):
        x, values, error = refine(a, x)
        for own in clusters(values, gap_of(error, values)):
            if len(own) > 1:  # turn the vectors of the cluster to the eigenvectors of what they span
                basis = np.linalg.qr(x[:, own])[0]
                shift = values[own].mean()
                x[:, own] = basis @ np.linalg.eigh(basis.T @ (a @ basis - shift * basis))[1]
        if error < 64 * len(a) * np.finfo(float).eps:
            break
    x /= np.linalg.norm(x, axis=0)
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    x *= np.where(x[np.abs(x).argmax(axis=0), np.arange(len(a))] < 0, -1, 1)
    return values[order] * size, x


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """The exact sum over dimensions of (n * x - S)**2 of each row."""
    top = int(np.abs(x).max(initial=0))
    low = np.array([int(s) // n for s in sums], dtype=np.int64)
    rest = np.array([int(s) % n for s in sums], dtype=np.int64)
    z = x - low  # n * x - S = n * z - rest
    most = n * int(np.abs(z).max(initial=0)) + n
    if top < _SAFE and most * most * len(sums) < _SAFE:
        return ((n * z - rest) ** 2).sum(axis=1).tolist()
    wide = z.astype(object) * n - rest.astype(object)
    told = [int(v) for v in (wide * wide).sum(axis=1)]
    return [v if v < 1 << 63 else None for v in told]


def whiten(table: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every row and component."""
    rows = remaining(table)
    n, sums, covariance = moments(rows)
    values, vectors = eigenvectors(covariance)
    trace = float(np.trace(covariance))
    real = values > max(trace, 0) * len(values) * np.finfo(float).eps
    values, vectors = values[real][:most], vectors[:, real][:, :most]
    k = len(values)
    weights = vectors / np.sqrt(values)
    low = np.array([int(s) // n for s in sums], dtype=np.int64) if n else np.zeros(0, np.int64)
    rest = np.array([int(s) % n / n for s in sums]) if n else np.zeros(0)

    def white(x: np.ndarray) -> np.ndarray:
        return (x - low - rest) @ weights

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, plain = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            for _, x in matrices(batch, 0):
                w = white(x)
                total += w.T @ w
                plain += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([np.vstack([total, plain]).ravel().tolist()])], ["t"])

    error = 0.0
    if k:
        told = (rows.select("x").mapInArrow(spread, "t array<double>").select(F.posexplode("t").alias("i", "v"))
                .groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect())
        total = np.array([r["v"] for r in told]).reshape(k + 1, k) / n
        error = float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in matrices(batch, 1) if k else ():
                w = white(x)
                many = pa.array(np.repeat(np.arange(at, at + len(x)), k))
                spot = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(many), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                     pa.array(np.full(len(spot), n)), pa.array(_deviations(x, n, sums), pa.int64()).take(spot),
                     pa.array(w.ravel()), pa.array(np.tile(values / trace, len(x))),
                     pa.array(np.full(len(spot), error))], names)

    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kinds = ["long", "int", "long", "long", "double", "double", "double"]
    return rows.select("vec_id", "x").mapInArrow(run, ", ".join(f"{a} {b}" for a, b in zip(names, kinds)))
