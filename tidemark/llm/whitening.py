"""Whitening of embeddings by shifted CholeskyQR.

The rows that count hold only finite entries. With x = floor(64 c) + 1000000, a first pass gives their number n and the
exact sums S of every dimension; a centred row is (n x - S) / n, from whole numbers, so nothing is lost to the large mean.
Then distributed Gram passes:

1. Every pass orthogonalises the centred rows by triangular solves with all R factors so far, and adds up their Gram
   matrix: each task its own, then groups of FAN matrices, so the driver gets at most FAN of them.
2. Its Cholesky factor is the next R. The first factors are those of the matrix plus a shift, which keeps it positive
   definite whatever the condition of the rows; passes go on until the rows are orthonormal to rounding.
3. R = R_k ... R_2 R_1 stands for all rows. Its singular value decomposition gives the components (right singular vectors)
   and their eigenvalues (squared singular values over n).
4. One more pass takes the covariance of the whitened rows, which gives identity_error and tells which directions hold any
   variance at all: those that rounding alone fills are no components.

A last map whitens every row. Nothing but matrices of the vectors' own dimension and the sums reaches the driver.

Rows whose vector is null or holds a null, NaN or infinite entry are left out, as are entries beyond long (in magnitude
over 2**53 after scaling). A vector that is shorter than the longest counts as padded with zeros. Without variance, and for
empty tables, there are no components and no rows. A null vec_id and repeated rows are rows like others. deviation is null
where it is beyond a long. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import textkit as K

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Matrices added up by one task after the first round.
FAN = 16
PASSES = 8
#: Singular values below this share of the largest are rounding.
LEAST = 1e-13
#: Rows worked on at a time.
ROWS = 4096
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def entries(column: pa.Array, dim: int) -> np.ndarray:
    """rows x dim, the scaled whole numbers of the vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).astype(np.int64) + SHIFT
    if len(size) and (size == dim).all():
        return values.reshape(-1, dim)
    out = np.full((len(size), dim), SHIFT, np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    return out


@dataclass
class Fit:
    """What is known of all rows; factors: the R of every pass so far."""

    n: int
    sums: list[int]
    factors: list[np.ndarray]
    components: np.ndarray | None = None  # dim x components, over sqrt(eigenvalue)
    explained: np.ndarray | None = None
    identity_error: float = 0.0

    def differences(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: as int64 where that is enough, else as Python's whole numbers."""
        most = int(np.abs(x).max(initial=0))
        if self.n * most + max(map(abs, self.sums), default=0) < 1 << 63:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.differences(x) / self.n).astype(np.float64)

    def orthogonal(self, x: np.ndarray) -> np.ndarray:
        """Rows after the triangular solves with all factors."""
        q = self.centred(x).T
        for r in self.factors:
            q = forward(r, q)
        return q.T


def forward(r: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Solves r.T z = y for a upper triangular r, a row of z after another."""
    z = np.empty_like(y)
    for i in range(len(r)):
        z[i] = (y[i] - r[:i, i] @ z[:i]) / r[i, i]
    return z


def _sums(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dim
        for batch in batches:
            x = entries(batch.column("v"), dim)
            n += len(x)
            wide = int(np.abs(x).max(initial=0)) * max(1, len(x)) >= 1 << 63
            sums = [a + int(b) for a, b in zip(sums, (x.astype(object) if wide else x).sum(axis=0), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[str(s) for s in sums]])], names=["n", "s"])

    return run


def _add_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, sums = 0, None
    for batch in batches:
        for k, s in zip(batch.column("n").to_pylist(), batch.column("s").to_pylist(), strict=True):
            n, sums = n + k, [int(x) + y for x, y in zip(s, sums or [0] * len(s), strict=True)]
    if sums is not None:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[str(s) for s in sums]])], names=["n", "s"])


def _gram(shared, dim: int, whiten: bool):
    """The Gram matrix of what this task's rows have become."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, total = shared.value, None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = entries(batch.column("v").slice(at, ROWS), dim)
                q = fit.centred(x) @ fit.components if whiten else fit.orthogonal(x)
                own = q.T @ q
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])

    return run


def _add_matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for raw in batch.column("g").to_pylist():
            own = np.frombuffer(raw)
            total = own.copy() if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])


def _added(partial: DataFrame, schema: str, add) -> list:
    """One row for each task, added up by FAN at a time until at most FAN are left."""
    tasks = partial.rdd.getNumPartitions()
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        partial = K.map_batches(partial.repartition(tasks), schema, add)
    return partial.collect()


def _rows(embeddings: DataFrame, column: str) -> DataFrame:
    v = F.col(column).cast("array<double>")
    most = F.lit(float(1 << 53) / SCALE)
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) > most)
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", bad))


def gram(rows: DataFrame, fit: Fit, whiten: bool = False) -> np.ndarray:
    dim, width = len(fit.sums), fit.components.shape[1] if whiten else len(fit.sums)
    shared = rows.sparkSession.sparkContext.broadcast(fit)
    partial = K.map_batches(rows.select("v"), "g binary", _gram(shared, dim, whiten))
    parts = [np.frombuffer(bytes(r.g)).reshape(width, width) for r in _added(partial, "g binary", _add_matrices)]
    return np.sum(parts, axis=0)


def factor(g: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """The upper triangular R of R.T R = g, or of g plus a shift that makes it positive definite."""
    dim, unit = len(g), np.finfo(float).eps / 2
    norm = float(np.linalg.norm(g, 2)) or 1.0
    shift = 11 * (n * dim + dim * (dim + 1)) * unit * norm
    shift = min(shift, norm * 1e-3)
    if not shifted:
        try:
            return np.linalg.cholesky(g).T
        except np.linalg.LinAlgError:
            pass
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(dim)).T
        except np.linalg.LinAlgError:
            shift *= 10


def fitted(rows: DataFrame) -> Fit | None:
    """The passes over all rows (vec_id, v)."""
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 0
    if not dim:
        return None
    found = _added(K.map_batches(rows.select("v"), "n long, s array<string>", _sums(dim)), "n long, s array<string>", _add_sums)
    n, sums = sum(r.n for r in found), [sum(int(r.s[i]) for r in found) for i in range(dim)]
    fit = Fit(n, sums, [])
    g = gram(rows, fit)
    spread = np.diag(g)
    if not spread.any():
        return None
    # dimensions of any size are brought to one first: a diagonal factor is triangular too
    scale = np.sqrt(np.where(spread > 0, spread, 1.0))
    fit.factors.append(np.diag(scale))
    g = g / np.outer(scale, scale)
    for k in range(PASSES):
        fit.factors.append(factor(g, n, shifted=k == 0))
        g = gram(rows, fit)
        left = np.linalg.eigvalsh(g)
        # directions that hold nothing may stay near zero; the others must be orthonormal
        if k and np.abs(left[left > 0.5] - 1).max(initial=0) < 1e-14 * max(dim, 10) and left[left <= 0.5].max(initial=0) < 1e-6:
            break
    total = fit.factors[0]
    for r in fit.factors[1:]:
        total = r @ total
    _, singular, directions = np.linalg.svd(total)
    kept = np.flatnonzero(singular > singular[0] * LEAST)
    fit.components = directions[kept].T / (singular[kept] / math.sqrt(n))
    covariance = gram(rows, fit, whiten=True) / n
    real = np.flatnonzero(np.abs(np.diag(covariance) - 1) < 0.01)[:COMPONENTS]
    fit.components, fit.explained = fit.components[:, real], singular[kept][real] ** 2 / float(spread.sum())
    fit.identity_error = float(np.abs(covariance[np.ix_(real, real)] - np.eye(len(real))).max())
    fit.factors = []
    return fit


def _whiten(shared, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = shared.value
        k = fit.components.shape[1]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = entries(part.column("v"), dim)
                m = len(x)
                d = fit.differences(x)
                if d.dtype != object and float(np.abs(d).max(initial=0)) ** 2 * dim < 9.2e18:
                    deviation = pa.array((d * d).sum(axis=1))
                else:
                    deviation = pa.array([s if (s := sum(int(v) ** 2 for v in row)) < 1 << 63 else None for row in d.tolist()], pa.int64())
                w = (d / fit.n).astype(np.float64) @ fit.components
                each = pa.array(np.repeat(np.arange(m), k))
                columns = [
                    part.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fit.n)), deviation.take(each),
                    pa.array(w.ravel()), pa.array(np.tile(fit.explained, m)), pa.array(np.full(m * k, fit.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])

    return run


def whitened(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """Of every row of finite entries its first COMPONENTS whitened components. embeddings: vec_id and the vectors."""
    rows = _rows(embeddings, column)
    fit = fitted(rows)
    spark = embeddings.sparkSession
    if fit is None:
        return spark.createDataFrame([], SCHEMA)
    return K.map_batches(rows, SCHEMA, _whiten(spark.sparkContext.broadcast(fit), len(fit.sums)))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(K.read(spark, sf_dir, "embeddings"))
