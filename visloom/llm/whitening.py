"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi rotations.

Three scans: exact sums of the entries as integers, the scatter of the centred vectors, and the projection.  Each task adds up
its rows and emits one partial sum for each dimension (or pair of dimensions), so what is shuffled does not grow with the rows.
The scatter Z'Z is factored on the driver, whose work depends on the dimension alone: pivoted Cholesky gives P L L' P' with the
largest remaining diagonal first, and rotations of pairs of columns make those of L orthogonal.  Then the squared column norms
are the eigenvalues of the scatter, and the normalised columns are its eigenvectors; neither L'L nor another product is formed, so
small eigenvalues keep their relative accuracy.

Defined results: a vector that is null or holds a null, NaN or infinite entry is dropped; of vectors of several lengths those of
the commonest one stay (of equally common ones the longest); entries beyond +-2**37 count as these bounds; a component whose
eigenvalue is zero to double precision has no rows, so equal vectors, a single vector and an empty table give an empty result, and
vectors of less than ``components`` dimensions as many components as there are; repeated rows count and come out as often as they
are there; null ids stay null; equal eigenvalues share a space in which any unit vectors may come out, the same for all rows.  A
``deviation`` beyond 38 digits is null.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from visloom.storage import written

SCALE, SHIFT, BOUND = 1024.0, 100_000, 2.0**47
ROWS = 4096  # of an Arrow batch
EPS = np.finfo(np.float64).eps


@dataclass(frozen=True)
class Basis:
    """Size of the fit list, sums by dimension (whole numbers), eigenvalues of the covariance, unit eigenvectors (columns), trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as whole numbers below it and what is left, times n."""
        low = [s // self.n for s in self.sums]
        return np.array(low, np.int64), np.array([s - self.n * m for s, m in zip(self.sums, low)], np.int64)


def usable(rows: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """The rows whose vector is there and has finite entries only."""
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return rows.where(F.col(vector_col).isNotNull() & finite)


def _matrix(column: pa.Array, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(whole numbers floor(1024 c) + 100000 of all vectors one after another, lengths)."""
    many = np.diff(column.offsets.to_numpy())
    c = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(SCALE * c), -BOUND, BOUND).astype(np.int64) + SHIFT, many


def _sums(vectors: DataFrame) -> DataFrame:
    """(size, at, n, s): number of vectors of each length and the exact sum of each of their dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for b in batches:
            x, many = _matrix(b.column(0))
            of = np.repeat(many, many)
            for d in np.unique(many[many > 0]).tolist():
                own = x[of == d].reshape(-1, d)
                n, s = found.get(d, (0, np.zeros(d, object)))
                found[d] = [n + len(own), s + own.sum(axis=0).astype(object)]
        for d, (n, s) in found.items():
            yield pa.RecordBatch.from_pydict({"size": [d] * d, "at": list(range(d)), "n": [n] * d, "s": [str(v) for v in s]}, pa.schema([("size", pa.int32()), ("at", pa.int32()), ("n", pa.int64()), ("s", pa.string())]))

    parts = vectors.mapInArrow(run, "size int, at int, n long, s string")
    return parts.groupBy("size", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(28,0)")).alias("s"))


def _centred(column: pa.Array, low: np.ndarray, rest: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(x - low as whole numbers, x - mean)."""
    y = _matrix(column)[0].reshape(-1, len(low)) - low
    return y, y - rest / n


def _scatter(vectors: DataFrame, low: np.ndarray, rest: np.ndarray, n: int) -> DataFrame:
    """(i, j, v) for i <= j: the scatter of the centred vectors."""
    d = len(low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            z = _centred(b.column(0), low, rest, n)[1]
            total += z.T @ z
        i, j = np.triu_indices(d)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"])

    return vectors.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with a = L L', its rows in the order of ``a``; as many columns as ``a`` has rank to double precision."""
    a, d = a.copy(), len(a)
    order, factor = np.arange(d), np.zeros((d, d))
    least = d * EPS * max(a.diagonal().max(initial=0.0), 0.0)
    rank = 0
    for k in range(d):
        p = k + int(np.argmax(a.diagonal()[k:]))
        if not a[p, p] > least:
            break
        for m in (a, factor):
            m[[k, p]] = m[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        order[[k, p]] = order[[p, k]]
        factor[k, k] = np.sqrt(a[k, k])
        factor[k + 1 :, k] = a[k + 1 :, k] / factor[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
        rank += 1
    out = np.zeros((d, rank))
    out[order] = factor[:, :rank]
    return out


def _rounds(r: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of r columns, in rounds of pairs that have none in common."""
    ring = list(range(r + r % 2))
    half = len(ring) // 2
    for _ in range(len(ring) - 1):
        pairs = [(p, q) for p, q in zip(ring[:half], ring[: half - 1 : -1]) if max(p, q) < r]
        if pairs:
            left, right = np.array(pairs).T
            yield left, right
        ring = [ring[0], ring[-1], *ring[1:-1]]


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``factor`` times a rotation that makes its columns orthogonal to double precision.

    Sweeps converge quadratically; one that has not after ``sweeps`` of them is an error, not a worse result.
    """
    u = factor.copy()
    pairs = list(_rounds(u.shape[1]))
    for _ in range(sweeps):
        worst = 0.0
        for p, q in pairs:
            a, b = u[:, p], u[:, q]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            size = np.sqrt(aa * bb)
            off = np.abs(ab) > EPS * size
            worst = max(worst, float(np.max(np.abs(ab[off]) / size[off], initial=0.0)))
            if not off.any():
                continue
            p, q, a, b = p[off], q[off], a[:, off], b[:, off]
            t = (bb[off] - aa[off]) / (2 * ab[off])
            t = np.where(t >= 0, 1.0, -1.0) / (np.abs(t) + np.hypot(1.0, t))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            u[:, p], u[:, q] = c * a - s * b, s * a + c * b
        if worst <= len(u) * EPS:
            return u
    raise ArithmeticError(f"columns are not orthogonal after {sweeps} sweeps")


def fit(rows: DataFrame, vector_col: str = "embedding") -> Basis | None:
    """The eigenvectors of the covariance (divisor n) of the usable vectors as whole numbers; None where there are no entries."""
    vectors = usable(rows, vector_col).select(vector_col)
    sums = _sums(vectors).toPandas()  # one row a dimension
    if sums.empty:
        return None
    n, size = max(zip(sums["n"], sums["size"]))
    own = sums[sums["size"] == size].sort_values("at")
    basis = Basis(int(n), [int(s) for s in own["s"]], np.zeros(0), np.zeros((0, 0)), 0.0)
    parts = _scatter(vectors.where(F.size(vector_col) == int(size)), *basis.centre(), basis.n).toPandas()
    scatter = np.zeros((int(size), int(size)))
    scatter[parts["i"], parts["j"]] = scatter[parts["j"], parts["i"]] = parts["v"]
    turned = one_sided_jacobi(pivoted_cholesky(scatter))
    norms = np.sqrt((turned * turned).sum(0))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    return Basis(basis.n, basis.sums, norms[order] ** 2 / basis.n, turned[:, order] / norms[order], float(np.trace(scatter)) / basis.n)


def _deviations(y: np.ndarray, rest: np.ndarray, n: int) -> list[str]:
    """Sum of (n x - S)**2 = sum of (n y - rest)**2 of each row, as whole numbers without a bound."""
    small = np.abs(y).max(initial=0) < 1 << 24 and n < 1 << 26 and y.shape[1] < 1 << 12
    kind = np.int64 if small else object
    y, r = y.astype(kind), rest.astype(kind)
    squares, mixed = (y * y).sum(1).tolist(), (y * r).sum(1).tolist()
    last = sum(v * v for v in rest.tolist())
    return [str(n * n * a - 2 * n * b + last) for a, b in zip(squares, mixed)]


def projected(rows: DataFrame, basis: Basis, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, deviation, whitened): one row a usable vector; ``whitened`` lists its components of unit variance."""
    low, rest = basis.centre()
    n, d = basis.n, len(low)
    axes = basis.vectors[:, :components] / np.sqrt(basis.values[:components])
    vectors = usable(rows, vector_col).where(F.size(vector_col) == d).select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, z = _centred(b.column(1), low, rest, n)
            w = (z @ axes).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * axes.shape[1]), pa.array(w))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_deviations(y, rest, n), pa.string()), lists], ["vec_id", "deviation", "whitened"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    found = vectors.mapInArrow(run, f"vec_id {kind}, deviation string, whitened array<double>")
    return found.withColumn("deviation", F.expr("try_cast(deviation AS decimal(38,0))"))


def identity_error(rows: DataFrame, components: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` minus the identity."""
    w = [F.col("whitened")[k] for k in range(components)]
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    found = rows.agg(*[F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs))


def whitened(rows: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each usable vector and component up to ``components``, numbered from 1 by falling eigenvalue.

    Columns vec_id, component, n, deviation (decimal), whitened, explained, identity_error.
    """
    basis = fit(rows, vector_col)
    if basis is None or not len(basis.values):
        kind = rows.schema[id_col].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    found = written(projected(rows, basis, components, id_col, vector_col), "whitened", batch=ROWS)
    many = min(components, len(basis.values))
    error = identity_error(found, many)
    shares = F.lit([float(v) for v in basis.values[:many] / basis.trace])
    flat = found.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return flat.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(basis.n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
