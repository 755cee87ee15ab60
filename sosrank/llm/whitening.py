"""Embedding whitening: distributed covariance, tridiagonal eigensolver, projection.

The fit list holds each distinct vector of whole numbers once. Two passes over it, each of one partial result a
partition, give the exact sums of every dimension and then the covariance of the centred vectors. The covariance (one
entry a pair of dimensions, whatever the number of rows) is reduced to tridiagonal form by Householder reflections; the
leading eigenvalues are bracketed by bisection on Sturm counts; inverse iteration gives their vectors, and vectors of
eigenvalues that lie close together are made orthogonal to each other within their cluster. The components, at most
``components`` times the dimensions, go with the projecting tasks.

Results in odd cases: rows with a null vector or a null or non-finite entry are dropped; vectors shorter than the
longest count as filled with zeros; rows repeated with one id stay, each with its results; a null id stays; components
whose eigenvalue is zero to double precision have no direction to scale and no rows (a single vector, copies of one
vector); a deviation beyond a long's range is null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sosrank.llm.common import written
from sosrank.llm.vectors import packed, unpack_rows, usable, whole

COMPONENTS = 4
#: Eigenvalues closer than this share of the matrix's norm are one cluster.
CLUSTER = 1e-3
EPS = np.finfo(np.float64).eps
MOST = (1 << 63) - 1
#: Rows worked on at a time.
ROWS = 1 << 13


# --- the eigensolver, on one small matrix -----------------------------------------------------------------------

def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and reflectors of the similar tridiagonal matrix (Householder)."""
    a = a.copy()
    n, reflectors = len(a), []
    for k in range(n - 2):
        v = a[k + 1:, k].copy()
        size = np.linalg.norm(v)
        if size == 0:
            reflectors.append(np.zeros_like(v))
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        reflectors.append(v)
        part = a[k + 1:, k + 1:]
        w = part @ v
        w -= (v @ w) * v
        part -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1:, k] -= 2 * v * (v @ a[k + 1:, k])
        a[k, k + 1:] = a[k + 1:, k]
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def restored(vector: np.ndarray, reflectors: list[np.ndarray]) -> np.ndarray:
    """A vector of the tridiagonal matrix as one of the matrix it came from."""
    out = vector.copy()
    for k in reversed(range(len(reflectors))):
        v = reflectors[k]
        out[k + 1:] -= 2 * v * (v @ out[k + 1:])
    return out


def count_below(d: np.ndarray, e: np.ndarray, x: float, tiny: float) -> int:
    """How many eigenvalues are below ``x``: negative pivots of the shifted matrix (Sturm)."""
    below, pivot = 0, 1.0
    for i in range(len(d)):
        pivot = d[i] - x - (e[i - 1] ** 2 / pivot if i else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        below += pivot < 0
    return below


def leading_eigenvalues(d: np.ndarray, e: np.ndarray, k: int) -> list[float]:
    """The ``k`` largest eigenvalues, falling, each by bisection to the last bit."""
    n = len(d)
    around = np.abs(np.concatenate([[0.0], e])) + np.abs(np.concatenate([e, [0.0]]))
    low, high = float((d - around).min()), float((d + around).max())
    tiny = max(np.finfo(np.float64).tiny, EPS ** 2 * max(abs(low), abs(high)))
    found = []
    for nth in range(k):
        a, b = low - abs(low) * EPS - tiny, high + abs(high) * EPS + tiny
        while True:
            mid = a + (b - a) / 2
            if not a < mid < b:
                break
            if count_below(d, e, mid, tiny) >= n - nth:
                b = mid
            else:
                a = mid
        found.append(b)
    return found


def _solved(d: np.ndarray, e: np.ndarray, shift: float, rhs: np.ndarray, tiny: float) -> np.ndarray:
    """Solve (T - shift) x = rhs by elimination with partial pivoting."""
    n = len(d)
    main, up, up2, low, x = d - shift, np.append(e, 0.0), np.zeros(n), np.append(e, 0.0), rhs.copy()
    for i in range(n - 1):
        if abs(low[i]) > abs(main[i]):
            main[i], low[i] = low[i], main[i]
            up[i], main[i + 1] = main[i + 1], up[i]
            up2[i], up[i + 1] = up[i + 1], 0.0
            x[i], x[i + 1] = x[i + 1], x[i]
        if abs(main[i]) < tiny:
            main[i] = tiny
        factor = low[i] / main[i]
        main[i + 1] -= factor * up[i]
        up[i + 1] -= factor * up2[i]
        x[i + 1] -= factor * x[i]
    if abs(main[-1]) < tiny:
        main[-1] = tiny
    for i in reversed(range(n)):
        after = up[i] * x[i + 1] if i + 1 < n else 0.0
        after += up2[i] * x[i + 2] if i + 2 < n else 0.0
        x[i] = (x[i] - after) / main[i]
        if abs(x[i]) > 1e200:  # only its direction counts
            x /= abs(x[i])
    return x


def leading_components(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and unit vectors as rows.

    Of the two signs the one that makes the largest entry positive is taken.
    """
    n = len(a)
    k = min(k, n)
    norm = float(np.abs(a).sum(axis=1).max()) if n else 0.0
    if not k or norm == 0:
        return np.zeros(0), np.zeros((0, n))
    d, e, reflectors = tridiagonal(a / norm)
    values, vectors = leading_eigenvalues(d, e, k), []
    tiny, rng = EPS * max(1.0, np.abs(d).max()), np.random.default_rng(0)
    cluster = 0  # first member of the current cluster
    for i, value in enumerate(values):
        if i and values[i - 1] - value > CLUSTER:
            cluster = i
        # equal eigenvalues get shifts a little apart, or iteration would give one vector again
        shift = value - (i - cluster) * 4 * EPS
        v = rng.standard_normal(n)
        for _ in range(5):
            v /= np.linalg.norm(v)
            v = _solved(d, e, shift, v, tiny)
            for _ in range(2):
                for other in vectors[cluster:]:
                    v -= (other @ v) * other
            v /= np.linalg.norm(v)
        vectors.append(v)
    out = np.array([restored(v, reflectors) for v in vectors])
    for _ in range(2):  # rounding of the way back
        for i in range(k):
            for j in range(i):
                out[i] -= (out[j] @ out[i]) * out[j]
            out[i] /= np.linalg.norm(out[i])
    out *= np.sign(out[np.arange(k), np.abs(out).argmax(axis=1)])[:, None]
    # the quotient of the vector is exact to the square of its error
    return np.array([float(v @ a @ v) for v in out]), out


# --- passes over the vectors ---------------------------------------------------------------------------------------

def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            cut = batch.slice(i, ROWS)
            yield cut, unpack_rows(cut.column(column).to_pylist())


def _wide(x: np.ndarray, dims: int) -> np.ndarray:
    return x if x.shape[1] == dims else np.pad(x, ((0, 0), (0, dims - x.shape[1])))


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """How many vectors there are, and the exact sum of every dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(0, object)
        for _, x in _blocks(batches, 0):
            safe = not x.size or float(np.abs(x.astype(np.float64)).max()) * len(x) < 2.0 ** 62
            part = x.sum(axis=0, dtype=np.int64 if safe else object).astype(object)
            wide = max(len(part), len(sums))
            sums = np.pad(sums, (0, wide - len(sums))) + np.pad(part, (0, wide - len(part)))
            n += len(x)
        values = pa.array([str(s) for s in [n, *sums.tolist()]], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(sums)), pa.int32()), values], ["dim", "s"])

    rows = (fit.mapInArrow(run, "dim int, s string").groupBy("dim")
            .agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("dim").collect())
    found = [int(r.s) for r in rows]  # one row a dimension
    return (found[0], found[1:]) if found else (0, [])


def _second_moments(fit: DataFrame, turn, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the fit list of ``y`` and of its products, ``y = turn(x)`` with ``dims`` columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims))
        for _, x in _blocks(batches, 0):
            y = turn(x)
            total[0] += y.sum(axis=0)
            total[1:] += y.T @ y
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()),
                                          pa.array(total.ravel())], ["i", "j", "s"])

    rows = fit.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    total = np.zeros((dims + 1, dims))
    for r in rows:  # one row a pair of dimensions
        total[r.i, r.j] = r.s
    return total[0], total[1:]


def _covariance(fit: DataFrame, turn, dims: int, n: int) -> np.ndarray:
    """Covariance (divisor n) of ``turn(x)``, whose mean is zero up to rounding; what is left of it is taken out."""
    first, second = _second_moments(fit, turn, dims)
    return second / n - np.outer(first / n, first / n)


@dataclass
class Whitening:
    """A fitted transform: ``project`` gives a vector's whitened components."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def turn(self):
        mean, scaled, dims = self.mean, (self.vectors / np.sqrt(self.values)[:, None]).T, len(self.sums)
        return lambda x: (_wide(x, dims) - mean) @ scaled


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on the distinct packed vectors of column ``x``; None where there is none."""
    fit = written(rows.select("x").distinct(), "fit")
    n, sums = _sums(fit)
    if not n:
        return None
    if len(sums) == 0:
        return Whitening(n, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    mean, dims = np.array([s / n for s in sums]), len(sums)
    v = _covariance(fit, lambda x: _wide(x, dims) - mean, dims, n)
    values, vectors = leading_components(v, components)
    trace = float(np.trace(v))
    real = values > dims * EPS * 16 * max(trace, 0.0)
    out = Whitening(n, sums, values[real], vectors[real], trace)
    if real.any():
        seen = _covariance(fit, out.turn(), int(real.sum()), n)
        out.identity_error = float(np.abs(seen - np.eye(len(seen))).max())
    return out


OUTPUT = ("component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """One row a vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    kind = rows.schema[id_col].dataType.simpleString()
    kept = rows.filter(usable(F.col(vector_col))).select(F.col(id_col).alias("vec_id"),
                                                         whole(F.col(vector_col)).alias("x"))
    # vectors of one length whatever their rows hold; two that differ by zeros at the end are one
    wide = kept.agg(F.max(F.size("x"))).first()[0] or 0
    kept = kept.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(wide) - F.size("x"))))
    kept = packed(kept)
    model = fit_whitening(kept, components)
    schema = f"vec_id {kind}, {OUTPUT}"
    if model is None or not len(model.values):
        return kept.sparkSession.createDataFrame([], schema)
    turn, n, dims, k = model.turn(), model.n, len(model.sums), len(model.values)
    sums, explained, error = np.array(model.sums, object), model.values / model.trace, model.identity_error

    def deviation(x: np.ndarray) -> pa.Array:
        most = float(np.abs(x.astype(np.float64)).max(initial=0)) * n + float(max(map(abs, sums), default=0))
        exact = np.int64 if most * most * dims < 2.0 ** 62 else object
        y = _wide(x, dims).astype(exact) * n - sums.astype(exact)
        found = (y * y).sum(axis=1).tolist()
        return pa.array([d if d <= MOST else None for d in found], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut, x in _blocks(batches, 1):
            m = len(x)
            each = pa.array(np.repeat(np.arange(m), k))
            cols = [cut.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, n), pa.int64()), deviation(x).take(each), pa.array(turn(x).ravel()),
                    pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "component", "n", "deviation", "whitened", "explained",
                                                    "identity_error"])

    return kept.mapInArrow(run, schema)
