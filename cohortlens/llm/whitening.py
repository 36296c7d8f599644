"""12 Embedding whitening: principal components of the distinct vectors, rows projected to unit variance.

Entries become integers, floor(256 c).  The *fit list* holds each distinct
integer vector once (one ``distinct``, written to the shared folder).  Sums and
centred products are partial sums per task, added per matrix row in Spark; the
driver gets d sums and d rows of the d x d covariance, sizes that depend on the
dimension alone.  It brings the matrix to tridiagonal form by Householder
reflections, brackets the leading eigenvalues by Sturm counts, finds their
vectors by inverse iteration (those of close eigenvalues are made orthogonal
to each other) and turns them back.  Components and means (k x d numbers) go to
every task with the function that projects the rows.

Defined results: a row whose vector is null, empty, or has a null, NaN or
infinite entry is left out, and so is a row whose vector has not the length
that most rows have (of equally many the longer).  Repeated rows and repeated
ids stay, each with its own result.  A component whose eigenvalue is nothing
but rounding (at most d x 2.2e-16 x the trace) can't be scaled to unit variance
and is left out: one distinct vector gives no rows, and k distinct vectors at
most k - 1 components.  An empty table gives no rows.  Other columns are
ignored by the query and kept by ``whiten``; the prefix ``__cl_`` is reserved.
A deviation beyond 64 bits stops the job with an OverflowError.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import staged

QUANTUM = 256
EPS = float(np.finfo(float).eps)


@dataclass(frozen=True)
class Whitening:
    """n and exact sums of the fit list, leading eigenvalues and components (rows) of its covariance."""

    n: int
    sums: tuple
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def scaled(self) -> np.ndarray:
        return self.components / np.sqrt(self.values)[:, None]


# ---------------------------------------------------------------- symmetric eigenproblem of the driver's d x d matrix
def tridiagonal(a: np.ndarray):
    """Diagonal, off-diagonal and reflectors of a symmetric matrix (Householder)."""
    a, reflectors = a.copy(), []
    for k in range(len(a) - 2):
        v = a[k + 1:, k].copy()
        norm = np.linalg.norm(v)
        if norm == 0.0:
            reflectors.append(None)
            continue
        v[0] += np.copysign(norm, v[0])
        v /= np.linalg.norm(v)
        block = a[k + 1:, k + 1:]
        p = block @ v
        w = p - (p @ v) * v
        block -= 2.0 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1:, k] -= 2.0 * v * (v @ a[k + 1:, k])
        reflectors.append(v)
    return np.diag(a).copy(), np.array([a[k + 1, k] for k in range(len(a) - 1)]), reflectors


def sturm_counts(diag, off, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each of the points ``at``."""
    tiny = EPS * (np.abs(diag).max() + (np.abs(off).max() if len(off) else 0.0)) + np.finfo(float).tiny
    q, count = diag[0] - at, np.zeros(len(at), dtype=int)
    for i in range(len(diag)):
        if i:
            q = diag[i] - at - off[i - 1] ** 2 / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_eigenvalues(diag, off, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection on Sturm counts."""
    d = len(diag)
    side = np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
    low, high = np.full(k, (diag - side).min()), np.full(k, (diag + side).max())
    width = max(abs(low[0]), abs(high[0]), np.finfo(float).tiny)
    high += 2 * EPS * width
    wanted = d - np.arange(1, k + 1)  # eigenvalues below the j-th largest
    while (high - low > 2 * EPS * np.maximum(np.abs(low), np.abs(high)) + EPS * EPS * width).any():
        mid = low + (high - low) / 2
        if ((mid == low) | (mid == high)).all():
            break
        below = sturm_counts(diag, off, mid) <= wanted
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return low + (high - low) / 2


def solve_shifted(diag, off, shift: float, b: np.ndarray) -> np.ndarray:
    """x with (T - shift) x = b: elimination with row exchanges, tiny pivots raised."""
    d = len(diag)
    tiny = EPS * (np.abs(diag).max() + (np.abs(off).max() if len(off) else 0.0)) + np.finfo(float).tiny
    u0, u1, u2 = np.zeros(d), np.zeros(d), np.zeros(d)
    x = b.astype(float).copy()
    row = [diag[0] - shift, off[0] if d > 1 else 0.0, 0.0]
    for i in range(d - 1):
        below = [off[i], diag[i + 1] - shift, off[i + 1] if i + 2 < d else 0.0]
        if abs(below[0]) > abs(row[0]):
            row, below = below, row
            x[i], x[i + 1] = x[i + 1], x[i]
        if abs(row[0]) < tiny:
            row[0] = tiny
        factor = below[0] / row[0]
        u0[i], u1[i], u2[i] = row
        row = [below[1] - factor * row[1], below[2] - factor * row[2], 0.0]
        x[i + 1] -= factor * x[i]
    u0[-1] = row[0] if abs(row[0]) >= tiny else tiny
    for i in range(d - 1, -1, -1):
        x[i] -= (u1[i] * x[i + 1] if i + 1 < d else 0.0) + (u2[i] * x[i + 2] if i + 2 < d else 0.0)
        x[i] /= u0[i]
    return x


def leading_eigenvectors(diag, off, values) -> np.ndarray:
    """Unit eigenvectors (rows) by inverse iteration; clusters of close values are kept orthogonal."""
    d, found = len(diag), []
    near = 1e-3 * max(np.abs(diag).max(), np.abs(off).max() if len(off) else 0.0)
    start = 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > near:
            start = j
        x = 1.0 + 0.5 * np.sin(np.arange(1, d + 1) * (j + 1.7))
        for _ in range(6):
            for _ in range(2):  # twice: one pass loses digits when the vectors are nearly parallel
                for v in found[start:]:
                    x = x - (v @ x) * v
            x = solve_shifted(diag, off, value, x / np.linalg.norm(x))
            x /= np.abs(x).max()
        for _ in range(2):
            for v in found[start:]:
                x = x - (v @ x) * v
        found.append(x / np.linalg.norm(x))
    return np.array(found).reshape(len(found), d)


def leading_eigenpairs(a: np.ndarray, k: int):
    """k largest eigenvalues of a symmetric matrix, falling, and their unit vectors as rows."""
    diag, off, reflectors = tridiagonal(a)
    values = leading_eigenvalues(diag, off, min(k, len(a)))
    vectors = leading_eigenvectors(diag, off, values)
    for i in range(len(reflectors) - 1, -1, -1):
        v = reflectors[i]
        if v is not None:
            vectors[:, i + 1:] -= 2.0 * np.outer(vectors[:, i + 1:] @ v, v)
    return values, vectors / np.linalg.norm(vectors, axis=1)[:, None]


# ---------------------------------------------------------------- distributed sums
def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(fit: DataFrame, d: int):
    """n and the exact sum of each dimension."""
    def partial(batches):
        n, total = 0, [0] * d
        for b in batches:
            m = _matrix(b.column(0), d)
            if len(m) and np.abs(m).max() < 2 ** 62 // max(len(m), 1):
                part = m.sum(axis=0).tolist()
            else:
                part = m.astype(object).sum(axis=0).tolist() if len(m) else [0] * d
            n, total = n + len(m), [t + p for t, p in zip(total, part)]
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(-1, d), pa.int32()), "s": pa.array([str(v) for v in [n, *total]])})

    rows = fit.select("x").mapInArrow(partial, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    by = {r["i"]: int(r["s"]) for r in rows}
    return by.get(-1, 0), tuple(by.get(i, 0) for i in range(d))


def _centred_products(fit: DataFrame, centre: np.ndarray, projection: np.ndarray | None = None) -> np.ndarray:
    """Sum over the fit list of y y', y = projection (x - centre): task sums, added per matrix row in Spark."""
    d = len(centre)
    k = d if projection is None else len(projection)
    schema = "i int, row array<double>"

    def batch(m):
        return pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(m.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    def partial(batches):
        total = np.zeros((k, k))
        for b in batches:
            y = _matrix(b.column(0), d) - centre
            if projection is not None:
                y = y @ projection.T
            total += y.T @ y
        yield batch(total)

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, row in zip(b.column(0).to_pylist(), _matrix(b.column(1), k)):
                total[i] = total[i] + row if i in total else row.copy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["i", "row"])

    rows = fit.select("x").mapInArrow(partial, schema).repartition("i").mapInArrow(add, schema).collect()  # k rows of k numbers
    out = np.zeros((k, k))
    for r in rows:
        out[r["i"]] = r["row"]
    return (out + out.T) / 2


# ---------------------------------------------------------------- operator
def integer_vector(vector: str, quantum: int = QUANTUM) -> Column:
    """floor(quantum * c) of each entry; null where the vector is not usable."""
    usable = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(
        vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.when(usable, F.transform(vector, lambda c: F.floor(c.cast("double") * quantum)))


def usable_rows(df: DataFrame, vector: str, quantum: int = QUANTUM) -> tuple[DataFrame, int]:
    """Rows with ``__cl_x``, all of one length, and that length (0: no row)."""
    out = df.withColumn("__cl_x", integer_vector(vector, quantum)).where(F.col("__cl_x").isNotNull())
    size = F.size("__cl_x").alias("d")
    top = out.groupBy(size).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = top["d"] if top else 0
    return out.where(F.size("__cl_x") == d), d


def fit_list(rows: DataFrame) -> DataFrame:
    """Each distinct integer vector once, staged."""
    return staged(rows.select(F.col("__cl_x").alias("x")).distinct(), "fit-list")


def fit_whitening(fit: DataFrame, d: int, components: int) -> Whitening:
    n, sums = _sums(fit, d)
    if n == 0:
        return Whitening(0, (), np.zeros(0), np.zeros((0, d)), 0.0)
    cov = _centred_products(fit, np.array([s / n for s in sums])) / n
    trace = float(np.trace(cov))
    values, vectors = leading_eigenpairs(cov, components)
    real = values > max(d * EPS * trace, 0.0)
    return Whitening(n, sums, values[real], vectors[real], trace)


def identity_error(fit: DataFrame, w: Whitening) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    if not len(w.values):
        return None
    return float(np.abs(_centred_products(fit, w.mean, w.scaled) / w.n - np.eye(len(w.values))).max())


def _deviations(x: np.ndarray, n: int, sums) -> np.ndarray:
    """Sum over dimensions of (n x - S)^2, exact."""
    bound = n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in sums), default=0)
    if bound * bound * max(x.shape[1], 1) < 2 ** 63:
        return ((x * n - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1)
    exact = ((x.astype(object) * n - np.array(sums, dtype=object)) ** 2).sum(axis=1)
    if len(exact) and max(exact) >= 2 ** 63:
        raise OverflowError("a squared deviation does not fit 64 bits")
    return exact.astype(np.int64)


def project(rows: DataFrame, w: Whitening, d: int) -> DataFrame:
    """Rows with ``deviation`` and ``whitened`` (one entry per component) in place of ``__cl_x``."""
    keep = [f for f in rows.schema.fields if f.name not in ("__cl_x", "deviation", "whitened")]
    mean, scaled, n, sums = w.mean if w.n else np.zeros(d), w.scaled, w.n, w.sums

    def apply(batches):
        for b in batches:
            x = _matrix(b.column(b.num_columns - 1), d) if d else np.zeros((b.num_rows, 0), dtype=np.int64)
            white = (x - mean) @ scaled.T
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(_deviations(x, n, sums), pa.int64()), pa.array(white.tolist(), pa.list_(pa.float64()))],
                [*b.schema.names[:-1], "deviation", "whitened"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["deviation bigint", "whitened array<double>"])
    return rows.select(*[f.name for f in keep], "__cl_x").mapInArrow(apply, schema)


def whiten(df: DataFrame, vector: str, components: int, quantum: int = QUANTUM) -> tuple[DataFrame, Whitening, float | None]:
    """Usable rows with all their columns, ``deviation`` and ``whitened``; the fit; its identity error."""
    rows, d = usable_rows(df, vector, quantum)
    fit = fit_list(rows)
    w = fit_whitening(fit, d, components)
    return project(rows, w, d), w, identity_error(fit, w)


def whitened_components(df: DataFrame, key: str, vector: str, components: int) -> DataFrame:
    """One row per usable row and component."""
    out, w, error = whiten(df.select(key, vector), vector, components)
    share = F.array(*[F.lit(float(v / w.trace)) for v in w.values]).cast("array<double>")
    return out.select(key, "deviation", F.posexplode("whitened").alias("__cl_at", "whitened")).select(
        F.col(key), (F.col("__cl_at") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened",
        share[F.col("__cl_at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"))
