"""Whitening of embeddings onto the leading principal components.

Mean and scatter (sums of products of deviations from the mean) are gathered by Welford's rank-one updates, vector by vector, in each
partition's iterator, so everything is centred before it is multiplied. Partitions' states are merged by the parallel update formula, first in
``MERGERS`` tasks, then these on the driver, whose share has the same size for any input. Sums and counts are kept as exact
integers beside. The eigenvectors come from a symmetric QR solve: Householder reflections to a tridiagonal matrix, then implicit
shifted QR steps.

An entry c counts as floor(scale * c) + shift. Rows whose vector is null, empty, or has null or non-finite entries, or entries whose
integer doesn't fit into 53 bits, are dropped; so are vectors of another length than the most frequent one (of several, the longest). Repeated rows and ids are
rows each; a null id stays. ``deviation`` is null where it doesn't fit into a long. A component without variance, as all are for
a single row or equal rows, has null ``whitened``, and ``explained`` null if nothing varies at all. An empty table gives an empty one. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks that merge the partitions' states before the driver merges theirs.
MERGERS = 8
_STATE = "dim int, n long, sums array<decimal(38,0)>, mean array<double>, scatter array<double>"
_DOUBLE_BITS = 53


class Moments:
    """Count, exact sums, mean and scatter of the vectors seen."""

    def __init__(self, dim: int):
        self.n, self.sums, self.mean, self.scatter = 0, [0] * dim, np.zeros(dim), np.zeros((dim, dim))

    def add(self, x: np.ndarray) -> None:
        """Rank-one updates by the rows of ``x``, integers as doubles."""
        step = np.empty_like(self.scatter)
        for row in x:
            self.n += 1
            ahead = row - self.mean
            self.mean += ahead / self.n
            np.multiply(ahead[:, None], row - self.mean, out=step)
            self.scatter += step

    def merge(self, n: int, sums: list[int], mean: np.ndarray, scatter: np.ndarray) -> None:
        """The parallel update: two sets' scatters, and what their means are apart."""
        both, apart = self.n + n, mean - self.mean
        self.scatter = self.scatter + scatter + np.outer(apart, apart) * (self.n / both * n)
        self.mean = self.mean + apart * (n / both)
        self.n, self.sums = both, [a + b for a, b in zip(self.sums, sums, strict=True)]

    def batch(self) -> pa.RecordBatch:
        kinds = pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0)), pa.list_(pa.float64()), pa.list_(pa.float64())
        values = len(self.mean), self.n, self.sums, self.mean.tolist(), self.scatter.ravel().tolist()
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["dim", "n", "sums", "mean", "scatter"])


def integers(column: pa.Array, scale: float, shift: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows of a list column that take part, and their integers (as doubles, which hold them exactly), by length."""
    sizes = np.where(np.asarray(column.is_valid()), np.diff(column.offsets.to_numpy()), 0)
    flat = column.flatten()
    entries = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        found = np.floor(scale * entries) + shift
        bad = ~np.asarray(flat.is_valid()) | ~(np.abs(found) < 2.0**_DOUBLE_BITS)
    ends = np.cumsum(sizes)
    wrong = np.concatenate(([0], np.cumsum(bad)))
    good = (sizes > 0) & (wrong[ends] == wrong[ends - sizes])
    rows, lists = [], []
    for dim in np.unique(sizes[good]):
        at = np.flatnonzero(good & (sizes == dim))
        rows.append(at)
        lists.append(found[(ends[at] - dim)[:, None] + np.arange(dim)])
    return rows, lists


def _gathered(scale: float, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[int, Moments] = {}
        for batch in batches:
            for x in integers(batch.column(0), scale, shift)[1]:
                own = of.setdefault(x.shape[1], Moments(x.shape[1]))
                own.add(x)
                own.sums = [a + b for a, b in zip(own.sums, _total(x), strict=True)]
        yield from (m.batch() for m in of.values())

    return run


def _states(rows: Iterator) -> dict[int, Moments]:
    of: dict[int, Moments] = {}
    for r in rows:
        of.setdefault(r["dim"], Moments(r["dim"])).merge(r["n"], [int(s) for s in r["sums"]], np.array(r["mean"]), np.array(r["scatter"]).reshape(r["dim"], -1))
    return of


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from (m.batch() for m in _states(r for b in batches for r in b.to_pylist()).values())


def moments(states: DataFrame) -> Moments | None:
    """The merged state of the most frequent length."""
    parted = states.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGERS))).repartition(MERGERS, "part").drop("part")
    found = _states(r.asDict() for r in parted.mapInArrow(_merged, _STATE).collect())
    return max(found.values(), key=lambda m: (m.n, len(m.mean)), default=None)


def _tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, subdiagonal and the orthogonal matrix that takes ``a`` to them, by Householder reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray, most_steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric matrix."""
    d, e, q = _tridiagonal((a + a.T) / 2)
    hi, steps = len(d) - 1, 0
    while hi > 0:
        small = np.abs(e[:hi]) <= np.finfo(float).eps * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1]))
        e[:hi][small] = 0
        if e[hi - 1] == 0:
            hi, steps = hi - 1, 0
            continue
        lo = hi - 1
        while lo > 0 and e[lo - 1] != 0:
            lo -= 1
        steps += 1
        if steps > most_steps:
            raise ArithmeticError("the QR steps don't converge")
        # Wilkinson's shift: the eigenvalue of the last two by two that is nearer to its last entry
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (half + np.copysign(np.hypot(half, e[hi - 1]), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):  # chase the bulge down by rotations of neighbours
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            a0, a1, b = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * a0 + 2 * c * s * b + s * s * a1, s * s * a0 - 2 * c * s * b + c * c * a1
            e[k] = (c * c - s * s) * b + c * s * (a1 - a0)
            x = e[k]
            if k < hi - 1:
                z, e[k + 1] = s * e[k + 1], c * e[k + 1]
            q[:, k], q[:, k + 1] = c * q[:, k] + s * q[:, k + 1], c * q[:, k + 1] - s * q[:, k]
    order = np.argsort(-d, kind="stable")
    return d[order], q[:, order]


def _total(x: np.ndarray) -> list[int]:
    """Exact sums of the columns."""
    wide = np.abs(x).max(initial=0) * len(x) >= 2.0**62
    return [int(v) for v in x.astype(np.int64).astype(object if wide else np.int64).sum(axis=0)]


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of squares of n * x - S by row; None where a long doesn't hold one."""
    most = n * float(np.abs(x).max(initial=0)) + max(map(abs, sums))
    apart = n * x.astype(np.int64 if most < 2.0**62 else object) - np.array(sums, np.int64 if most < 2.0**62 else object)
    if float(np.abs(apart).max(initial=0)) ** 2 * len(sums) >= 2.0**62:
        apart = apart.astype(object)
    return [int(v) if v < 1 << 63 else None for v in (apart * apart).sum(axis=1)]


def whiten(vectors: DataFrame, components: int = 8, scale: float = 1024, shift: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row and each of the first ``components``: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    chosen = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    kind = chosen.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = moments(chosen.select("vector").mapInArrow(_gathered(scale, shift), _STATE))
    if fit is None:
        return chosen.sparkSession.createDataFrame([], schema)
    n, sums, dim = fit.n, fit.sums, len(fit.mean)
    values, axes = symmetric_qr(fit.scatter / n)
    values, axes, trace = values[:components], axes[:, :components], float(np.trace(fit.scatter)) / n
    # what rounding leaves of a variance of zero is none
    alive = values > dim * np.finfo(float).eps * max(trace, 0)
    # the mean is a quotient of exact integers: its whole part is taken away first, which rounds nothing
    whole = np.array([s // n for s in sums], np.float64)
    rest = np.array([s % n / n for s in sums])
    axes_scaled = np.where(alive, axes / np.sqrt(np.where(alive, values, 1)), 0)
    explained = [float(v) / trace if trace > 0 else None for v in np.maximum(values, 0)]

    def projected(x: np.ndarray) -> np.ndarray:
        return ((x - whole) - rest) @ axes_scaled

    def white(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Moments(int(alive.sum()))
        for batch in batches:
            for x in integers(batch.column(0), scale, shift)[1]:
                if x.shape[1] == dim:
                    own.add(projected(x)[:, alive])
        yield own.batch()

    error = None
    if alive.any():
        again = moments(chosen.select("vector").mapInArrow(white, _STATE).where("n > 0"))
        error = float(np.abs(again.scatter / again.n - np.eye(len(again.mean))).max())

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = len(values)
        for batch in batches:
            for at, x in zip(*integers(batch.column(1), scale, shift), strict=True):
                if x.shape[1] != dim:
                    continue
                deviation = pa.array(_deviations(x, n, sums), pa.int64())
                rows, component = np.repeat(np.arange(len(at)), many), np.tile(np.arange(many), len(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at[rows])), pa.array(component + 1, pa.int32()), pa.array(np.full(len(rows), n)), deviation.take(pa.array(rows)),
                        pa.array(projected(x).ravel(), mask=~alive[component]), pa.array(explained, pa.float64()).take(pa.array(component)), pa.array([error] * len(rows), pa.float64()),
                    ],
                    [f.split()[0] for f in schema.split(", ")],
                )

    return chosen.mapInArrow(out, schema)
