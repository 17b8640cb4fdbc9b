"""Operator 11: whitening of embeddings on their leading principal components.

Method: the scatter of the centred vectors is summed by Spark; a pivoted Cholesky factor of it is found, and a
one-sided Jacobi iteration rotates the columns of that triangular factor until they are orthogonal. Then their
squared norms are the eigenvalues and the normalised columns the components; no matrix is squared again.

Entries are put on a grid first, x = floor(64 * c) + 1000000, so the sums of the fit are exact integers. The fit
uses each distinct x vector once. Only tables whose size follows the dimension reach the driver: the sums (a row
for each dimension) and the scatter (a row for each pair of dimensions).

Defined results: a vector that is null, empty, or holds a null or non-finite entry takes no part; nor does one whose
length differs from the most frequent one (the greater, if two are as frequent). Null and repeated ids are kept, a
row each. Entries beyond 2**44 in magnitude count as that. Directions without variance are no components, so
a table of equal vectors, a single one, or an empty table gives no rows. A deviation beyond a long is null.
Columns other than the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.llm.common import slices, written

GRID, SHIFT, FAR = 64, 1_000_000, 2.0 ** 44
#: A pivot or an eigenvalue below this share of the largest one times the dimension is rounding, not variance.
TINY = 4 * np.finfo(float).eps


@dataclass(frozen=True)
class Whitening:
    """A fitted model: ``sums`` are exact, of the grid values less SHIFT; ``axes`` are unit rows, by falling variance."""
    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float


def on_grid(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, x``: the rows that take part, x as little-endian 64-bit integers less SHIFT."""
    v = df.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    v = v.filter(F.col("v").isNotNull() & (F.size("v") > 0)
                 & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            x = np.floor(np.clip(GRID * lists.values.to_numpy(zero_copy_only=False), -FAR, FAR)).astype("<i8")
            at = 8 * lists.offsets.to_numpy().astype(np.int64)
            raw = x.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                                             names=["vec_id", "x"])

    kind = v.schema["vec_id"].dataType.simpleString()
    return v.mapInArrow(pack, f"vec_id {kind}, x binary")


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), "<i8").reshape(-1, dim)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n: one rounding where the integers fit, and of the entries' own size where they don't."""
    if np.abs(x).max(initial=0) < 2 ** 62 // max(n, 1):
        return (n * x - sums.astype(np.int64)) / n
    mean = np.array([s // n for s in sums], object)
    rest = np.array([(s % n) / n for s in sums], float)
    return (x - mean.astype(np.int64)).astype(float) - rest


def _cells(parts: DataFrame) -> dict[int, float]:
    return {r["cell"]: r["value"] for r in parts.groupBy("cell").agg(F.sum("value").alias("value")).collect()}


def scatter(points: DataFrame, dim: int, n: int, sums: np.ndarray) -> np.ndarray:
    """Covariance of the distinct grid vectors: each task centres its rows, multiplies, and gives a row for each cell."""
    at = np.triu_indices(dim)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in slices(batches, 4096):
            c = _centred(_matrix(batch, dim), n, sums)
            total += c.T @ c
        yield pa.RecordBatch.from_arrays([pa.array(at[0] * dim + at[1], pa.int64()), pa.array(total[at])], names=["cell", "value"])

    out = np.zeros((dim, dim))
    for cell, value in _cells(points.select("x").mapInArrow(multiply, "cell bigint, value double")).items():
        out[cell // dim, cell % dim] = out[cell % dim, cell // dim] = value / n
    return out


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``order, l`` with a[order][:, order] = l @ l.T; l is lower trapezoidal, with as many columns as the rank.

    The largest remaining diagonal entry is taken next, so the columns' norms fall and rounding ends at the rank.
    """
    d = len(a)
    order, l, left = np.arange(d), np.zeros((d, d)), np.diag(a).astype(float).copy()
    stop = TINY * d * max(left.max(initial=0.0), 0.0)
    for k in range(d):
        p = k + int(np.argmax(left[k:]))
        if not left[p] > stop:
            return order, l[:, :k]
        order[[k, p]], left[[k, p]], l[[k, p]] = order[[p, k]], left[[p, k]], l[[p, k]]
        l[k, k] = np.sqrt(left[k])
        below = slice(k + 1, d)
        l[below, k] = (a[order[below], order[k]] - l[below, :k] @ l[k, :k]) / l[k, k]
        left[below] -= l[below, k] ** 2
    return order, l


def _tournament(m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rounds of disjoint pairs of m columns in which every pair meets once; an odd column rests."""
    ring = list(range(m + m % 2))
    half = len(ring) // 2
    for _ in range(len(ring) - 1):
        pairs = [(a, b) for a, b in zip(ring[:half], reversed(ring[half:]), strict=True) if max(a, b) < m]
        yield np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int)
        ring = [ring[0], ring[-1], *ring[1:-1]]


def one_sided_jacobi(l: np.ndarray, most_sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Squared norms and unit columns of l rotated from the right until its columns are orthogonal, largest first.

    They are the eigenvalues and eigenvectors of l @ l.T. The pairs of a round are disjoint and turn at once.
    """
    u = np.array(l, float)
    rounds = list(_tournament(u.shape[1]))
    for _ in range(most_sweeps):
        worst = 0.0
        for p, q in rounds:
            if not len(p):
                continue
            a, b = u[:, p], u[:, q]
            alpha, beta, gamma = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            off = np.abs(gamma) / np.sqrt(alpha * beta)
            worst = max(worst, float(off.max()))
            turn = off > 1e-16
            zeta = np.where(turn, (beta - alpha) / np.where(turn, 2 * gamma, 1.0), 0.0)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            u[:, p], u[:, q] = c * a - c * t * b, c * t * a + c * b
        if worst < 1e-15 * np.sqrt(len(u)):
            break
    norms = (u * u).sum(0)
    by = np.argsort(-norms, kind="stable")
    return norms[by], u[:, by] / np.sqrt(norms[by])


def principal_axes(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as rows; the largest entry of each is positive."""
    order, l = pivoted_cholesky(covariance)
    if not l.shape[1]:
        return np.zeros(0), np.zeros((0, len(covariance)))
    values, columns = one_sided_jacobi(l)
    axes = np.empty_like(columns.T)
    axes[:, order] = columns.T
    axes *= np.where(axes[np.arange(len(axes)), np.abs(axes).argmax(1)] < 0, -1.0, 1.0)[:, None]
    return values, axes


def _identity_error(points: DataFrame, model: Whitening) -> float:
    """Largest entry by which the covariance of the whitened distinct vectors is off the identity."""
    m, n, dim = len(model.axes), model.n, len(model.sums)
    sums, scaled = np.array(model.sums, object), model.axes.T / np.sqrt(model.variances)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((m, m)), np.zeros(m)
        for batch in slices(batches, 4096):
            w = _centred(_matrix(batch, dim), n, sums) @ scaled
            total, first = total + w.T @ w, first + w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m * m + m)), pa.array(np.concatenate([total.ravel(), first]))], names=["cell", "value"])

    cells = _cells(points.select("x").mapInArrow(multiply, "cell bigint, value double"))
    second = np.array([cells[i] for i in range(m * m)]).reshape(m, m) / n
    mean = np.array([cells[m * m + i] for i in range(m)]) / n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(m)).max())


def fit(rows: DataFrame, most: int = 16) -> tuple[DataFrame, Whitening | None]:
    """The rows of :func:`on_grid` that take part, and the model of their ``most`` leading components (None: no variance)."""
    lengths = rows.groupBy(F.octet_length("x").alias("b")).count().orderBy(F.desc("count"), F.desc("b")).limit(1).collect()
    if not lengths:
        return rows, None
    dim = lengths[0]["b"] // 8
    rows = rows.filter(F.octet_length("x") == 8 * dim)
    points = written(rows.select("x").distinct(), "grid-points")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = [0] * dim, 0
        for batch in slices(batches, 4096):
            x = _matrix(batch, dim)
            total, count = [a + int(b) for a, b in zip(total, x.sum(0), strict=True)], count + len(x)
        yield pa.RecordBatch.from_pydict({"d": [*range(dim), dim], "value": [*map(str, total), str(count)]})

    exact = points.mapInArrow(add, "d bigint, value string").groupBy("d").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    found = {r["d"]: int(r["value"]) for r in exact.collect()}
    n, sums = found[dim], np.array([found[i] for i in range(dim)], object)
    covariance = scatter(points, dim, n, sums)
    values, axes = principal_axes(covariance)
    if not len(values):
        return rows, None
    model = Whitening(n, tuple(sums), axes[:most], values[:most], float(np.trace(covariance)), 0.0)
    return rows, Whitening(n, model.sums, model.axes, model.variances, model.trace, _identity_error(points, model))


def transform(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each row and component."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    m, dim, n, sums = len(model.axes), len(model.sums), model.n, np.array(model.sums, object)
    scaled = model.axes.T / np.sqrt(model.variances)

    def deviations(x: np.ndarray) -> list[int | None]:
        top = float(n) * np.abs(x).max(initial=0) + max(abs(float(s)) for s in model.sums)
        if top * top * dim < 2 ** 62:
            return ((n * x - sums.astype(np.int64)) ** 2).sum(1).tolist()
        exact = ((n * x.astype(object) - sums) ** 2).sum(1)
        return [int(v) if v < 2 ** 63 else None for v in exact]

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            x = _matrix(batch, dim)
            k = len(x)
            each = np.repeat(np.arange(k), m)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, m + 1), k), pa.int32()), pa.array(np.full(k * m, n)),
                pa.array(deviations(x), pa.int64()).take(pa.array(each)), pa.array((_centred(x, n, sums) @ scaled).ravel()),
                pa.array(np.tile(model.variances / model.trace, k)), pa.array(np.full(k * m, model.identity_error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(whiten, schema)


def whiten(df: DataFrame, most: int = 16, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Fit on the table and whiten each of its rows; see the module's defined results."""
    rows, model = fit(on_grid(df, id_col, vec_col), most)
    return transform(rows, model)
