"""Whitening of vectors by principal components, refined to double precision.

Entries become integers ``x = floor(64 * c) + 1000000``. Three distributed passes work them up: exact integer
sums; the covariance, merged from blocks that are centred first; and the covariance of the whitened rows, which
is compared with the identity. Only matrices of the size of the dimension come to the driver.

The eigenvectors start as those of a float32 solver. Ogita-Aishima iterations then correct them by matrix products
in extended precision (float64 beyond ``EXTENDED_DIM`` dimensions), doubling the correct digits each time. Where
eigenvalues lie closer together than an iteration can tell apart, their vectors are only made orthogonal there, and
a solve of the small matrix of the cluster, shifted by its middle, turns them into eigenvectors.

Bounds: a task holds blocks of ``BLOCK_ROWS`` rows; the driver three matrices of the dimension.

Defined results: null vectors, empty ones and those with null or non-finite entries are left out. Vectors of another
size than the most frequent one (of equally frequent ones the larger) are left out too. No rows left give no
rows. Repeated rows count as often as they occur, and null IDs stay. A component without variance (within 1e-12 of
the largest) has a null ``whitened``; ``identity_error`` is over the others, null if there is none. Entries of more than 2 ** 60
steps are held at that. A ``deviation`` of more than 38 digits is null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, spread

#: Fixed values of the integer form.
STEPS, OFFSET = 64, 1_000_000
COMPONENTS = 32
BLOCK_ROWS = 4096
#: Up to this dimension the iterations run in extended precision.
EXTENDED_DIM = 512
ROUNDS = 12
#: Partial matrices are merged in two steps, by this many groups first.
GROUPS = 64
NO_VARIANCE = 1e-12
_LIMIT = float(1 << 60)
_LOW = np.int64((1 << 32) - 1)


# ---- eigenvectors ----------------------------------------------------------------


def _clusters(values: np.ndarray, gap: float) -> Iterator[np.ndarray]:
    """Positions of runs of ascending values that lie closer than ``gap``."""
    order = np.argsort(values)
    breaks = np.flatnonzero(np.diff(values[order]) > gap) + 1
    for run in np.split(order, breaks):
        if len(run) > 1:
            yield run


def refine(matrix: np.ndarray, vectors: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of a symmetric matrix from approximate ``vectors``, to double precision."""
    kind = np.longdouble if len(matrix) <= EXTENDED_DIM else np.float64
    a, x = matrix.astype(kind), vectors.astype(kind)
    one = np.eye(len(a), dtype=kind)
    norm = np.sqrt((a * a).sum())
    if not norm:
        return np.zeros(len(a)), np.eye(len(a))
    before = np.inf
    for _ in range(rounds):
        r = one - x.T @ x
        s = x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(np.diag(s))
        apart = 2 * (np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum()))
        gaps = values[None, :] - values[:, None]
        far = np.abs(gaps) > apart
        step = np.where(far, (s + values[None, :] * r) / np.where(far, gaps, 1), r / 2)
        x = x + x @ step
        for run in _clusters(values, apart):
            # The subspace is right by now; inside it the shifted small matrix tells the vectors apart.
            part = x[:, run]
            middle = values[run].mean()
            small = part.T @ (a @ part - middle * part)
            _, turn = np.linalg.eigh(((small + small.T) / 2).astype(np.float64))
            x[:, run] = part @ turn.astype(kind)
        change = float(np.abs(step).max())
        if change < 1e-17 or (change >= before and change < 1e-14):
            break
        before = change
    # One last orthogonalisation, then Rayleigh quotients.
    x = x + x @ ((one - x.T @ x) / 2)
    values = (x * (a @ x)).sum(axis=0) / (x * x).sum(axis=0)
    return values.astype(np.float64), x.astype(np.float64)


def eigenvectors(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; the largest entry of each is positive."""
    covariance = (covariance + covariance.T) / 2
    scale = np.abs(covariance).max(initial=0.0) or 1.0
    _, start = np.linalg.eigh((covariance / scale).astype(np.float32))
    values, vectors = refine(covariance / scale, start)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order] * scale, vectors[:, order]
    vectors /= np.sqrt((vectors * vectors).sum(axis=0))
    top = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.where(vectors[top, np.arange(len(values))] < 0, -1.0, 1.0)


# ---- passes ----------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """A fit: count, exact sums, eigenvalues with their vectors, and the whole variance."""

    count: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def pivots(self) -> tuple[np.ndarray, np.ndarray]:
        """Whole parts of the means, and what is left of the sums beside them."""
        whole = [s // self.count for s in self.sums]
        rest = [s - self.count * w for s, w in zip(self.sums, whole, strict=True)]
        return np.array(whole, np.int64), np.array(rest, np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """IDs and integer rows."""
    for batch in batches:
        for first in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(first, BLOCK_ROWS)
            entries = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            with np.errstate(over="ignore"):
                steps = np.clip(np.floor(entries * STEPS), -_LIMIT, _LIMIT)
            yield part.column(0), steps.astype(np.int64) + OFFSET


def _sums(dim: int):
    """Sums of the high and the low halves of the integers, one row per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n = np.zeros(dim, np.int64), np.zeros(dim, np.int64), 0
        for _, x in _blocks(batches, dim):
            high += (x >> 32).sum(axis=0)
            low += (x & _LOW).sum(axis=0)
            n += len(x)
        if n:
            place = np.arange(dim, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(high), pa.array(low)], names=["i", "high", "low"])

    return run


_STATE = "i int, part int, n bigint, mean array<double>, moments array<double>"


def _state(n: int, mean: np.ndarray, moments: np.ndarray, part: int = 0, first: int = 0) -> pa.RecordBatch:
    rows = len(moments)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.arange(first, first + rows, dtype=np.int32)), pa.array(np.full(rows, part, np.int32)),
            pa.array(np.full(rows, n, np.int64)), pa.array([mean] * rows, pa.list_(pa.float64())),
            pa.array(list(moments), pa.list_(pa.float64())),
        ],
        names=["i", "part", "n", "mean", "moments"],
    )


def _joined(a: tuple, b: tuple, rows: slice | int = slice(None)) -> tuple:
    """Centred moments of two sets of rows together (Chan, Golub and LeVeque)."""
    (n, mean, moments), (m, other, more) = a, b
    if not n:
        return b
    gap = other - mean
    joint = moments + more + np.multiply.outer(gap[rows], gap) * (n * m / (n + m))
    return n + m, mean + gap * (m / (n + m)), joint


def _moments(dim: int, width: int, form):
    """Moments of a task's rows, after ``form`` makes doubles of the integers; one row per row of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        whole = (0, np.zeros(width), np.zeros((width, width)))
        for _, x in _blocks(batches, dim):
            z = form(x)
            mean = z.mean(axis=0)
            centred = z - mean
            whole = _joined(whole, (len(z), mean, centred.T @ centred))
        if whole[0]:
            yield _state(*whole, part=TaskContext.get().partitionId())

    return run


def _merge(table: pa.Table) -> pa.Table:
    """One row of the matrix from its parts, in their order."""
    table = table.sort_by("part")
    row = table.column("i")[0].as_py()
    whole = (0, None, None)
    for n, mean, moments in zip(*(table.column(c).to_pylist() for c in ("n", "mean", "moments")), strict=True):
        whole = _joined(whole, (n, np.array(mean), np.array(moments)), row)
    part = table.column("part")[0].as_py()
    return pa.Table.from_batches([_state(whole[0], whole[1], whole[2][None, :], part, row)])


def _covariance(states: DataFrame, width: int) -> np.ndarray:
    """Merged in two steps, so that no task gathers the parts of all others."""
    group = F.pmod(F.col("part"), F.lit(GROUPS)).alias("group")
    some = states.groupBy("i", group).applyInArrow(_merge, _STATE)
    out = np.zeros((width, width))
    # One row per dimension, or per component.
    for row in some.groupBy("i").applyInArrow(_merge, _STATE).collect():
        out[row["i"]] = np.array(row["moments"]) / row["n"]
    return out


def _rows(table: DataFrame, row_id: str, vector: str) -> DataFrame:
    finite = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = table.where(F.coalesce(finite, F.lit(False)) & (F.size(vector) > 0))
    return rows.select(F.col(row_id).alias("id"), F.col(vector).cast("array<double>").alias("vector"))


def fit(rows: DataFrame, dim: int) -> Whitening:
    """Fit valid ``rows(id, vector)`` of one size."""
    total = rows.mapInArrow(_sums(dim), "i int, high bigint, low bigint").groupBy("i")
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    sums = {r["i"]: (int(r["high"]) << 32) + int(r["low"]) for r in total.agg(*exact).collect()}
    sums = tuple(sums[i] for i in range(dim))
    count = rows.count()
    pivot = Whitening(count, sums, np.zeros(0), np.zeros(0), 0.0).pivots[0]
    states = rows.mapInArrow(_moments(dim, dim, lambda x: (x - pivot).astype(np.float64)), _STATE)
    covariance = _covariance(states, dim)
    values, vectors = eigenvectors(covariance)
    return Whitening(count, sums, values, vectors, float(np.trace(covariance)))


def _projection(fitted: Whitening, components: int):
    """A function from integer rows to whitened ones: NaN where there is no variance."""
    pivot, rest = fitted.pivots
    means = rest / fitted.count
    values = fitted.values[:components]
    alive = values > NO_VARIANCE * max(fitted.values[0], 0.0)
    scale = np.where(alive, 1 / np.sqrt(np.where(alive, values, 1.0)), np.nan)
    turned = fitted.vectors[:, :components]

    def form(x: np.ndarray) -> np.ndarray:
        return (((x - pivot).astype(np.float64) - means) @ turned) * scale

    return form, alive


def _deviations(x: np.ndarray, pivot: np.ndarray, rest: np.ndarray, n: int) -> list[int | None]:
    """Sums of ``(n * x - S) ** 2``, in integers of any length."""
    z = x - pivot
    widest = max(int(np.abs(z).max(initial=0)), 1)
    if len(pivot) * widest * max(widest, n) < 1 << 62:
        squares, mixed = (z * z).sum(axis=1).tolist(), (z * rest).sum(axis=1).tolist()
    else:
        z = z.astype(object)
        squares, mixed = (z * z).sum(axis=1).tolist(), (z * rest.astype(object)).sum(axis=1).tolist()
    own = sum(int(r) ** 2 for r in rest)
    found = (n * n * a - 2 * n * b + own for a, b in zip(squares, mixed, strict=True))
    return [d if d < 10**38 else None for d in found]


def _emit(fitted: Whitening, dim: int, components: int, error: float | None):
    form, _ = _projection(fitted, components)
    pivot, rest = fitted.pivots
    explained = fitted.values[:components] / fitted.trace if fitted.trace > 0 else np.zeros(components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, dim):
            n = len(x)
            each = pa.array(np.repeat(np.arange(n), components))
            deviations = pa.array(_deviations(x, pivot, rest, fitted.count), pa.decimal128(38, 0))
            whitened = form(x).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(each), pa.array(np.tile(np.arange(1, components + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * components, fitted.count, np.int64)), deviations.take(each),
                    pa.array(whitened, mask=np.isnan(whitened)), pa.array(np.tile(explained, n)),
                    pa.array([error] * (n * components), pa.float64()),
                ],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(
    table: DataFrame, *, row_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """``row_id, component, n, deviation, whitened, explained, identity_error``: up to ``components`` rows per vector.

    ``deviation`` is a decimal of 38 digits.
    """
    spark = table.sparkSession
    ship(spark)
    rows = _rows(table, row_id, vector)
    kind = table.schema[row_id].dataType.simpleString()
    schema = (
        f"id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, "
        "identity_error double"
    )
    size = F.size("vector").alias("size")
    common = rows.groupBy(size).count().orderBy(F.desc("count"), F.desc("size")).first()
    if common is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", row_id)
    dim = common["size"]
    rows = spread(rows.where(F.size("vector") == dim))
    fitted = fit(rows, dim)
    components = min(components, dim)
    form, alive = _projection(fitted, components)
    error = None
    if alive.any():
        width = int(alive.sum())
        states = rows.mapInArrow(_moments(dim, width, lambda x: form(x)[:, alive]), _STATE)
        error = float(np.abs(_covariance(states, width) - np.eye(width)).max())
    return rows.mapInArrow(_emit(fitted, dim, components, error), schema).withColumnRenamed("id", row_id)
