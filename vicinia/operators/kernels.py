"""Batch helpers that run inside Spark tasks on one bounded block of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

DISTANCE_DIGITS = 12
# Pairs held at once while one slice of queries meets one block.
PAIRS_AT_ONCE = 2_000_000


def to_matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column as a matrix of unit rows; zero rows stay zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    matrix = values.reshape(len(column), dim)
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0.0)


def nearest(queries: np.ndarray, block: np.ndarray, k: int):
    """Yield ``(start, positions, distances)``: the k nearest block rows per query.

    Distances are cosine distances rounded to ``DISTANCE_DIGITS``. Equal ones
    keep block order, so the caller sorts the block by its tie-break first.
    """
    k = min(k, len(block))
    if k == 0 or len(queries) == 0:
        return
    step = max(1, PAIRS_AT_ONCE // len(block))
    transposed = np.ascontiguousarray(block.T)
    for start in range(0, len(queries), step):
        distance = 1.0 - queries[start : start + step] @ transposed
        np.clip(distance, 0.0, 2.0, out=distance)
        np.round(distance, DISTANCE_DIGITS, out=distance)
        if k == len(block):
            found = np.broadcast_to(np.arange(k), distance.shape).copy()
        else:
            found = np.argpartition(distance, k - 1, axis=1)[:, :k]
            bound = np.take_along_axis(distance, found, axis=1).max(axis=1, keepdims=True)
            # More rows at the boundary than places: take the first in block order.
            for row in np.flatnonzero((distance <= bound).sum(axis=1) > k):
                within = np.flatnonzero(distance[row] <= bound[row])
                order = np.argsort(distance[row, within], kind="stable")
                found[row] = within[order[:k]]
        values = np.take_along_axis(distance, found, axis=1)
        order = np.lexsort((found, values), axis=1)
        yield start, np.take_along_axis(found, order, 1), np.take_along_axis(values, order, 1)
