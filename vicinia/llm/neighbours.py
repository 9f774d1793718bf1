"""Approximate nearest neighbours by an inverted multi-index.

Both halves of the vectors are quantised on their own, so that ``CENTROIDS`` centroids
a half make their square of cells. The centroids are fitted on the driver by k-means
on a sample of at most ``SAMPLE`` vectors; every vector is entered in its cell. A query
visits cells in the order of the summed distance of its halves to the centroids,
taken from a heap over the two sorted lists, until the cells seen hold a share of all
vectors. That share is calibrated on the sample: the smallest at which sampled
queries find ``RECALL`` of their true neighbours. All entries of visited cells are
compared exactly, in double precision.

Nearness is the inner product, so the distance of a half is its negative.

Cells are put together to blocks of about ``BLOCK_ROWS`` entries, and a cell with more
is dealt over several blocks. A block is held by one task, and its queries stream past.

Defined results: vectors that are null, zero, or hold a null or a component that is
not finite take no part, nor do those of another length than the valid vector of the
smallest ID; a query's own ID is no candidate of it; ties go to the smaller ID; of
rows that repeat a query's ID one asks, and rows that repeat a candidate's ID are
entries each; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, ship, spread

CENTROIDS = 64
SAMPLE = 12_000
SAMPLE_QUERIES = 200
ROUNDS = 12
RECALL = 0.97
BLOCK_ROWS = 8192
#: Queries compared with a block at once.
QUERY_ROWS = 256


@dataclass(frozen=True)
class Quantiser:
    """Centroids of both halves, and the share of entries that a query sees."""

    left: np.ndarray
    right: np.ndarray
    share: float

    @property
    def split(self) -> int:
        return self.left.shape[1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of each vector."""
        return _nearest(x[:, : self.split], self.left) * len(self.right) + _nearest(x[:, self.split :], self.right)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(1) - 2 * x @ centroids.T).argmin(1)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids by Lloyd's rounds; a centroid that nobody chose moves to a random vector."""
    distinct = np.unique(x, axis=0)
    k = min(k, len(distinct))
    centroids = distinct[rng.choice(len(distinct), k, replace=False)].astype(np.float64)
    for _ in range(ROUNDS):
        own = _nearest(x, centroids)
        size = np.bincount(own, minlength=k)
        for d in range(x.shape[1]):
            total = np.bincount(own, x[:, d], k)
            centroids[:, d] = np.where(size > 0, total / np.maximum(size, 1), centroids[:, d])
        for lost in np.flatnonzero(size == 0):
            centroids[lost] = x[rng.integers(len(x))]
    return centroids


def traverse(query: np.ndarray, quantiser: Quantiser, counts: np.ndarray, wanted: float) -> list[int]:
    """Cells by summed distance until they hold ``wanted`` entries; empty cells are passed by."""
    a = -(quantiser.left @ query[: quantiser.split])
    b = -(quantiser.right @ query[quantiser.split :])
    first, second = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
    a, b = sorted(a.tolist()), sorted(b.tolist())
    width = len(b)
    sizes = counts.tolist()
    heap = [(a[0] + b[0], 0, 0)]
    # A pair enters when its left and its upper neighbour have left: each row's next column.
    done = [0] * len(a)
    visited, seen = [], 0
    while heap and seen < wanted:
        _, i, j = heapq.heappop(heap)
        done[i] = j + 1
        cell = first[i] * width + second[j]
        if sizes[cell]:
            visited.append(cell)
            seen += sizes[cell]
        if j + 1 < width and (i == 0 or done[i - 1] > j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if i + 1 < len(a) and done[i + 1] == j:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
    return visited


def fit(x: np.ndarray, neighbours: int, centroids: int = CENTROIDS, recall: float = RECALL, seed: int = 5) -> Quantiser:
    """Quantise a sample, and find the share of entries that reaches ``recall`` on it."""
    rng = np.random.default_rng(seed)
    half = max(1, x.shape[1] // 2) if x.shape[1] > 1 else 1
    left = k_means(x[:, :half], centroids, rng)
    right = k_means(x[:, half:], centroids, rng) if x.shape[1] > half else np.zeros((1, 0))
    quantiser = Quantiser(left, right, 1.0)
    cells = quantiser.cells(x)
    counts = np.bincount(cells, minlength=len(left) * len(right))
    asked = rng.choice(len(x), min(SAMPLE_QUERIES, len(x)), replace=False)
    needed = []
    for q in asked:
        score = x @ x[q]
        score[q] = -np.inf
        k = min(neighbours, len(x) - 1)
        if not k:
            continue
        best = np.argpartition(-score, k - 1)[:k]
        order = traverse(x[q], quantiser, counts, np.inf)
        place = np.full(len(counts), -1)
        place[order] = np.arange(len(order))
        # Entries seen before each neighbour's cell is, as a share: the cell itself need not be counted.
        before = np.cumsum(counts[order]) - counts[order]
        needed.append(before[place[cells[best]]] / len(x))
    share = float(np.quantile(np.concatenate(needed), recall)) if needed else 1.0
    return Quantiser(left, right, min(1.0, share + 1 / len(x)))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _assign(quantiser: Quantiser):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = quantiser.cells(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cells, pa.int32())], names=["id", "vector", "cell"]
                )

    return run


def pack(counts: np.ndarray, rows: int = BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray, int]:
    """``(first block, number of blocks)`` of each cell, and the number of blocks."""
    first, parts = np.zeros(len(counts), np.int32), np.ones(len(counts), np.int32)
    block, filled = 0, 0
    for cell, n in enumerate(counts.tolist()):
        if n > rows:
            if filled:
                block, filled = block + 1, 0
            first[cell], parts[cell] = block, -(-n // rows)
            block += int(parts[cell])
        else:
            if filled + n > rows:
                block, filled = block + 1, 0
            first[cell] = block
            filled += n
    return first, parts, block + 1


_ROW = "block int, mine boolean, id bigint, vector array<double>, cell int, cells binary"


def _ask(quantiser: Quantiser, counts: np.ndarray, first: np.ndarray, parts: np.ndarray):
    """Each query to the blocks of the cells that it visits."""
    wanted = quantiser.share * counts.sum()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, QUERY_ROWS):
                part = batch.slice(begin, QUERY_ROWS)
                blocks, rows, lists = [], [], []
                for k, query in enumerate(_matrix(part.column(1))):
                    visited = np.array(traverse(query, quantiser, counts, wanted), np.int64)
                    to = np.repeat(first[visited], parts[visited]) + np.concatenate(
                        [np.arange(p) for p in parts[visited]] or [np.zeros(0, int)]
                    )
                    cells = np.repeat(visited, parts[visited])
                    order = np.argsort(to, kind="stable")
                    to, cells = to[order], cells[order]
                    heads = np.flatnonzero(np.diff(to, prepend=-1))
                    for a, b in zip(heads, [*heads[1:], len(to)], strict=True):
                        blocks.append(int(to[a]))
                        rows.append(k)
                        lists.append(cells[a:b].astype("<i4").tobytes())
                taken = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(blocks, pa.int32()), pa.array([False] * len(rows), pa.bool_()),
                        part.column(0).take(taken), part.column(1).take(taken),
                        pa.nulls(len(rows), pa.int32()), pa.array(lists, pa.binary()),
                    ],
                    names=["block", "mine", "id", "vector", "cell", "cells"],
                )

    return run


def best_rows(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, open_: np.ndarray, k: int):
    """``(query row, vector row, score)`` of the k best open vectors of each query, ties to the smaller ID."""
    fits = open_ & (ids[None, :] != own[:, None])
    with np.errstate(over="ignore", invalid="ignore"):
        rough = queries @ vectors.T
    # Products may overflow: infinite ones rank first or last, undefined ones last of all.
    rough[np.isnan(rough) | ~fits] = -np.inf
    rows, columns, scores = [], [], []
    k = min(k, rough.shape[1])
    edge = -np.partition(-rough, k - 1, axis=1)[:, k - 1]
    for q in range(len(queries)):
        # A matrix product may round equal vectors differently: take a little more, and sum each row alike.
        slack = 1e-9 * (1 + abs(edge[q])) if np.isfinite(edge[q]) else 0.0
        near = np.flatnonzero((rough[q] >= edge[q] - slack) & fits[q])
        with np.errstate(over="ignore", invalid="ignore"):
            exact = (vectors[near] * queries[q]).sum(axis=1)
        order = np.lexsort((ids[near], -exact))[:k]
        rows.append(np.full(len(order), q))
        columns.append(near[order])
        scores.append(exact[order])
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(scores)


def _rerank(k: int):
    """The k best of a block for each query; rows sorted by block, its entries first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, vectors = None, [], None
        ids = cells = places = None
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            mine = batch.column(1).to_numpy(zero_copy_only=False)
            change = np.flatnonzero(np.concatenate([[True], (numbers[1:] != numbers[:-1]) | (mine[1:] != mine[:-1])]))
            for a, b in zip(change, [*change[1:], batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                if numbers[a] != block:
                    block, held, vectors = numbers[a], [], None
                if mine[a]:
                    held.append((part.column(2).to_numpy(), _matrix(part.column(3)), part.column(4).to_numpy()))
                    continue
                if vectors is None:
                    if not held:
                        continue
                    ids, vectors, cells = (np.concatenate(x) for x in zip(*held, strict=True))
                    held = []
                    known, places = np.unique(cells, return_inverse=True)
                for begin in range(0, part.num_rows, QUERY_ROWS):
                    few = part.slice(begin, QUERY_ROWS)
                    asked = few.column(2).to_numpy()
                    visits = np.zeros((few.num_rows, len(known)), bool)
                    for row, packed in enumerate(few.column(5)):
                        visits[row, np.isin(known, np.frombuffer(packed.as_buffer(), "<i4"))] = True
                    rows, columns, scores = best_rows(_matrix(few.column(3)), asked, vectors, ids, visits[:, places], k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(asked[rows]), pa.array(ids[columns]), pa.array(scores, pa.float64())],
                        names=["query_id", "vec_id", "score"],
                    )

    return run


def valid(vector: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def search(
    table: DataFrame, asks: Column, *, row_id: str = "vec_id", vector: str = "embedding", k: int = 20,
    centroids: int = CENTROIDS, recall: float = RECALL,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k nearest found of each row that ``asks``, among all rows.

    ``asks`` is a condition on the ID, named ``id``.
    """
    spark = table.sparkSession
    ship(spark)
    rows = table.select(
        F.col(row_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector")
    ).where(F.col("id").isNotNull() & valid(F.col("vector")))
    seen = rows.agg(F.count(F.lit(1)), F.min_by(F.size("vector"), "id")).first()
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    if not seen[0]:
        return spark.createDataFrame([], empty)
    rows = rows.where(F.size("vector") == seen[1])
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    # Some more than the sample are drawn, and what is over is left out.
    drawn = rows.where(draw < int(min(1.0, 0.9 * SAMPLE / seen[0]) * (1 << 30)))
    if seen[0] <= SAMPLE:
        drawn = rows
    sample = drawn.orderBy(draw, "id").limit(SAMPLE).select("vector").toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], empty)
    quantiser = fit(_matrix(sample.column(0).combine_chunks()), k, centroids, recall)
    index = cut(rows.mapInArrow(_assign(quantiser), "id bigint, vector array<double>, cell int"))
    counts = np.zeros(len(quantiser.left) * len(quantiser.right), np.int64)
    # One row per cell: at most the square of the number of centroids.
    for cell, n in index.groupBy("cell").count().collect():
        counts[cell] = n
    first, parts, blocks = pack(counts)
    plan = spark.createDataFrame(
        [(c, int(first[c]), int(parts[c])) for c in np.flatnonzero(counts).tolist()], "cell int, first int, parts int"
    )
    entries = index.join(F.broadcast(plan), "cell").select(
        (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("block"),
        F.lit(True).alias("mine"), "id", "vector", "cell", F.lit(None).cast("binary").alias("cells"),
    )
    # Traversal is heavy for the few bytes of a query.
    queries = spread(rows.where(asks).dropDuplicates(["id"])).mapInArrow(_ask(quantiser, counts, first, parts), _ROW)
    both = entries.unionByName(queries).repartitionById(blocks, F.col("block"))
    both = both.sortWithinPartitions("block", F.col("mine").desc(), "id")
    found = both.mapInArrow(_rerank(k), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
