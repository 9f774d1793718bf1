"""Exact cosine k-nearest-neighbour join.

Three physical plans give the same rows; sizes measured on the data choose one.

``library``  The library fits a broadcast budget: every task of the query side
             meets the whole library. No shuffle at all.
``queries``  Only the query side fits: one pass over the library where it lies,
             each task keeping its k best per query, then one merge.
``cells``    Neither fits: both sides are cut into cells around pivots and a
             query is compared with a cell only if the triangle inequality cannot
             rule it out (the pivot-based join of Lu et al., PVLDB 5(10), 2012).
             Rows are stored by cell, in blocks of bounded size; slices of
             queries meet the blocks where these lie, so no vector is shuffled
             to the cells it visits and no task grows with N.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors
from ..session import cut, cut_counting, ship, spread
from .kernels import DISTANCE_DIGITS, nearest, to_matrix

BROADCAST_BYTES = 8 * 1024 * 1024
#: Vectors of a block of the library in the cell plan; a Python task holds one at a time.
BLOCK_BYTES = 2 * 1024 * 1024
#: Blocks' worth of queries in a slice; a Python task holds a slice or two and their lists.
SLICE_BLOCKS = 2
#: Blocks that a task of the cell plan reads in all, one after the other.
SIDE_BYTES = 1024 * 1024 * 1024
#: Rows of the library that are dealt to a task to be packed.
PACKED_BYTES = 64 * 1024 * 1024
#: Tasks for each core in which slices meet blocks, where slices alone are fewer.
TASKS_A_CORE = 8
#: Queries and library rows that are multiplied at once: what fits a core's cache.
TILE_QUERIES, TILE_ROWS = 512, 512
#: Pairs that are worked out one by one at once.
PAIRS_GATHERED = 8192
#: Library rows from which the plan for few queries bounds what a task sends.
BOUND_SAMPLE = 4096
#: Distances to pivots that a task works out at once.
GAPS_AT_ONCE = 4_000_000
# A search of fewer rows is cheaper than moving the queries to more tasks.
SPREAD_ROWS = 1024
# Slack on Euclidean bounds: distances are rounded to 1e-12, so lengths on the
# unit sphere are good to about 1e-6.
SLACK = 2e-6
# Candidates among which pivots far apart are chosen.
SPREAD_PIVOTS = 8192
# What rounding a distance may move it by, with room.
ROUNDING = 2e-12
ZERO_CELL = -1
FIRST_ROWS_CELL = -2


def vector_profile(df: DataFrame, vector: str = "embedding", dim: int | None = None) -> tuple[int, int]:
    """``(rows, dim)`` of the valid vectors of one size.

    Without ``dim`` the size is that of the first valid vector by ``ord`` and ID: one row more or
    less of another size does not change it.
    """
    rows = df.where(vectors.is_valid(vector))
    if dim is not None:
        return rows.where(F.size(vector) == dim).count(), dim
    order = F.struct(*[c for c in ("ord", "paper_id", "query_id") if c in df.columns])
    sizes = rows.groupBy(F.size(vector).alias("size")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    row = sizes.orderBy("first").first()
    return (row["n"], row["size"]) if row else (0, 0)


def knn(
    queries: DataFrame,
    library: DataFrame,
    k: int,
    *,
    dim: int | None = None,
    library_rows: int | None = None,
    query_rows: int | None = None,
    exclude_self: bool = False,
    strategy: str | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int | None = None,
) -> DataFrame:
    """The k library rows nearest to each query.

    ``queries(query_id, embedding)`` × ``library(paper_id, ord, embedding)`` →
    ``(query_id, neighbor_id, distance, rank)``. Ties go to the lower ``ord``,
    then the lower ``paper_id``. Vectors that are not valid are left out.
    ``exclude_self`` drops the pair of a row with itself.
    """
    ship(queries.sparkSession)
    if dim is None or library_rows is None:
        library_rows, dim = vector_profile(library, dim=dim)
    query_type = queries.schema["query_id"].dataType
    id_type = library.schema["paper_id"].dataType
    ord_type = library.schema["ord"].dataType
    queries = queries.select("query_id", vectors.as_doubles("embedding").alias("embedding")).where(
        vectors.is_valid("embedding", dim)
    )
    library = library.select(
        "paper_id", "ord", vectors.as_doubles("embedding").alias("embedding")
    ).where(vectors.is_valid("embedding", dim))
    pairs = T.StructType(
        [
            T.StructField("query_id", query_type),
            T.StructField("neighbor_id", id_type),
            T.StructField("neighbor_ord", ord_type),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    if library_rows == 0:
        return queries.sparkSession.createDataFrame([], pairs).select(
            "query_id", "neighbor_id", "distance", F.lit(0).alias("rank")
        )

    if strategy is None:
        row_bytes = 8 * dim
        if library_rows * row_bytes <= broadcast_bytes:
            strategy = "library"
        else:
            if query_rows is None:
                query_rows = queries.count()
            strategy = "queries" if query_rows * row_bytes <= broadcast_bytes else "cells"

    wanted = k + 1 if exclude_self else k
    if strategy == "library":
        if library_rows >= SPREAD_ROWS:
            queries = spread(queries)
        return _with_library_broadcast(queries, library, k, wanted, dim, exclude_self, pairs)
    if strategy == "queries":
        found = _with_queries_broadcast(queries, library, wanted, dim, pairs)
    elif strategy == "cells":
        found = _through_cells(
            queries, library, k, wanted, dim, library_rows, exclude_self, pairs,
            broadcast_bytes, block_rows or max(1, BLOCK_BYTES // (8 * dim)),
        )
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return _best(found, k, exclude_self).select("query_id", "neighbor_id", "distance", "rank")


def _best(pairs: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    if exclude_self:
        pairs = pairs.where(F.col("neighbor_id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy("distance", "neighbor_ord", "neighbor_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _in_tie_order(table: pa.Table) -> pa.Table:
    return table.sort_by([("ord", "ascending"), ("paper_id", "ascending")])


def _ragged(ids: pa.Array, positions: np.ndarray) -> pa.Array:
    return ids.take(pa.array(positions.ravel()))


# ---- the library is small ---------------------------------------------------


def _with_library_broadcast(
    queries: DataFrame,
    library: DataFrame,
    k: int,
    wanted: int,
    dim: int,
    exclude_self: bool,
    pairs: T.StructType,
) -> DataFrame:
    local = _in_tie_order(library.toArrow())
    shared = queries.sparkSession.sparkContext.broadcast(
        (to_matrix(local["embedding"], dim), local["paper_id"].combine_chunks())
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, ids = shared.value
        for batch in batches:
            query_ids = batch.column("query_id")
            for start, found, distance in nearest(
                to_matrix(batch.column("embedding"), dim), matrix, wanted
            ):
                rows, width = found.shape
                owner = np.repeat(np.arange(start, start + rows), width)
                table = pa.table(
                    {
                        "query_id": query_ids.take(pa.array(owner)),
                        "neighbor_id": _ragged(ids, found),
                        "distance": distance.ravel(),
                    }
                )
                rank = np.tile(np.arange(1, width + 1, dtype=np.int32), rows)
                if exclude_self:
                    same = pc.equal(table["query_id"], table["neighbor_id"]).to_numpy()
                    same = same.reshape(rows, width)
                    shift = np.cumsum(same, axis=1).ravel()
                    rank = (rank - shift).astype(np.int32)
                    keep = ~same.ravel() & (rank <= k)
                    table = table.append_column("rank", pa.array(rank)).filter(pa.array(keep))
                else:
                    table = table.append_column("rank", pa.array(rank))
                yield from table.to_batches()

    schema = T.StructType(
        [pairs["query_id"], pairs["neighbor_id"], pairs["distance"],
         T.StructField("rank", T.IntegerType())]
    )
    return queries.mapInArrow(search, schema)


# ---- the query side is small ------------------------------------------------


def _with_queries_broadcast(
    queries: DataFrame, library: DataFrame, wanted: int, dim: int, pairs: T.StructType
) -> DataFrame:
    local = queries.toArrow()
    asked = to_matrix(local["embedding"], dim)
    shared = queries.sparkSession.sparkContext.broadcast(
        (asked, local["query_id"].combine_chunks(), _sampled_bound(asked, library, wanted, dim))
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, query_ids, bound = shared.value
        best: pa.Table | None = None
        for batch in batches:
            block = _in_tie_order(pa.Table.from_batches([batch]))
            new = _pair_table(matrix, query_ids, block, dim, wanted, bound)
            best = new if best is None else _merge(pa.concat_tables([best, new]), wanted)
        if best is not None:
            yield from best.to_batches(max_chunksize=65536)

    return library.mapInArrow(search, pairs)


def _sampled_bound(asked: np.ndarray, library: DataFrame, wanted: int, dim: int) -> np.ndarray:
    """The distance at which each query has ``wanted`` rows in a sample of the library.

    No row farther away can be among its best, so no task needs to send one.
    """
    # Any rows will do: the bound is exact for those it was taken from.
    rows = library.select("embedding").limit(BOUND_SAMPLE).toArrow()
    bound = np.full(len(asked), np.inf)
    if rows.num_rows >= wanted:
        for start, _, distance in nearest(asked, to_matrix(rows["embedding"], dim), wanted):
            bound[start : start + len(distance)] = distance[:, -1]
    return bound


def _pair_table(
    matrix: np.ndarray,
    query_ids: pa.Array,
    block: pa.Table,
    dim: int,
    wanted: int,
    bound: np.ndarray | None = None,
) -> pa.Table:
    """The best pairs, within ``bound``, of a query matrix with a block in tie order."""
    ids = block["paper_id"].combine_chunks()
    ords = block["ord"].combine_chunks()
    parts = []
    for start, found, distance in nearest(matrix, to_matrix(block["embedding"], dim), wanted):
        owner = np.repeat(np.arange(start, start + len(found)), found.shape[1])
        found, distance = found.ravel(), distance.ravel()
        if bound is not None:
            near = distance <= bound[owner]
            owner, found, distance = owner[near], found[near], distance[near]
        parts.append(
            pa.table(
                {
                    "query_id": query_ids.take(pa.array(owner)),
                    "neighbor_id": _ragged(ids, found),
                    "neighbor_ord": _ragged(ords, found),
                    "distance": distance,
                }
            )
        )
    if parts:
        return pa.concat_tables(parts)
    return pa.table(
        {
            "query_id": query_ids.slice(0, 0),
            "neighbor_id": ids.slice(0, 0),
            "neighbor_ord": ords.slice(0, 0),
            "distance": pa.array([], pa.float64()),
        }
    )


def _merge(table: pa.Table, wanted: int) -> pa.Table:
    """Keep the best ``wanted`` rows of each query."""
    table = table.sort_by(
        [("query_id", "ascending"), ("distance", "ascending"),
         ("neighbor_ord", "ascending"), ("neighbor_id", "ascending")]
    )
    codes = table["query_id"].combine_chunks().dictionary_encode().indices.to_numpy()
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    place = np.arange(len(codes)) - np.repeat(first, np.diff(np.r_[first, len(codes)]))
    return table.filter(pa.array(place < wanted))


# ---- neither side is small --------------------------------------------------


def _through_cells(
    queries: DataFrame,
    library: DataFrame,
    k: int,
    wanted: int,
    dim: int,
    library_rows: int,
    exclude_self: bool,
    pairs: T.StructType,
    broadcast_bytes: int,
    block_rows: int,
) -> DataFrame:
    spark = queries.sparkSession

    # No list can hold more than ``wanted`` copies of one vector. The window
    # limit runs before the shuffle, so a vector held by a third of the rows
    # leaves each task as ``wanted`` rows.
    copies = Window.partitionBy("embedding").orderBy("ord", "paper_id")
    distinct = (
        library.withColumn("copy", F.row_number().over(copies))
        .where(F.col("copy") <= wanted)
        .drop("copy")
    )
    # Places stand for the tie order, queries are numbered: numbers alone meet.
    placed = cut(distinct.orderBy("ord", "paper_id").withColumn("place", F.monotonically_increasing_id()))
    asked, seen = cut_counting(
        queries.withColumn("asked", F.monotonically_increasing_id()), n=F.count(F.lit(1))
    )

    pivots = _pivots(placed, dim, library_rows, broadcast_bytes, block_rows)
    shared_pivots = spark.sparkContext.broadcast(pivots)
    has_length = F.exists("embedding", lambda x: x != 0.0)
    blocks = cut(_packed(placed, "place", shared_pivots, dim, library_rows, block_rows))
    # Written, so that packing and searching never hold their workers' memory at once.
    slices = cut(_sliced(asked.where(has_length), shared_pivots, dim, seen["n"], block_rows * SLICE_BLOCKS))

    # One row per cell: bounded by the number of pivots.
    known = (
        blocks.select(F.inline("known"))
        .groupBy("cell")
        .agg(F.sum("n").alias("n"), F.min("inner").alias("inner"), F.max("outer").alias("outer"))
        .toArrow().to_pandas().set_index("cell")
    )
    shared_stats = spark.sparkContext.broadcast(
        _CellStats(
            pivots=pivots,
            n=known["n"].reindex(range(len(pivots)), fill_value=0).to_numpy(),
            inner=known["inner"].reindex(range(len(pivots)), fill_value=0.0).to_numpy(),
            outer=known["outer"].reindex(range(len(pivots)), fill_value=0.0).to_numpy(),
            zeros=int(known["n"].get(ZERO_CELL, 0)),
        )
    )

    library_side = blocks.select(
        F.col("keys").alias("places"), F.col("cells").alias("block_cells"),
        F.col("vectors").alias("block_vectors"), F.col("low").alias("block_low"), F.col("high").alias("block_high"),
    )
    home = (F.col("low") <= F.col("block_high")) & (F.col("block_low") <= F.col("high"))

    # A slice first meets the blocks that hold its own cells, all of them in one task.
    parts = -(-seen["n"] // (block_rows * SLICE_BLOCKS))
    first = cut(_met(_dealt(slices, parts), library_side.coalesce(1), home, wanted, dim, shared_stats, onwards=True))
    # The k-th distance seen so far bounds how far away a better row can be.
    cores = spark.sparkContext.defaultParallelism
    sides = max(1, -(-library_rows * 8 * dim // SIDE_BYTES), TASKS_A_CORE * cores // max(1, parts))
    rest = _met(_dealt(first, parts), library_side.coalesce(sides), ~home, wanted, dim, shared_stats)

    lists = first.select(*rest.columns).unionByName(rest).select(F.inline(F.arrays_zip("owners", "places", "distances")))
    # A zero query is equally far from every row: it needs the first rows only.
    front = F.broadcast(placed.orderBy("place").limit(wanted).select(F.col("place").alias("places")))
    level = asked.where(~has_length).select(F.col("asked").alias("owners")).crossJoin(front)
    lists = lists.unionByName(level.withColumn("distances", F.lit(1.0)))
    order = Window.partitionBy("owners").orderBy("distances", "places")
    best = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)
    names = placed.select(F.col("place").alias("places"), F.col("paper_id").alias("neighbor_id"))
    return (
        best.join(asked.select(F.col("asked").alias("owners"), "query_id"), "owners")
        .join(names, "places")
        .select("query_id", "neighbor_id", F.col("places").alias("neighbor_ord"), F.col("distances").alias("distance"))
    )


def _packed(
    rows: DataFrame, key: str, pivots: Broadcast, dim: int, count: int, block_rows: int, parts: int | None = None
) -> DataFrame:
    """``rows(<key> long, embedding)`` by cell, ``block_rows`` of them to a row, each block in order of its keys.

    ``keys`` and ``cells`` have an entry per vector, ``vectors`` holds the unit rows; ``low`` and ``high`` are the
    first and last cell, and ``known`` has the number of vectors and the range of radii of each cell.
    """

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, len(pivots.value)):
            matrix = to_matrix(batch.column("embedding"), dim)
            gap = _lengths(matrix, pivots.value)
            cell = gap.argmin(axis=1)
            radius = gap[np.arange(len(cell)), cell]
            zero = ~matrix.any(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    batch.column("embedding"),
                    pa.array(np.where(zero, ZERO_CELL, cell).astype(np.int32)),
                    pa.array(np.where(zero, 0.0, radius)),
                ],
                ["key", "embedding", "cell", "radius"],
            )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while held.num_rows >= block_rows:
                yield block(held.slice(0, block_rows))
                held = held.slice(block_rows)
        if held is not None and held.num_rows:
            yield block(held)

    def block(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks().sort_by("key")
        cells, radius = table["cell"].to_numpy(), table["radius"].to_numpy()
        known = [
            {"cell": int(c), "n": int(here.sum()), "inner": float(radius[here].min()), "outer": float(radius[here].max())}
            for c in np.unique(cells)
            for here in [cells == c]
        ]
        row = {
            "keys": [table["key"].to_numpy()], "cells": [cells], "vectors": [to_matrix(table["embedding"], dim).tobytes()],
            "low": [int(cells.min())], "high": [int(cells.max())], "known": [known],
        }
        return pa.RecordBatch.from_arrays([pa.array(row[f.name], f.type) for f in kinds], schema=kinds)

    kinds = pa.schema(
        [
            ("keys", pa.list_(pa.int64())), ("cells", pa.list_(pa.int32())), ("vectors", pa.binary()),
            ("low", pa.int32()), ("high", pa.int32()),
            ("known", pa.list_(pa.struct(
                [("cell", pa.int32()), ("n", pa.int64()), ("inner", pa.float64()), ("outer", pa.float64())]
            ))),
        ]
    )
    celled = rows.select(F.col(key).alias("key"), "embedding").mapInArrow(
        to_cells, "key long, embedding array<double>, cell int, radius double"
    )
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if parts is None:
        parts = max(1, min(2 * cores, count // block_rows), count * 8 * dim // PACKED_BYTES)
    return (
        celled.repartitionByRange(parts, "cell", "key")
        .sortWithinPartitions("cell", "key")
        .mapInArrow(
            pack,
            "keys array<long>, cells array<int>, vectors binary, low int, high int, "
            "known array<struct<cell int, n long, inner double, outer double>>",
        )
    )


def _sliced(asked: DataFrame, pivots: Broadcast, dim: int, count: int, slice_rows: int) -> DataFrame:
    """Queries packed as slices, about one to a partition; ranges differ a little, so they are dealt a fifth short of full."""
    parts = max(1, -(-count * 5 // (4 * slice_rows)))
    packed = _packed(asked, "asked", pivots, dim, count, slice_rows, parts).drop("known")
    return packed.withColumns({"slice": F.monotonically_increasing_id(), "bound": F.lit(None).cast("array<double>")})


def _dealt(slices: DataFrame, parts: int) -> DataFrame:
    """Stored slices, no more than about two to a task: small files that are read as one partition are dealt anew."""
    slices = slices.select("slice", "low", "high", "keys", "vectors", "bound")
    return slices if 2 * slices.rdd.getNumPartitions() >= parts else slices.repartition(parts)


def _met(
    slices: DataFrame, blocks: DataFrame, which: Column, wanted: int, dim: int, stats: Broadcast, onwards: bool = False
) -> DataFrame:
    """The best rows of every query of ``slices`` in the ``blocks`` that ``which`` names, one row per slice and task.

    A task holds its slices and reads its blocks as stored, one after the other, and keeps running lists: no vector
    is shuffled, and only what may be among the best leaves the task. A slice comes with the first block of a task, and a
    block's vectors where ``which`` holds. Where a slice is to meet others ``onwards``, it is handed on with its bound.
    """
    held = "slice long, low int, high int, keys array<long>, vectors binary, bound array<double>, "

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices_: dict[int, tuple[list, np.ndarray, _Lists]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column("slice")[i].as_py()
                if number not in slices_:
                    matrix = _vectors(batch, "vectors", i, dim).copy()
                    known = batch.column("bound")[i]
                    # No cosine distance exceeds 2, which is the bound where none is known.
                    bound = known.values.to_numpy().copy() if known.is_valid else np.full(len(matrix), 2.0)
                    ends = [batch.column(name)[i].as_py() for name in ("low", "high")]
                    slices_[number] = ends, _numbers(batch, "keys", i).copy(), _Lists(matrix, bound, wanted)
                if batch.column("block_vectors")[i].is_valid:
                    lists = slices_[number][-1]
                    cells = np.unique(_numbers(batch, "block_cells", i))
                    near = stats.value.reached(lists.matrix, lists.limit(), cells)
                    lists.meet(_vectors(batch, "block_vectors", i, dim), _numbers(batch, "places", i), near)
        while slices_:
            number, found = slices_.popitem()
            yield result(number, *found)

    def result(number: int, ends: list, asked: np.ndarray, lists: _Lists) -> pa.RecordBatch:
        filled = np.isfinite(lists.distances)
        values = {}
        if onwards:
            values = {
                "slice": pa.array([number], pa.int64()),
                "low": pa.array(ends[:1], pa.int32()),
                "high": pa.array(ends[1:], pa.int32()),
                "keys": pa.array([asked], pa.list_(pa.int64())),
                "vectors": pa.array([lists.matrix.tobytes()], pa.binary()),
                "bound": pa.array([lists.limit()], pa.list_(pa.float64())),
            }
        values |= {
            "owners": pa.array([np.repeat(asked, filled.sum(axis=1))], pa.list_(pa.int64())),
            "places": pa.array([lists.places[filled]], pa.list_(pa.int64())),
            "distances": pa.array([lists.distances[filled]], pa.list_(pa.float64())),
        }
        return pa.RecordBatch.from_pydict(values)

    # The lower bits count the rows of a partition.
    lead = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    # The side on the right is held, the one on the left is read once.
    met = blocks.withColumn("lead", lead).hint("shuffle_replicate_nl").join(slices, which | F.col("lead"))
    met = met.select(
        "slice", "low", "high",
        *[F.when(F.col("lead"), F.col(name)).alias(name) for name in ("keys", "vectors", "bound")],
        *[F.when(which, F.col(name)).alias(name) for name in ("places", "block_cells", "block_vectors")],
    )
    return met.mapInArrow(
        search, (held if onwards else "") + "owners array<long>, places array<long>, distances array<double>"
    )


def _numbers(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy()


def _vectors(batch: pa.RecordBatch, name: str, row: int, dim: int) -> np.ndarray:
    return np.frombuffer(batch.column(name)[row].as_buffer(), np.float64).reshape(-1, dim)


class _Lists:
    """The best rows seen so far of each query of a slice, within a known bound.

    Pairs are sifted in single precision, less what that may be off, and those left are worked out in double: the
    rows are those of products in double alone. Found pairs wait, and are sorted into the lists many at a time.
    """

    def __init__(self, matrix: np.ndarray, bound: np.ndarray, wanted: int):
        self.matrix, self.bound, self.wanted = matrix, bound, wanted
        self.single = matrix.astype(np.float32)
        self.slack = _single_slack(matrix.shape[1])
        self._distances = np.full((len(matrix), wanted), np.inf)
        self._places = np.full((len(matrix), wanted), np.iinfo(np.int64).max)
        self._waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._held = 0
        self._bind()

    @property
    def distances(self) -> np.ndarray:
        self._settle()
        return self._distances

    @property
    def places(self) -> np.ndarray:
        self._settle()
        return self._places

    def limit(self) -> np.ndarray:
        """Distances beyond which nothing is taken; pairs that wait do not count yet."""
        return self._limit

    def _bind(self) -> None:
        self._limit = np.minimum(self.bound, self._distances[:, -1])
        self.floor = (1.0 - self._limit - ROUNDING - self.slack).astype(np.float32)

    def meet(self, block: np.ndarray, places: np.ndarray, queries: np.ndarray) -> None:
        """Take in the rows of a block that are among the best of ``queries`` so far."""
        product = np.empty((TILE_QUERIES, TILE_ROWS), np.float32)
        near: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0
        for low in range(0, len(block), TILE_ROWS):
            rows = block[low : low + TILE_ROWS]
            tile = np.ascontiguousarray(rows.T, dtype=np.float32)
            for start in range(0, len(queries), TILE_QUERIES):
                some = queries[start : start + TILE_QUERIES]
                if len(rows) == TILE_ROWS:
                    cosine = np.matmul(self.single[some], tile, out=product[: len(some)])
                else:
                    cosine = self.single[some] @ tile
                # Most rows of a product hold nothing: their greatest entry says so.
                hit = np.flatnonzero(cosine.max(axis=1) >= self.floor[some])
                if not len(hit):
                    continue
                some, cosine = some[hit], cosine[hit]
                row, column = np.divmod(np.flatnonzero(cosine >= self.floor[some][:, None]), cosine.shape[1])
                if len(row) > 4 * self.wanted:
                    many = np.bincount(row, minlength=len(some)) > 4 * self.wanted
                    if many.any():
                        self._meet_many(some[many], rows, places[low : low + TILE_ROWS])
                        few = ~many[row]
                        row, column = row[few], column[few]
                near.append((some[row], column + low))
                count += len(row)
                if count > PAIRS_GATHERED:
                    near, count = self._work_out(near, block, places), 0
                if self._held > self.wanted * len(self.matrix) // 2:
                    self._settle()
        self._work_out(near, block, places)

    def _meet_many(self, some: np.ndarray, rows: np.ndarray, places: np.ndarray) -> None:
        """Note pairs of queries with rows of which so many are near that these alone set a bound, taken from double products."""
        exact = self.matrix[some] @ rows.T
        last = np.partition(exact, -self.wanted, axis=1)[:, -self.wanted]
        owner, column = np.nonzero(exact >= np.maximum(last, 1.0 - self._limit[some])[:, None] - ROUNDING)
        self._note(some[owner], exact[owner, column], places[column])

    def _work_out(self, near: list[tuple[np.ndarray, np.ndarray]], block: np.ndarray, places: np.ndarray) -> list:
        """Note those of the pairs that are near in double precision as well; returns that none are left."""
        if not near:
            return []
        owners, columns = (np.concatenate(part) for part in zip(*near, strict=True))
        for start in range(0, len(owners), PAIRS_GATHERED):
            owner, column = owners[start : start + PAIRS_GATHERED], columns[start : start + PAIRS_GATHERED]
            exact = np.einsum("ij,ij->i", self.matrix[owner], block[column])
            self._note(owner, exact, places[column])
        return []

    def _note(self, owner: np.ndarray, cosine: np.ndarray, place: np.ndarray) -> None:
        distance = np.round(np.clip(1.0 - cosine, 0.0, 2.0), DISTANCE_DIGITS)
        keep = np.flatnonzero(distance <= self._limit[owner])
        if len(keep):
            self._waiting.append((owner[keep], distance[keep], place[keep]))
            self._held += len(keep)

    def _settle(self) -> None:
        """Sort what waits into the lists."""
        if not self._held:
            return
        owner, distance, place = (np.concatenate(part) for part in zip(*self._waiting, strict=True))
        self._waiting, self._held = [], 0
        rows, at = np.unique(owner, return_inverse=True)
        owners = np.concatenate([np.repeat(np.arange(len(rows)), self.wanted), at])
        distance = np.concatenate([self._distances[rows].ravel(), distance])
        place = np.concatenate([self._places[rows].ravel(), place])
        order = np.lexsort((place, distance, owners))
        first = np.searchsorted(owners[order], np.arange(len(rows)))
        taken = order[first[:, None] + np.arange(self.wanted)]
        self._distances[rows], self._places[rows] = distance[taken], place[taken]
        self._bind()


def _single_slack(dim: int) -> float:
    """What a product of two unit rows in single precision may be off, with room: 2u a term for the rows as stored and the sum."""
    return (dim + 8) * 2.0**-23


def _pivots(
    library: DataFrame, dim: int, rows: int, broadcast_bytes: int, block_rows: int
) -> np.ndarray:
    """Non-zero library vectors drawn by hash, within the broadcast budget.

    At least one per block; for smaller libraries twice the root of their size,
    which keeps cells tight enough to be ruled out.
    """
    wanted = max(-(-rows // block_rows), 2 * math.isqrt(rows))
    budget = max(1, broadcast_bytes // (8 * dim))
    count = min(wanted, budget)
    drawn = min(budget, max(count, min(4 * count, SPREAD_PIVOTS)))
    usable = library.where(F.exists("embedding", lambda x: x != 0.0)).select("embedding")
    sample = usable.where(F.pmod(F.xxhash64("embedding"), F.lit(rows)) < 2 * drawn)
    table = sample.limit(drawn).toArrow()
    if table.num_rows == 0:
        table = usable.limit(1).toArrow()
    if table.num_rows == 0:  # only zero vectors: any direction will do
        return np.eye(1, dim)
    matrix = to_matrix(table["embedding"], dim)
    return matrix if len(matrix) > SPREAD_PIVOTS else _far_apart(matrix, count)


def _far_apart(matrix: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` rows, each the farthest from those before it."""
    chosen = [0]
    least = 1.0 - matrix @ matrix[0]
    while len(chosen) < min(count, len(matrix)):
        chosen.append(int(least.argmax()))
        if least[chosen[-1]] <= 0.0:
            chosen.pop()
            break
        np.minimum(least, 1.0 - matrix @ matrix[chosen[-1]], out=least)
    return matrix[chosen]


def _slices(batches: Iterator[pa.RecordBatch], pivots: int) -> Iterator[pa.RecordBatch]:
    """Batches of so few rows that a matrix of rows and pivots stays small, however many pivots."""
    step = max(1, GAPS_AT_ONCE // max(1, pivots))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def _lengths(matrix: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances between unit rows."""
    return np.sqrt(np.clip(2.0 - 2.0 * (matrix @ pivots.T), 0.0, 4.0))


class _CellStats:
    """What the router knows of each cell: pivot, size and range of radii."""

    def __init__(self, pivots, n, inner, outer, zeros):
        self.pivots, self.n, self.inner, self.outer, self.zeros = pivots, n, inner, outer, zeros

    def reached(self, matrix: np.ndarray, bound: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Positions of the unit rows that may have a row within ``bound`` in one of ``cells``."""
        filled = cells[cells != ZERO_CELL]
        near = np.zeros(len(matrix), bool)
        step = max(1, GAPS_AT_ONCE // max(1, len(filled)))
        for start in range(0, len(matrix), step):
            some = slice(start, start + step)
            near[some] = self._mask(_lengths(matrix[some], self.pivots[filled]), bound[some], filled).any(axis=1)
        if len(filled) < len(cells):
            # Zero rows lie at cosine distance 1 from everything.
            near |= bound >= 1.0
        return np.flatnonzero(near)

    def _mask(self, gap: np.ndarray, bound: np.ndarray, cells) -> np.ndarray:
        """Cells of which the triangle inequality rules out no row within ``bound``."""
        least = np.maximum(np.maximum(gap - self.outer[cells], self.inner[cells] - gap), 0.0)
        return least <= np.sqrt(2.0 * bound)[:, None] + SLACK

    def _first_mask(self, gap: np.ndarray, wanted: int) -> np.ndarray:
        """Nearest filled cells of each query that together hold ``wanted`` rows."""
        order = np.argsort(np.where(self.n > 0, gap, np.inf), axis=1, kind="stable")
        held = np.cumsum(self.n[order], axis=1)
        needed = (held - self.n[order] < wanted) & (self.n[order] > 0)
        mask = np.zeros(gap.shape, dtype=bool)
        np.put_along_axis(mask, order, needed, axis=1)
        return mask

    def _spread(self, mask: np.ndarray, zero_cell: np.ndarray, first_rows: np.ndarray):
        rows, cells = np.nonzero(mask)
        extra, front = np.flatnonzero(zero_cell), np.flatnonzero(first_rows)
        return (
            np.r_[rows, extra, front],
            np.r_[cells, np.full(len(extra), ZERO_CELL), np.full(len(front), FIRST_ROWS_CELL)],
        )

    def first_visit(self, matrix: np.ndarray, wanted: int):
        zero = ~matrix.any(axis=1)
        mask = self._first_mask(_lengths(matrix, self.pivots), wanted) & ~zero[:, None]
        short = (self.n.sum() < wanted) and self.zeros > 0
        return self._spread(mask, ~zero & short, zero)

    def later_visits(self, matrix: np.ndarray, bound: np.ndarray, wanted: int):
        zero = ~matrix.any(axis=1)
        gap = _lengths(matrix, self.pivots)
        seen = self._first_mask(gap, wanted)
        mask = self._mask(gap, bound, slice(None)) & (self.n > 0) & ~seen & ~zero[:, None]
        short = (self.n.sum() < wanted) and self.zeros > 0
        # Zero rows lie at cosine distance 1 from everything.
        ask_zero = ~zero & (bound >= 1.0) & (self.zeros > 0) & (not short)
        return self._spread(mask, ask_zero, np.zeros(len(matrix), dtype=bool))
