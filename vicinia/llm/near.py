"""Near-duplicate documents by bottom-k sketches of one hash function.

A document is the set of hashes of its runs of ``size`` words (A-Z as a-z). Two
documents are linked if ``100 * |intersection| >= threshold * |union|``; classes
are the components of the links.

1. Documents with equal sets are one class from the start; its smallest ID stands
   for it below.
2. The ``SKETCH`` smallest hashes of a set are its sketch. An inverted list holds
   the documents that retained a value. Sketches of linked documents share at
   least ``needed`` values (all but 1.5 links in ten million at the threshold
   itself, and fewer beyond; without exception where sets fit their sketch). So
   of each sketch only its rarest values, all but ``needed - 1``, need a list, and
   values that nobody else retained use up their places without one.
3. In each list, all documents are compared with the first.
4. Only lists that still hold several components go on: their documents outside
   the commonest component are compared with those of other components, in pairs
   of blocks of bounded size whose sets are of sizes that may be linked. Overlaps of longer sketches (small sets are compared whole)
   estimate the similarity from the union sketch; what may reach the threshold,
   and nothing else, leaves the block, and only that of the first list that two
   documents share.
5. Every pair is confirmed on full sets.

A list of thousands of copies costs a row for each in step 3, and step 4 sees only
those that did not join the first. No pairs of a list are written before they pass
the estimate.

Defined results: a null text, or one without words, has the empty set, is linked
with nothing, and is its own class; with fewer words than ``size``, the whole
sequence is the one run; rows of equal ID are one node with the links of all their
texts; a null ID is an ID like
any other, smaller than all; an empty table gives an empty result. IDs are
integers. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship
from .arrays import find_words, hash_words, mix, odd_numbers, text_slices, window_hashes
from .components import components

SHINGLE = 5
SKETCH = 64
#: Sets up to this size are compared whole in blocks; of larger ones, sketches of LONG_SKETCH values.
WHOLE = 256
LONG_SKETCH = 128
#: Standard deviations below the expected overlap that a sketch may fall.
MARGIN = 5.5
#: Documents of a block, about.
BLOCK = 512
#: IDs that may be broadcast: 8 bytes each.
BROADCAST_IDS = 1_000_000
NO_ID = -(1 << 63)
#: Bytes of text worked on at once.
SLICE = 1 << 19
_U = np.uint64


def least_overlap(size: int, sketch: int, threshold: int) -> int:
    """Values that the sketch of a set of ``size`` shares with the sketch of any set linked with it."""
    share = threshold / 100
    expected = math.floor(sketch * (share - MARGIN * math.sqrt(share * (1 - share) / sketch)))
    if size <= share * sketch:
        # All sets linked with it fit their sketches, too.
        return -(-threshold * size // 100)
    return max(1, min(expected, -(-threshold * size // 100)))


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words of one document."""
    if not len(words):
        return np.zeros(0, np.uint64)
    if len(words) < size:
        factors = odd_numbers(len(words), 2)
        return mix(np.array([(words * factors).sum()], np.uint64) + _U(len(words)))
    return np.unique(window_hashes(words, size))


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    for first, last, data, offsets in text_slices(batch.column(0), SLICE):
        starts, ends, rows = find_words(data, offsets)
        words = hash_words(data, starts, ends, lower=True)
        for k in range(last - first):
            yield first + k, shingle_set(words[rows[k] : rows[k + 1]], size)


def _sketches(size: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, sketches = [], [], []
            for _, found in _sets(batch, size):
                counts.append(len(found))
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                sketches.append(found[:length].view(np.int64).copy())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()),
                    pa.array(sketches, pa.list_(pa.int64())),
                ],
                names=["id", "n", "key", "sketch"],
            )

    return run


def _full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                found = [s for _, s in _sets(part, size)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(1), pa.array([len(s) for s in found], pa.int64()),
                        pa.array([s.tobytes() for s in found], pa.binary()),
                    ],
                    names=["id", "n", "hashes"],
                )

    return run


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Values that two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def estimate(a: np.ndarray, b: np.ndarray, length: int) -> tuple[int, int]:
    """``(shared values, values)`` of the union sketch: the smallest values of both sets."""
    union = np.union1d(a[:length], b[:length])[:length]
    return overlap(overlap_values(a[:length], b[:length]), union), len(union)


def overlap_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.intersect1d(a, b, assume_unique=True) if len(a) and len(b) else np.zeros(1, np.uint64) - _U(1)


def may_reach(shared: np.ndarray, total: np.ndarray, threshold: int) -> np.ndarray:
    """Whether a union sketch leaves the threshold possible."""
    share = threshold / 100
    return shared >= total * share - MARGIN * np.sqrt(np.maximum(total, 1) * share * (1 - share))


def _confirm(threshold: int):
    """The rows whose two sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                shared = overlap(a, b) if len(a) and len(b) else 0
                linked = len(a) and len(b) and 100 * shared >= threshold * (len(a) + len(b) - shared)
                keep.append(bool(linked))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The ``pairs(a, b)`` that reach the threshold on full sets. Joins split a document of many pairs."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b"
    )
    return both.select("a", "b", "x", "y").mapInArrow(_confirm(threshold), "a bigint, b bigint")


def _incidence(lists: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    """Which of the sorted ``values`` each list holds, as a matrix of 0 and 1."""
    out = np.zeros((len(lists), len(values)), np.float32)
    if len(values):
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        flat = np.concatenate(lists)
        at = np.searchsorted(values, flat)
        at[at == len(values)] = 0
        hit = values[at] == flat
        out[row[hit], at[hit]] = 1
    return out


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values each list of ``a`` shares with each of ``b``."""
    both = np.intersect1d(np.concatenate(a), np.concatenate(b))
    return _incidence(a, both) @ _incidence(b, both).T


def compare(block: list, batch: list, value: int, threshold: int) -> list[tuple[int, int]]:
    """Pairs of a row of the block and a row of the batch that may be linked.

    Rows are ``(id, component, n, sketch, listed)``; ``value`` is the list that brought them together.
    """
    ids, comps, sizes = (np.array([r[c] for r in block]) for c in range(3))
    others, their, counts = (np.array([r[c] for r in batch]) for c in range(3))
    fits = (comps[:, None] != their[None, :]) & (
        100 * np.minimum(sizes[:, None], counts[None, :]) >= threshold * np.maximum(sizes[:, None], counts[None, :])
    )
    # A pair belongs to the smallest of the lists that it shares.
    fits &= _shared([r[4][r[4] < value] for r in block], [r[4][r[4] < value] for r in batch]) == 0
    rows, columns = np.flatnonzero(fits.any(axis=1)), np.flatnonzero(fits.any(axis=0))
    if not len(rows):
        return []
    shared = np.zeros(fits.shape, np.float32)
    mine, yours = [block[k][3][:LONG_SKETCH] for k in rows], [batch[k][3][:LONG_SKETCH] for k in columns]
    shared[np.ix_(rows, columns)] = _shared(mine, yours)
    short, shorter = np.minimum(sizes, LONG_SKETCH), np.minimum(counts, LONG_SKETCH)
    total = np.minimum(short[:, None] + shorter[None, :] - shared, LONG_SKETCH)
    fits &= may_reach(shared, total, threshold)
    out = []
    for i, j in zip(*np.nonzero(fits), strict=True):
        a, b = block[i][3], batch[j][3]
        if max(sizes[i], counts[j]) <= WHOLE:
            common = overlap(a, b)
            good = 100 * common >= threshold * (len(a) + len(b) - common)
        else:
            good = may_reach(*estimate(a, b, LONG_SKETCH), threshold)
        if good:
            out.append((int(ids[i]), int(others[j])))
    return out


#: Sides of a pair of blocks.
LEFT, BOTH, RIGHT = 0, 1, 2


def block_pairs(labelled: DataFrame, threshold: int) -> DataFrame:
    """``(value, block, side, id, component, n)``: the rows of each pair of blocks to be compared.

    ``labelled`` has ``(value, id, component, n)``. Only lists of several components are left, and of those no pair of
    blocks within the commonest component. A list of up to ``BLOCK`` rows is one block, compared with itself. A longer
    one is dealt by size, in steps so wide that linked documents lie in the same step or in neighbours, and by hash into
    blocks of about ``BLOCK`` rows; each pair of blocks that sizes allow is a group of its own, in which every block
    stands once. So no group has many more than ``2 * BLOCK`` rows, however long its list.
    """
    counted = labelled.groupBy("value", "component").agg(F.count(F.lit(1)).alias("c"))
    lists = cut(
        counted.groupBy("value")
        .agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.sum("c").alias("all"), F.max("c").alias("most"))
        .where("all > most")
        .select("value", "main", "all")
    )
    # A little wider, so that rounding puts no linked sizes two steps apart.
    width = 1.001 * max(0.01, math.log(100 / threshold))
    rows = labelled.join(lists, "value").withColumns(
        {"other": F.col("component") != F.col("main"), "step": F.floor(F.log("n") / width)}
    )
    cells = cut(
        rows.where(F.col("all") > BLOCK)
        .groupBy("value", "other", "step")
        .agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    )
    met = cells.select("value", F.col("step").alias("at"), F.struct("step", "other", "blocks").alias("met"))
    partners = (
        cells.withColumn("at", F.explode(F.array(*[F.col("step") + k for k in (-1, 0, 1)])))
        .join(met, ["value", "at"])
        .where("other OR met.other")
        .groupBy("value", "other", "step", "blocks")
        .agg(F.collect_list("met").alias("partners"))
    )
    rows = rows.join(partners, ["value", "other", "step"], "left")
    # Blocks of the commonest component that meet no others are done.
    rows = rows.where((F.col("all") <= BLOCK) | F.col("partners").isNotNull())
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), "blocks")).select("*", F.explode_outer("partners").alias("met"))
    numbers = F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("met.blocks"), F.lit(1)) - 1)
    rows = rows.withColumn("number", F.explode(numbers))
    mine, theirs = F.struct("step", "own"), F.struct("met.step", F.col("number").alias("own"))
    side = (
        F.when(F.col("met").isNull(), F.when(F.col("other"), BOTH).otherwise(RIGHT))
        .when(~F.col("other"), RIGHT)
        .when(~F.col("met.other") | (mine < theirs), LEFT)
        .when(mine == theirs, BOTH)
        .otherwise(RIGHT)
    )
    first = F.struct("step", "own", "other")
    second = F.struct("met.step", F.col("number").alias("own"), "met.other")
    # Equal hashes would only put two groups together.
    block = F.when(F.col("met").isNull(), F.lit(0).cast("bigint")).otherwise(
        F.when(F.col("side") == RIGHT, F.xxhash64(second, first)).otherwise(F.xxhash64(first, second))
    )
    return rows.withColumn("side", side).select("value", block.alias("block"), "side", "id", "component", "n")


def _compared(threshold: int):
    """Pairs of blocks: rows sorted by list, block and side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, left, right = None, [], []
        found: set[tuple[int, int]] = set()

        def work() -> None:
            for first in range(0, len(right) if left else 0, BLOCK):
                pairs = compare(left, right[first : first + BLOCK], place[0], threshold)
                found.update((max(p), min(p)) for p in pairs)

        def result() -> pa.RecordBatch:
            pairs = sorted(found)
            found.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"]
            )

        for rows in batches:
            columns = [rows.column(c).to_pylist() for c in ("value", "block", "side", "id", "component", "n")]
            for value, number, side, id_, component, count, sketch, listed in zip(
                *columns, rows.column("sketch"), rows.column("listed"), strict=True
            ):
                if (value, number) != place:
                    work()
                    place, left, right = (value, number), [], []
                row = (
                    id_, component, count, np.frombuffer(sketch.as_buffer(), "<u8").copy(),
                    listed.values.to_numpy(),
                )
                if side != RIGHT:
                    left.append(row)
                if side != LEFT:
                    right.append(row)
            yield result()
        work()
        yield result()

    return run


def sketches(documents: DataFrame, row_id: str, text: str, size: int = SHINGLE) -> DataFrame:
    """``(id, n, key, sketch)``: set size, digest of the set (null if empty) and its smallest hashes."""
    rows = documents.select(F.col(text).alias("text"), F.coalesce(F.col(row_id).cast("bigint"), F.lit(NO_ID)).alias("id"))
    return rows.mapInArrow(_sketches(size, SKETCH), "id bigint, n bigint, key binary, sketch array<bigint>")


def listed_values(classes: DataFrame, threshold: int) -> DataFrame:
    """``(id, n, listed)``: the values by which a document is found."""
    retained = classes.select("id", "n", F.explode("sketch").alias("value"))
    common = retained.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = retained.join(common, "value").groupBy("id", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "value"))).alias("found")
    )
    # The overlap that a set of each size needs, as far as sizes differ in it.
    needed = F.element_at(
        F.array(*[F.lit(least_overlap(max(1, s), SKETCH, threshold)) for s in range(2 * SKETCH)]),
        F.least(F.col("n") + 1, F.lit(2 * SKETCH)).cast("int"),
    )
    length = F.least("n", F.lit(SKETCH))
    # Values of nobody else are the rarest and come first.
    places = length - needed + 1 - (length - F.size("found"))
    listed = shared.withColumn("places", places.cast("int")).where("places > 0")
    return listed.select("id", "n", F.slice("found", F.lit(1), F.col("places")).getField("value").alias("listed"))


def near_duplicates(
    documents: DataFrame, *, row_id: str = "doc_id", text: str = "text", threshold: int = 85, size: int = SHINGLE
) -> DataFrame:
    """``row_id``, ``n_shingles``, ``component_id`` and ``kept`` (whether the row's ID names its component)."""
    spark = documents.sparkSession
    ship(spark)
    found = cut(sketches(documents, row_id, text, size))
    # Equal sets have equal sketches.
    classes = found.where("n > 0").groupBy("key").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")
    )
    listed = cut(listed_values(classes, threshold))
    entries = listed.select("id", "n", F.explode("listed").alias("value"))
    firsts = (
        entries.groupBy("value")
        .agg(F.min(F.struct("id", "n")).alias("first"), F.count(F.lit(1)).alias("length"))
        .where("length > 1")
    )
    lists = cut(
        entries.join(firsts, "value").select("value", "id", "n", F.col("first.id").alias("pivot"), F.col("first.n").alias("pivot_n"))
    )
    wanted = cut(lists.select("id").distinct())
    texts = documents.select(
        F.col(text).alias("text"), F.coalesce(F.col(row_id).cast("bigint"), F.lit(NO_ID)).alias("id")
    )
    few = wanted.count() <= BROADCAST_IDS
    texts = texts.join(F.broadcast(wanted) if few else wanted, "id", "left_semi").select("text", "id")
    sets = cut(texts.mapInArrow(_full_sets(size), "id bigint, n bigint, hashes binary"))

    # Step 3: the first of each list.
    stars = (
        lists.where("id <> pivot")
        .where(100 * F.least("n", "pivot_n") >= threshold * F.greatest("n", "pivot_n"))
        .select(F.col("id").alias("a"), F.col("pivot").alias("b"))
        .distinct()
    )
    parts = cut(components(confirmed(stars, sets, threshold)))

    # Step 4: lists of several components.
    labelled = cut(
        lists.join(parts, "id", "left").select("value", "id", "n", F.coalesce("component", "id").alias("component"))
    )
    length = F.when(F.col("n") <= WHOLE, F.col("n")).otherwise(F.lit(LONG_SKETCH))
    short = sets.select("id", F.substring(F.col("hashes"), F.lit(1), (8 * length).cast("int")).alias("sketch"))
    short = short.join(listed.select("id", "listed"), "id")
    rows = block_pairs(labelled, threshold).join(short, "id").repartition("value", "block")
    rows = rows.sortWithinPartitions("value", "block", "side")
    more = rows.mapInArrow(_compared(threshold), "a bigint, b bigint").distinct()
    more = cut(confirmed(more, sets, threshold))
    if not more.isEmpty():
        parts = cut(components(parts.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more)))

    # Back to all documents.
    reach = classes.select("key", "id").join(parts, "id", "left").select("key", F.coalesce("component", "id").alias("component"))
    out = found.select("id", "n", "key").join(reach, "key", "left")
    kind = documents.schema[row_id].dataType
    given = lambda c: F.when(c != NO_ID, c).cast(kind)
    component = F.coalesce("component", "id")
    return out.select(
        given(F.col("id")).alias(row_id), F.col("n").alias("n_shingles"),
        given(component).alias("component_id"), (F.col("id") == component).alias("kept"),
    )
