"""Ranked lexical search by MaxScore with pair bounds.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case. A document's score
sums, over the distinct terms of a query, a weight times a saturated frequency, all in whole numbers (:func:`weight`,
:func:`impacts`).

The documents stay where they lie. A first pass writes, for each, its length and the frequencies of the terms that
the queries use; document frequencies and totals are counted from that table. A second pass turns it, block by
block, into inverted lists and stores of every listed term its largest impact, and of every listed *pair* of terms
the size of the intersection of their lists and the largest joint impact in it. Pairs are those of terms that stand
within ``REACH`` places of each other in a query's order of weights.

At query time the pairs that save most against the sum of their own maxima are chosen, each term once: no document
gains more from a pair than its largest joint impact or the larger single one. Sorted by these bounds, the longest
prefix of pairs and terms that together stays below the 50th best score found so far is not essential: documents that hold nothing else are never touched. Documents of
essential lists are completed from the largest bound down, and dropped as soon as what is left cannot lift them to
that score. Each task keeps the best rows of its documents; a window over them picks the best of all.

Scale: queries are worked off in blocks of ``QUERY_TERMS`` terms, each a pass over all documents, so what is sent to the executors does
not grow with either side. Tasks hold blocks of ``BLOCK_POSTINGS`` postings or ``BLOCK_ROWS`` documents; nothing is shuffled but counts,
maxima and ``k`` rows per task and query.

Defined results: null texts and texts without terms are no documents of the collection (they count neither in ``N`` nor
in ``L``). Queries that are null, empty or match nothing have no rows. Repeated documents are ranked one by one, null
document IDs after all others of the same score. Repeated items are answered one by one. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, ship, spread
from .arrays import text_slices

#: Fixed values of the score.
UNIT, SATURATION = 1_000_000_000, 20
BEST = 50
#: A term is paired with so many next ones in a query's order of weights.
REACH = 3
#: Terms (with repeats) of the queries that are answered in one pass.
QUERY_TERMS = 200_000
BLOCK_POSTINGS, BLOCK_ROWS = 2_000_000, 1 << 16

_LETTERS = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text: bytes of longer characters are all beyond ASCII."""
    return text.translate(_LETTERS).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(weights: np.ndarray, tf: np.ndarray, lengths: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What terms of a weight and a frequency add to documents of a length."""
    if 50 * documents * int(lengths.max(initial=0)) < 1 << 62:
        share = (50 * documents * lengths) // total
    else:
        share = np.array([50 * documents * int(n) // total for n in lengths], np.int64)
    return weights * ((UNIT * tf) // (1000 * tf + SATURATION * (50 + share)))


# ---- postings --------------------------------------------------------------------


def _postings(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column(1)):
                lengths, ids, counts, ends = [], [], [], [0]
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    words = terms(data[a:b].tobytes())
                    found = Counter(map(number, words))
                    found.pop(None, None)
                    ids += found.keys()
                    counts += found.values()
                    lengths.append(len(words))
                    ends.append(len(ids))
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first), pa.array(lengths, pa.int64()),
                        pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32())),
                        pa.ListArray.from_arrays(ends, pa.array(counts, pa.int32())),
                    ],
                    names=["id", "n", "terms", "counts"],
                )

    return run


@dataclass
class Block:
    """Inverted lists of some documents: rows are numbered by ascending document ID."""

    ids: pa.Array
    rows: np.ndarray
    values: np.ndarray
    known: np.ndarray
    starts: np.ndarray

    def lists(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        edges = [*self.starts.tolist(), len(self.rows)]
        return {
            t: (self.rows[a:b], self.values[a:b]) for t, a, b in zip(self.known.tolist(), edges, edges[1:], strict=False)
        }


def _invert(batch: pa.RecordBatch, weights: np.ndarray, documents: int, total: int) -> Block:
    order = pc.sort_indices(batch.column(0), null_placement="at_end")
    batch = batch.take(order)
    ids = batch.column(2).flatten().to_numpy()
    tf = batch.column(3).flatten().to_numpy().astype(np.int64)
    sizes = batch.column(2).value_lengths().to_numpy()
    lengths = np.repeat(batch.column(1).to_numpy(), sizes)
    rows = np.repeat(np.arange(batch.num_rows, dtype=np.int32), sizes)
    values = impacts(weights[ids], tf, lengths, documents, total) if len(ids) else np.zeros(0, np.int64)
    order = np.argsort(ids, kind="stable")
    # What adds nothing finds nothing.
    order = order[values[order] > 0]
    known, starts = np.unique(ids[order], return_index=True)
    return Block(batch.column(0), rows[order], values[order], known, starts)


def _blocks(batches: Iterator[pa.RecordBatch], weights: np.ndarray, documents: int, total: int) -> Iterator[Block]:
    held, postings, rows = [], 0, 0
    for batch in batches:
        ends = np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy())])
        first = 0
        while first < batch.num_rows:
            room = int(np.searchsorted(ends, ends[first] + BLOCK_POSTINGS - postings, "right")) - 1
            last = min(batch.num_rows, max(first + 1, room), first + max(1, BLOCK_ROWS - rows))
            held.append(batch.slice(first, last - first))
            postings, rows = postings + int(ends[last] - ends[first]), rows + last - first
            first = last
            if postings >= BLOCK_POSTINGS or rows >= BLOCK_ROWS or first < batch.num_rows:
                yield _invert(_together(held), weights, documents, total)
                held, postings, rows = [], 0, 0
    if held:
        yield _invert(_together(held), weights, documents, total)


def _together(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


# ---- bounds ----------------------------------------------------------------------


def listed_pairs(queries: Sequence[Sequence[int]], weights: np.ndarray, reach: int = REACH) -> set[tuple[int, int]]:
    """Pairs of terms that stand close in the order of weights of a query."""
    pairs = set()
    for query in queries:
        order = sorted(query, key=lambda t: (weights[t], t))
        for i, a in enumerate(order):
            pairs |= {(min(a, b), max(a, b)) for b in order[i + 1 : i + 1 + reach]}
    return pairs


_MAXIMA = "a int, b int, held bigint, most bigint"


def _maxima(shared, documents: int, total: int):
    """Largest impacts of terms (``b`` is -1), and of pairs within the intersection of their lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, partners = shared.value
        found: dict[tuple[int, int], tuple[int, int]] = {}

        def note(pair: tuple[int, int], held: int, most: int) -> None:
            old = found.get(pair, (0, 0))
            found[pair] = (old[0] + held, max(old[1], most))

        for block in _blocks(batches, weights, documents, total):
            lists = block.lists()
            dense = np.zeros(len(block.ids), np.int64)
            for a, (rows, values) in lists.items():
                note((a, -1), len(rows), int(values.max()))
                near = [b for b in partners.get(a, ()) if b in lists]
                if not near:
                    continue
                dense[rows] = values
                for b in near:
                    others, more = lists[b]
                    own = dense[others]
                    both = own > 0
                    held = int(np.count_nonzero(both))
                    if held:
                        note((a, b), held, int((own + more)[both].max()))
                dense[rows] = 0
        keys = np.array(list(found), np.int32).reshape(-1, 2)
        values = np.array(list(found.values()), np.int64).reshape(-1, 2)
        arrays = [keys[:, 0], keys[:, 1], values[:, 0], values[:, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(v)) for v in arrays], names=["a", "b", "held", "most"])

    return run


@dataclass(frozen=True)
class Plan:
    """A query's pairs and single terms by rising bound, and the sums of the bounds up to each."""

    units: list[tuple[int, ...]]
    upto: list[int]


def combine(query: Sequence[int], pairs: set[tuple[int, int]], most: dict[tuple[int, int], int]) -> Plan:
    """Choose of ``pairs``, each term once, those first whose bound saves most against two single maxima.

    Terms that no document holds are left out.
    """
    alone = {t: most[t, -1] for t in query if (t, -1) in most}
    savings = []
    for a, b in pairs:
        # Pairs that never meet in a document have no joint impact, only single ones.
        if a in alone and b in alone:
            joint = max(most.get((a, b), 0), alone[a], alone[b])
            savings.append((joint - alone[a] - alone[b], a, b, joint))
    bounds, free = [], set(alone)
    for saved, a, b, joint in sorted(savings):
        if saved < 0 and a in free and b in free:
            free -= {a, b}
            bounds.append((joint, (a, b)))
    bounds += [(alone[t], (t,)) for t in free]
    bounds.sort()
    upto, total = [], 0
    for bound, _ in bounds:
        total += bound
        upto.append(total)
    return Plan([u for _, u in bounds], upto)


# ---- search ----------------------------------------------------------------------


def _best_of(block: Block, lists: dict, plan: Plan, least: int, k: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a block with a score of at least ``least``, and their scores: the best k or a few more.

    ``sums`` is scratch space of zeros, and is left so.
    """
    # Documents that hold only the first units stay below the score to reach.
    skipped = int(np.searchsorted(plan.upto, least, "left"))
    none = np.zeros(0, np.int64)
    essential = [t for unit in plan.units[skipped:] for t in unit if t in lists]
    if not essential:
        return none, none
    for t in essential:
        rows, values = lists[t]
        sums[rows] += values
    found = np.flatnonzero(sums)
    scores = sums[found]
    sums[found] = 0
    for at in range(skipped - 1, -1, -1):
        hopeful = scores + plan.upto[at] >= least
        found, scores = found[hopeful], scores[hopeful]
        if not len(found):
            return none, none
        for t in plan.units[at]:
            if t in lists:
                rows, values = lists[t]
                place = np.minimum(np.searchsorted(rows, found), len(rows) - 1)
                scores += np.where(rows[place] == found, values[place], 0)
    if len(found) > k:
        least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
    good = scores >= max(least, 1)
    return found[good], scores[good]


def _search(shared, documents: int, total: int, k: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, plans = shared.value
        best: list[pa.Table | None] = [None] * len(plans)
        least = [0] * len(plans)
        for block in _blocks(batches, weights, documents, total):
            lists = block.lists()
            sums = np.zeros(len(block.ids), np.int64)
            for q, plan in enumerate(plans):
                if not plan.upto or plan.upto[-1] < least[q]:
                    continue
                rows, scores = _best_of(block, lists, plan, least[q], k, sums)
                if not len(rows):
                    continue
                new = pa.table({"id": block.ids.take(pa.array(rows)).cast(kind), "score": scores})
                both = new if best[q] is None else pa.concat_tables([best[q], new])
                order = pc.sort_indices(both, [("score", "descending"), ("id", "ascending")], null_placement="at_end")
                best[q] = both.take(order[:k]).combine_chunks()
                if len(best[q]) == k:
                    least[q] = best[q].column("score")[k - 1].as_py()
        for q, rows in enumerate(best):
            if rows is not None:
                yield from rows.add_column(0, "q", pa.array(np.full(len(rows), q, np.int32))).to_batches()

    return run


def _query_blocks(items: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items with their distinct terms, in runs of about ``limit`` terms."""
    block, size = [], 0
    for row in items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).toLocalIterator():
        words = list(dict.fromkeys(terms((row["t"] or "").encode())))
        if not words:
            continue
        if block and size + len(words) > limit:
            yield block
            block, size = [], 0
        block.append((row["i"], words))
        size += len(words)
    if block:
        yield block


def search(
    documents: DataFrame,
    items: DataFrame,
    *,
    row_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    k: int = BEST,
    query_terms: int = QUERY_TERMS,
) -> DataFrame:
    """``item_id``, ``rank``, ``row_id``, ``score``: the k best documents of each item, ties to the smaller ID."""
    spark = documents.sparkSession
    ship(spark)
    rows = spread(documents.select(F.col(row_id).alias("id"), F.col(text).alias("text")))
    schema = T.StructType(
        [
            T.StructField(item_id, items.schema[item_id].dataType), T.StructField("rank", T.IntegerType()),
            T.StructField(row_id, documents.schema[row_id].dataType), T.StructField("score", T.LongType()),
        ]
    )
    out = None
    for block in _query_blocks(items, item_id, item_text, query_terms):
        found = _answer(rows, block, items.schema[item_id].dataType, k)
        if found is not None:
            found = found.toDF(*schema.names)
            out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def _answer(rows: DataFrame, block: list[tuple[object, list[bytes]]], item_kind: T.DataType, k: int) -> DataFrame | None:
    """The best rows for one block of queries."""
    spark = rows.sparkSession
    share = spark.sparkContext.broadcast
    number: dict[bytes, int] = {}
    queries = [[number.setdefault(w, len(number)) for w in words] for _, words in block]
    id_kind = rows.schema["id"].dataType
    form = T.StructType([T.StructField("id", id_kind), *T._parse_datatype_string(
        "n bigint, terms array<int>, counts array<int>").fields])
    index = cut(rows.mapInArrow(_postings(share(number)), form))
    seen = index.agg(F.count_if(F.col("n") > 0).alias("n"), F.sum("n").alias("all")).first()
    if not seen["n"]:
        return None
    held = np.zeros(len(number), np.int64)
    # One row per term of the queries.
    for term, n in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        held[term] = n
    totals = seen["n"], seen["all"]
    weights = np.array([weight(seen["n"], n) for n in held.tolist()], np.int64)
    partners: dict[int, list[int]] = {}
    for a, b in sorted(listed_pairs(queries, weights)):
        partners.setdefault(a, []).append(b)
    maxima = index.mapInArrow(_maxima(share((weights, partners)), *totals), _MAXIMA)
    maxima = maxima.groupBy("a", "b").agg(F.sum("held").alias("held"), F.max("most").alias("most"))
    # One row per term and listed pair of the queries.
    most = {(a, b): m for a, b, _, m in maxima.collect()}
    plans = [combine(query, listed_pairs([query], weights), most) for query in queries]
    form = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("id", id_kind), T.StructField("score", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_type

    found = index.mapInArrow(_search(share((weights, plans)), *totals, k, to_arrow_type(id_kind)), form)
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = spark.createDataFrame(
        list(enumerate(i for i, _ in block)),
        T.StructType([T.StructField("q", T.IntegerType()), T.StructField("item", item_kind)]),
    )
    return ranked.join(F.broadcast(named), "q").select("item", "rank", "id", "score")
