"""Removal of long repeated passages by recompression.

Every document is a sequence of words. Rounds rewrite all sequences in the same
way: a round of runs replaces a maximal run of one symbol, a round of pairs
replaces neighbours of which the first has a coin of 1 and the second of 0. A new
symbol's name is a hash of what it stands for, so equal runs and pairs get one
name everywhere without a shared dictionary, and equal passages are rewritten
alike but for their ends. For every symbol the words that decided it are known.

1. Names of the last round are dealt out by name; those that occur once are told
   from those that are shared. A window is ruled out if a symbol decided wholly
   inside it occurs nowhere else: had the window another place, so had the symbol.
2. The remaining windows are verified: dealt out by a 96-bit hash of their words,
   every occurrence but the first (by document, then position) is a repeat.
3. Words covered by a repeat are removed.

Nothing is ruled out by chance, and a clash of names only leaves a window to be
verified. Tasks first settle what repeats among their own documents and send one
row of each name, so that a passage in a third of all documents costs a row per
task. Rows travel as packed arrays; no task needs more than its share of names.

Defined results: a null or empty text has no words; documents are ordered by ID,
null first, and those of equal ID by a 64-bit hash of the text; rows equal in both
are one document, and each gets its result; texts of any length are read whole; an
empty table gives an empty result. IDs are integers. Only the named columns are
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship
from .arrays import find_words, hash_words, mix, odd_numbers, text_slices, window_hashes

WINDOW = 20
#: One round of runs, then rounds of pairs; each makes symbols about a third longer.
ROUNDS = "rpppp"
#: Symbols or windows that a task gathers before it sends them.
GATHER = 1_500_000
NO_ID = -(1 << 63)
_FAR = 1 << 60
_U = np.uint64

#: Packed rows: the part that gets them, documents with their counts, and a name and a place for each entry.
_PACKED = "part int, ids binary, ties binary, counts binary, first binary, second binary, places binary"
#: Packed marks: the part that gets them, documents with their counts, and the places.
_PLACES = "part int, ids binary, ties binary, counts binary, places binary"
_MARKS = "id bigint, tie bigint, marks binary"


def recompress(words: np.ndarray, owner: np.ndarray, rounds: str = ROUNDS):
    """``(name, owner, begin, end, left, right)`` of the symbols after all rounds.

    ``[begin, end)`` are the words a symbol stands for, ``[left, right)`` those that decided it; a
    symbol that a text's end may have decided has ``left`` or ``right`` far outside.
    """
    name, begin = words, np.arange(len(words), dtype=np.int64)
    end = begin + 1
    left, right = begin, end
    for number, kind in enumerate(rounds):
        if not len(name):
            break
        same = owner[1:] == owner[:-1]
        if kind == "r":
            head = np.flatnonzero(np.concatenate([[True], ~(same & (name[1:] == name[:-1]))]))
            tail = np.concatenate([head[1:], [len(name)]]) - 1
            length = (tail - head + 1).astype(np.uint64)
            new = np.where(length > 1, mix(name[head] + _U(0x51ED27) * length + _U(number)), name[head])
            own = owner[head]
            joined = own[1:] == own[:-1]
            new_left = np.where(np.concatenate([[False], joined]), np.concatenate([[0], left[tail[:-1]]]), -_FAR)
            new_right = np.where(np.concatenate([joined, [False]]), np.concatenate([right[head[1:]], [0]]), _FAR)
            left, right = np.minimum(new_left, left[head]), np.maximum(new_right, right[tail])
            name, owner, begin, end = new, own, begin[head], end[tail]
        else:
            coin = (mix(name + _U(1000 + number)) & _U(1)).astype(bool)
            pair = np.concatenate([coin[:-1] & ~coin[1:] & same, [False]])
            first = np.flatnonzero(~np.concatenate([[False], pair[:-1]]))
            merged = pair[first]
            last = first + merged
            new = np.where(merged, mix(name[first] * _U(0x9E3779B97F4A7C15) + mix(name[last]) + _U(number)), name[first])
            # What did not merge knows the coin of the neighbour it might have merged with.
            ahead = np.where(np.concatenate([[False], same]), np.concatenate([[0], left[:-1]]), -_FAR)[first]
            behind = np.where(np.concatenate([same, [False]]), np.concatenate([right[1:], [0]]), _FAR)[first]
            new_left = np.where(~merged & ~coin[first], np.minimum(ahead, left[first]), left[first])
            new_right = np.where(~merged & coin[first], np.maximum(behind, right[last]), right[last])
            name, owner, begin, end, left, right = new, owner[first], begin[first], end[last], new_left, new_right
    return name, owner, begin, end, left, right


def _bytes(x: np.ndarray, kind: str) -> bytes:
    """Numbers with all their lowest bytes first: small ones are then mostly zeros in a row, which compress."""
    return np.ascontiguousarray(x, kind).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _from(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


class _Packer:
    """Gathers entries, settles those that repeat within the task, and packs the others by part."""

    def __init__(self, parts: int, verify: bool):
        self.parts, self.verify = parts, verify
        self._clear()

    def _clear(self) -> None:
        self.ids, self.ties = [], []
        self.rows, self.first, self.second, self.places = [], [], [], []
        self.documents = self.entries = 0

    def add(self, ids, ties, owner, first, second, places) -> None:
        self.ids.append(ids)
        self.ties.append(ties)
        self.rows.append(owner + self.documents)
        self.first.append(first)
        self.second.append(second)
        self.places.append(places)
        self.documents += len(ids)
        self.entries += len(first)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.entries:
            self._clear()
            return
        ids, ties = np.concatenate(self.ids), np.concatenate(self.ties)
        rows, first = np.concatenate(self.rows), np.concatenate(self.first)
        second, places = np.concatenate(self.second), np.concatenate(self.places)
        self._clear()
        order, settled = settle(first, second, ids[rows], ties[rows], places, self.verify)
        # What is settled goes on as marks; of the rest, one entry per name.
        marks = order[settled]
        yield from _packed(np.full(len(marks), -1, np.int32), rows, first, second, places, ids, ties, marks, self.parts)
        heads = order[leaders(first, second, order)]
        part = ((first[heads] >> _U(32)) * _U(self.parts) >> _U(32)).astype(np.int32)
        if not self.verify:
            # A name that is shared here is shared anywhere: tell so by sending it twice.
            many = np.isin(first[heads], first[marks])
            second = second.copy()
            second[heads] = many
        yield from _packed(part, rows, first, second, places, ids, ties, heads, self.parts)


def leaders(first: np.ndarray, second: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which entries of ``order`` are the first of their name."""
    a, b = first[order], second[order]
    return np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(order) else np.zeros(0, bool)


def settle(first, second, ids, ties, places, verify: bool, known: np.ndarray | None = None):
    """``(order by name, which entries of it are marked)``.

    To verify is to mark all occurrences of a name but the first by document and place; otherwise
    all entries of a name that occurs twice, or that is known to be shared, are marked.
    """
    order = np.argsort(first, kind="stable")
    a = first[order]
    same = a[1:] == a[:-1]
    again = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    if not verify:
        if known is not None and known.any():
            start = np.flatnonzero(np.concatenate([[True], ~same]))
            told = np.maximum.reduceat(known[order].astype(np.int8), start).astype(bool)
            again |= np.repeat(told, np.diff(np.concatenate([start, [len(a)]])))
        return order, again
    spots = np.flatnonzero(again)
    if len(spots):
        chosen = order[spots]
        chosen = chosen[np.lexsort((places[chosen], ties[chosen], ids[chosen], second[chosen], first[chosen]))]
        order = order.copy()
        order[spots] = chosen
    marked = np.zeros(len(order), bool)
    head = leaders(first, second, order)
    start = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0)) if len(order) else order
    lead = order[start] if len(order) else order
    marked = (ids[order] != ids[lead]) | (ties[order] != ties[lead]) | (places[order] != places[lead])
    return order, marked


def _packed(part, rows, first, second, places, ids, ties, chosen, parts) -> Iterator[pa.RecordBatch]:
    """Rows of the packed schema for the chosen entries; marks (part -1) are spread over all parts."""
    if not len(chosen):
        return
    by = np.lexsort((places[chosen], rows[chosen], part))
    part, chosen = part[by], chosen[by]
    # Marks are cut into a few rows, so that no part gets them all.
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    if part[0] < 0:
        step = max(1, len(chosen) // 16)
        cuts = np.arange(0, len(chosen), step)
    out = {k: [] for k in ("part", "ids", "ties", "counts", "first", "second", "places")}
    for number, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(chosen)], strict=True)):
        own = chosen[a:b]
        row = rows[own]
        heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        mark = part[a] < 0
        spread = int(_U(ids[row[0]].astype(np.uint64) + _U(number)) % _U(parts))
        out["part"].append(-1 - spread if mark else int(part[a]))
        out["ids"].append(_bytes(ids[row[heads]], "<i8"))
        out["ties"].append(_bytes(ties[row[heads]], "<i8"))
        out["counts"].append(_bytes(np.diff([*heads, len(row)]), "<i4"))
        out["first"].append(b"" if mark else _bytes(first[own], "<u8"))
        out["second"].append(b"" if mark else _bytes(second[own], "<u4"))
        out["places"].append(_bytes(places[own], "<i4"))
    kinds = [pa.int32()] + [pa.binary()] * 6
    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=[*out])


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where one of the sorted columns changes, and the end."""
    n = len(columns[0])
    change = np.zeros(n, bool)
    change[:1] = True
    for x in columns:
        change[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(change), n)


def _judge(verify: bool, parts: int):
    """Marks of all packed rows of a part, packed for the parts of their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, marks = [], []
        for batch in batches:
            for row in batch.to_pylist():
                counts = _from(row["counts"], "<i4")
                ids, ties = (np.repeat(_from(row[c], "<i8"), counts) for c in ("ids", "ties"))
                places = _from(row["places"], "<i4")
                if row["part"] < 0:
                    marks.append((ids, ties, places))
                else:
                    gathered.append((ids, ties, _from(row["first"], "<u8"), _from(row["second"], "<u4"), places))
        if gathered:
            ids, ties, first, second, places = (np.concatenate(x) for x in zip(*gathered, strict=True))
            gathered.clear()
            # Without verification, the second number tells what a task knows to be shared.
            known = None if verify else second > 0
            order, marked = settle(first, second, ids, ties, places, verify, known)
            found = order[marked]
            marks.append((ids[found], ties[found], places[found]))
        if not marks:
            return
        ids, ties, places = (np.concatenate(x) for x in zip(*marks, strict=True))
        # By the tie too: rows without an ID are many documents.
        to = (mix(ids.astype(np.uint64) + mix(ties)) % _U(parts)).astype(np.int32)
        order = np.lexsort((places, ties, ids, to))
        to, ids, ties, places = to[order], ids[order], ties[order], places[order]
        documents = _heads(to, ids, ties)
        rows = {k: [] for k in ("part", "ids", "ties", "counts", "places")}
        for a, b in zip(*(lambda h: (h[:-1], h[1:]))(_heads(to)), strict=True):
            own = documents[np.searchsorted(documents, a) : np.searchsorted(documents, b)]
            rows["part"].append(int(to[a]))
            rows["ids"].append(_bytes(ids[own], "<i8"))
            rows["ties"].append(_bytes(ties[own], "<i8"))
            rows["counts"].append(_bytes(np.diff(np.append(own, b)), "<i4"))
            rows["places"].append(_bytes(places[a:b], "<i4"))
        kinds = [pa.int32()] + [pa.binary()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], names=[*rows])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document with all its marks."""
    marks = []
    for batch in batches:
        for row in batch.to_pylist():
            counts = _from(row["counts"], "<i4")
            marks.append(
                (np.repeat(_from(row["ids"], "<i8"), counts), np.repeat(_from(row["ties"], "<i8"), counts),
                 _from(row["places"], "<i4"))
            )
    if not marks:
        return
    ids, ties, places = (np.concatenate(x) for x in zip(*marks, strict=True))
    order = np.lexsort((places, ties, ids))
    ids, ties, places = ids[order], ties[order], places[order]
    heads = _heads(ids, ties)
    data = [_bytes(np.unique(places[a:b]), "<i4") for a, b in zip(heads, heads[1:], strict=False)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(ids[heads[:-1]]), pa.array(ties[heads[:-1]]), pa.array(data, pa.binary())], names=["id", "tie", "marks"]
    )


def _gathered_marks(packed: DataFrame, parts: int, verify: bool) -> DataFrame:
    """``(id, tie, marks)``: for every document with marks its packed places."""
    dealt = packed.repartitionById(parts, F.when(F.col("part") < 0, -1 - F.col("part")).otherwise(F.col("part")))
    found = dealt.mapInArrow(_judge(verify, parts), _PLACES)
    return found.repartitionById(parts, F.col("part")).mapInArrow(_merge, _MARKS)


def _slices(batch: pa.RecordBatch, column: int = 0):
    """``(first, last, data, offsets, word starts, word ends, row offsets of words)`` of a text column."""
    for first, last, data, offsets in text_slices(batch.column(column)):
        starts, ends, words = find_words(data, offsets)
        yield first, last, data, offsets, starts, ends, words


def _columns(batch: pa.RecordBatch, first: int, last: int, *columns: int) -> list[np.ndarray]:
    return [batch.column(c).slice(first, last - first).to_numpy() for c in columns]


def _symbols(parts: int, window: int, rounds: str):
    """Packed names of the symbols that may decide a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(parts, verify=False)
        for batch in batches:
            for first, last, data, _, starts, ends, words in _slices(batch):
                ids, ties = _columns(batch, first, last, 1, 2)
                owner = np.repeat(np.arange(last - first), np.diff(words))
                name, own, begin, _, left, right = recompress(hash_words(data, starts, ends), owner, rounds)
                use = right - left <= window
                own = own[use]
                packer.add(ids, ties, own, name[use], np.zeros(len(own), np.uint32), begin[use] - words[own])
                if packer.entries >= GATHER:
                    yield from packer.flush()
        yield from packer.flush()

    return run


def _joined(texts: bytes, keep: np.ndarray | None = None) -> bytes:
    words = texts.split()
    return b" ".join(words if keep is None else compress(words, keep))


def _out(kept: bytes, digest: bool) -> str:
    return hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "replace")


def _candidates(window: int, rounds: str, digest: bool):
    """Results of documents without a window left to verify; of the others the text and the windows."""
    names = ["id", "tie", "n_words", "kept", "packed", "windows"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            # Texts come compressed; a few at a time are opened.
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                opened = pa.array([expand.decompress(t.as_py()) for t in part.column(0)], pa.large_binary())
                marks = part.column(3)
                for first, last, data, offsets in text_slices(opened):
                    starts, ends, words = find_words(data, offsets)
                    ids, ties = _columns(part, first, last, 1, 2)
                    owner = np.repeat(np.arange(last - first), np.diff(words))
                    _, own, place, _, left, right = recompress(hash_words(data, starts, ends), owner, rounds)
                    use = right - left <= window
                    own, place, left, right = own[use], place[use], left[use], right[use]
                    marked = np.zeros(len(data) + 1, bool)
                    for k in range(first, last):
                        if marks[k].is_valid:
                            marked[words[k - first] + _from(marks[k].as_py(), "<i4")] = True
                    bad = ~marked[place]
                    total = int(words[-1])
                    change = np.zeros(total + 2, np.int64)
                    low = np.maximum(right[bad] - window, words[own[bad]])
                    np.add.at(change, low, 1)
                    np.add.at(change, left[bad] + 1, -1)
                    sizes = np.diff(words)
                    inside = np.arange(total) < np.repeat(words[1:] - window + 1, sizes)
                    open_windows = inside & (np.cumsum(change)[:total] == 0)
                    rows = {n: [] for n in names}
                    for k in range(last - first):
                        content = data[offsets[k] : offsets[k + 1]].tobytes()
                        windows = np.flatnonzero(open_windows[words[k] : words[k + 1]])
                        rows["id"].append(ids[k])
                        rows["tie"].append(ties[k])
                        rows["n_words"].append(int(sizes[k]))
                        rows["kept"].append(None if len(windows) else _out(_joined(content), digest))
                        rows["packed"].append(squeeze.compress(content) if len(windows) else None)
                        rows["windows"].append(_ranges(windows) if len(windows) else None)
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], names=names
                    )

    return run


def _ranges(numbers: np.ndarray) -> bytes:
    """Sorted numbers as starts and lengths of their runs."""
    head = np.flatnonzero(np.concatenate([[True], np.diff(numbers) != 1]))
    length = np.diff(np.concatenate([head, [len(numbers)]]))
    return np.stack([numbers[head], length], 1).astype("<i4").tobytes()


def _numbers(packed: bytes) -> np.ndarray:
    start, length = np.frombuffer(packed, "<i4").reshape(-1, 2).astype(np.int64).T
    return np.repeat(start - np.cumsum(length) + length, length) + np.arange(int(length.sum()))


def _windows(parts: int, window: int):
    """Packed hashes of the windows to be verified."""
    second_seed = odd_numbers(1, 99)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(parts, verify=True)
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for k, row in enumerate(batch.column(0)):
                data = np.frombuffer(expand.decompress(row.as_py()), np.uint8)
                starts, ends, _ = find_words(data, np.array([0, len(data)]))
                hashes = hash_words(data, starts, ends)
                places = _numbers(batch.column(3)[k].as_py())
                first = window_hashes(hashes, window, seed=1)[places]
                second = (window_hashes(hashes ^ second_seed, window, seed=2) >> _U(32)).astype(np.uint32)[places]
                ids, ties = _columns(batch, k, k + 1, 1, 2)
                packer.add(ids, ties, np.zeros(len(places), np.int64), first, second, places)
                if packer.entries >= GATHER:
                    yield from packer.flush()
        yield from packer.flush()

    return run


def _removed(window: int, digest: bool):
    """Words left, of documents with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            gone, kept = [], []
            for text, count, marks in zip(batch.column(0), batch.column(3), batch.column(4), strict=True):
                words = count.as_py()
                change = np.zeros(words + window + 1, np.int64)
                if marks.is_valid:
                    places = _from(marks.as_py(), "<i4")
                    change[places] += 1
                    change[places + window] -= 1
                stays = np.cumsum(change)[:words] == 0
                gone.append(int(words - stays.sum()))
                kept.append(_out(_joined(expand.decompress(text.as_py()), stays.tolist()), digest))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(3), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                names=["id", "n_words", "n_removed", "kept"],
            )

    return run


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text column compressed: it travels twice."""
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for first in range(0, batch.num_rows, 512):
            part = batch.slice(first, 512)
            texts = pa.array([squeeze.compress((t.as_py() or "").encode()) for t in part.column(0)], pa.binary())
            yield pa.RecordBatch.from_arrays([texts, *part.columns[1:]], names=["packed", "id", "tie"])


def remove_repeats(
    documents: DataFrame, *, row_id: str = "doc_id", text: str = "text", window: int = WINDOW,
    rounds: str = ROUNDS, digest: bool = False,
) -> DataFrame:
    """``row_id``, ``n_words``, ``n_removed`` and ``kept``: the words left, joined by one space.

    With ``digest``, ``kept`` is the SHA-256 of that text in lower-case hex instead.
    """
    spark = documents.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(
        F.col(text).alias("text"),
        F.coalesce(F.col(row_id).cast("bigint"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(F.col(text)).alias("tie"),
    )
    shared = _gathered_marks(rows.mapInArrow(_symbols(parts, window, rounds), _PACKED), parts, verify=False)
    packed = rows.mapInArrow(_compressed, "packed binary, id bigint, tie bigint")
    judged = packed.join(shared, ["id", "tie"], "left").select("packed", "id", "tie", "marks")
    judged = cut(
        judged.mapInArrow(
            _candidates(window, rounds, digest),
            "id bigint, tie bigint, n_words bigint, kept string, packed binary, windows binary",
        )
    )
    left = judged.where(F.col("windows").isNotNull())
    found = left.select("packed", "id", "tie", "windows").mapInArrow(_windows(parts, window), _PACKED)
    repeats = _gathered_marks(found, parts, verify=True)
    ended = (
        left.join(repeats, ["id", "tie"], "left")
        .select("packed", "id", "tie", "n_words", "marks")
        .mapInArrow(_removed(window, digest), "id bigint, n_words bigint, n_removed bigint, kept string")
    )
    clean = judged.where(F.col("windows").isNull()).select("id", "n_words", F.lit(0).cast("bigint").alias("n_removed"), "kept")
    own_id = F.when(F.col("id") != NO_ID, F.col("id")).cast(documents.schema[row_id].dataType)
    return clean.unionByName(ended).select(own_id.alias(row_id), "n_words", "n_removed", "kept")
