"""Byte-level BPE encoding and decoding by replaying the merges over many words at once.

A text is cut by a pattern into pieces. The distinct pieces that a worker has not
met yet become one list of symbols with links to both neighbours, and an inverted
index leads from the rank of each adjacent pair to the positions where it stands.
Ranks are taken from a heap, lowest first; a rank merges all its positions
together, and only the two pairs that touch a merge are looked up again and
indexed. The ids of a piece are then reused wherever the piece occurs.

Merging all positions of a rank together could differ from merging the leftmost
lowest pair again and again only where a merge makes a pair of the same or a
lower rank. Such pieces are noted, and encoded one by one.

Vocabularies are rank files (base64 token and rank per line). They are read on
the driver and broadcast; their size is fixed. A worker keeps about
``KEPT_PIECES`` pieces (or ``KEPT_CHARACTERS``); beyond, it forgets all but the most
used half, which costs time but changes nothing.

Defined results: a null or empty text has no ids and decodes to nothing; texts of
any length are encoded whole; equal rows get equal results; an empty table gives
an empty result; an id outside the vocabulary raises ``ValueError`` in decoding.
Only the named columns are read.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .arrays import ranges, text_slices

KEPT_PIECES = 200_000
KEPT_CHARACTERS = 4_000_000
NO_RANK = np.int32(2**31 - 1)


@dataclass(frozen=True)
class Vocabulary:
    """Tokens by rank, and the ranks of all pairs of tokens whose join is a token."""

    blob: bytes
    offsets: np.ndarray
    byte_ids: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    pattern: str

    @property
    def size(self) -> int:
        return len(self.offsets) - 1


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Read a rank file. Ranks must run from 0 without a gap and cover all 256 bytes."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    tokens = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without a gap")
    size = len(tokens)
    pairs = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs[left * size + right] = rank
    keys = np.fromiter(pairs, np.int64, len(pairs))
    values = np.fromiter(pairs.values(), np.int32, len(pairs))
    order = np.argsort(keys)
    return Vocabulary(
        b"".join(tokens),
        np.cumsum([0, *map(len, tokens)]),
        np.array([ranks[bytes([b])] for b in range(256)], np.int32),
        keys[order],
        values[order],
        pattern,
    )


class Encoder:
    """Encodes texts; keeps the ids of pieces it has met."""

    def __init__(self, words: Vocabulary):
        import regex

        self.words = words
        self.find = regex.compile(words.pattern).findall
        self.letters = np.frombuffer(words.blob, np.uint8)
        self.whole = {
            words.blob[a:b]: k for k, (a, b) in enumerate(zip(words.offsets, words.offsets[1:], strict=False))
        }
        self.lengths = np.diff(words.offsets)
        self._forget()

    def _forget(self) -> None:
        self.index = _Index()
        self.ids = np.zeros(0, np.int32)
        self.begin = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)

    def _thin(self) -> None:
        """Keep the pieces used most, up to half of what may be kept."""
        order = np.argsort(-self.uses, kind="stable")[: KEPT_PIECES // 2]
        order = order[self.uses[order] > 1]
        old, pieces = self.index, list(self.index)
        counts = self.count[order]
        ids = self.ids[ranges(self.begin[order], counts)]
        uses = self.uses[order]
        self._forget()
        characters = 0
        for number, k in enumerate(order.tolist()):
            characters += len(pieces[k])
            if characters > KEPT_CHARACTERS // 2:
                break
            self.index[pieces[k]] = number
        old.clear()
        self.index.characters = min(characters, KEPT_CHARACTERS // 2)
        n = len(self.index)
        self.count, self.uses = counts[:n], uses[:n]
        self.begin = np.cumsum(self.count) - self.count
        self.ids = ids[: int(self.count.sum())].copy()

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and their offsets."""
        if len(self.index) > KEPT_PIECES or self.index.characters > KEPT_CHARACTERS:
            self._thin()
        known = len(self.begin)
        places, sizes = [], []
        number = self.index.__getitem__
        for text in texts:
            pieces = self.find(text)
            places.append(np.fromiter(map(number, pieces), np.int64, len(pieces)))
            sizes.append(len(pieces))
        if len(self.index) > known:
            self._learn(list(islice(self.index, known, None)))
        piece = np.concatenate(places) if places else np.zeros(0, np.int64)
        self.uses = np.bincount(piece, minlength=len(self.begin)) + np.pad(self.uses, (0, len(self.begin) - len(self.uses)))
        counts = self.count[piece]
        out = self.ids[ranges(self.begin[piece], counts)]
        ends = np.concatenate([[0], np.cumsum(counts)])
        offsets = ends[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)]
        return out, offsets

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a list of ids."""
        if len(ids) and (int(ids.max()) >= self.words.size or int(ids.min()) < 0):
            raise ValueError("an id is not in the vocabulary")
        return self.letters[ranges(self.words.offsets[ids], self.lengths[ids])]

    def _learn(self, pieces: list[str]) -> None:
        encoded = [p.encode() for p in pieces]
        ids, offsets = self.replay(encoded)
        base = len(self.ids)
        self.ids = np.concatenate([self.ids, ids])
        self.begin = np.concatenate([self.begin, offsets[:-1] + base])
        self.count = np.concatenate([self.count, np.diff(offsets)])

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.words.size + right
        at = np.searchsorted(self.words.pair_keys, keys)
        at[at == len(self.words.pair_keys)] = 0
        return np.where(self.words.pair_keys[at] == keys, self.words.pair_ranks[at], NO_RANK)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct byte strings by merges in rank order over all of them."""
        alone = [self.whole.get(w, -1) for w in words]
        lengths = np.array([1 if a >= 0 else len(w) for w, a in zip(words, alone, strict=True)], np.int64)
        letters = b"".join(b"\0" if a >= 0 else w for w, a in zip(words, alone, strict=True))
        symbol = self.words.byte_ids[np.frombuffer(letters, np.uint8)]
        n = len(symbol)
        begin = np.cumsum(lengths) - lengths
        word_of = np.repeat(np.arange(len(words)), lengths)
        whole = np.array(alone, np.int64)
        symbol[begin[whole >= 0]] = whole[whole >= 0]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[begin + lengths - 1], before[begin] = -1, -1
        alive = np.ones(n, bool)
        rank = np.full(n, NO_RANK, np.int32)
        inner = np.flatnonzero(after >= 0)
        rank[inner] = self._pair_ranks(symbol[inner], symbol[inner + 1])

        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(positions: np.ndarray) -> None:
            found = rank[positions]
            order = np.argsort(found, kind="stable")
            found, positions = found[order], positions[order]
            edges = np.flatnonzero(found[1:] != found[:-1]) + 1
            for part in np.split(positions, edges):
                key = int(rank[part[0]]) if len(part) else NO_RANK
                if key != NO_RANK:
                    if key not in index:
                        index[key] = []
                        heapq.heappush(heap, key)
                    index[key].append(part)

        enter(inner)
        redo: list[np.ndarray] = []
        while heap:
            lowest = heapq.heappop(heap)
            lists = index.pop(lowest)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            at = at[alive[at] & (rank[at] == lowest)]
            if not len(at):
                continue
            if len(at) > 1:
                at = np.unique(at)
                # Of overlapping pairs such as in "aaa", every second one merges, from the left.
                chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
                if chained.any():
                    head = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                    at = at[(np.arange(len(at)) - head) % 2 == 0]
            gone = after[at]
            symbol[at] = lowest
            alive[gone] = False
            rank[gone] = NO_RANK
            follow = after[gone]
            after[at] = follow
            before[follow[follow >= 0]] = at[follow >= 0]
            left = before[at]
            touched = np.concatenate([at, left[left >= 0]])
            if len(touched) > 1:
                touched = np.unique(touched)
            touched = touched[alive[touched]]
            has_next = after[touched] >= 0
            rank[touched[~has_next]] = NO_RANK
            touched = touched[has_next]
            if len(touched):
                rank[touched] = self._pair_ranks(symbol[touched], symbol[after[touched]])
                early = touched[rank[touched] <= lowest]
                if len(early):
                    redo.append(word_of[early])
                enter(touched)
        ids, owner = symbol[alive], word_of[alive]
        if redo:
            again = np.unique(np.concatenate(redo))
            fixed = {int(k): self.one(words[k]) for k in again}
            keep = ~np.isin(owner, again)
            ids = np.concatenate([ids[keep], *[np.array(v, np.int32) for v in fixed.values()]])
            owner = np.concatenate([owner[keep], *[np.full(len(v), k) for k, v in fixed.items()]])
            order = np.argsort(owner, kind="stable")
            ids, owner = ids[order], owner[order]
        return ids.astype(np.int32), np.searchsorted(owner, np.arange(len(words) + 1))

    def one(self, word: bytes) -> list[int]:
        """One piece: merge the lowest pair, the leftmost of equals, until none is left."""
        if word in self.whole:
            return [self.whole[word]]
        symbol = [int(x) for x in self.words.byte_ids[np.frombuffer(word, np.uint8)]]
        after = [*range(1, len(symbol)), -1]
        before = list(range(-1, len(symbol) - 1))
        keys, ranks, size = self.words.pair_keys, self.words.pair_ranks, self.words.size

        def pair(i: int) -> int:
            key = symbol[i] * size + symbol[after[i]]
            at = int(np.searchsorted(keys, key))
            return int(ranks[at]) if at < len(keys) and keys[at] == key else int(NO_RANK)

        heap = [(r, i) for i in range(len(symbol) - 1) if (r := pair(i)) != NO_RANK]
        heapq.heapify(heap)
        dead = [False] * len(symbol)
        while heap:
            rank, i = heapq.heappop(heap)
            if dead[i] or after[i] < 0 or pair(i) != rank:
                continue
            j = after[i]
            symbol[i], dead[j], after[i] = rank, True, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (i, before[i]):
                if k >= 0 and after[k] >= 0 and (r := pair(k)) != NO_RANK:
                    heapq.heappush(heap, (r, k))
        return [s for s, d in zip(symbol, dead, strict=True) if not d]


class _Index(dict):
    """Numbers pieces in the order in which they are first asked for."""

    characters = 0

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.characters += len(piece)
        return number


_ENCODERS: dict[str, Encoder] = {}


def _encoder(shared, name: str) -> Encoder:
    """One encoder for each worker and vocabulary."""
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(shared.value)
    return _ENCODERS[name]


def _strings(column: pa.Array, first: int, last: int) -> list[str]:
    return [t or "" for t in column.slice(first, last - first).to_pylist()]


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))],
    ).cast(pa.binary())


def _prepare(df: DataFrame, words: Vocabulary):
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(words)
    return shared, f"{df.sparkSession.sparkContext.applicationId}-{shared._jbroadcast.id()}"


def _coded(column: pa.Array, encoder: Encoder, decoded: bool) -> Iterator[tuple[int, int, list[pa.Array]]]:
    for first, last, _, _ in text_slices(column):
        ids, offsets = encoder.encode(_strings(column, first, last))
        arrays = [
            pa.array(np.diff(offsets), pa.int64()),
            _binary(ids.astype("<u4").view(np.uint8), offsets * 4),
        ]
        if decoded:
            parts = [encoder.decode(ids[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]
            ends = np.cumsum([0, *map(len, parts)])
            arrays.append(_binary(np.concatenate(parts) if parts else np.zeros(0, np.uint8), ends))
        yield first, last, arrays


def encode(
    df: DataFrame, words: Vocabulary, *, text: str = "text", keep: Sequence[str] = ("doc_id",), round_trip: bool = False
) -> DataFrame:
    """Columns ``keep``, ``n_tokens`` and ``ids``: little-endian unsigned 32-bit integers.

    With ``round_trip`` also ``decoded``, the bytes that the ids decode to.
    """
    shared, name = _prepare(df, words)
    fields = [T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(keep)]
    fields += [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    if round_trip:
        fields.append(T.StructField("decoded", T.BinaryType()))

    # The text travels once, whether it is kept or not.
    extra = text not in keep
    at = len(keep) if extra else list(keep).index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, name)
        for batch in batches:
            others = batch.columns[: len(keep)]
            for first, last, arrays in _coded(batch.column(at), encoder, round_trip):
                kept = [c.slice(first, last - first) for c in others]
                yield pa.RecordBatch.from_arrays([*kept, *arrays], names=[f.name for f in fields])

    rows = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], *[F.col(text).alias("t")][: int(extra)])
    coded = rows.mapInArrow(run, T.StructType(fields))
    return coded.toDF(*keep, *[f.name for f in fields[len(keep) :]])


def decode(df: DataFrame, words: Vocabulary, *, ids: str = "ids", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``decoded``, the bytes of ``ids`` as :func:`encode` gives them; null decodes to nothing."""
    shared, name = _prepare(df, words)
    fields = [T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(keep)]
    fields.append(T.StructField("decoded", T.BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, name)
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column(0)):
                parts = [
                    encoder.decode(np.frombuffer(data[a:b].tobytes(), "<u4").astype(np.int64))
                    for a, b in zip(offsets, offsets[1:], strict=False)
                ]
                ends = np.cumsum([0, *map(len, parts)])
                kept = [c.slice(first, last - first) for c in batch.columns[1:]]
                out = _binary(np.concatenate(parts) if parts else np.zeros(0, np.uint8), ends)
                yield pa.RecordBatch.from_arrays([*kept, out], names=[f.name for f in fields])

    rows = df.select(F.col(ids).alias("t"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    return rows.mapInArrow(run, T.StructType(fields)).toDF(*keep, "decoded")
