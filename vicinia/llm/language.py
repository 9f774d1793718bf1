"""Language identification by averaged subword embeddings under a linear softmax.

Every run of two to four bytes of the letters of a text (other ASCII characters
count as one space, A-Z as a-z) is hashed into a table of embeddings; a text is
the mean of its runs' embeddings, and a linear softmax tells the language. Both
tables are learned together by stochastic gradient descent in NumPy on the driver
from a sample of labelled rows: ``sample_per_language`` rows expected per
language (``SAMPLE_ROWS`` in all, about, but one row of every language at least), each with at most ``sample_runs``
runs, taken evenly over the whole text. Every label that occurs is learned. A fifth of the sample is left out of the descent; it sets the temperature
that makes the highest probability an honest one, and the score below which a
prediction is rejected: the highest below which at least half of them are wrong.

A prediction reads the whole text. As the mean and the softmax are linear up to
the last step, both tables are multiplied into one logit per run and language
before they are broadcast, as long as there are no more languages than dimensions; else the embeddings are
averaged and multiplied once per text. So what is broadcast grows by ``DIMENSION`` numbers a language only.

Defined results: a null text or one without a letter is ``und`` with score 0 and
rejected; equal texts get equal predictions; an empty table gives an empty
result; a sample without labels gives a model that answers ``und`` for all, and rejects only what has no letter.
Only the named columns are read; columns of the same name as a result are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .arrays import text_slices

UNDETERMINED = "und"
ORDERS = (2, 3, 4)
BUCKETS = 1 << 15
#: Bytes of text worked on at once; its arrays take some 60 times as much.
SLICE = 1 << 19
DIMENSION = 16
SAMPLE_PER_LANGUAGE = 800
#: With many languages, fewer rows of each: so many in all, about.
SAMPLE_ROWS = 12_000
#: Labels whose sampling rates may be broadcast: a name and a number each.
BROADCAST_LABELS = 100_000
SAMPLE_RUNS = 600
EPOCHS, BATCH, RATE = 6, 16, 4.0
#: A small sample is gone through more often, up to this many texts in all.
LEAST_STEPS = 12_000
#: Among rejected predictions of the left-out sample, at least this share is wrong, of at least so many.
WRONG_SHARE, FEWEST_REJECTED = 0.5, 5

_FOLD = np.full(256, 32, np.uint8)
for _low, _high in ((65, 91), (97, 123)):
    _FOLD[_low:_high] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))


def run_buckets(data: np.ndarray) -> list[np.ndarray]:
    """For each length, the bucket of the run that starts at each byte; runs over the end are left out."""
    folded = _FOLD[data].astype(np.uint32)
    out = []
    partial = folded * _FACTORS[0]
    for order in range(2, max(ORDERS) + 1):
        partial = (partial[:-1] ^ (partial[:-1] >> np.uint32(15))) * _FACTORS[1] + folded[order - 1 :] * _FACTORS[2]
        if order in ORDERS:
            mixed = (partial ^ (partial >> np.uint32(13))) * _FACTORS[3]
            out.append((mixed >> np.uint32(17)).astype(np.int32) & (BUCKETS - 1))
    return out


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


@dataclass(frozen=True)
class Model:
    """Languages, logits per bucket and language, logits of the bias, temperature and rejection score.

    With ``weight``, ``logits`` are embeddings still to be multiplied by it.
    """

    languages: tuple[str, ...]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float
    weight: np.ndarray | None = None

    def raw(self, mean: np.ndarray) -> np.ndarray:
        """Logits of texts by the means of their runs."""
        return (mean if self.weight is None else mean @ self.weight) + self.bias


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def fit(runs: list[np.ndarray], labels: np.ndarray, languages: Sequence[str], seed: int = 7) -> Model:
    """Train on hashed runs of texts, calibrate on every fifth text."""
    n = len(languages)
    if not n or not len(runs):
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    held = np.arange(len(runs)) % 5 == 4 if len(runs) >= 50 else np.zeros(len(runs), bool)
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (BUCKETS, DIMENSION)).astype(np.float32)
    weight, bias = np.zeros((DIMENSION, n), np.float32), np.zeros(n, np.float32)
    train = np.flatnonzero(~held)
    epochs = max(EPOCHS, min(40 * EPOCHS, LEAST_STEPS // len(train)))
    steps, done = epochs * len(train), 0
    for _ in range(epochs):
        order = rng.permutation(train)
        for first in range(0, len(order), BATCH):
            rows = order[first : first + BATCH]
            sizes = np.array([len(runs[r]) for r in rows])
            ids = np.concatenate([runs[r] for r in rows])
            mean = np.add.reduceat(embed[ids], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
            wrong = _softmax(mean @ weight + bias)
            wrong[np.arange(len(rows)), labels[rows]] -= 1
            rate = RATE * (1 - done / steps)
            back = (wrong @ weight.T).astype(np.float32)
            weight -= (rate / len(rows)) * (mean.T @ wrong)
            bias -= (rate / len(rows)) * wrong.sum(axis=0)
            share = np.repeat(back * (np.float32(rate) / sizes[:, None]).astype(np.float32), sizes, axis=0)
            for d in range(DIMENSION):
                embed[:, d] -= np.bincount(ids, share[:, d], BUCKETS).astype(np.float32)
            done += len(rows)
    logits, after = ((embed @ weight).astype(np.float32), None) if n <= DIMENSION else (embed, weight)
    judged = np.flatnonzero(held) if held.any() else train
    untold = Model(tuple(languages), logits, bias.astype(np.float64), 1.0, 0.0, after)
    raw = untold.raw(np.stack([logits[runs[r]].mean(axis=0) for r in judged]))
    truth = labels[judged]
    temperatures = np.geomspace(0.1, 10, 41)
    losses = [-np.log(_softmax(raw / t)[np.arange(len(judged)), truth] + 1e-12).mean() for t in temperatures]
    temperature = float(temperatures[int(np.argmin(losses))])
    chance = _softmax(raw / temperature)
    scores = chance.max(axis=1)
    order = np.argsort(scores, kind="stable")
    wrong = np.cumsum(chance.argmax(axis=1)[order] != truth[order]) / np.arange(1, len(order) + 1)
    bad = np.flatnonzero((wrong >= WRONG_SHARE) & (np.arange(len(order)) + 1 >= FEWEST_REJECTED))
    reject_below = float(np.nextafter(scores[order[bad[-1]]], 1)) if len(bad) else 0.0
    return replace(untold, temperature=temperature, reject_below=reject_below)


def sample(df: DataFrame, text: str, label: str, row_id: str, per_language: int, most_runs: int):
    """``(runs, labels, languages)`` of about ``per_language`` rows of each label, chosen by a hash of the ID."""
    known = df.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    key = F.coalesce(F.col(row_id).cast("string"), F.lit(""))
    # Rows without an ID are told apart by their text.
    draw = F.when(F.col(row_id).isNull(), F.xxhash64(F.lit(""), text)).otherwise(F.xxhash64(key))
    known = known.select(
        F.col(text).alias("text"), F.col(label).cast("string").alias("label"), F.pmod(draw, F.lit(1 << 30)).alias("draw")
    )
    # One row per language.
    sizes = known.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("draw").alias("least")).collect()
    if not sizes:
        return [], np.zeros(0, np.int64), ()
    languages = tuple(sorted(r["label"] for r in sizes))
    per_language = min(per_language, SAMPLE_ROWS // len(languages))
    spark = df.sparkSession
    rates = spark.createDataFrame(
        [(r["label"], max(int(min(1.0, per_language / r["n"]) * (1 << 30)), r["least"] + 1)) for r in sizes],
        "label string, below bigint",
    )
    rates = F.broadcast(rates) if len(sizes) <= BROADCAST_LABELS else rates
    # Rows that are copies with their ID are drawn together: one stands for them.
    chosen = known.join(rates, "label").where("draw < below").groupBy("label", "draw").agg(F.min("text").alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column(0), SLICE):
                found = []
                for a, b in zip(offsets, offsets[1:], strict=False):
                    own = np.concatenate([[32], data[a:b], [32]]).astype(np.uint8)
                    runs = np.concatenate(run_buckets(own)) if len(own) >= max(ORDERS) else np.zeros(0, np.int32)
                    if len(runs) > most_runs:
                        runs = runs[np.linspace(0, len(runs) - 1, most_runs).astype(np.int64)]
                    found.append(runs.astype("<i4").tobytes())
                kept = [c.slice(first, last - first) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), *kept], names=["runs", "label", "draw"])

    ship(spark)
    # At most SAMPLE_ROWS rows (about), or one of each language, of most_runs numbers.
    got = chosen.select("text", "label", "draw").mapInArrow(features, "runs binary, label string, draw bigint").collect()
    place = {name: k for k, name in enumerate(languages)}
    got = sorted((r for r in got if len(r["runs"])), key=lambda r: (r["draw"], r["label"], bytes(r["runs"])))
    return (
        [np.frombuffer(bytes(r["runs"]), "<i4") for r in got],
        np.array([place[r["label"]] for r in got], np.int64),
        languages,
    )


def train(
    df: DataFrame, *, text: str = "text", label: str = "lang", row_id: str = "doc_id",
    sample_per_language: int = SAMPLE_PER_LANGUAGE, sample_runs: int = SAMPLE_RUNS,
) -> Model:
    """A model from the rows of ``df`` that have a text and a label."""
    return fit(*sample(df, text, label, row_id, sample_per_language, sample_runs))


def predict_slice(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(language number, score, has an ASCII letter)`` of each text of a slice."""
    rows, n = len(offsets) - 1, model.logits.shape[1]
    # A space before and after each text, so that runs see its ends and do not join texts.
    lengths = np.diff(offsets)
    place = np.arange(len(data)) + np.repeat(2 * np.arange(rows) + 1, lengths)
    padded = np.full(len(data) + 2 * rows, 32, np.uint8)
    padded[place] = data
    begin = offsets[:-1] + 2 * np.arange(rows)
    size = lengths + 2
    total = np.zeros((rows, n))
    count = np.zeros(rows)
    for order, buckets in zip(ORDERS, run_buckets(padded), strict=True):
        # Runs that leave their text belong to none: sums are differences of running sums.
        inside = np.maximum(size - order + 1, 0)
        count += inside
        for k in range(n):
            values = np.concatenate([[0.0], np.cumsum(model.logits[:, k][buckets], dtype=np.float64)])
            total[:, k] += values[np.minimum(begin + inside, len(buckets))] - values[np.minimum(begin, len(buckets))]
    mean = model.raw(total / np.maximum(count, 1)[:, None])
    chance = _softmax(mean / model.temperature)
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    return chance.argmax(axis=1), chance.max(axis=1), letters[offsets[1:]] > letters[offsets[:-1]]


def predict(
    df: DataFrame, model: Model, *, text: str = "text", lang: str = "lang_pred", score: str = "score",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Columns ``keep`` (all, if not given), the predicted language, its calibrated score and ``rejected``."""
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in (df.columns if keep is None else keep) if c not in (lang, score, "rejected")]
    # Columns travel by place: their names may be anything.
    schema = T.StructType(
        [T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(kept)]
        + [T.StructField("l", T.StringType()), T.StructField("s", T.DoubleType()), T.StructField("r", T.BooleanType())]
    )

    # The text travels once, whether it is kept or not.
    extra = text not in kept
    at = len(kept) if extra else kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNDETERMINED], object)
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column(at), SLICE):
                if model.languages:
                    best, scores, lettered = predict_slice(model, data, offsets)
                else:
                    best, scores, lettered = (np.zeros(last - first, t) for t in (int, float, bool))
                for k in np.flatnonzero(~lettered):
                    lettered[k] = has_letter(data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "ignore"))
                rejected = ~lettered
                if model.languages:
                    rejected |= scores < model.reject_below
                best = np.where(lettered, best, len(model.languages)) if model.languages else best
                scores = np.where(lettered, scores, 0.0)
                out = [c.slice(first, last - first) for c in batch.columns[: len(kept)]]
                out += [
                    pa.array(names[best].tolist(), pa.string()), pa.array(scores, pa.float64()),
                    pa.array(rejected, pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    rows = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(kept)], *[F.col(text).alias("t")][: int(extra)])
    return rows.mapInArrow(run, schema).toDF(*kept, lang, score, "rejected")


def held_out(row_id: Column) -> Column:
    """The fold that is never learned from: every fourth ID by its checksum."""
    return F.coalesce(F.pmod(F.crc32(row_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(
    documents: DataFrame, *, text: str = "text", label: str = "lang", row_id: str = "doc_id"
) -> DataFrame:
    """Train on the labelled rows outside the held-out fold and predict all rows.

    Columns: ``row_id``, ``held_out``, ``lang_pred``, ``score``, ``rejected``.
    """
    model = train(documents.where(~held_out(F.col(row_id))), text=text, label=label, row_id=row_id)
    rows = documents.select(F.col(row_id), F.col(text).alias("_text"), held_out(F.col(row_id)).alias("held_out"))
    return predict(rows, model, text="_text", keep=(row_id, "held_out"))
