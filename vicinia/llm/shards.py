"""Sharding through a lookup table of prime size that shards fill by turns.

Each shard has its own order of preference over the slots: a start and a step
from its name, which visit every slot, as the size is prime. Shards claim their
next free slot by turns until the table is full, so their slots differ in number
by one at most (in proportion with weights), and a shard that leaves gives up its
own slots while nearly all others stay. A row's slot is the first 48 bits of the MD5
digest of its key, so one look into the broadcast table places it. The table is as large as its parameter
says, whatever the data. Whole rows are then written, a folder for each shard, and read back from there: rows
meet those of their shard in tasks of bounded size, of which a large shard gets several.

A hot key would send all its rows to one shard; ``spread`` adds as many bits of
a second column (such as a row number) as asked for, so that a key's rows share
several slots.

Defined results: a null key is a key like any other; equal keys share a shard;
an empty table gives an empty result; columns named ``slot`` or ``shard`` in the
input are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLE_SIZE = 65537


def _numbers(name: str, size: int) -> tuple[int, int]:
    digest = hashlib.blake2b(name.encode(), digest_size=16).digest()
    start, step = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little")
    return start % size, step % (size - 1) + 1


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE, weights: Sequence[int] | None = None) -> np.ndarray:
    """The number of the shard at each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and differ")
    if not is_prime(size) or size < len(shards):
        raise ValueError("the table size must be a prime not below the number of shards")
    turns = list(weights or [1] * len(shards))
    if len(turns) != len(shards) or min(turns) < 1:
        raise ValueError("each shard needs a weight of 1 or more")
    table = np.full(size, -1, np.int64)
    places = [_numbers(name, size) for name in shards]
    next_one = [start for start, _ in places]
    left = size
    while left:
        for k, (_, step) in enumerate(places):
            for _ in range(min(turns[k], left)):
                slot = next_one[k]
                while table[slot] >= 0:
                    slot = (slot + step) % size
                table[slot], next_one[k] = k, (slot + step) % size
                left -= 1
    return table


def slot_of(keys: Sequence[Column], size: int = TABLE_SIZE, spread: tuple[Column, int] | None = None) -> Column:
    """The slot of a key; with ``spread``, of a key and one of so many parts."""
    parts = [k.cast("string") for k in keys]
    # Nulls would leave a hash unchanged: name them, so that (null, 'a') and ('a', null) differ.
    parts = [F.coalesce(F.concat(F.lit("+"), p), F.lit("-")) for p in parts]
    if spread:
        parts.append(F.pmod(F.xxhash64(spread[0]), F.lit(spread[1])).cast("string"))
    digest = F.md5(parts[0]) if len(parts) == 1 else F.md5(F.concat(*[F.md5(p) for p in parts]))
    return F.pmod(F.conv(F.left(digest, F.lit(12)), 16, 10).cast("bigint"), F.lit(size)).cast("int")


def place(
    df: DataFrame,
    keys: Sequence[str],
    shards: Sequence[str],
    *,
    size: int = TABLE_SIZE,
    weights: Sequence[int] | None = None,
    spread: tuple[str, int] | None = None,
) -> DataFrame:
    """``df`` with ``slot`` and ``shard``."""
    table = lookup_table(shards, size, weights)
    slots = df.sparkSession.createDataFrame(
        [(k, shards[owner]) for k, owner in enumerate(table.tolist())], "slot int, shard string"
    )
    extra = (F.col(spread[0]), spread[1]) if spread else None
    rows = df.drop("shard").withColumn("slot", slot_of([F.col(k) for k in keys], size, extra))
    return rows.join(F.broadcast(slots), "slot").select(*[c for c in rows.columns if c != "slot"], "slot", "shard")


def write(placed: DataFrame, path: str) -> None:
    """One folder per shard; a large shard is several files, each of one task of bounded size."""
    placed.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)


def read(spark: SparkSession, path: str, schema: T.StructType, shard: str | None = None) -> DataFrame:
    """What :func:`write` wrote with ``schema``, or one shard of it: no file of another is opened."""
    rows = spark.read.schema(schema).parquet(path)
    return rows if shard is None else rows.where(F.col("shard") == shard)
