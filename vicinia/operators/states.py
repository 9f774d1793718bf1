"""Mergeable states of mean vectors: a count and a sum for each group.

States of one level are rows, few beside the vectors behind them. Coarser levels come from finer states and never from
the vectors again, and a change of the vectors is a state of its own: what came adds to the stored one, what went is
subtracted. Counts and sums combine before every shuffle, so a group that holds half of all rows costs a row per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..session import cut

LEVEL = "level"


def _sum(vector: str):
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    return vector_to_array(Summarizer.sum(array_to_vector(F.col(vector))))


def _grouped(rows: DataFrame, keys: Sequence[str]):
    """Groups of rows; without keys one, which is not there without rows."""
    return rows.groupBy(*keys) if keys else rows.groupBy(F.lit(0).alias("_all"))


def states(rows: DataFrame, keys: Sequence[str], dim: int, vector: str = "embedding") -> DataFrame:
    """``keys, n, total`` of the valid vectors of one size. Null keys are groups of their own."""
    usable = rows.select(*keys, vectors.as_doubles(vector).alias("v")).where(vectors.is_valid("v", dim))
    return _grouped(usable, keys).agg(F.count(F.lit(1)).alias("n"), _sum("v").alias("total")).select(*keys, "n", "total")


def merged(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States by ``keys``, some of those that ``parts`` has."""
    return _grouped(parts, keys).agg(F.sum("n").alias("n"), _sum("total").alias("total")).select(*keys, "n", "total")


def negated(parts: DataFrame) -> DataFrame:
    """States that take away what ``parts`` count."""
    return parts.withColumns({"n": -F.col("n"), "total": F.transform("total", lambda x: -x)})


def changed(stored: DataFrame, came: DataFrame, went: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored states after some rows came and others went; groups that lost all rows are gone."""
    both = stored.unionByName(came).unionByName(negated(went))
    return merged(both, keys).where("n > 0")


def means(parts: DataFrame) -> DataFrame:
    """States with ``mean`` instead of ``total``."""
    n = F.col("n")
    return parts.withColumn("mean", F.transform("total", lambda x: x / n)).drop("total")


def grouping_sets(
    rows: DataFrame, keys: Sequence[str], sets: Sequence[Sequence[str]], dim: int, vector: str = "embedding"
) -> DataFrame:
    """States of several sets of keys at once: ``keys`` (null where left out), ``level, n, total``.

    ``level`` has a bit for each key, the first key's the highest, set where the key is left out. The vectors
    are read once, for the states by all keys; each set merges the smallest set before it that holds its keys.
    """
    done = {tuple(keys): cut(states(rows, keys, dim, vector))}
    out = None
    for wanted in sorted((tuple(k for k in keys if k in s) for s in sets), key=len, reverse=True):
        finer = min((s for s in done if set(wanted) <= set(s)), key=len)
        if wanted not in done:
            done[wanted] = cut(merged(done[finer], wanted))
        kinds = {f.name: f.dataType for f in rows.schema.fields}
        level = sum(1 << (len(keys) - 1 - k) for k, key in enumerate(keys) if key not in wanted)
        named = done[wanted].select(
            *[F.col(k) if k in wanted else F.lit(None).cast(kinds[k]).alias(k) for k in keys],
            F.lit(level).alias(LEVEL), "n", "total",
        )
        out = named if out is None else out.unionByName(named)
    return out


def cube(rows: DataFrame, keys: Sequence[str], dim: int, vector: str = "embedding") -> DataFrame:
    """:func:`grouping_sets` of all subsets of ``keys``."""
    sets = [s for size in range(len(keys) + 1) for s in combinations(keys, size)]
    return grouping_sets(rows, keys, sets, dim, vector)


def rollup(rows: DataFrame, keys: Sequence[str], dim: int, vector: str = "embedding") -> DataFrame:
    """:func:`grouping_sets` of all prefixes of ``keys``."""
    return grouping_sets(rows, keys, [keys[:size] for size in range(len(keys) + 1)], dim, vector)
