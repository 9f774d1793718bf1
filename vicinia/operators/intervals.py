"""Interval and band joins: points within intervals, for keys and stretches of any weight.

Intervals are dealt to levels by their length: a level's bins are as wide as its longest intervals, and four times as wide as those of
the level below, so an interval lies in one bin or two. A point lies in one bin of each level that occurs, and meets
each interval once at most. Bins with more than ``block_rows`` rows of a side are split into blocks on that side, and the other
side goes to each of them, so no task holds more than two blocks at a time, whatever a key or a moment holds.

What is compared per pair found depends on how evenly points lie within a bin: an interval covers a quarter of its bin's
width at least, or a quarter of what it spans of two.

Rows whose key, point or bound is null or NaN, and intervals that end before they start, match nothing, as in SQL. Bounds
belong to their interval. Repeated rows are rows of their own. Infinite bounds are allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

#: Rows of a side in one block: a pair of blocks takes so many comparisons squared at most.
BLOCK_ROWS = 4096
#: Least and largest exponent of a bin's width; intervals beyond the largest share one bin per key.
_LEAST, _WIDEST = -40, 200


def _number(df: DataFrame, column: str) -> Column:
    """A column as a double that keeps its order."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    return F.col(column).cast("double")


def _bin(value: Column, level: Column) -> Column:
    # Division by a power of two keeps the order, so a point's bin lies between those of the bounds around it.
    return F.when(level > _WIDEST, F.lit(0).cast("bigint")).otherwise(F.floor(value / F.pow(F.lit(2.0), level)))


def _known(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for column in columns:
        known = F.col(column).isNotNull()
        if isinstance(df.schema[column].dataType, T.DoubleType | T.FloatType):
            known &= ~F.isnan(column)
        df = df.where(known)
    return df


def _rows(df: DataFrame, keys: Sequence[str], name: str, numbers: dict[str, Column]) -> DataFrame:
    """Rows as one column under numbered keys, so that no names clash, with a number that is the same in each run of a task."""
    own = df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.struct(*df.columns).alias(name),
                    *[v.alias(n) for n, v in numbers.items()])
    # Read from files, a row's number does not change when its task runs again.
    return cut(own).withColumn("_salt", F.monotonically_increasing_id())


def interval_join(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, end: str, *, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """All pairs of one key with ``start <= at <= end``, as two columns of structs, ``point`` and ``interval``."""
    points = _known(points, [*keys, at])
    intervals = _known(intervals, [*keys, start, end]).where(F.col(start) <= F.col(end))
    mine = _rows(points, keys, "point", {"_at": _number(points, at)})
    theirs = _rows(intervals, keys, "interval", {"_from": _number(intervals, start), "_to": _number(intervals, end)})
    length = F.col("_to") - F.col("_from")
    exponent = (2 * F.ceil(F.log2(length) / 2)).cast("int")
    level = F.when(length == 0, _LEAST).when(F.isnan(length) | (length > 2.0**_WIDEST), _WIDEST + 2)
    theirs = theirs.withColumn("_level", level.otherwise(F.greatest(F.lit(_LEAST), exponent)))
    # One small number per level: some 120 at most.
    levels = sorted(r["_level"] for r in theirs.select("_level").distinct().collect())
    spot = [*[f"_k{i}" for i in range(len(keys))], "_level", "_bin"]
    mine = mine.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")))
    mine = mine.withColumn("_bin", _bin(F.col("_at"), F.col("_level")))
    bins = F.sequence(_bin(F.col("_from"), F.col("_level")), _bin(F.col("_to"), F.col("_level")))
    theirs = theirs.withColumn("_bin", F.explode(bins))

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        sizes = rows.groupBy(*spot).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(name))
        return sizes.where(F.col(name) > 1)

    # A row for every block_rows rows of a side at most.
    hot = cut(blocks(mine, "_p").join(blocks(theirs, "_q"), spot, "full"))

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        rows = rows.join(hot, spot, "left")
        parts, copies = F.coalesce(own, F.lit(1)), F.coalesce(other, F.lit(1))
        block, copy = f"{own}_block", f"{other}_block"
        rows = rows.withColumn(block, F.pmod("_salt", parts).cast("int"))
        return rows.withColumn(copy, F.explode(F.sequence(F.lit(0), copies - 1))).drop("_p", "_q", "_salt")

    met = dealt(mine, "_p", "_q").join(dealt(theirs, "_q", "_p"), [*spot, "_p_block", "_q_block"])
    inside = (F.col(f"point.`{at}`") >= F.col(f"interval.`{start}`")) & (F.col(f"point.`{at}`") <= F.col(f"interval.`{end}`"))
    return met.where(inside).select("point", "interval")


def band_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, width: float, *, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """All pairs of one key whose numbers differ by ``width`` at most, as structs ``left`` and ``right``.

    ``right``'s number less and plus ``width``, in its own type, are the bounds.
    """
    around = right.select(
        *[F.col(k) for k in keys], (F.col(value) - width).alias("_low"), (F.col(value) + width).alias("_high"),
        F.struct(*right.columns).alias("_right"),
    )
    met = interval_join(left, around, keys, value, "_low", "_high", block_rows=block_rows)
    return met.select(F.col("point").alias("left"), F.col("interval._right").alias("right"))
