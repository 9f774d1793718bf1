"""Ordered work on groups of any size: frames, running totals, as-of joins and sessions.

A window over a group runs in one task. Here rows are range-partitioned by group and order instead, every range is
worked on by itself, and what a range needs of those before it travels as a small table of its *borders*: only groups that
run over the end of a range have rows there, so it holds a few rows per range, whatever the data. A group that holds
half of all rows is spread over half of the ranges.

``order`` must tell all rows of a group apart, or results follow the order in which ties were written. Null groups
are groups like any other; null order values come first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

_GROUP, _RANGE, _HALO = "_group", "_range", "_halo"


def in_ranges(df: DataFrame, groups: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` range-partitioned, with the number of the range and one column for the group, as a written table.

    Written, because the range of a row must not change between its uses.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in [*groups, *order]])
    return cut(ranged.withColumn(_RANGE, F.spark_partition_id()).withColumn(_GROUP, F.struct(*groups)))


def _spans(ranged: DataFrame) -> DataFrame:
    """``(group, range, turn)`` of groups that lie in several ranges; a range has at most two of them."""
    found = ranged.select(_GROUP, _RANGE).distinct()
    own = Window.partitionBy(_GROUP)
    turn = F.row_number().over(own.orderBy(_RANGE))
    return found.withColumns({"turn": turn, "ranges": F.count(F.lit(1)).over(own)}).where("ranges > 1").drop("ranges")


def _in_range(order: Sequence[str]):
    return Window.partitionBy(_RANGE, _GROUP).orderBy(*order)


def _halo(ranged: DataFrame, order: Sequence[str], rows: int) -> DataFrame:
    """The last ``rows`` rows of each group before each range it runs on into, under the number of that range."""
    spans = cut(_spans(ranged))
    back = Window.partitionBy(_RANGE, _GROUP).orderBy(*[F.desc(c) for c in order])
    ends = ranged.join(F.broadcast(spans), [_GROUP, _RANGE])
    ends = ends.withColumn("back", F.row_number().over(back)).where(F.col("back") <= rows)
    # A range a group runs into holds a row of it at least, so no row is wanted farther on than that.
    sent = ends.withColumn("turn", F.explode(F.sequence(F.col("turn") + 1, F.col("turn") + rows))).drop(_RANGE, "back")
    met = sent.join(F.broadcast(spans), [_GROUP, "turn"])
    last = F.row_number().over(Window.partitionBy(_GROUP, _RANGE).orderBy(*[F.desc(c) for c in order]))
    return met.withColumn("back", last).where(F.col("back") <= rows).drop("back", "turn")


def framed(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], preceding: int, columns: Mapping[str, Column]
) -> DataFrame:
    """``df`` with aggregates over each row and the ``preceding`` rows before it in its group.

    ``columns`` are aggregates without a window, such as ``F.avg("value")``.
    """
    ranged = in_ranges(df, groups, order)
    rows = ranged.withColumn(_HALO, F.lit(False)).unionByName(
        _halo(ranged, order, preceding).select(*ranged.columns, F.lit(True).alias(_HALO))
    )
    frame = _in_range(order).rowsBetween(-preceding, 0)
    rows = rows.withColumns({name: value.over(frame) for name, value in columns.items()})
    return rows.where(~F.col(_HALO)).select(*df.columns, *columns)


def with_previous(df: DataFrame, groups: Sequence[str], order: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """``df`` with values of the row before in its group: ``columns`` maps new names to old ones."""
    ranged = in_ranges(df, groups, order)
    rows = ranged.withColumn(_HALO, F.lit(False)).unionByName(
        _halo(ranged, order, 1).select(*ranged.columns, F.lit(True).alias(_HALO))
    )
    rows = rows.withColumns({new: F.lag(old).over(_in_range(order)) for new, old in columns.items()})
    return rows.where(~F.col(_HALO)).select(*df.columns, *columns)


def running_total(df: DataFrame, groups: Sequence[str], order: Sequence[str], columns: Mapping[str, Column]) -> DataFrame:
    """``df`` with sums of values over each row and all rows before it in its group."""
    ranged = in_ranges(df, groups, order)
    earlier = Window.partitionBy(_GROUP).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(_GROUP, _RANGE).agg(*[F.sum(v).alias(f"_of_{n}") for n, v in columns.items()])
    before = parts.join(F.broadcast(cut(_spans(ranged))), [_GROUP, _RANGE]).select(
        _GROUP, _RANGE, *[F.sum(f"_of_{n}").over(earlier).alias(f"_of_{n}") for n in columns]
    )
    frame = _in_range(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.withColumns({name: F.sum(value).over(frame) for name, value in columns.items()})
    rows = rows.join(F.broadcast(before), [_GROUP, _RANGE], "left")
    return rows.select(
        *df.columns,
        *[(F.col(n) + F.coalesce(F.col(f"_of_{n}"), F.lit(0))).alias(n) for n in columns],
    )


def asof_join(
    left: DataFrame,
    right: DataFrame,
    groups: Sequence[str],
    time: str,
    values: Sequence[str],
    *,
    left_id: str,
    right_id: str,
    prefix: str = "last_",
) -> DataFrame:
    """Every row of ``left`` with ``values`` of the last row of ``right`` in its group that is not later.

    Of rows of ``right`` at one time the one with the largest ``right_id`` counts. Rows without one keep nulls. One
    range partitioning of both sides; the last values pass over the ends of ranges by a table of the borders.
    """
    wanted = F.struct(*[F.col(v).alias(v) for v in values])
    empty = F.lit(None).cast(right.select(wanted.alias("v")).schema["v"].dataType)
    names = [*groups, time]
    mine = left.select(
        *names, F.lit(1).alias("_side"), F.col(left_id).alias("_id"), F.struct(*left.columns).alias("_row"), empty.alias("_value")
    )
    other = F.lit(None).cast(mine.schema["_row"].dataType)
    theirs = right.select(
        *names, F.lit(0).alias("_side"), F.col(right_id).alias("_id"), other.alias("_row"), wanted.alias("_value")
    )
    order = [time, "_side", "_id"]
    ranged = in_ranges(theirs.unionByName(mine), groups, order)
    ends = ranged.where("_side = 0").groupBy(_GROUP, _RANGE).agg(
        F.max_by("_value", F.struct(*order)).alias("_end")
    )
    earlier = Window.partitionBy(_GROUP).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    spans = cut(_spans(ranged))
    before = spans.join(ends, [_GROUP, _RANGE], "left").select(
        _GROUP, _RANGE, F.last("_end", ignorenulls=True).over(earlier).alias("_before")
    )
    last = F.last("_value", ignorenulls=True).over(_in_range(order).rowsBetween(Window.unboundedPreceding, 0))
    rows = ranged.withColumn("_last", last).where("_side = 1").join(F.broadcast(before), [_GROUP, _RANGE], "left")
    found = F.coalesce("_last", "_before")
    return rows.select(
        *[F.col(f"_row.{c}").alias(c) for c in left.columns], *[found.getField(v).alias(f"{prefix}{v}") for v in values]
    )


def sessions(
    events: DataFrame, groups: Sequence[str], time: str, row_id: str, gap: str, measures: Mapping[str, Column]
) -> DataFrame:
    """``groups``, ``session`` (numbered from 1), ``start``, ``end``, ``n`` and ``measures`` of each session.

    A session ends where the next event is ``gap`` (an interval) or more away. Sessions that run over the end of a range
    are one: they are numbered over all ranges and combined before the last shuffle.
    """
    order = [time, row_id]
    rows = with_previous(events, groups, order, {"_previous": time})
    fresh = F.col("_previous").isNull() | (F.col(time) >= F.col("_previous") + F.expr(f"INTERVAL {gap}"))
    rows = running_total(rows.withColumn("_fresh", fresh.cast("int")), groups, order, {"session": F.col("_fresh")})
    return rows.groupBy(*groups, "session").agg(
        F.min(time).alias("start"), F.max(time).alias("end"), F.count(F.lit(1)).alias("n"),
        *[value.alias(name) for name, value in measures.items()],
    )
