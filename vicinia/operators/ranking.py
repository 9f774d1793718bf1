"""Row numbers over groups that may hold most of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def distributed_rank(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], rank: str = "rank"
) -> DataFrame:
    """1..n within each of ``groups`` by ``order``, without one task per group.

    Rows are range-partitioned by group and order; each range is numbered on its
    own and moved by the number of rows in the ranges before it. ``order`` must
    tell all rows of a group apart.
    """
    ranged = df.repartitionByRange(*[F.col(g) for g in groups], *order).withColumn(
        "_range", F.spark_partition_id()
    )
    # The range of a row must not change between the two uses below.
    ranged = cut(ranged)
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*groups, "_range")
        .count()
        .select(
            *[F.col(g).alias(f"_of_{g}") for g in groups],
            F.col("_range").alias("_of_range"),
            F.sum("count").over(before).alias("_before"),
        )
        .where(F.col("_before") > 0)
    )
    # NULL is a group like any other.
    same = F.col("_range") == F.col("_of_range")
    for group in groups:
        same &= F.col(group).eqNullSafe(F.col(f"_of_{group}"))
    within = Window.partitionBy("_range", *groups).orderBy(*order)
    # At most one group runs on into a range, so there are no more offsets than ranges.
    return (
        ranged.withColumn("_place", F.row_number().over(within))
        .join(F.broadcast(offsets), same, "left")
        .withColumn(rank, F.coalesce("_before", F.lit(0)) + F.col("_place"))
        .drop("_before", "_place", "_range", "_of_range", *[f"_of_{g}" for g in groups])
    )
