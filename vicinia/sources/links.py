"""Files of links, one per line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from .feeds import first_seen
from .landing import with_place


def numbered_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``path, line_no, value``: every line with its 1-based number in its file.

    Splits of a file are numbered apart and moved by the lines before them, so
    a file of any length is read in parallel. A missing path is an error.
    """
    paths = [path] if isinstance(path, str) else list(path)
    lines = with_place(spark.read.text(paths))
    before = (
        Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    )
    # One row per file split.
    offsets = (
        lines.groupBy("path", "split")
        .count()
        .select("path", "split", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    )
    within = Window.partitionBy("path", "split").orderBy("seq")
    return (
        lines.withColumn("place", F.row_number().over(within))
        .join(offsets, ["path", "split"])
        .select("path", (F.col("before") + F.col("place")).alias("line_no"), "value")
    )


def parse_lines(lines: DataFrame, domain: str = text.LINK_DOMAIN) -> DataFrame:
    """``path, line_no, value, paper_id`` without blank lines and ``#`` comments."""
    return (
        lines.withColumn("value", text.strip("value"))
        .where((F.col("value") != "") & ~F.col("value").startswith("#"))
        .withColumn("paper_id", text.link_paper_id("value", domain))
    )


def accepted(parsed: DataFrame) -> DataFrame:
    """``paper_id, ord``: distinct IDs with the place they were first seen at."""
    return first_seen(parsed.where(F.col("paper_id").isNotNull()), ["path", "line_no"])


def skipped(parsed: DataFrame) -> DataFrame:
    """``path, line_no, value`` of the lines that are no supported link."""
    return parsed.where(F.col("paper_id").isNull()).select("path", "line_no", "value")


def read_links(
    spark: SparkSession, path: str | Sequence[str], domain: str = text.LINK_DOMAIN
) -> tuple[DataFrame, DataFrame]:
    """``(accepted, skipped)`` of a links file."""
    parsed = parse_lines(numbered_lines(spark, path), domain)
    return accepted(parsed), skipped(parsed)
