"""Mixing sources to target weights, with DataFrame functions only.

A document's size is its number of words. Sources ordered by name share the
total of all sizes by their weights; no source is asked for more than
``max_epochs`` times what it has, and what it cannot give is shared again among
the others by weight. Every document gets a key that is as good as random. A
source is read in key order, whole as often as its target allows, and once more
up to the word at which its budget is exhausted.

The order within a source is worked out without a task per source: keys are
uniform, so equal key ranges of a source hold about equally many rows. Sizes are
summed per range, ranges are added up per source, and rows are placed within
their range only.

Defined results: a null text has size 0; a null source is a source of its own,
ordered last; rows with a null ID share one key and are ordered by size; equal
rows are told apart arbitrarily but get the same multiset of results; a source
without words has target 0; an empty table gives an empty result. Columns of the
input other than the named ones are ignored unless listed in ``carry``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import distributed_rank
from ..session import cut

WORD_BREAK = r"[\x20\x09-\x0D]+"
#: Rows of one source in one key range, about.
RANGE_ROWS = 1024
#: Hex digits of the digest that make the key: 60 bits.
KEY_DIGITS = 15


def word_array(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.coalesce(
        F.array_remove(F.split(text, WORD_BREAK), ""), F.array().cast("array<string>")
    )


def word_count(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def random_key(row_id: Column, seed: str) -> Column:
    """60 bits of a digest of the seed and the ID."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(row_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, KEY_DIGITS), 16, 10).cast("long")


def targets(sources: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """``(source, source_size, source_rows, target)`` from ``(source, source_size, source_rows)``.

    Sources are filled by weight; those that would exceed ``max_epochs`` times
    their size are fixed there, and the rest is shared again until none exceeds.
    Each round adds up three numbers; no source leaves the cluster.
    """
    named = sources.withColumn("_absent", F.col("source").isNull().cast("int"))
    ranked = distributed_rank(
        named.withColumn("_all", F.lit(0)), ["_all"], [F.col("_absent"), F.col("source")], "place"
    )
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")
    )
    table = cut(
        ranked.select(
            "source", "source_size", "source_rows", weight.cast("long").alias("_weight"),
            (F.col("source_size") * max_epochs).alias("_most"),
        )
    )
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    share, by = total, None
    wide = "decimal(38,0)"
    fixed = F.lit(False)
    seen = -1
    while True:
        row = table.agg(
            F.coalesce(F.sum(F.when(~fixed, F.col("_weight"))), F.lit(0)),
            F.coalesce(F.sum(F.when(fixed, F.col("_most"))), F.lit(0)),
            F.coalesce(F.sum(fixed.cast("long")), F.lit(0)),
        ).first()
        by, share = max(1, int(row[0])), int(total) - int(row[1])
        if row[2] == seen:
            break
        seen = row[2]
        fixed = F.col("_weight").cast(wide) * F.lit(share).cast("decimal(20,0)") > F.col("_most").cast(
            wide
        ) * F.lit(by).cast("decimal(15,0)")
    target = F.when(fixed, F.col("_most").cast("double")).otherwise(
        (F.col("_weight") * F.lit(share)).cast("double") / F.lit(by).cast("double")
    )
    return table.select("source", "source_size", "source_rows", target.alias("target"))


def mix(
    documents: DataFrame,
    *,
    row_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: Sequence[int] = (1, 2, 3),
    max_epochs: int = 3,
    seed: str = "mix",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Per row its size, its source's size and target, and the words the mix takes of it.

    Columns: ``row_id``, ``size``, ``source_size``, ``target``, ``taken`` and those of ``carry``.
    """
    rows = documents.select(
        F.col(row_id).alias("_id"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        random_key(F.col(row_id), seed).alias("_key"),
        *[F.col(c).alias(f"_carry_{c}") for c in carry],
    )
    rows = cut(rows)
    sources = cut(
        targets(
            rows.groupBy("source").agg(
                F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows")
            ),
            weights,
            max_epochs,
        )
    )
    # A source without a name must meet itself in the join.
    name = F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit("")).alias("_source")
    sources = sources.select(name, "source_size", "target", F.ceil(F.col("source_rows") / RANGE_ROWS).alias("_ranges"))
    placed = rows.withColumn("_source", name).join(sources, "_source")
    width = F.ceil(F.lit(float(16**KEY_DIGITS)) / F.col("_ranges")).cast("long")
    placed = placed.withColumn("_range", F.floor(F.col("_key") / width).cast("long"))
    ahead = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_source", "_range")
        .agg(F.sum("size").alias("_range_size"))
        .select("_source", "_range", F.coalesce(F.sum("_range_size").over(ahead), F.lit(0)).alias("_ahead"))
    )
    within = (
        Window.partitionBy("_source", "_range")
        .orderBy("_key", "_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = placed.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0))).join(
        offsets, ["_source", "_range"]
    )
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    placed = placed.withColumn("_epochs", epochs.cast("long"))
    rest = budget - F.col("_epochs") * F.col("source_size") - F.col("_ahead") - F.col("_within")
    taken = F.col("_epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.select(
        F.col("_id").alias(row_id), "size", "source_size", "target", taken.cast("long").alias("taken"),
        *[F.col(f"_carry_{c}").alias(c) for c in carry if c != row_id],
    )


#: The rows of :func:`mix` over ``documents`` in DuckDB. The rank list of sources sorted by what
#: they have against what they weigh replaces the rounds: the fixed ones are its beginning.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k
  FROM documents),
sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [1, 2, 3][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
         CAST(sum(w) OVER () AS BIGINT) AS w_all,
         CAST(coalesce(sum(3 * source_size) OVER o, 0) AS BIGINT) AS full_before,
         CAST(coalesce(sum(w) OVER o, 0) AS BIGINT) AS w_before
  FROM sums
  WINDOW o AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
judged AS (
  SELECT *, CAST(w AS HUGEINT) * (total - full_before) > CAST(3 * source_size AS HUGEINT) * (w_all - w_before) AS fixed
  FROM ordered),
rest AS (
  SELECT coalesce(sum(w) FILTER (NOT fixed), 1) AS by_w,
         max(total) - coalesce(sum(3 * source_size) FILTER (fixed), 0) AS share FROM judged),
goals AS (
  SELECT source, source_size,
         CASE WHEN fixed THEN CAST(3 * source_size AS DOUBLE)
              ELSE CAST(w * share AS DOUBLE) / CAST(by_w AS DOUBLE) END AS target
  FROM judged, rest),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY k, s.doc_id, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead,
         CASE WHEN g.source_size > 0 THEN CAST(floor(g.target) AS BIGINT) // g.source_size ELSE 0 END AS epochs
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - ahead)) AS BIGINT) AS taken
FROM placed
"""
