"""Paths and inherited exclusion over a tree of collections.

``collections(key, name, parent_key, ord)``. Ancestors are resolved by pointer
doubling: each step joins every open node to its current ancestor and so
doubles the distance covered. A tree of depth d takes log2(d) joins, and walks
that run into cycles end after log2(n).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import cut, cut_counting

# Doublings per written round: two joins cover four levels.
STEPS = 2
# Paths are built on the way for up to 2**6 levels; only then are cycles sought.
HOPEFUL_STEPS = 6

Merge = dict[str, Callable[[Column, Column], Column]]


def _step(nodes: DataFrame, merge: Merge, stop: str | None) -> DataFrame:
    carried = list(merge)
    above = nodes.select(
        F.col("key").alias("up"),
        F.col("up").alias("up_up"),
        *[F.col(c).alias(f"up_{c}") for c in carried],
    )
    next_up = F.col("up_up")
    if stop is not None:
        next_up = F.when(~F.col(f"up_{stop}"), next_up)
    moved = nodes.where(F.col("up").isNotNull()).join(above, "up").select(
        "key",
        next_up.alias("up"),
        *[merge[c](F.col(c), F.col(f"up_{c}")).alias(c) for c in carried],
    )
    return nodes.where(F.col("up").isNull()).unionByName(moved)


def _climb(
    nodes: DataFrame, merge: Merge, max_steps: int | None = None, stop: str | None = None
) -> tuple[DataFrame, int]:
    """Follow ``up`` to its end, but at most ``2**max_steps`` levels where given.

    ``merge[column](own, above)`` joins a node's column to that of its ancestor.
    A node whose boolean ``stop`` column turns true climbs no further. Returns
    the nodes and how many of them still have somewhere to go.
    """
    nodes = nodes.select("key", "up", *merge)
    done, still_open = 0, 1
    while still_open and (max_steps is None or done < max_steps):
        for _ in range(STEPS):
            nodes = _step(nodes, merge, stop)
            done += 1
        nodes, seen = cut_counting(nodes, open=F.count_if(F.col("up").isNotNull()))
        still_open = seen["open"]
    return nodes, still_open


def _linked(collections: DataFrame) -> DataFrame:
    """One row per key (the last one counts) with ``up``: its parent, if that exists."""
    latest = Window.partitionBy("key").orderBy(F.desc("ord"))
    rows = (
        collections.withColumn("place", F.row_number().over(latest))
        .where(F.col("place") == 1)
        .select("key", "name", "parent_key", "ord")
    )
    known = rows.select(F.col("key").alias("parent_key"), F.lit(True).alias("known"))
    return rows.join(known, "parent_key", "left").select(
        "key", "name", "ord", F.when(F.col("known"), text.not_empty("parent_key")).alias("up")
    )


def _cut_cycles(linked: DataFrame, count: int) -> DataFrame:
    """Open each cycle at its entry: the cycle node first met from the lowest-``ord``
    node leading into the cycle. The link cut is the one that closes on the entry."""
    nodes = linked.select("key", "up", "ord")
    # A walk of at least n levels ends on a cycle, and has seen all of it.
    walked, still_open = _climb(
        nodes.withColumn("least", F.col("ord")), {"least": F.least}, max(1, count.bit_length())
    )
    if not still_open:
        return linked
    walked = walked.where(F.col("up").isNotNull())
    on_cycle = cut(walked.select(F.col("up").alias("key")).distinct())
    # The least ord over a whole cycle names it.
    cycle_of = walked.join(on_cycle, "key", "left_semi").select(
        F.col("key").alias("entry"), F.col("least").alias("cycle")
    )
    leading = nodes.join(walked.select("key"), "key", "left_semi")
    stops = (
        leading.join(on_cycle.withColumn("on_cycle", F.lit(True)), "key", "left")
        .withColumn("up", F.when(F.col("on_cycle").isNull(), F.col("up")))
        .withColumn("entry", F.col("key"))
    )
    reached, _ = _climb(stops, {"entry": lambda own, above: above})
    entries = (
        reached.select("key", "entry")
        .join(nodes.select("key", "ord"), "key")
        .join(cycle_of, "entry")
        .groupBy("cycle")
        .agg(F.min_by("entry", "ord").alias("up"))
    )
    closing = (
        linked.select("key", "up")
        .join(on_cycle, "key", "left_semi")
        .join(entries, "up", "left_semi")
        .select("key", F.lit(True).alias("closing"))
    )
    return cut(
        linked.join(closing, "key", "left")
        .withColumn("up", F.when(F.col("closing").isNull(), F.col("up")))
        .drop("closing")
    )


@dataclass(frozen=True)
class Tree:
    """Collections with resolved parents, stored once for several questions."""

    linked: DataFrame
    count: int


def stored_tree(collections: DataFrame | Tree) -> Tree:
    if isinstance(collections, Tree):
        return collections
    linked, seen = cut_counting(_linked(collections), n=F.count(F.lit(1)))
    return Tree(linked, seen["n"])


def collection_paths(collections: DataFrame | Tree) -> DataFrame:
    """``key, path``: names from the root down, each ended by ``/``."""
    tree = stored_tree(collections)
    own = F.concat(text.strip(F.coalesce(text.not_empty("name"), F.col("key"))), F.lit("/"))
    extend: Merge = {"path": lambda own, above: F.concat(above, own)}

    def named(nodes: DataFrame) -> DataFrame:
        return nodes.select("key", "up", own.alias("path"))

    # No path is longer than the number of nodes.
    steps = min(HOPEFUL_STEPS, max(1, tree.count.bit_length()))
    found, still_open = _climb(named(tree.linked), extend, steps)
    if still_open:
        found, _ = _climb(named(_cut_cycles(tree.linked, tree.count)), extend)
    return found.select("key", "path")


def excluded_collections(collections: DataFrame | Tree, names: Sequence[str]) -> DataFrame:
    """``key`` of each collection whose own name or an ancestor's is one of ``names``."""
    tree = stored_tree(collections)
    if not names:
        return tree.linked.select("key").where(F.lit(False))
    hit = text.excluded_name("name", names)
    nodes = tree.linked.select("key", F.when(~hit, F.col("up")).alias("up"), hit.alias("hit"))
    # A walk on a cycle without a match has seen all of it after n levels.
    settled, _ = _climb(
        nodes, {"hit": lambda own, above: own | above}, max(1, tree.count.bit_length()), stop="hit"
    )
    return settled.where("hit").select("key")


def fully_excluded_papers(memberships: DataFrame, excluded: DataFrame) -> DataFrame:
    """``paper_id`` of papers whose every collection is excluded.

    ``memberships(paper_id, collection_key)``. A key that no collection has is
    not excluded, and a paper without memberships does not occur here.
    """
    marks = excluded.select(F.col("key").alias("collection_key"), F.lit(True).alias("mark"))
    return (
        memberships.join(marks.distinct(), "collection_key", "left")
        .groupBy("paper_id")
        .agg(F.bool_and(F.coalesce("mark", F.lit(False))).alias("all_excluded"))
        .where("all_excluded")
        .select("paper_id")
    )


def library_after_exclusion(
    library: DataFrame, memberships: DataFrame, excluded: DataFrame
) -> DataFrame:
    """The library without its fully excluded papers."""
    return library.join(fully_excluded_papers(memberships, excluded), "paper_id", "left_anti")


def collection_lists(memberships: DataFrame) -> DataFrame:
    """``paper_id, collection_keys``: the keys of each paper as one list."""
    return memberships.groupBy("paper_id").agg(
        F.array_sort(F.collect_list("collection_key")).alias("collection_keys")
    )
