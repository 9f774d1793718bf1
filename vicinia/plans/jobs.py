"""The three jobs: library sync, feed scoring and link scoring."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import digest, embed, hierarchy, incremental, lof, relevance
from ..operators.centroids import collection_centroids, without_excluded
from ..operators.knn import vector_profile
from ..operators.relevance import Settings
from ..session import cut, cut_counting, job_tables
from ..sources import feeds, library, links
from ..sources.tables import TableStore, latest_of_repeats

# ---- library sync -----------------------------------------------------------


@dataclass(frozen=True)
class SyncResult:
    stats: DataFrame
    quarantine: DataFrame | None = None
    preview: DataFrame | None = None


def sync_library(
    store: TableStore,
    items: DataFrame,
    collections: DataFrame,
    using: embed.Model,
    source: str = "zotero",
    dry_run: bool = False,
    run: str | None = None,
) -> SyncResult:
    """Take in library items and collections, embed what lacks a vector, renew centroids.

    ``items`` are rows of :func:`vicinia.sources.library.read_items` and ``collections``
    of ``read_collections``. A dry run still stores items and collections, then
    lists what it would embed. What could not be embedded is kept in the table
    ``quarantine`` under the name of the ``run``; the counts add up to
    ``needing_embedding``.

    Texts are shuffled once, to the buckets of the stored table, and written only there:
    the other steps read what they need of it, and tell rows apart by their IDs. Only where
    the IDs that occur again, or wait among others, are too many to broadcast, that join
    shuffles texts once more.
    """
    with job_tables(store.spark) as keep:
        stored_ids = store.read("papers").select("id", F.lit(True).alias("stored"))
        papers = store.upsert_papers(
            latest_of_repeats(items, ["id"], ["ord"]), unique=True, beside=["collections"]
        )
        arrived = papers.select("id").join(stored_ids, "id", "left").agg(
            F.count(F.lit(1)).alias("retrieved"), F.count_if(F.col("stored").isNull()).alias("new")
        ).first().asDict()
        store.replace_collections(collections)
        lists = papers.select(
            F.col("id").alias("paper_id"), F.col("collections").alias("collection_keys")
        )
        store.replace_memberships(lists, unique=True)

        waiting, needed = _waiting(store, source, using.model_id)
        stats = {**arrived, **needed, "embedded": 0, "errors": 0, "blank": 0}
        if dry_run or not needed["needing_embedding"]:
            preview = digest.preview(waiting) if dry_run else None
            return keep(SyncResult(_stats_row(store.spark, stats), preview=preview))

        keyed = waiting.withColumnRenamed("id", "paper_id")
        embedded = embed.embed(embed.with_text(keyed), using, in_place=True).drop("text")
        bad, outcome = store_vectors(store, embedded, using, run)
        refresh_centroids(store, using.model_id, source)
        stats.update(outcome)
        stats["blank"] = stats["needing_embedding"] - stats["embedded"] - stats["errors"]
        return keep(SyncResult(_stats_row(store.spark, stats), quarantine=bad))


def _waiting(store: TableStore, source: str, model_id: str) -> tuple[DataFrame, dict[str, int]]:
    """The stored papers of ``source`` that lack a vector, and how many.

    They are found by ID, and read where they lie: all of them on a first run, else by their IDs.
    """
    papers = store.read("papers")
    ids, needed = cut_counting(
        embed.unembedded(papers, store.read("embeddings"), source, model_id).select(F.col("id").alias("_id")),
        needing_embedding=F.count(F.lit(1)),
    )
    papers = papers.where(F.col("source") == source)
    if needed["needing_embedding"] < papers.count():
        papers = papers.join(ids, F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    return papers, needed


def store_vectors(
    store: TableStore, embedded: DataFrame, using: embed.Model, run: str | None = None
) -> tuple[DataFrame, dict[str, int]]:
    """Append the valid vectors of papers that have none, quarantine the rest; returns that and the counts.

    Valid are vectors of the model's size, which its first stored vector has set.
    """
    embedded = cut(embedded)
    dim = store.settle_dimension(using.model_id, embedded)
    good, bad = embed.split_errors(embedded, dim)
    store.append_embeddings(good, using.model_id)
    # Counted from the written table: a task that ran twice does not count twice.
    counts = embedded.agg(F.count_if(vectors.is_valid("embedding", dim)).alias("good"), F.count(F.lit(1)).alias("n")).first()
    if counts["n"] > counts["good"]:
        rows = bad.select(F.col("paper_id").alias("id"), F.col("error").alias("reason"))
        store.quarantine(rows, "embeddings", using.model_id, run or f"run-{uuid.uuid4().hex}")
    return bad, {"embedded": counts["good"], "errors": counts["n"] - counts["good"]}


def _stats_row(spark: SparkSession, stats: dict[str, int]) -> DataFrame:
    return spark.createDataFrame(
        [tuple(stats.values())], ", ".join(f"{name} long" for name in stats)
    )


def refresh_centroids(store: TableStore, model_id: str, source: str = "zotero") -> None:
    """Recompute all centroids of a model. Without collections the old ones stay."""
    collections = store.read("collections")
    if collections.isEmpty():
        return
    current = embed.library_vectors(
        store.read("papers"), store.embeddings_of(model_id), source, model_id
    )
    centroids = collection_centroids(
        collections, hierarchy.collection_paths(collections), store.memberships(), current,
        store.dimension(model_id),
    )
    store.replace_centroids(centroids, model_id)


# ---- scoring ----------------------------------------------------------------


@dataclass(frozen=True)
class Snapshot:
    """A fitted library and its centroids, fixed for one run."""

    fitted: lof.FittedLibrary
    centroids: DataFrame
    stats: dict[str, int]


def prepare_library(
    store: TableStore, using: embed.Model, settings: Settings, **knn_options
) -> Snapshot:
    """Fit the library of a model, less the papers and centroids that are excluded."""
    model_id = using.model_id
    # Taken before the rows are read: a change in between is found by the next run.
    tables = store.sequences()
    rows = embed.library_vectors(
        store.read("papers"), store.embeddings_of(model_id), settings.source, model_id
    ).withColumn("ord", F.col("paper_id"))
    centroids = store.centroids(model_id).select("collection_path", "centroid", "ord")
    barred = None
    if settings.excluded_names:
        tree = hierarchy.stored_tree(store.read("collections"))
        excluded = hierarchy.excluded_collections(tree, settings.excluded_names)
        barred = hierarchy.fully_excluded_papers(store.memberships(), excluded)
        centroids = without_excluded(centroids, hierarchy.collection_paths(tree), excluded)
    library, stats = _kept_rows(rows, barred)
    fitted = _stored_fit(store, library, using, settings, tables, **knn_options)
    stats["library_left_out"] = stats["library_after"] - fitted.count
    if stats["library_left_out"]:
        found = fitted.left_out.select(F.col("paper_id").alias("id"), "reason")
        store.quarantine(found, "embeddings", model_id, f"fit-{uuid.uuid4().hex}")
    centroids, used = cut_counting(centroids, centroids=F.count(F.lit(1)))
    return Snapshot(fitted, centroids, {**stats, **used})


def _stored_fit(
    store: TableStore, library: DataFrame, using: embed.Model, settings: Settings, tables: dict[str, int], **knn_options
) -> lof.FittedLibrary:
    """The fit of exactly these rows, brought up to date from the last one of the same settings.

    While the tables are in the states the last fit belongs to, nothing is looked at. Otherwise rows are
    compared by their prints, and only what the changed ones reach is worked out again.
    """
    wanted = (using.model_id, settings.source, settings.lof_neighbors, sorted(settings.excluded_names))
    name = hashlib.sha256(repr(wanted).encode()).hexdigest()
    kept = store.fit_state(name)
    dim = store.dimension(using.model_id)
    if dim is None:
        dim = vector_profile(library)[1]
    state = kept[0] if kept and kept[0].dim == dim else None
    if state is None or kept[2] != tables:
        rows = library.where(vectors.is_valid("embedding", dim)).select(
            "paper_id", "ord", vectors.as_doubles("embedding").alias("embedding")
        )
        prints = rows.select("paper_id", incremental.fingerprint().alias("print"))
        # The fit is read from where it is stored: what led to it goes.
        with job_tables(store.spark):
            if state is None:
                new = incremental.start(rows, settings.lof_neighbors, dim=dim, **knn_options)
                state = store.store_fit(name, new, prints, tables)
            else:
                added, removed = incremental.changes(kept[1], rows)
                new = incremental.update(state, rows, added, removed, settings.lof_neighbors, **knn_options)
                if new.searched or new.count != state.count or new.revised or new.rated:
                    state = store.store_fit(name, new, prints, tables)
                else:
                    store.confirm_fit(name, state, tables)
    return lof.fit(library, settings.lof_neighbors, dim=state.dim, about=state.about, count=state.count)


def _kept_rows(rows: DataFrame, barred: DataFrame | None) -> tuple[DataFrame, dict[str, int]]:
    """The stored library rows that are not barred, and how many there were."""
    if barred is None:
        kept, seen = cut_counting(rows, library_after=F.count(F.lit(1)))
        return kept, {"library_before": seen["library_after"], **seen}
    marked = rows.join(barred.withColumn("barred", F.lit(True)), "paper_id", "left")
    marked, seen = cut_counting(
        marked,
        library_before=F.count(F.lit(1)),
        library_after=F.count_if(F.col("barred").isNull()),
    )
    return marked.where(F.col("barred").isNull()).drop("barred"), seen


@dataclass(frozen=True)
class DigestResult:
    rows: DataFrame | None
    items: DataFrame | None
    stats: DataFrame | None
    lines: DataFrame | None = None
    extra: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def empty(self) -> bool:
        return self.items is None


NO_DIGEST = DigestResult(None, None, None)


def score_papers(
    feed: DataFrame, snapshot: Snapshot, using: embed.Model, settings: Settings, **knn_options
) -> DigestResult:
    """Score feed rows against a snapshot. An empty library gives no digest at all."""
    if snapshot.fitted.count == 0:
        return NO_DIGEST
    with job_tables(feed.sparkSession) as keep:
        rows = keep(cut(
            relevance.score_rows(
                relevance.first_of_each(feed), snapshot.fitted, snapshot.centroids, using, settings,
                **knn_options,
            )
        ))
    items = relevance.digest_items(rows)
    library = {name: F.lit(value) for name, value in snapshot.stats.items()}
    return DigestResult(rows, items, relevance.run_stats(rows).withColumns(library))


def deliver(
    result: DigestResult, run_date: str, out: str | None, dry_run: bool, short: bool = False
) -> DigestResult:
    """Write ranked items (by run date), text and stats, or only build the lines."""
    if result.empty:
        return result
    # Ranked once, for the lines and the items, by what the order needs; an item is a row per paper.
    ranks = digest.ranked(result.items.select("paper_id", "is_update", "max_similarity", "ord"))
    ranks = ranks.select(F.col("paper_id").alias("_paper"), "section", "rank")
    placed = result.items.join(ranks, F.col("paper_id").eqNullSafe(F.col("_paper"))).drop("_paper")
    lines = digest.digest_lines(placed, run_date, short)
    if out is not None and not dry_run:
        write_items(placed, f"{out}/items", run_date)
        digest.write_text(lines, f"{out}/text/run_date={run_date}")
        result.stats.write.mode("overwrite").parquet(f"{out}/stats/run_date={run_date}")
    return replace(result, lines=lines)


def write_items(items: DataFrame, path: str, run_date: str) -> None:
    (
        items.drop("ord")
        .withColumn("run_date", F.lit(run_date))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_date")
        .parquet(path)
    )


def score_feed(
    store: TableStore,
    listings: DataFrame,
    metadata: DataFrame,
    using: embed.Model,
    settings: Settings = Settings(),
    *,
    run_date: str,
    out: str | None = None,
    threshold: float | None = None,
    dry_run: bool = False,
    short: bool = False,
    **knn_options,
) -> DigestResult:
    """Score the papers of category listings and deliver their digest."""
    if threshold is not None:
        settings = replace(settings, threshold=threshold)
    with job_tables(store.spark) as keep:
        feed, seen = cut_counting(feeds.listed_papers(listings, metadata), n=F.count(F.lit(1)))
        if not seen["n"]:
            return NO_DIGEST
        snapshot = prepare_library(store, using, settings, **knn_options)
        result = score_papers(feed, snapshot, using, settings, **knn_options)
        return keep(deliver(result, run_date, out, dry_run, short))


def score_links(
    spark: SparkSession,
    store: TableStore,
    links_path: str | Sequence[str],
    metadata: DataFrame,
    using: embed.Model,
    settings: Settings = Settings(),
    *,
    run_date: str,
    out: str | None = None,
    dry_run: bool = False,
    domain: str = text.LINK_DOMAIN,
    **knn_options,
) -> DigestResult:
    """Score the papers that a links file names and deliver their digest.

    ``extra`` holds the report of skipped lines and the IDs without metadata.
    """
    with job_tables(spark) as keep:
        wanted, skipped = links.read_links(spark, links_path, domain)
        wanted = cut(wanted)
        feed, seen = cut_counting(feeds.enrich(wanted, metadata), n=F.count(F.lit(1)))
        extra = {
            "skipped": digest.skip_report(skipped),
            "missing": feeds.missing_metadata(wanted, metadata),
        }
        if not seen["n"]:
            return keep(DigestResult(None, None, None, extra=extra))
        snapshot = prepare_library(store, using, settings, **knn_options)
        result = score_papers(feed, snapshot, using, settings, **knn_options)
        return keep(deliver(replace(result, extra=extra), run_date, out, dry_run))


# ---- command of the library path ---------------------------------------------


def sync_landed(
    store: TableStore,
    items_path: str | Sequence[str],
    collections_path: str | Sequence[str],
    using: embed.Model,
    source: str = "zotero",
    types: Sequence[str] = library.PAPER_TYPES,
    dry_run: bool = False,
) -> SyncResult:
    """:func:`sync_library` over landed JSON files."""
    spark = store.spark
    return sync_library(
        store,
        library.read_items(spark, items_path, source, types),
        library.read_collections(spark, collections_path),
        using,
        source,
        dry_run,
    )
