"""Local outlier factor (Breunig et al., SIGMOD 2000) of queries against a library.

The library is fitted once: each row gets its k-distance and local reachability
density. Queries are then scored against those columns, however many come.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text, vectors
from ..schemas import MATCHES
from ..session import cut
from .knn import knn, vector_profile

# Fixed values that decide results.
DENSITY_FLOOR = 1e-10
SMALLEST_FITTED_LIBRARY = 3
# Scores are averages over shuffled rows; rounding keeps ">=" gates repeatable.
SCORE_DIGITS = 12


def effective_neighbors(wanted: int, library_rows: int) -> int:
    return max(2, min(wanted, library_rows - 1))


def density(reach: Column) -> Column:
    """Local reachability density of a mean reach."""
    return F.lit(1.0) / (reach + F.lit(DENSITY_FLOOR))


@dataclass(frozen=True)
class FittedLibrary:
    """A library, the densities of its rows, and what scoring needs to know of it.

    ``library(paper_id, ord, embedding)`` and ``about(paper_id, title, kdist, lrd)`` have
    the same rows; searching reads only the one, and scoring joins only the
    other. Below three rows both densities are NULL and scoring falls back to
    mean similarity. ``left_out(paper_id, reason)`` are the rows that could not
    be used.
    """

    library: DataFrame
    about: DataFrame
    count: int
    dim: int
    neighbors: int
    left_out: DataFrame | None = None

    @property
    def rows(self) -> DataFrame:
        return self.library.join(self.about, "paper_id")


def unusable(library: DataFrame, dim: int) -> DataFrame:
    """``(paper_id, reason)`` of rows without a valid vector of the wanted size."""
    reason = (
        F.when(F.col("embedding").isNull(), "no vector")
        .when(F.size("embedding") != dim, F.concat(F.lit("size "), F.size("embedding"), F.lit(f" instead of {dim}")))
        .otherwise("not finite")
    )
    bad = library.where(~vectors.is_valid("embedding", dim))
    return bad.select("paper_id", reason.alias("reason"))


def fit(
    library: DataFrame,
    neighbors: int = 20,
    dim: int | None = None,
    about: DataFrame | None = None,
    count: int | None = None,
    **knn_options,
) -> FittedLibrary:
    """Fit ``library(paper_id, ord, embedding[, title])``; unusable vectors are listed in ``left_out``.

    The library is read several times, so pass it as a stored table. ``dim`` is the
    model's vector size. ``about(paper_id, kdist, lrd)`` is a fit of the same ``count`` rows: it is taken as it is.
    """
    if about is None or count is None or dim is None:
        count, dim = vector_profile(library, dim=dim)
    left_out = unusable(library, dim)
    if "title" not in library.columns:
        library = library.withColumn("title", F.lit("").cast(T.StringType()))
    rows = library.where(vectors.is_valid("embedding", dim))
    library = rows.select("paper_id", "ord", vectors.as_doubles("embedding").alias("embedding"))
    titles = rows.select("paper_id", "title")
    k = effective_neighbors(neighbors, count)
    if about is not None:
        return FittedLibrary(library, titles.join(about, "paper_id"), count, dim, k, left_out)
    if count < SMALLEST_FITTED_LIBRARY:
        none = F.lit(None).cast("double")
        about = titles.withColumns({"kdist": none, "lrd": none})
        return FittedLibrary(library, about, count, dim, k, left_out)

    pairs = cut(
        knn(
            library.select(F.col("paper_id").alias("query_id"), "embedding"),
            library,
            k,
            dim=dim,
            library_rows=count,
            query_rows=count,
            exclude_self=True,
            **knn_options,
        ).select("query_id", "neighbor_id", "distance")
    )
    # Pairs of one row leave a task together, so both aggregates combine before
    # shuffling; a neighbour of very many rows is a skewed join key, which AQE splits.
    kdist = pairs.groupBy("query_id").agg(F.max("distance").alias("kdist"))
    lrd = (
        pairs.join(kdist.withColumnRenamed("query_id", "neighbor_id"), "neighbor_id")
        .groupBy("query_id")
        .agg(
            F.max("distance").alias("kdist"),
            density(F.avg(F.greatest("kdist", "distance"))).alias("lrd"),
        )
    )
    about = titles.join(lrd.withColumnRenamed("query_id", "paper_id"), "paper_id")
    return FittedLibrary(library, about, count, dim, k, left_out)


def neighbors_with_density(
    queries: DataFrame, fitted: FittedLibrary, top_k: int = 5, **knn_options
) -> DataFrame:
    """One row per query and neighbour, carrying the neighbour's title and densities."""
    k = max(fitted.neighbors, top_k)
    found = knn(
        queries, fitted.library, k, dim=fitted.dim, library_rows=fitted.count, **knn_options
    )
    return found.join(fitted.about.withColumnRenamed("paper_id", "neighbor_id"), "neighbor_id")


def score(
    queries: DataFrame,
    fitted: FittedLibrary,
    *,
    top_k: int = 5,
    digits: int = SCORE_DIGITS,
    with_matches: bool = True,
    **knn_options,
) -> DataFrame:
    """``queries(query_id, embedding)`` → ``query_id, lof, score[, top_matches]``.

    ``lof`` is NULL for a library of one or two rows, whose score is the mean
    cosine moved to 0..1. ``top_matches`` holds the most similar titles first.
    """
    found = neighbors_with_density(queries, fitted, top_k if with_matches else 1, **knn_options)
    if fitted.count < SMALLEST_FITTED_LIBRARY:
        lof = F.lit(None).cast("double")
        result = (F.avg(F.lit(1.0) - F.col("distance")) + 1.0) / 2.0
    else:
        near = F.col("rank") <= fitted.neighbors
        own = density(F.avg(F.when(near, F.greatest("kdist", "distance"))))
        lof = F.avg(F.when(near, F.col("lrd"))) / own
        result = vectors.density_score(lof)
    columns = [lof.alias("lof"), F.round(result, digits).alias("score")]
    if with_matches:
        # At most top_k entries per query: NULLs of farther rows are not collected.
        match = F.when(
            F.col("rank") <= top_k,
            F.struct(
                "rank",
                text.title_or_id("title", F.col("neighbor_id").cast("string")).alias("title"),
                (F.lit(1.0) - F.col("distance")).alias("similarity"),
            ),
        )
        ordered = F.array_sort(F.collect_list(match))
        columns.append(
            F.transform(
                ordered, lambda m: F.struct(m["title"].alias("title"), m["similarity"].alias("similarity"))
            ).cast(MATCHES).alias("top_matches")
        )
    return found.groupBy("query_id").agg(*columns)


def top_matches(queries: DataFrame, library: DataFrame, top_k: int = 5, **knn_options) -> DataFrame:
    """The most similar library rows of each query, one row per rank."""
    return knn(queries, library, top_k, **knn_options).select(
        "query_id", "rank", "neighbor_id", (F.lit(1.0) - F.col("distance")).alias("similarity")
    )


def mean_similarity(queries: DataFrame, library: DataFrame, **knn_options) -> DataFrame:
    """Mean cosine of each query over a library of one or two rows."""
    return (
        knn(queries, library, SMALLEST_FITTED_LIBRARY - 1, **knn_options)
        .groupBy("query_id")
        .agg(F.avg(F.lit(1.0) - F.col("distance")).alias("mean_similarity"))
    )
