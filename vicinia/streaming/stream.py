"""Incremental scoring and embedding over file streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import embed
from ..operators.relevance import Settings
from ..plans.jobs import Snapshot, refresh_centroids, score_papers, store_vectors
from ..schemas import FEED
from ..session import job_tables
from ..sources.tables import TableStore, latest_rows

STREAMED_FEED = T.StructType(FEED.fields + [T.StructField("ord", T.LongType())])


def read_feed(spark: SparkSession, path: str, schema: T.StructType = STREAMED_FEED) -> DataFrame:
    """A stream over Parquet files of feed rows."""
    return spark.readStream.schema(schema).parquet(path)


def drop_repeats(
    feed: DataFrame, key: str = "paper_id", time: str = "event_time", delay: str = "1 day"
) -> DataFrame:
    """Each key once within the watermark. Optional: the jobs only look within one run."""
    return feed.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def score_stream(
    feed: DataFrame,
    snapshot: Snapshot,
    using: embed.Model,
    settings: Settings,
    out: str,
    checkpoint: str,
    **knn_options,
) -> StreamingQuery:
    """Score what is new against a fixed snapshot, then stop.

    Each micro-batch overwrites its own ``batch`` partition, so a batch that is
    run again after a failure does not double its rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        with job_tables(batch.sparkSession):
            result = score_papers(batch, snapshot, using, settings, **knn_options)
            if result.empty:
                return
            (
                result.items.withColumn("batch", F.lit(batch_id))
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("batch")
                .parquet(out)
            )

    return (
        feed.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def embed_stream(
    papers: DataFrame,
    store: TableStore,
    using: embed.Model,
    source: str,
    checkpoint: str,
    centroids: bool = True,
) -> StreamingQuery:
    """Store arriving papers and embed those that lack a vector, then stop.

    ``papers`` has the stored columns and ``ord``. Papers are upserted and only
    papers without a vector get one, so a repeated batch changes nothing. Papers
    that could not be embedded are kept in the table ``quarantine`` under the
    number of their batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        with job_tables(batch.sparkSession):
            store.upsert_papers(batch)
            arrived = latest_rows(batch, ["id"], ["ord"])
            waiting = embed.unembedded(arrived, store.read("embeddings"), source, using.model_id)
            keyed = waiting.withColumnRenamed("id", "paper_id")
            embedded = embed.embed(embed.with_text(keyed), using).drop("text")
            store_vectors(store, embedded, using, f"stream-{batch_id}")
            if centroids:
                refresh_centroids(store, using.model_id, source)

    return (
        papers.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
