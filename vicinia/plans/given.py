"""The given tables in the roles of the engine: vectors, papers, trees and memberships."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of files."""
    schema = table(spark, folder, name).schema
    # A stream takes a plain path for a folder; a pattern may also be met by a file.
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors as a library."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("paper_id"), F.col("vec_id").alias("ord"), "embedding", "label"
    )


def papers(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as papers: the first line is the title, the rest the abstract."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("paper_id"),
        F.col("doc_id").alias("ord"),
        text.first_line("text").alias("title"),
        text.after_first_line("text").alias("abstract"),
        "source",
        "lang",
    )


def feed(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the FEED columns. Labelled ones of good quality count as updates."""
    quality = table(spark, folder, "labels").select(F.col("doc_id").alias("paper_id"), "quality")
    rows = papers(spark, folder).join(quality, "paper_id", "left")
    return rows.select(
        F.col("paper_id").cast("string").alias("paper_id"),
        "title",
        F.array("source").alias("authors"),
        "abstract",
        text.paper_url(F.col("paper_id").cast("string")).alias("url"),
        F.lit("2024-01-01").alias("date_published"),
        F.when(F.col("quality") == 1, "2024-01-02").otherwise("2024-01-01").alias("date_updated"),
        (F.coalesce("quality", F.lit(0)) == 1).alias("is_update"),
        F.array("lang").alias("categories"),
        "ord",
    )


def split_by_language(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """``(library, arrivals)``: vectors of English or unknown papers, and the others."""
    lang = table(spark, folder, "documents").select(F.col("doc_id").alias("paper_id"), "lang")
    rows = vectors(spark, folder).join(lang, "paper_id", "left")
    english = F.coalesce("lang", F.lit("en")) == "en"
    return rows.where(english), rows.where(~english).withColumnRenamed("paper_id", "query_id")


def places(spark: SparkSession, folder: str) -> DataFrame:
    """Regions, nations, customers and orders as one tree of collections."""

    def level(name: str, mark: str, key: str, label, parent) -> DataFrame:
        return table(spark, folder, name).select(
            F.concat(F.lit(mark), F.col(key)).alias("key"),
            label.alias("name"),
            parent.alias("parent_key"),
            F.col(key).cast("long").alias("ord"),
        )

    none = F.lit(None).cast("string")
    return (
        level("region", "r", "r_regionkey", F.col("r_name"), none)
        .unionByName(
            level("nation", "n", "n_nationkey", F.col("n_name"), F.concat(F.lit("r"), "n_regionkey"))
        )
        .unionByName(
            level("customer", "c", "c_custkey", F.col("c_name"), F.concat(F.lit("n"), "c_nationkey"))
        )
        .unionByName(
            level(
                "orders", "o", "o_orderkey", F.col("o_orderkey").cast("string"),
                F.concat(F.lit("c"), "o_custkey"),
            )
        )
    )


def part_memberships(spark: SparkSession, folder: str) -> DataFrame:
    """Parts belong to the nations of the suppliers they are bought from."""
    nation = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("n"), "s_nationkey").alias("collection_key")
    )
    bought = table(spark, folder, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return bought.join(nation, "l_suppkey").select(
        F.col("l_partkey").alias("paper_id"), "collection_key"
    ).distinct()


def shelves(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """``(collections, memberships)``: languages under sources, and topics from labels.

    A document is directly in its source's language and in its vector's topic.
    """
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("paper_id"), "source", "lang"
    )
    topics = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("paper_id"), F.concat(F.lit("topic"), "label").alias("topic")
    )
    none = F.lit(None).cast("string")
    shelf = F.concat_ws(":", "source", "lang")
    sources = docs.select(F.col("source").alias("key")).distinct()
    pairs = docs.select("source", "lang").distinct()
    named = topics.select(F.col("topic").alias("key")).distinct()
    collections = (
        sources.select("key", F.col("key").alias("name"), none.alias("parent_key"))
        .unionByName(pairs.select(shelf.alias("key"), F.col("lang").alias("name"),
                                  F.col("source").alias("parent_key")))
        .unionByName(named.select("key", F.col("key").alias("name"), none.alias("parent_key")))
        # Any order that follows the data will do; the keys differ.
        .withColumn("ord", F.xxhash64("key"))
    )
    memberships = docs.select("paper_id", shelf.alias("collection_key")).unionByName(
        topics.select("paper_id", F.col("topic").alias("collection_key"))
    )
    return collections, memberships
