"""A corpus from raw documents to token ids, in five stages.

Every stage takes the documents its predecessor kept, with the columns
``doc_id, text, lang, source, n_chars``, and all but the last return them.
Between stages the documents are written and read again. An empty table passes
through; nulls are handled as each operator says. Columns beyond those five, and
names that clash with an operator's own, are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinia.llm import bpe, language, mixing, near, pii
from vicinia.llm.queries import public_vocabulary
from vicinia.session import cut, cut_counting, job_tables

#: Near copies share at least this percentage of their runs of five words.
THRESHOLD = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents without a letter and those whose language cannot be told."""
    model = language.train(docs)
    names = [f"c{k}" for k in range(len(docs.columns))]
    # Numbered names cannot clash with the columns of the prediction.
    found = language.predict(docs.toDF(*names), model, text=names[docs.columns.index("text")])
    return found.where(~F.col("rejected")).select(*names).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each class of near copies the document with the smallest ID.

    Documents are told apart by ID and text: rows that share both are one, of which the first by the
    other columns stays; rows of one ID with different texts are documents of their own, and so are
    rows without an ID, which come after all others. Texts are shuffled only where the sets of rows that go are too
    large to be broadcast.
    """
    rows = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    place = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    key, text = place["doc_id"], place["text"]
    twice = rows.groupBy(F.col(key).alias("twice")).count().where("count > 1").select("twice")
    twice, seen = cut_counting(twice, n=F.count(F.lit(1)))
    # An ID of one row names it; other rows are named by a hash, which sorts nowhere in particular.
    shared = F.col(key).isNull()
    if seen["n"]:
        rows = rows.join(twice, F.col(key) == F.col("twice"), "left")
        shared |= F.col("twice").isNotNull()
    node = F.when(shared, F.xxhash64(key, text)).otherwise(F.col(key).cast("bigint"))
    rows = rows.select(*place.values(), shared.alias("shared"), node.alias("node"))
    classes = near.near_duplicates(rows.select("node", F.col(text).alias("text")), row_id="node", threshold=THRESHOLD)
    # Members of classes of one are never looked at again.
    found = cut(classes.where("node <> component_id").select("node", "component_id").distinct())
    linked = found.unionByName(found.select(F.col("component_id").alias("node"), "component_id").distinct())
    members = rows.select("node", F.col(key).alias("id")).join(linked, "node")
    first = members.groupBy("component_id").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).getField("node").alias("first")
    )
    losers = linked.join(first, "component_id").where(F.col("node") != F.col("first"))
    repeated = rows.where("shared").groupBy("node").count().where("count > 1")
    fates = cut(
        losers.select("node", F.lit("goes").alias("fate"))
        .unionByName(repeated.select("node", F.lit("repeats").alias("fate")))
        .groupBy("node").agg(F.min("fate").alias("fate"))
    )
    rows = rows.join(fates, "node", "left")
    place_of = F.row_number().over(Window.partitionBy("node").orderBy(*[c for c in place.values() if c not in (key, text)]))
    firsts = rows.where("fate = 'repeats'").withColumn("row", place_of).where("row = 1")
    kept = rows.where("fate IS NULL").select(*place.values()).unionByName(firsts.select(*place.values()))
    return kept.toDF(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind, and count the characters anew where the text changed."""
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(others)], "text")
    names = [f"c{k}" for k in range(len(others))]
    found = pii.detect(rows, pii.train(docs), keep=names, redacted="text")
    changed = (F.col("spans") != "") & F.col(names[others.index("n_chars")]).isNotNull()
    columns = []
    for column in docs.columns:
        if column == "text":
            columns.append(F.col("text"))
            continue
        value = F.col(names[others.index(column)])
        if column == "n_chars":
            value = F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(value)
        columns.append(value.alias(column))
    return found.select(*columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out whole documents, so that each source has about its target of words.

    Where a budget ends inside a document, the document is in if at least half of it is.
    Documents without words have no share in a mix of words.
    """
    rows = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    place = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    mixed = mixing.mix(
        rows, row_id=place["doc_id"], source=place["source"], text=place["text"], carry=rows.columns
    )
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    out = mixed.where(copies > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
    return out.select(*rows.columns).toDF(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    coded = bpe.encode(docs, public_vocabulary(), keep=("doc_id", "source", "lang", "text"), round_trip=True)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select("doc_id", "source", "lang", "n_tokens", "ids", same.alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: Models are trained on the way, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote besides its result is deleted after it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with job_tables(spark) as keep:
            docs = keep(cut(stage(spark, docs, sf_dir)))
    return STAGES[-1][1](spark, docs, sf_dir)
