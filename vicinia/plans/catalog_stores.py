"""Queries over stored tables, forced plans, landed files and streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import embed, hierarchy, incremental, lof, ranking, states, terms
from ..operators.relevance import Settings
from ..session import cut, scratch_path
from ..sources import feeds, layers, tables
from ..streaming import stream
from . import catalog, given, jobs
from .catalog import query, sql_hash, sql_lof

# ---- plans meant for large inputs, forced on the given ones --------------------


@query(catalog.SQL["topk_neighbors"])
def topk_queries_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Top matches by the plan for a large library and few queries."""
    return _matches(spark, folder, "queries")


@query(catalog.SQL["topk_neighbors"])
def topk_cells_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Top matches by the plan for two large sides."""
    return _matches(spark, folder, "cells")


def _matches(spark: SparkSession, folder: str, strategy: str) -> DataFrame:
    lib, arrivals = given.split_by_language(spark, folder)
    found = lof.top_matches(arrivals, lib, 5, strategy=strategy)
    titles = given.papers(spark, folder).select(F.col("paper_id").alias("neighbor_id"), "title")
    return found.join(titles, "neighbor_id", "left").select(
        "query_id", "rank", "neighbor_id", F.round("similarity", 9).alias("similarity"),
        tx.title_or_id("title", F.col("neighbor_id").cast("string")).alias("title"),
    )


@query(catalog.SQL["library_density"])
def lof_cells_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Densities of the library by the plan for two large sides."""
    fitted = lof.fit(given.vectors(spark, folder), strategy="cells")
    return fitted.rows.select("paper_id", F.round("kdist", 9).alias("kdist"), F.round("lrd", 6).alias("lrd"))


@query(
    """
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank
FROM events"""
)
def rank_many_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Rank of every event within its user, by value: many groups for the ranges."""
    events = given.table(spark, folder, "events").select("event_id", "user_id", "value")
    ranked = ranking.distributed_rank(events, ["user_id"], [F.col("value").desc(), F.col("event_id")])
    return ranked.select("event_id", "user_id", "rank")


# ---- terms as a table ----------------------------------------------------------

SQL_TERM_TABLE = """
terms AS (
  SELECT lower(w) AS term, min(item_id * 100000 + i) AS ord FROM (
    SELECT item_id, unnest(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS w,
           generate_subscripts(regexp_extract_all(text, '[^ \\t\\n\\r]+'), 1) - 1 AS i FROM benchmark)
  GROUP BY lower(w))
"""


@query(
    f"""
WITH {catalog.SQL_PAPERS}, {SQL_TERM_TABLE},
hits AS (SELECT doc_id, string_agg(term, ' ' ORDER BY ord) AS found, count(*) AS n
         FROM papers JOIN terms ON contains(lower(title || chr(10) || abstract), term)
         GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_terms, md5(coalesce(found, '')) AS terms_digest
FROM papers LEFT JOIN hits USING (doc_id)"""
)
def term_table_matches(spark: SparkSession, folder: str) -> DataFrame:
    """All words of all benchmark passages as terms, looked for in all documents."""
    words = given.table(spark, folder, "benchmark").select(
        "item_id", F.posexplode(F.filter(F.split("text", "[ \t\n\r]+"), lambda x: x != "")).alias("i", "term")
    )
    listed = words.select((F.col("item_id") * 100000 + F.col("i")).alias("ord"), "term")
    found = terms.match(given.papers(spark, folder), listed)
    return found.select(
        F.col("paper_id").alias("doc_id"), F.size("matched_terms").cast("bigint").alias("n_terms"),
        F.md5(F.array_join("matched_terms", " ")).alias("terms_digest"),
    )


# ---- exclusions ----------------------------------------------------------------


@query(
    f"""
WITH {catalog.SQL_PAPERS}
SELECT doc_id AS paper_id, title FROM papers WHERE source <> 'src3' AND lang <> 'de'"""
)
def papers_after_exclusion(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are not only in shelves of an excluded source or language."""
    shelves, _ = given.shelves(spark, folder)
    docs = given.table(spark, folder, "documents")
    members = docs.select(F.col("doc_id").alias("paper_id"), F.concat_ws(":", "source", "lang").alias("collection_key"))
    gone = hierarchy.excluded_collections(hierarchy.stored_tree(shelves), ["src3", "de"])
    papers = given.papers(spark, folder).select("paper_id", "title")
    return hierarchy.library_after_exclusion(papers, members, gone)


# ---- stored tables ---------------------------------------------------------------


def _items(papers: DataFrame, title) -> DataFrame:
    named = papers.withColumn("title", title)
    return catalog._as_items(named, F.array(F.concat_ws(":", "source", "lang")))


@query(
    f"""
WITH {catalog.SQL_PAPERS}
SELECT doc_id::VARCHAR AS id, 'new ' || title AS title, md5(abstract) AS abstract_digest,
       source || ':' || lang AS shelf, (SELECT count(*) FROM papers WHERE lang = 'en') AS new_ones
FROM papers"""
)
def sync_twice(spark: SparkSession, folder: str) -> DataFrame:
    """A library synced without the English documents, then with all of them under new titles."""
    shelves, _ = given.shelves(spark, folder)
    papers = given.papers(spark, folder)
    store = tables.TableStore(spark, scratch_path(spark, "twice"), buckets=4)
    jobs.sync_library(store, _items(papers.where("lang <> 'en'"), F.col("title")), shelves, catalog.HASH_MODEL, "given")
    second = jobs.sync_library(
        store, _items(papers, F.concat(F.lit("new "), "title")), shelves, catalog.HASH_MODEL, "given"
    )
    rows = store.read("papers").join(store.memberships().withColumnRenamed("paper_id", "id"), "id")
    return rows.select(
        "id", "title", F.md5("abstract").alias("abstract_digest"), F.col("collection_key").alias("shelf"),
        second.stats.select("new").scalar().alias("new_ones"),
    )


@query(
    """
WITH shelf AS (SELECT source || ':' || lang AS key FROM documents GROUP BY ALL ORDER BY count(*) DESC, key LIMIT 1),
one AS (SELECT max(doc_id::VARCHAR) AS id FROM documents)
SELECT 'member' AS kind, doc_id::VARCHAR AS id FROM documents WHERE source || ':' || lang = (SELECT key FROM shelf)
UNION ALL SELECT 'paper', id FROM one UNION ALL SELECT 'vector', id FROM one"""
)
def store_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Point lookups in a stored library: the members of its largest shelf, one paper and its vector."""
    store = catalog._document_store(spark, folder)
    shelves = store.memberships().groupBy("collection_key").count()
    largest = shelves.orderBy(F.desc("count"), "collection_key").first()["collection_key"]
    last = store.read("papers").agg(F.max("id")).first()[0]
    vector = store.embedding(last, catalog.HASH_MODEL.model_id)
    return (
        store.members(largest).select(F.lit("member").alias("kind"), F.col("paper_id").alias("id"))
        .unionByName(store.paper(last).select(F.lit("paper").alias("kind"), "id"))
        .unionByName(vector.select(F.lit("vector").alias("kind"), F.col("paper_id").alias("id")))
    )


GIVEN_MODEL = embed.Model("given", "64", embed.TokenHashEmbedder)


@query(
    f"WITH {sql_lof(catalog.SQL_ALL_LIB.replace('vec_id AS ord', 'vec_id::VARCHAR AS ord'), catalog.SQL_ALL_QRY)} "
    "SELECT p::VARCHAR AS paper_id, round(kdist, 9) AS kdist, round(lrd, 6) AS lrd, 1 AS fits FROM fitted"
)
def stored_density(spark: SparkSession, folder: str) -> DataFrame:
    """Densities of the given vectors as a library, read back by a second run, which fits nothing."""
    rows = given.vectors(spark, folder).select(F.col("paper_id").cast("string").alias("paper_id"), "embedding")
    store = tables.TableStore(spark, scratch_path(spark, "density"), buckets=4)
    papers = rows.select("paper_id", F.lit("").alias("title"), F.lit("").alias("abstract"), F.lit(0).alias("ord"))
    store.upsert_papers(catalog._as_items(papers, tx.string_array([])))
    jobs.store_vectors(store, rows.withColumn("error", F.lit(None).cast("string")), GIVEN_MODEL)
    settings = Settings(source="given")
    for _ in range(2):
        snapshot = jobs.prepare_library(store, GIVEN_MODEL, settings)
    fits = [store._fit_tables(name)[1].sequence() for name in store.folder.names("library_fits")]
    return snapshot.fitted.about.select(
        "paper_id", F.round("kdist", 9).alias("kdist"), F.round("lrd", 6).alias("lrd"), F.lit(sum(fits)).alias("fits")
    )


@query(
    f"""
WITH {sql_lof(catalog.SQL_ALL_LIB, catalog.SQL_ALL_QRY)}
SELECT p AS paper_id, round(kdist, 9) AS kdist, round(lrd, 6) AS lrd, true AS fewer_searches FROM fitted"""
)
def incremental_density(spark: SparkSession, folder: str) -> DataFrame:
    """Densities of all vectors: a library without German and French papers that gains the German, loses the Spanish,
    and gains the French and the Spanish again."""
    lib, arrivals = given.split_by_language(spark, folder)
    rows = lib.unionByName(arrivals.withColumnRenamed("query_id", "paper_id")).select("paper_id", "ord", "embedding", "lang")
    rows = cut(rows.withColumn("lang", F.coalesce("lang", F.lit("en"))))
    languages = [["de", "fr"], ["fr"], ["fr", "es"], []]
    states, held = [], None
    for missing in languages:
        now = rows.where(~F.col("lang").isin(missing)) if missing else rows
        now = now.drop("lang")
        if not states:
            states.append(incremental.start(now))
        else:
            added, removed = incremental.changes(held, now)
            states.append(incremental.update(states[-1], now, added, removed, refit_share=1.0))
        held = cut(now.select("paper_id", incremental.fingerprint().alias("print")))
    # A change searches the whole library for fewer rows than it has.
    fewer = all(s.searched < s.count for s in states[1:])
    return states[-1].about.select(
        "paper_id", F.round("kdist", 9).alias("kdist"), F.round("lrd", 6).alias("lrd"), F.lit(fewer).alias("fewer_searches")
    )


EVENT_BATCHES = 5


@query(
    f"""
WITH numbered AS (SELECT *, ntile({EVENT_BATCHES}) OVER (ORDER BY event_id) AS batch FROM events),
newest AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY batch DESC, ts DESC, event_id DESC) AS place FROM numbered)
SELECT user_id, event_id, event_type, value, props FROM newest WHERE place = 1 AND event_type <> 'error'"""
)
def delta_upserts(spark: SparkSession, folder: str) -> DataFrame:
    """The last event of each user: five batches are upserted as layers and compacted in between; users whose last
    event is an error are deleted."""
    events = given.table(spark, folder, "events")
    total = events.count()
    ranked = cut(ranking.distributed_rank(events.withColumn("all", F.lit(1)), ["all"], [F.col("event_id")]))
    # As ntile deals them: the first batches take one row more where the rows do not come out even.
    size, more = divmod(total, EVENT_BATCHES)
    ends = [size * (k + 1) + min(k + 1, more) for k in range(EVENT_BATCHES)]
    table = layers.LayeredTable(
        spark, scratch_path(spark, "events"), events.schema, ["user_id"], buckets=4,
        indexed={"event_type": lambda: F.col("event_type")},
    )
    for k, end in enumerate(ends):
        batch = ranked.where((F.col("rank") > (ends[k - 1] if k else 0)) & (F.col("rank") <= end))
        table.upsert(batch.select(*events.columns), ["ts", "event_id"])
        if k == 2:
            table.compact(force=True)
    table.delete(table.by_value("event_type", "error").where("event_type = 'error'").select("user_id"))
    return table.read().select("user_id", "event_id", "event_type", "value", "props")


@query(
    """
WITH shelf AS (SELECT source || ':' || lang AS key FROM documents GROUP BY ALL ORDER BY count(*) DESC, key LIMIT 1)
SELECT doc_id::VARCHAR AS id FROM documents WHERE source || ':' || lang = (SELECT key FROM shelf)"""
)
def members_by_index(spark: SparkSession, folder: str) -> DataFrame:
    """Members of the largest shelf, through the index from collections to buckets."""
    store = catalog._document_store(spark, folder)
    shelves = store.memberships().groupBy("collection_key").count()
    largest = shelves.orderBy(F.desc("count"), "collection_key").first()["collection_key"]
    return store.members(largest).select(F.col("paper_id").alias("id"))


@query(
    f"""
WITH {catalog.SQL_PAPERS}
SELECT doc_id::VARCHAR AS id, title, CASE WHEN lang = 'de' THEN 'moved' ELSE source END AS source
FROM papers WHERE lang = 'de' OR source = 'src1'"""
)
def papers_of_source(spark: SparkSession, folder: str) -> DataFrame:
    """Papers of two sources through the index, after a second write moved the German ones from one to the other."""
    papers = given.papers(spark, folder)
    store = tables.TableStore(spark, scratch_path(spark, "sources"), buckets=8)
    rows = catalog._as_items(papers, tx.string_array([])).drop("source")
    rows = rows.join(papers.select(F.col("paper_id").cast("string").alias("id"), "source", "lang"), "id")
    store.upsert_papers(rows)
    store.upsert_papers(rows.where("lang = 'de'").withColumn("source", F.lit("moved")))
    return store.papers_of("src1").unionByName(store.papers_of("moved")).select("id", "title", "source")


class UnevenEmbedder:
    """A model with faults: it fails on some texts, and gives other sizes or no numbers for others."""

    def __init__(self, model: str):
        self.dim = int(model)

    def embed_batch(self, texts):
        out = []
        for value in texts:
            size = len(value)
            if "@" in value:
                raise ValueError("unreadable")
            if size % 7 == 3:
                out.append([1.0] * (self.dim - 1))
            elif size % 11 == 5:
                out.append([float("nan")] * self.dim)
            else:
                out.append([1.0, float(size)] + [0.0] * (self.dim - 2))
        return out


UNEVEN = embed.Model("uneven", "4", UnevenEmbedder)


@query(
    f"""
WITH {catalog.SQL_PAPERS},
sized AS (
  SELECT doc_id::VARCHAR AS id, txt, CASE WHEN contains(txt, '@') THEN 0 WHEN length(txt) % 7 = 3 THEN 3
         WHEN length(txt) % 11 = 5 THEN -1 ELSE 4 END AS size
  FROM (SELECT doc_id, {catalog.SQL_EMBED_TEXT} AS txt FROM papers)),
kept AS (SELECT arg_min(size, id) AS size FROM sized WHERE size > 0 AND txt <> '')
SELECT id, CASE WHEN size = 0 THEN 'failed' ELSE 'vector' END AS kind,
       (SELECT count(*) FROM sized WHERE size = (SELECT size FROM kept) AND txt <> '') AS embedded
FROM sized WHERE size <> (SELECT size FROM kept) AND txt <> ''"""
)
def quarantine(spark: SparkSession, folder: str) -> DataFrame:
    """All documents through a faulty model: every row that has no usable vector is kept with its reason."""
    none = spark.createDataFrame([], tables.TABLES["collections"])
    store = tables.TableStore(spark, scratch_path(spark, "quarantine"), buckets=4)
    items = catalog._as_items(given.papers(spark, folder), tx.string_array([]))
    result = jobs.sync_library(store, items, none, UNEVEN, "given", run="first")
    return store.read("quarantine").select(
        "id", F.when(F.col("reason").startswith("ValueError"), "failed").otherwise("vector").alias("kind"),
        result.stats.select("embedded").scalar().alias("embedded"),
    )


# ---- streams ---------------------------------------------------------------------


@query(
    f"""
WITH {catalog.SQL_PAPERS},
{sql_hash(f"SELECT doc_id AS key, {catalog.SQL_EMBED_TEXT} AS txt FROM papers", "h")}
SELECT key::VARCHAR AS paper_id, count(*) AS n_parts, round(max(c) / min(c), 6) AS ratio
FROM h_count GROUP BY key"""
)
def stream_embed(spark: SparkSession, folder: str) -> DataFrame:
    """All documents arrive as a stream and are stored with their vectors."""
    arriving = given.stream(spark, folder, "documents")
    papers = arriving.select(
        F.col("doc_id").cast("string").alias("id"), F.lit("given").alias("source"),
        tx.first_line("text").alias("title"), tx.string_array([]).alias("authors"),
        tx.after_first_line("text").alias("abstract"), F.lit("").alias("url"),
        F.lit(None).cast("string").alias("date_added"), F.lit(None).cast("string").alias("date_published"),
        F.col("doc_id").alias("ord"),
    )
    root = scratch_path(spark, "arrivals")
    store = tables.TableStore(spark, f"{root}/store", buckets=4)
    stream.embed_stream(
        papers, store, catalog.HASH_MODEL, "given", f"{root}/progress", centroids=False
    ).awaitTermination()
    parts = store.read("embeddings").select("paper_id", F.explode("embedding").alias("value")).where("value <> 0")
    # Vectors have length one; the ratio of their parts is that of the counts behind them.
    return parts.groupBy("paper_id").agg(
        F.count(F.lit(1)).alias("n_parts"), F.round(F.max("value") / F.min("value"), 6).alias("ratio")
    ).select("paper_id", "n_parts", "ratio")


# ---- landed files ------------------------------------------------------------------


def _escaped(value: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(mark), F.lit(name))
    return value


@query(
    f"""
WITH e AS (SELECT {catalog.SQL_PAPER_ID.format(n="doc_id")} || 'v1' AS pid, text, source, lang FROM documents)
SELECT pid AS paper_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS abstract_digest,
       source AS authors, 'https://arxiv.org/abs/' || pid AS url, lang = 'fr' AS is_update, lang AS categories FROM e"""
)
def atom_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents landed as Atom files and read back as feed rows."""
    docs = given.table(spark, folder, "documents")
    updated = F.when(F.col("lang") == "fr", "2024-02-01T00:00:00Z").otherwise("2024-01-01T00:00:00Z")
    entry = F.concat(
        F.lit("<entry><id>http://arxiv.org/abs/"), catalog.paper_number("doc_id"), F.lit("v1</id><title>t</title><author><name> "),
        "source", F.lit("</name></author><summary>"), _escaped(F.col("text")),
        F.lit("</summary><published>2024-01-01T00:00:00Z</published><updated>"), updated,
        F.lit('</updated><category term="'), "lang", F.lit('"/></entry>'),
    )
    path = scratch_path(spark, "atom")
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entries = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(files)).cast("int").alias("file"), F.lit(1).alias("place"), entry.alias("value"))
    # Every file is one feed: its tags stand before and after its entries.
    tags = F.array(F.struct(F.lit(0).alias("place"), F.lit("<feed>").alias("value")), F.struct(F.lit(2).alias("place"), F.lit("</feed>").alias("value")))
    frames = spark.range(files).select(F.col("id").cast("int").alias("file"), F.inline(tags))
    landed = entries.unionByName(frames).repartitionById(files, F.col("file")).sortWithinPartitions("file", "place")
    landed.select("value").write.text(path)
    return feeds.read_metadata(spark, path).select(
        "paper_id", F.md5("abstract").alias("abstract_digest"), F.array_join("authors", "|").alias("authors"),
        "url", "is_update", F.array_join("categories", "|").alias("categories"),
    )


# ---- states of mean vectors ----------------------------------------------------------


def _shelved(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors with the source and language of their documents."""
    docs = given.table(spark, folder, "documents").select(F.col("doc_id").alias("paper_id"), "source", "lang")
    return given.vectors(spark, folder).join(docs, "paper_id").select("source", "lang", "embedding")


def _by_place(found: DataFrame, *keys: str) -> DataFrame:
    long = states.means(found).select(*keys, "n", F.posexplode("mean").alias("pos", "mean"))
    return long.withColumn("mean", F.round("mean", 9))


_SQL_SHELVED = """
shelved AS (
  SELECT source, lang, (generate_subscripts(embedding, 1) - 1)::INTEGER AS pos, unnest(embedding)::DOUBLE AS x
  FROM embeddings JOIN documents ON doc_id = vec_id)"""


@query(
    f"""
WITH {_SQL_SHELVED}
SELECT source, lang, GROUPING(source, lang)::INTEGER AS level, pos, count(*) AS n, round(avg(x), 9) AS mean
FROM shelved GROUP BY GROUPING SETS ((source, lang, pos), (source, pos), (lang, pos), (pos))"""
)
def centroids_cube(spark: SparkSession, folder: str) -> DataFrame:
    """Mean vectors by source and language, by each of them, and of all: coarse ones from fine ones."""
    return _by_place(states.cube(_shelved(spark, folder), ["source", "lang"], 64), "source", "lang", "level")


@query(
    f"""
WITH {_SQL_SHELVED}
SELECT source, pos, count(*) AS n, round(avg(x), 9) AS mean FROM shelved
WHERE lang IS DISTINCT FROM 'es' GROUP BY source, pos"""
)
def centroids_after_delta(spark: SparkSession, folder: str) -> DataFrame:
    """Mean vectors by source of a library without English documents, after these came and the Spanish went."""
    rows, keys = _shelved(spark, folder), ["source"]
    english, spanish = F.coalesce(F.col("lang") == "en", F.lit(False)), F.coalesce(F.col("lang") == "es", F.lit(False))
    stored = cut(states.states(rows.where(~english), keys, 64))
    came, went = (states.states(rows.where(c), keys, 64) for c in (english, spanish))
    return _by_place(states.changed(stored, came, went, keys), "source")
