"""Queries over the given tables, each with the SQL that must give the same rows.

Every query reads whole tables. Numbers are rounded on both sides: sums run in
another order in each engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import centroids, digest, embed, hierarchy, lof, ranking, relevance
from ..operators.relevance import Settings
from ..session import cut, scratch_path
from ..sources import feeds, library, links, tables
from ..streaming import stream
from . import given, jobs

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TERMS = ["License", " über ", "@", "thanin", ""]
# Scores of the given vectors lie close together; this splits them about in half.
VECTOR_THRESHOLD = 0.6216
# About the middle of what turns score against documents, and documents against passages.
TURN_THRESHOLD = 0.05
PASSAGE_THRESHOLD = 0.626
HASH_MODEL = embed.model("hash", "64")


def query(sql: str | None = None):
    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return register


# ---- shared SQL -------------------------------------------------------------

SQL_PAPER_ID = (
    "(CASE WHEN {n} < 1000000000 THEN lpad(({n} // 100000)::VARCHAR, 4, '0') || '.' || "
    "lpad(({n} % 100000)::VARCHAR, 5, '0') ELSE translate(({n} // 10000000)::VARCHAR, '0123456789', 'abcdefghij') "
    "|| '/' || lpad(({n} % 10000000)::VARCHAR, 7, '0') END)"
)


def paper_number(column: str) -> Column:
    """A paper ID of its own for every number: of the newer form as long as it can tell them apart."""
    n = F.col(column)
    newer = F.concat(F.lpad(F.floor(n / 100000).cast("string"), 4, "0"), F.lit("."), F.lpad((n % 100000).cast("string"), 5, "0"))
    letters = F.translate(F.floor(n / 10000000).cast("string"), "0123456789", "abcdefghij")
    older = F.concat(letters, F.lit("/"), F.lpad((n % 10000000).cast("string"), 7, "0"))
    return F.when(n < 1000000000, newer).otherwise(older)


COSINE_DISTANCE = "round(least(2.0, greatest(0.0, 1.0 - list_cosine_similarity({a}, {b}))), 12)"

SQL_PAPERS = """
papers AS (
  SELECT doc_id, source, lang,
         CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, 1, instr(text, chr(10)) - 1)
              ELSE text END AS title,
         CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1)
              ELSE '' END AS abstract
  FROM documents)
"""

SQL_TERMS = """list_filter(['license', 'über', '@', 'thanin'],
  lambda t: contains(lower(title || chr(10) || abstract), t))"""


def sql_lof(library: str, queries: str, top_k: int = 1) -> str:
    """CTEs over ``library(p, ord, v)`` and ``queries(q, v)``: ``fitted`` and ``scored``."""
    near = f"greatest((SELECT k FROM size), {top_k})"
    return f"""
lib AS MATERIALIZED ({library}), qry AS MATERIALIZED ({queries}),
size AS (SELECT greatest(2, least(20, count(*) - 1)) AS k FROM lib),
lib_pairs AS (
  SELECT p, o, d FROM (
    SELECT p, o, d, row_number() OVER (PARTITION BY p ORDER BY d, ord) AS rn FROM (
      SELECT a.p AS p, b.p AS o, b.ord AS ord, {COSINE_DISTANCE.format(a='a.v', b='b.v')} AS d
      FROM lib a JOIN lib b ON a.p <> b.p))
  WHERE rn <= (SELECT k FROM size)),
kd AS (SELECT p, max(d) AS kdist FROM lib_pairs GROUP BY p),
fitted AS MATERIALIZED (
  SELECT kd.p AS p, kd.kdist AS kdist, r.lrd AS lrd FROM kd JOIN (
    SELECT n.p AS p, 1.0 / (avg(greatest(kd.kdist, n.d)) + 1e-10) AS lrd
    FROM lib_pairs n JOIN kd ON kd.p = n.o GROUP BY n.p) r ON r.p = kd.p),
qry_pairs AS MATERIALIZED (
  SELECT q, o, d, rn FROM (
    SELECT q, o, d, row_number() OVER (PARTITION BY q ORDER BY d, ord) AS rn FROM (
      SELECT a.q AS q, b.p AS o, b.ord AS ord, {COSINE_DISTANCE.format(a='a.v', b='b.v')} AS d
      FROM qry a CROSS JOIN lib b))
  WHERE rn <= {near}),
scored AS (
  SELECT q, avg(lrd) * (avg(greatest(kdist, d)) + 1e-10) AS lof
  FROM qry_pairs JOIN fitted ON fitted.p = o WHERE rn <= (SELECT k FROM size) GROUP BY q)
"""


SQL_RAW_SCORE = "1.0 / (1.0 + exp(-greatest(-60.0, least(60.0, 1.5 - lof))))"
SQL_SCORE = f"round({SQL_RAW_SCORE}, 6)"


def sql_hash(texts: str, name: str) -> str:
    """CTEs over ``texts(key, txt)``: ``<name>_count(key, pos, c)`` and ``<name>(key, v)``."""
    return f"""
{name}_text AS MATERIALIZED ({texts}),
{name}_count AS MATERIALIZED (
  SELECT key, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS pos, count(*)::DOUBLE AS c
  FROM (SELECT key, unnest(regexp_split_to_array(lower(txt), '[ \\t\\n\\r]+')) AS t FROM {name}_text)
  WHERE t <> '' GROUP BY key, pos),
{name} AS MATERIALIZED (
  SELECT g.key AS key, list(coalesce(c.c, 0.0) ORDER BY g.pos) AS v
  FROM (SELECT key, pos FROM {name}_text CROSS JOIN range(64) r(pos)) g
  LEFT JOIN {name}_count c ON c.key = g.key AND c.pos = g.pos GROUP BY g.key)
"""


SQL_EMBED_TEXT = """concat_ws(chr(10),
  CASE WHEN title <> '' THEN 'Title: ' || title END,
  CASE WHEN abstract <> '' THEN 'Abstract: ' || abstract END)"""

SQL_SPLIT = """
lang_of AS (SELECT vec_id, embedding::DOUBLE[] AS v, coalesce(lang, 'en') AS lang
            FROM embeddings LEFT JOIN documents ON doc_id = vec_id)"""
SQL_SPLIT_LIB = "SELECT vec_id AS p, vec_id AS ord, v FROM lang_of WHERE lang = 'en'"
SQL_SPLIT_QRY = "SELECT vec_id AS q, v FROM lang_of WHERE lang <> 'en'"
SQL_ALL_LIB = "SELECT vec_id AS p, vec_id AS ord, embedding::DOUBLE[] AS v FROM embeddings"
SQL_ALL_QRY = "SELECT vec_id AS q, embedding::DOUBLE[] AS v FROM embeddings"


# ---- neighbours and density -------------------------------------------------


@query(
    f"WITH {sql_lof(SQL_ALL_LIB, SQL_ALL_QRY)} "
    f"SELECT q AS query_id, round(lof, 6) AS lof, {SQL_SCORE} AS score, "
    f"{SQL_SCORE} >= {VECTOR_THRESHOLD} AS is_relevant FROM scored"
)
def lof_score(spark: SparkSession, folder: str) -> DataFrame:
    """Density score of every vector against the library of all vectors."""
    lib = given.vectors(spark, folder)
    fitted = lof.fit(lib)
    scored = lof.score(
        lib.withColumnRenamed("paper_id", "query_id"), fitted, digits=6, with_matches=False
    )
    return scored.select(
        "query_id",
        F.round("lof", 6).alias("lof"),
        "score",
        (F.col("score") >= VECTOR_THRESHOLD).alias("is_relevant"),
    )


@query(
    f"WITH {sql_lof(SQL_ALL_LIB, SQL_ALL_QRY)} "
    "SELECT p AS paper_id, round(kdist, 9) AS kdist, round(lrd, 6) AS lrd FROM fitted"
)
def library_density(spark: SparkSession, folder: str) -> DataFrame:
    """k-distance and reachability density of every library row."""
    fitted = lof.fit(given.vectors(spark, folder))
    return fitted.rows.select(
        "paper_id", F.round("kdist", 9).alias("kdist"), F.round("lrd", 6).alias("lrd")
    )


@query(
    f"WITH {SQL_SPLIT}, {SQL_PAPERS}, {sql_lof(SQL_SPLIT_LIB, SQL_SPLIT_QRY, 5)} "
    "SELECT q AS query_id, rn::INTEGER AS rank, o AS neighbor_id, round(1.0 - d, 9) AS similarity, "
    "coalesce(nullif(trim(title), ''), o::VARCHAR) AS title "
    "FROM qry_pairs LEFT JOIN papers ON doc_id = o WHERE rn <= 5"
)
def topk_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar English papers of each other paper, with titles."""
    lib, arrivals = given.split_by_language(spark, folder)
    found = lof.top_matches(arrivals, lib, 5)
    titles = given.papers(spark, folder).select(F.col("paper_id").alias("neighbor_id"), "title")
    return found.join(titles, "neighbor_id", "left").select(
        "query_id",
        "rank",
        "neighbor_id",
        F.round("similarity", 9).alias("similarity"),
        tx.title_or_id("title", F.col("neighbor_id").cast("string")).alias("title"),
    )


@query(
    """
WITH parts AS (SELECT toxic, unnest(embedding::DOUBLE[]) AS x,
                      generate_subscripts(embedding, 1) AS pos
               FROM embeddings JOIN labels ON doc_id = vec_id),
lib AS (SELECT toxic, list(m ORDER BY pos) AS v FROM
        (SELECT toxic, pos, avg(x) AS m FROM parts GROUP BY toxic, pos) GROUP BY toxic)
SELECT vec_id AS query_id,
       round((avg(list_cosine_similarity(embedding::DOUBLE[], v)) + 1.0) / 2.0, 6) AS score
FROM embeddings CROSS JOIN lib GROUP BY vec_id"""
)
def small_library_score(spark: SparkSession, folder: str) -> DataFrame:
    """Scores against a library of two: the mean vectors of both ``toxic`` classes."""
    rows = given.vectors(spark, folder)
    marked = rows.join(
        given.table(spark, folder, "labels").select(F.col("doc_id").alias("paper_id"), "toxic"),
        "paper_id",
    )
    lib = marked.groupBy(F.col("toxic").alias("paper_id")).agg(
        vx.mean_vector("embedding").alias("embedding")
    )
    fitted = lof.fit(lib.withColumn("ord", F.col("paper_id")))
    scored = lof.score(
        rows.withColumnRenamed("paper_id", "query_id"), fitted, digits=6, with_matches=False
    )
    return scored.select("query_id", "score")


@query(
    """
WITH parts AS (SELECT label, unnest(embedding::DOUBLE[]) AS x,
                      generate_subscripts(embedding, 1) AS pos FROM embeddings),
c AS (SELECT label, list(m ORDER BY pos) AS v FROM
      (SELECT label, pos, avg(x) AS m FROM parts GROUP BY label, pos) GROUP BY label)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 9) AS similarity,
       round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 9) AS centroid_norm
FROM embeddings JOIN c USING (label)"""
)
def own_topic_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine of each vector and the mean of its label, column against column."""
    rows = given.vectors(spark, folder)
    means = rows.groupBy("label").agg(vx.mean_vector("embedding").alias("centroid"))
    return rows.join(means, "label").select(
        F.col("paper_id").alias("vec_id"),
        F.round(vx.cosine("embedding", "centroid"), 9).alias("similarity"),
        F.round(vx.norm("centroid"), 9).alias("centroid_norm"),
    )


@query(
    """
SELECT doc_id, embedding IS NOT NULL AS is_valid,
       round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS length
FROM documents LEFT JOIN embeddings ON vec_id = doc_id"""
)
def vector_check(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each document has a usable vector, and the vector's length."""
    rows = given.table(spark, folder, "documents").select("doc_id").join(
        given.table(spark, folder, "embeddings").select(
            F.col("vec_id").alias("doc_id"), "embedding"
        ),
        "doc_id",
        "left",
    )
    return rows.select(
        "doc_id",
        vx.is_valid("embedding", 64).alias("is_valid"),
        F.round(vx.norm("embedding"), 6).alias("length"),
    )


# ---- collections ------------------------------------------------------------

SQL_PLACES = """
tree AS (
  SELECT 'r' || r_regionkey AS key, r_name AS name, NULL AS parent FROM region
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey FROM nation
  UNION ALL SELECT 'c' || c_custkey, c_name, 'n' || c_nationkey FROM customer
  UNION ALL SELECT 'o' || o_orderkey, o_orderkey::VARCHAR, 'c' || o_custkey FROM orders)
"""


@query(
    f"""
WITH RECURSIVE {SQL_PLACES},
paths AS (
  SELECT key, name || '/' AS path FROM tree
  WHERE parent IS NULL OR parent NOT IN (SELECT key FROM tree)
  UNION ALL SELECT t.key, p.path || t.name || '/' FROM tree t JOIN paths p ON t.parent = p.key)
SELECT key, path FROM paths"""
)
def collection_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Full paths of regions, nations, customers and orders."""
    return hierarchy.collection_paths(given.places(spark, folder))


EXCLUDED_PLACES = ["  asia ", "Nation_8", "Customer#000000009"]


@query(
    f"""
WITH RECURSIVE {SQL_PLACES},
gone AS (
  SELECT key FROM tree WHERE lower(trim(name)) IN ('asia', 'nation_8', 'customer#000000009')
  UNION SELECT t.key FROM tree t JOIN gone g ON t.parent = g.key)
SELECT key FROM gone"""
)
def excluded_collections(spark: SparkSession, folder: str) -> DataFrame:
    """All places at or under an excluded name."""
    return hierarchy.excluded_collections(given.places(spark, folder), EXCLUDED_PLACES)


SQL_PART_MEMBERS = """
members AS (SELECT DISTINCT l_partkey AS part, 'n' || s_nationkey AS key
            FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
"""


@query(
    f"""
WITH RECURSIVE {SQL_PLACES}, {SQL_PART_MEMBERS},
gone AS (
  SELECT key FROM tree WHERE lower(trim(name)) IN ('asia', 'europe')
  UNION SELECT t.key FROM tree t JOIN gone g ON t.parent = g.key),
barred AS (SELECT part FROM members GROUP BY part
           HAVING bool_and(key IN (SELECT key FROM gone)))
SELECT p_partkey AS paper_id, p_name AS title FROM part
WHERE p_partkey NOT IN (SELECT part FROM barred)"""
)
def library_after_exclusion(spark: SparkSession, folder: str) -> DataFrame:
    """Parts that are not bought in two regions' nations only."""
    parts = given.table(spark, folder, "part").select(
        F.col("p_partkey").alias("paper_id"), F.col("p_name").alias("title")
    )
    gone = hierarchy.excluded_collections(given.places(spark, folder), ["Asia", "Europe"])
    return hierarchy.library_after_exclusion(parts, given.part_memberships(spark, folder), gone)


@query(
    f"""
WITH {SQL_PART_MEMBERS}
SELECT part AS paper_id, string_agg(key, ',' ORDER BY key) AS collection_keys, count(*) AS n
FROM members GROUP BY part"""
)
def collection_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The collections of each part as one list."""
    lists = hierarchy.collection_lists(given.part_memberships(spark, folder))
    return lists.select(
        "paper_id",
        F.array_join("collection_keys", ",").alias("collection_keys"),
        F.size("collection_keys").cast("long").alias("n"),
    )


SQL_SHELVES = """
shelf_members AS (
  SELECT doc_id, source || '/' || lang || '/' AS path FROM documents
  UNION ALL SELECT vec_id, 'topic' || label || '/' FROM embeddings),
shelf_values AS (
  SELECT path, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos
  FROM shelf_members JOIN embeddings ON vec_id = doc_id),
shelf_means AS (SELECT path, pos, avg(x) AS m FROM shelf_values GROUP BY path, pos)
"""


def _shelf_centroids(
    spark: SparkSession, folder: str
) -> tuple[hierarchy.Tree, DataFrame, DataFrame]:
    collections, memberships = given.shelves(spark, folder)
    collections = cut(collections)
    tree = hierarchy.stored_tree(collections)
    paths = hierarchy.collection_paths(tree)
    found = centroids.collection_centroids(
        collections, paths, memberships, given.vectors(spark, folder)
    )
    # Ties are told apart by path, which the SQL side knows as well.
    return tree, paths, found.withColumn("ord", F.col("collection_path"))


@query(
    f"""
WITH {SQL_SHELVES}
SELECT path AS collection_path, (pos - 1)::INTEGER AS pos, round(m, 9) AS mean FROM shelf_means"""
)
def collection_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Mean vector of each shelf and topic, one row per dimension."""
    _, _, found = _shelf_centroids(spark, folder)
    long = found.select("collection_path", F.posexplode("centroid").alias("pos", "mean"))
    return long.withColumn("mean", F.round("mean", 9))


@query(
    f"""
WITH {SQL_SHELVES},
c AS (SELECT path, list(m ORDER BY pos) AS v FROM shelf_means
      WHERE path NOT LIKE 'src3/%' AND path <> 'topic0/' GROUP BY path),
d AS (SELECT vec_id, path, {COSINE_DISTANCE.format(a='embedding::DOUBLE[]', b='v')} AS d
      FROM embeddings CROSS JOIN c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, path) AS rn FROM d)
SELECT vec_id AS query_id, path AS closest_collection,
       round(1.0 - d, 6) AS closest_collection_score FROM r WHERE rn = 1"""
)
def nearest_collection(spark: SparkSession, folder: str) -> DataFrame:
    """The shelf or topic nearest to each vector, less two excluded ones."""
    tree, paths, found = _shelf_centroids(spark, folder)
    gone = hierarchy.excluded_collections(tree, ["SRC3", "topic0"])
    found = cut(centroids.without_excluded(found, paths, gone))
    queries = given.vectors(spark, folder).withColumnRenamed("paper_id", "query_id")
    return centroids.nearest_collection(queries, found).withColumn(
        "closest_collection_score", F.round("closest_collection_score", 6)
    )


# ---- keyed tables -----------------------------------------------------------


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def unembedded_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that have no vector yet."""
    papers = given.table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), F.lit("given").alias("source")
    )
    stored = given.vectors(spark, folder).select("paper_id", F.lit("m").alias("model"))
    return embed.unembedded(papers, stored, "given", "m").select("id")


@query(
    f"""
WITH {SQL_PAPERS}
SELECT vec_id AS paper_id, title, len(embedding)::INTEGER AS dims,
       round(embedding[1]::DOUBLE, 6) AS first_value
FROM embeddings JOIN papers ON doc_id = vec_id"""
)
def library_with_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors with the titles of their papers."""
    papers = given.papers(spark, folder).select(
        F.col("paper_id").alias("id"), F.lit("given").alias("source"), "title"
    )
    stored = given.vectors(spark, folder).select(
        "paper_id", F.lit("m").alias("model"), vx.as_doubles("embedding").alias("embedding")
    )
    rows = embed.library_vectors(papers, stored, "given", "m")
    return rows.select(
        "paper_id",
        "title",
        F.size("embedding").alias("dims"),
        F.round(F.element_at("embedding", 1), 6).alias("first_value"),
    )


@query(
    """
WITH old AS (SELECT * FROM events WHERE event_type <> 'click'
             QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
new AS (SELECT * FROM events WHERE event_type = 'click'
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
merged AS (SELECT * FROM new UNION ALL
           SELECT * FROM old WHERE user_id NOT IN (SELECT user_id FROM new))
SELECT user_id, event_id, event_type, value, props FROM merged"""
)
def upsert_latest(spark: SparkSession, folder: str) -> DataFrame:
    """Last event per user: clicks replace whole rows of the other kinds."""
    events = given.table(spark, folder, "events")
    order = ["ts", "event_id"]
    old = tables.latest_rows(events.where(F.col("event_type") != "click"), ["user_id"], order)
    new = tables.latest_rows(events.where(F.col("event_type") == "click"), ["user_id"], order)
    return tables.merge_rows(old, new, ["user_id"]).select(
        "user_id", "event_id", "event_type", "value", "props"
    )


@query(
    """
WITH old AS (SELECT DISTINCT o_custkey AS customer, o_orderpriority AS priority FROM orders
             WHERE o_orderstatus <> 'O'),
new AS (SELECT DISTINCT o_custkey AS customer, o_orderpriority AS priority FROM orders
        WHERE o_orderstatus = 'O')
SELECT customer, priority FROM new UNION ALL
SELECT customer, priority FROM old WHERE customer NOT IN (SELECT customer FROM new)"""
)
def replace_memberships(spark: SparkSession, folder: str) -> DataFrame:
    """Order priorities per customer: open orders set a customer's list anew."""
    orders = given.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"), "o_orderstatus"
    )
    is_open = F.col("o_orderstatus") == "O"
    store = tables.TableStore(spark, scratch_path(spark, "memberships"), buckets=8)
    for part in (orders.where(~is_open), orders.where(is_open)):
        lists = part.groupBy(F.col("customer").cast("string").alias("paper_id")).agg(
            F.collect_set("priority").alias("collection_keys")
        )
        store.replace_memberships(lists)
    return store.memberships().select(
        F.col("paper_id").cast("bigint").alias("customer"), F.col("collection_key").alias("priority")
    )


@query(
    f"""
WITH {SQL_PAPERS},
{sql_hash(f"SELECT doc_id AS key, {SQL_EMBED_TEXT} AS txt FROM papers", "h")},
len AS (SELECT key, sqrt(sum(c * c)) AS n FROM h_count GROUP BY key),
vals AS (SELECT source || '/' || lang || '/' AS path, g.pos AS pos, coalesce(c, 0.0) / n AS x
         FROM documents JOIN len ON len.key = doc_id CROSS JOIN range(64) g(pos)
         LEFT JOIN h_count hc ON hc.key = doc_id AND hc.pos = g.pos)
SELECT path AS collection_path, pos::INTEGER AS pos, round(avg(x), 9) AS mean
FROM vals GROUP BY path, pos"""
)
def sync_library(spark: SparkSession, folder: str) -> DataFrame:
    """The sync job on all documents: store, embed, and read the centroids back."""
    store = _document_store(spark, folder)
    found = store.centroids(HASH_MODEL.model_id)
    long = found.select("collection_path", F.posexplode("centroid").alias("pos", "mean"))
    return long.withColumn("mean", F.round("mean", 9))


# ---- text -------------------------------------------------------------------


@query(
    f"""
WITH {SQL_PAPERS}
SELECT doc_id AS paper_id, array_to_string({SQL_TERMS}, '|') AS terms,
       len({SQL_TERMS}) > 0 AS forced FROM papers"""
)
def term_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Configured terms found in each document, in their order."""
    terms = tx.matched_terms("title", "abstract", TERMS)
    return given.papers(spark, folder).select(
        "paper_id", F.array_join(terms, "|").alias("terms"), (F.size(terms) > 0).alias("forced")
    )


@query(
    """
WITH p AS (SELECT doc_id, source,
         CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, 1, instr(text, chr(10)) - 1)
              ELSE text END AS title,
         CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1)
              ELSE '' END AS abstract FROM documents),
t AS (SELECT doc_id, concat_ws(chr(10),
        CASE WHEN title <> '' THEN 'Title: ' || title END, 'Authors: ' || source || ', Ed. ' || source,
        CASE WHEN abstract <> '' THEN 'Abstract: ' || abstract END) AS txt FROM p)
SELECT doc_id AS paper_id, length(txt)::INTEGER AS chars, md5(txt) AS digest FROM t"""
)
def embedding_text(spark: SparkSession, folder: str) -> DataFrame:
    """The text to embed of each document, by length and digest."""
    authors = F.array("source", F.concat(F.lit("Ed. "), "source"))
    text = tx.embedding_text("title", authors, "abstract")
    rows = given.papers(spark, folder).select("paper_id", text.alias("text")).where(tx.has_text("text"))
    return rows.select("paper_id", F.length("text").alias("chars"), F.md5("text").alias("digest"))


@query(
    """
SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '…' ELSE text END AS short,
       CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '...' ELSE text END AS card,
       trim(regexp_replace(text, '\\s+', ' ', 'g')) AS squeezed FROM documents"""
)
def snippets(spark: SparkSession, folder: str) -> DataFrame:
    """Both kinds of snippet and the white-space-normalised text of each document."""
    docs = given.table(spark, folder, "documents")
    return docs.select(
        "doc_id",
        tx.snippet("text").alias("short"),
        tx.card_snippet("text").alias("card"),
        tx.squeeze("text").alias("squeezed"),
    )


@query(
    f"""
WITH {SQL_PAPERS}, {sql_hash(f"SELECT doc_id AS key, {SQL_EMBED_TEXT} AS txt FROM papers", "h")},
len AS (SELECT key, sqrt(sum(c * c)) AS n FROM h_count GROUP BY key)
SELECT key AS paper_id, pos::INTEGER AS pos, round(c / n, 9) AS value
FROM h_count JOIN len USING (key)"""
)
def hash_embed(spark: SparkSession, folder: str) -> DataFrame:
    """The token-hash embedding of every document, its non-zero values as rows."""
    texts = embed.with_text(given.papers(spark, folder).withColumn("authors", tx.string_array([])))
    rows = embed.embed(texts, HASH_MODEL).select(
        "paper_id", F.posexplode("embedding").alias("pos", "value")
    )
    return rows.where(F.col("value") != 0.0).withColumn("value", F.round("value", 9))


# ---- sources ----------------------------------------------------------------

# Forms a link line may take around a page's URL and a paper ID made from its number.
SQL_LINES = """
lines AS (
  SELECT page_id, form, value FROM (
    SELECT page_id, PAPER_ID_OF_PAGE AS pid, url FROM pages) p,
  LATERAL (VALUES (1, url), (2, url || '/abs/' || pid || 'v1'), (3, '  ' || pid || 'v2 '),
           (4, 'oai:example.org:' || pid), (5, 'http://www.example.org:80/' || pid),
           (6, 'https://www.example.org/abs/' || pid || 'v3'), (7, '# ' || pid), (8, ''),
           (9, 'math.GT/' || lpad((page_id % 10000000)::VARCHAR, 7, '0') || 'v1')) AS f(form, value)),
kept AS (SELECT page_id, form, trim(value) AS value FROM lines
         WHERE trim(value) <> '' AND NOT starts_with(trim(value), '#')),
hosts AS (
  SELECT *, regexp_extract(value, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1) AS scheme,
         regexp_replace(lower(regexp_extract(value, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)),
                        '^www\\.', '') AS host FROM kept),
parsed AS (
  SELECT page_id, form, value,
         CASE WHEN scheme = '' OR ends_with(host, 'example.org') THEN
           regexp_replace(nullif(regexp_extract(value,
             '(\\d{4}\\.\\d{4,5}(?:v\\d+)?|[a-z\\-]+(?:\\.[A-Z]{2})?/\\d{7}(?:v\\d+)?)', 1), ''),
             'v\\d+$', '') END AS paper_id FROM hosts)
""".replace("PAPER_ID_OF_PAGE", SQL_PAPER_ID.format(n="page_id"))


def _link_lines(spark: SparkSession, folder: str) -> DataFrame:
    pages = given.table(spark, folder, "pages").select("page_id", "url")
    pid = paper_number("page_id")
    forms = [
        F.col("url"),
        F.concat("url", F.lit("/abs/"), pid, F.lit("v1")),
        F.concat(F.lit("  "), pid, F.lit("v2 ")),
        F.concat(F.lit("oai:example.org:"), pid),
        F.concat(F.lit("http://www.example.org:80/"), pid),
        F.concat(F.lit("https://www.example.org/abs/"), pid, F.lit("v3")),
        F.concat(F.lit("# "), pid),
        F.lit(""),
        F.concat(F.lit("math.GT/"), F.lpad((F.col("page_id") % 10000000).cast("string"), 7, "0"), F.lit("v1")),
    ]
    return pages.select("page_id", F.posexplode(F.array(*forms)).alias("form", "value")).select(
        F.col("page_id").alias("path"), (F.col("form") + 1).alias("line_no"), "value"
    )


@query(
    f"""
WITH {SQL_LINES}
SELECT paper_id, min(page_id * 10 + form) AS first_seen FROM parsed
WHERE paper_id IS NOT NULL GROUP BY paper_id"""
)
def link_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct paper IDs in link lines, with where each was first seen."""
    parsed = links.parse_lines(_link_lines(spark, folder), "example.org")
    found = links.accepted(parsed)
    return found.select(
        "paper_id", (F.col("ord.path") * 10 + F.col("ord.line_no")).alias("first_seen")
    )


@query(f"WITH {SQL_LINES} SELECT page_id, form, value FROM parsed WHERE paper_id IS NULL")
def link_skips(spark: SparkSession, folder: str) -> DataFrame:
    """Link lines that name no supported paper."""
    parsed = links.parse_lines(_link_lines(spark, folder), "example.org")
    return links.skipped(parsed).select(
        F.col("path").alias("page_id"), F.col("line_no").alias("form"), "value"
    )


@query(
    f"""
WITH {SQL_LINES}, s AS (SELECT * FROM parsed WHERE paper_id IS NULL)
SELECT page_id, form, value, (SELECT count(*) FROM s) AS skipped,
       greatest((SELECT count(*) FROM s) - 10, 0) AS not_shown
FROM s ORDER BY page_id, form LIMIT 10"""
)
def skip_report(spark: SparkSession, folder: str) -> DataFrame:
    """The report of skipped lines: the first ten and how many there are."""
    parsed = cut(links.parse_lines(_link_lines(spark, folder), "example.org"))
    report = digest.skip_report(links.skipped(parsed))
    return report.select(
        F.col("path").alias("page_id"), F.col("line_no").alias("form"), "value", "skipped", "not_shown"
    )


def _metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as metadata records: two versions of each paper, made from its number."""
    docs = given.table(spark, folder, "documents")
    pid = paper_number("doc_id")
    return docs.select(
        F.explode(F.array(F.concat(pid, F.lit("v1")), F.concat(pid, F.lit("v2")))).alias("paper_id"),
        tx.first_line("text").alias("title"),
        "doc_id",
    ).withColumn("ord", F.struct("doc_id", "paper_id"))


SQL_META = """
meta AS (
  SELECT doc_id, PAPER_ID_OF_DOCUMENT AS canonical,
         CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, 1, instr(text, chr(10)) - 1)
              ELSE text END AS title FROM documents),
wanted AS (SELECT paper_id, min(page_id * 10 + form) AS first_seen FROM parsed
           WHERE paper_id IS NOT NULL GROUP BY paper_id)
""".replace("PAPER_ID_OF_DOCUMENT", SQL_PAPER_ID.format(n="doc_id"))


@query(
    f"""
WITH {SQL_LINES}, {SQL_META}
SELECT canonical || 'v2' AS paper_id, title, first_seen FROM wanted JOIN meta ON canonical = paper_id
QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY doc_id DESC) = 1"""
)
def enrich_links(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata of linked papers; the last record of each counts."""
    wanted = links.accepted(links.parse_lines(_link_lines(spark, folder), "example.org"))
    rows = feeds.enrich(wanted, _metadata(spark, folder))
    return rows.select(
        "paper_id", "title", (F.col("ord.path") * 10 + F.col("ord.line_no")).alias("first_seen")
    )


@query(
    f"""
WITH {SQL_LINES}, {SQL_META}
SELECT paper_id FROM wanted WHERE paper_id NOT IN (SELECT canonical FROM meta)"""
)
def missing_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Linked papers without a metadata record."""
    wanted = links.accepted(links.parse_lines(_link_lines(spark, folder), "example.org"))
    return feeds.missing_metadata(wanted, _metadata(spark, folder)).select("paper_id")


@query(
    """
WITH l AS (SELECT md5(text) AS id, substr(source, 4)::INTEGER AS category_ord, doc_id FROM documents)
SELECT id, category_ord, doc_id FROM l
QUALIFY row_number() OVER (PARTITION BY id ORDER BY category_ord, doc_id) = 1"""
)
def feed_union_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """Texts listed by several sources, each at the first place it was seen."""
    docs = given.table(spark, folder, "documents").select(
        F.md5("text").alias("id"),
        F.substring("source", 4, 10).cast("int").alias("category_ord"),
        "doc_id",
    )
    return feeds.first_seen(docs, ["category_ord", "doc_id"], "id").select(
        "id", "ord.category_ord", "ord.doc_id"
    )


@query(
    f"""
WITH l AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'oai:x:' || {SQL_PAPER_ID.format(n="page_id")}
             ELSE '' END AS guid,
             url || '/' || {SQL_PAPER_ID.format(n="page_id")} || 'v1' AS link FROM pages)
SELECT page_id, regexp_extract(coalesce(nullif(guid, ''), link),
  '(\\d{{4}}\\.\\d{{4,5}}(?:v\\d+)?|[a-z\\-]+(?:\\.[A-Z]{{2}})?/\\d{{7}}(?:v\\d+)?)', 1) AS paper_id FROM l"""
)
def listing_entries(spark: SparkSession, folder: str) -> DataFrame:
    """IDs of listing entries: the identifier where there is one, else the link."""
    pid = paper_number("page_id")
    pages = given.table(spark, folder, "pages").select(
        "page_id",
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("oai:x:"), pid))
        .otherwise("").alias("guid"),
        F.concat("url", F.lit("/"), pid, F.lit("v1")).alias("link"),
    )
    return pages.select("page_id", feeds.listing_id("guid", F.lit(""), "link").alias("paper_id"))


@query(
    f"""
WITH e AS (
  SELECT doc_id, {SQL_PAPER_ID.format(n="doc_id")} || 'v1' AS pid, text, source, lang,
         coalesce(quality, 0) AS quality FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, pid AS paper_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS abstract_digest,
       CASE WHEN lang = 'en' THEN source ELSE source || '|' || lang END AS authors,
       'https://arxiv.org/abs/' || pid AS url, quality = 1 AS is_update, lang AS categories FROM e"""
)
def feed_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in the shape of Atom entries, parsed into feed rows."""
    docs = given.table(spark, folder, "documents").join(
        given.table(spark, folder, "labels").select("doc_id", "quality"), "doc_id", "left"
    )
    entries = docs.select(
        "doc_id",
        F.concat(F.lit(" http://arxiv.org/abs/"), paper_number("doc_id"), F.lit("v1 ")).alias("id"),
        F.lit(None).cast("string").alias("title"),
        F.array(
            F.struct(F.concat(F.lit(" "), "source").alias("name")),
            F.struct(F.when(F.col("lang") != "en", F.col("lang")).otherwise("").alias("name")),
        ).alias("author"),
        F.col("text").alias("summary"),
        F.lit("2024-01-01T00:00:00Z ").alias("published"),
        F.when(F.col("quality") == 1, "2024-02-01T00:00:00Z")
        .otherwise("2024-01-01T00:00:00Z").alias("updated"),
        F.array(
            F.struct(F.lit("").alias("_term")), F.struct(F.col("lang").alias("_term"))
        ).alias("category"),
    )
    return feeds.parse_entries(entries, ["doc_id"]).select(
        "doc_id",
        "paper_id",
        F.md5("abstract").alias("abstract_digest"),
        F.array_join("authors", "|").alias("authors"),
        "url",
        "is_update",
        F.array_join("categories", "|").alias("categories"),
    )


@query(
    """
SELECT 'given:' || doc_id AS id, md5(text) AS abstract_digest,
       source || ' ' || lang || '|' || source AS authors,
       CASE WHEN lang = 'fr' THEN 'https://doi.org/10.1/' || doc_id
            WHEN lang = 'de' THEN '' ELSE 'https://example.org/' || doc_id END AS url,
       CASE WHEN lang = 'es' THEN NULL ELSE '2024-01-01' END AS date_added,
       CASE WHEN lang = 'en' THEN '' ELSE lang || '|' || source END AS collections
FROM documents WHERE lang IN ('en', 'fr', 'de', 'es')"""
)
def library_items(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in the shape of library items, parsed into paper rows."""
    docs = given.table(spark, folder, "documents")
    lang, none = F.col("lang"), F.lit(None).cast("string")

    def creator(role: str, first, last, name):
        return F.struct(
            F.lit(role).alias("creatorType"), first.alias("firstName"), last.alias("lastName"),
            name.alias("name"),
        )

    key = F.col("doc_id").cast("string")
    items = docs.select(
        F.when(lang == "en", key).otherwise("").alias("key"),
        F.struct(
            key.alias("key"),
            F.when(lang == "en", "journalArticle").otherwise("preprint").alias("itemType"),
            none.alias("title"),
            F.col("text").alias("abstractNote"),
            F.array(
                creator("author", F.col("source"), lang, none),
                creator("translator", F.lit("not"), F.lit("kept"), none),
                creator("editor", none, F.lit(""), F.col("source")),
                creator("editor", none, none, F.lit("")),
            ).alias("creators"),
            F.when(lang == "fr", F.concat(F.lit("10.1/"), key)).otherwise("").alias("DOI"),
            F.when(lang.isin("fr", "de"), "")
            .otherwise(F.concat(F.lit("https://example.org/"), key)).alias("url"),
            none.alias("date"),
            F.when(lang != "es", "2024-01-01").alias("dateAdded"),
            F.when(lang != "en", F.array("lang", "source")).alias("collections"),
        ).alias("data"),
        F.struct(F.when(lang == "es", "").alias("dateAdded")).alias("meta"),
    )
    rows = library.parse_items(items, "given")
    return rows.select(
        "id",
        F.md5("abstract").alias("abstract_digest"),
        F.array_join("authors", "|").alias("authors"),
        "url",
        "date_added",
        F.array_join("collections", "|").alias("collections"),
    )


@query(
    """
SELECT 'c' || c_custkey AS key, c_name AS name,
       CASE WHEN c_nationkey = 0 THEN NULL ELSE 'n' || c_nationkey END AS parent_key FROM customer"""
)
def collection_items(spark: SparkSession, folder: str) -> DataFrame:
    """Customers in the shape of collection records; ``false`` means no parent."""
    key = F.concat(F.lit("c"), "c_custkey")
    items = given.table(spark, folder, "customer").select(
        F.lit(None).cast("string").alias("key"),
        F.struct(
            key.alias("key"),
            F.col("c_name").alias("name"),
            F.when(F.col("c_nationkey") == 0, "false")
            .otherwise(F.concat(F.lit("n"), "c_nationkey")).alias("parentCollection"),
        ).alias("data"),
    )
    return library.parse_collections(items)


# ---- ranking and digests ----------------------------------------------------


@query(
    """
SELECT event_id, event_type, row_number() OVER
         (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events"""
)
def section_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Rank of every event within its type, by value."""
    events = given.table(spark, folder, "events").select("event_id", "event_type", "value")
    ranked = ranking.distributed_rank(
        events, ["event_type"], [F.col("value").desc(), F.col("event_id")]
    )
    return ranked.select("event_id", "event_type", "rank")


def _arrivals_judged(spark: SparkSession, folder: str, digits: int = 6) -> DataFrame:
    """Arrivals scored against the English library, gated by score and terms."""
    lib, arrivals = given.split_by_language(spark, folder)
    scores = lof.score(arrivals, lof.fit(lib), digits=digits, with_matches=False)
    feed = given.feed(spark, folder)
    rows = scores.withColumn("paper_id", F.col("query_id").cast("string")).join(feed, "paper_id")
    rows = rows.withColumn(
        "matched_terms", tx.matched_terms("title", "abstract", TERMS)
    )
    return relevance.judge(rows, VECTOR_THRESHOLD).withColumn("max_similarity", F.col("score"))


def sql_judged(digits: int = 6) -> str:
    score = f"round({SQL_RAW_SCORE}, {digits})"
    return f"""
{SQL_SPLIT}, {SQL_PAPERS}, {sql_lof(SQL_SPLIT_LIB, SQL_SPLIT_QRY)},
judged AS MATERIALIZED (
  SELECT q AS doc_id, {score} AS score, {score} >= {VECTOR_THRESHOLD} AS is_relevant,
         {SQL_TERMS} AS terms, coalesce(quality, 0) = 1 AS is_update, title, abstract, source
  FROM scored JOIN papers ON papers.doc_id = q LEFT JOIN labels ON labels.doc_id = q),
items AS MATERIALIZED (
  SELECT *, NOT is_relevant AS override, CASE WHEN is_relevant THEN '' ELSE
    array_to_string(terms, '|') END AS override_terms,
    CASE WHEN is_update THEN 'update' ELSE 'new' END AS section,
    row_number() OVER (PARTITION BY is_update ORDER BY score DESC, doc_id) AS rank
  FROM judged WHERE is_relevant OR len(terms) > 0)
"""


SQL_JUDGED = sql_judged()


@query(
    f"""
WITH {SQL_JUDGED}
SELECT doc_id::VARCHAR AS paper_id, section, rank, score, override AS override_by_terms,
       override_terms FROM items"""
)
def relevance_digest(spark: SparkSession, folder: str) -> DataFrame:
    """Relevant or term-forced arrivals, ranked within new listings and updates."""
    items = _arrivals_judged(spark, folder).where("included")
    return digest.ranked(items).select(
        "paper_id", "section", "rank", "score", "override_by_terms",
        F.array_join("override_terms", "|").alias("override_terms"),
    )


@query(
    f"""
WITH {SQL_JUDGED}
SELECT count(*) AS retrieved, count(*) AS scored, 0::BIGINT AS errors, 0::BIGINT AS blank,
       count(*) FILTER (is_relevant) AS relevant,
       count(*) FILTER (NOT is_relevant AND len(terms) > 0) AS forced,
       count(*) FILTER (is_relevant OR len(terms) > 0) AS included,
       count(*) FILTER ((is_relevant OR len(terms) > 0) AND NOT is_update) AS new_listings,
       count(*) FILTER ((is_relevant OR len(terms) > 0) AND is_update) AS updates FROM judged"""
)
def run_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of a scoring run."""
    return relevance.run_stats(
        _arrivals_judged(spark, folder).withColumn("status", F.lit("scored"))
    )


@query(
    f"""
WITH {SQL_JUDGED},
kept AS (SELECT doc_id FROM judged WHERE is_relevant)
SELECT doc_id::VARCHAR AS paper_id, array_to_string({SQL_TERMS}, '|') AS terms FROM papers
WHERE len({SQL_TERMS}) > 0 AND doc_id NOT IN (SELECT doc_id FROM kept)"""
)
def missing_forced(spark: SparkSession, folder: str) -> DataFrame:
    """Term-matching documents that relevance alone would leave out."""
    relevant = _arrivals_judged(spark, folder).where("is_relevant").select("paper_id")
    missing = relevance.missing_forced(
        given.feed(spark, folder), relevant, TERMS
    )
    return missing.select("paper_id", F.array_join("matched_terms", "|").alias("terms"))


@query(
    f"""
WITH {SQL_JUDGED},
kept AS (SELECT doc_id, score FROM judged WHERE is_relevant),
added AS (SELECT doc_id, 0.0 AS score FROM papers
          WHERE len({SQL_TERMS}) > 0 AND doc_id NOT IN (SELECT doc_id FROM kept))
SELECT doc_id::VARCHAR AS paper_id, score::DOUBLE AS max_similarity FROM kept
UNION ALL SELECT doc_id::VARCHAR, score::DOUBLE FROM added"""
)
def complete_forced(spark: SparkSession, folder: str) -> DataFrame:
    """Relevant arrivals plus every term-matching document, at score 0."""
    relevant = _arrivals_judged(spark, folder).where("is_relevant")
    items = relevant.select("paper_id", "max_similarity", "ord")
    full = relevance.complete_forced(
        given.feed(spark, folder), items, TERMS
    )
    return full.select("paper_id", "max_similarity")


@query(
    f"""
WITH {sql_judged(4)},
n AS (SELECT count(*) AS n, count(*) FILTER (NOT is_update) AS new,
             count(*) FILTER (is_update) AS upd FROM items),
heads AS (
  SELECT 0 AS place, unnest(['arXiv Feed Digest – 2024-01-31', repeat('=', 50),
      'Found ' || n || ' relevant arXiv item' || CASE WHEN n = 1 THEN '' ELSE 's' END || '.',
      'New listings: ' || new, 'Updates: ' || upd, '']) AS text,
    unnest(range(6)) AS line_no FROM n WHERE n > 0
  UNION ALL SELECT 1, unnest(['New listings', repeat('-', 50)]), unnest(range(2)) FROM n WHERE new > 0
  UNION ALL SELECT 2, unnest(['Updates', repeat('-', 50)]), unnest(range(2)) FROM n WHERE upd > 0),
drawn AS (
  SELECT CASE WHEN is_update THEN 2 ELSE 1 END AS place, rank,
    CASE WHEN is_update THEN [rank || '. ' || coalesce(nullif(title, ''), 'Unknown title')]
    ELSE list_filter([
      rank || '. ' || coalesce(nullif(title, ''), 'Unknown title'),
      '   Authors:    ' || source,
      '   URL:        https://arxiv.org/abs/' || doc_id,
      '   Similarity: ' || printf('%.4f', score),
      CASE WHEN override THEN '   Override:   keyword(s): ' || array_to_string(terms, ', ') END,
      CASE WHEN abstract <> '' THEN '   Abstract:   ' || substr(abstract, 1, 300) ||
        CASE WHEN length(abstract) > 300 THEN '…' ELSE '' END END,
      ''], lambda x: x IS NOT NULL) END AS lines
  FROM items)
SELECT place::INTEGER AS place, 0::BIGINT AS rank, line_no::INTEGER AS line_no, text FROM heads
UNION ALL
SELECT place::INTEGER, rank, unnest(range(len(lines)))::INTEGER, unnest(lines) FROM drawn"""
)
def digest_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The text digest of the arrivals, line by line."""
    none = F.lit(None).cast("string")
    items = _arrivals_judged(spark, folder, 4).where("included").withColumns(
        {"closest_collection": none, "closest_collection_score": F.lit(None).cast("double")}
    )
    return digest.digest_lines(cut(items), "2024-01-31")


# ---- jobs -------------------------------------------------------------------


def _as_items(papers: DataFrame, collections) -> DataFrame:
    return papers.select(
        F.col("paper_id").cast("string").alias("id"),
        F.lit("given").alias("source"),
        "title",
        tx.string_array([]).alias("authors"),
        "abstract",
        F.lit("").alias("url"),
        F.lit(None).cast("string").alias("date_added"),
        F.lit(None).cast("string").alias("date_published"),
        collections.alias("collections"),
        "ord",
    )


def _document_store(spark: SparkSession, folder: str) -> tables.TableStore:
    """All documents synced as a library, each in the shelf of its source and language."""
    shelves, _ = given.shelves(spark, folder)
    store = tables.TableStore(spark, scratch_path(spark, "documents"), buckets=8)
    items = _as_items(given.papers(spark, folder), F.array(F.concat_ws(":", "source", "lang")))
    jobs.sync_library(store, items, shelves, HASH_MODEL, "given")
    return store


#: Turns that a conversation may have without its order running into the next one's.
TURNS = 1 << 31


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as feed metadata; answers count as updates."""
    turns = given.table(spark, folder, "conversations")
    answer = F.col("role") == "assistant"
    return turns.select(
        F.concat("conv_id", F.lit("."), "turn", F.lit("v1")).alias("paper_id"),
        tx.first_line("text").alias("title"),
        tx.string_array([]).alias("authors"),
        tx.after_first_line("text").alias("abstract"),
        F.lit("").alias("url"),
        F.lit("a").alias("date_published"),
        F.when(answer, "b").otherwise("a").alias("date_updated"),
        answer.alias("is_update"),
        F.array("role").alias("categories"),
        (F.col("conv_id") * TURNS + F.col("turn")).alias("ord"),
    )


SQL_TURNS = """
turns AS (SELECT conv_id || '.' || turn || 'v1' AS key, role = 'assistant' AS is_update,
  conv_id * TURNS + turn AS ord,
  CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, 1, instr(text, chr(10)) - 1)
       ELSE text END AS title,
  CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1)
       ELSE '' END AS abstract FROM conversations)
""".replace("TURNS + turn", f"{TURNS} + turn")

FEED_SETTINGS = Settings(
    threshold=TURN_THRESHOLD,
    always_include_terms=tuple(TERMS),
    excluded_collections=("SRC3", "de"),
    source="given",
    score_digits=6,
)


@query(
    f"""
WITH {SQL_PAPERS}, {SQL_TURNS},
{sql_hash(f"SELECT doc_id AS key, {SQL_EMBED_TEXT} AS txt FROM papers", "h")},
{sql_hash(f"SELECT key, {SQL_EMBED_TEXT} AS txt FROM turns", "t")},
{sql_lof("SELECT doc_id AS p, doc_id::VARCHAR AS ord, v FROM papers JOIN h ON key = doc_id "
         "WHERE source <> 'src3' AND lang <> 'de'", "SELECT key AS q, v FROM t")},
shelf_len AS (SELECT key, sqrt(sum(c * c)) AS n FROM h_count GROUP BY key),
shelf_values AS (
  SELECT source || '/' || lang || '/' AS path, g.pos AS pos, avg(coalesce(c, 0.0) / n) AS x
  FROM papers JOIN shelf_len l ON l.key = doc_id CROSS JOIN range(64) g(pos)
  LEFT JOIN h_count hc ON hc.key = doc_id AND hc.pos = g.pos
  WHERE source <> 'src3' AND lang <> 'de' GROUP BY source, lang, g.pos),
shelf AS (SELECT path, list(x ORDER BY pos) AS v FROM shelf_values GROUP BY path),
near AS (SELECT key, max(1.0 - d) AS closest_collection_score FROM (
  SELECT t.key AS key, {COSINE_DISTANCE.format(a='t.v', b='shelf.v')} AS d FROM t CROSS JOIN shelf)
  GROUP BY key),
judged AS (
  SELECT turns.*, {SQL_SCORE} AS score, {SQL_TERMS} AS terms, closest_collection_score
  FROM turns JOIN scored ON q = turns.key JOIN near ON near.key = turns.key),
best AS (SELECT q, round(1.0 - d, 6) AS best_match FROM qry_pairs WHERE rn = 1)
SELECT key AS paper_id, score AS max_similarity, best_match,
       round(closest_collection_score, 6) AS closest_collection_score,
       score < {TURN_THRESHOLD} AS override_by_terms,
       CASE WHEN score < {TURN_THRESHOLD} THEN array_to_string(terms, '|') ELSE '' END AS override_terms,
       CASE WHEN is_update THEN 'update' ELSE 'new' END AS section,
       row_number() OVER (PARTITION BY is_update ORDER BY score DESC, ord) AS rank
FROM judged JOIN best ON q = key WHERE score >= {TURN_THRESHOLD} OR len(terms) > 0"""
)
def score_feed(spark: SparkSession, folder: str) -> DataFrame:
    """The feed job: all conversation turns against the library of all documents."""
    metadata = _turns(spark, folder)
    # Half of the listed IDs carry a version, as listings of both kinds occur.
    listings = metadata.select(
        F.when(F.col("is_update"), F.col("paper_id"))
        .otherwise(tx.canonical_id("paper_id")).alias("paper_id"),
        "ord",
    )
    result = jobs.score_feed(
        _document_store(spark, folder), listings, metadata, HASH_MODEL, FEED_SETTINGS,
        run_date="2024-01-31",
    )
    # Texts and titles of matches stay behind.
    narrow = result.items.select(
        "paper_id",
        "max_similarity",
        F.round(F.element_at("top_matches", 1)["similarity"], 6).alias("best_match"),
        F.round("closest_collection_score", 6).alias("closest_collection_score"),
        "override_by_terms",
        F.array_join("override_terms", "|").alias("override_terms"),
        "is_update",
        "ord",
    )
    return digest.ranked(narrow).select(
        "paper_id", "max_similarity", "best_match", "closest_collection_score", "override_by_terms", "override_terms",
        "section", "rank",
    )


SQL_BENCHMARK_LIB = (
    "SELECT item_id AS p, item_id::VARCHAR AS ord, v FROM benchmark JOIN b ON key = item_id"
)
SQL_BENCHMARK_HASH = sql_hash(
    "SELECT item_id AS key, 'Abstract: ' || text AS txt FROM benchmark", "b"
)


def _benchmark_snapshot(spark: SparkSession, folder: str, settings: Settings):
    """The benchmark passages as a library."""
    passages = given.table(spark, folder, "benchmark").select(
        F.col("item_id").alias("paper_id"),
        F.lit("").alias("title"),
        F.col("text").alias("abstract"),
        F.col("item_id").alias("ord"),
    )
    store = tables.TableStore(spark, scratch_path(spark, "benchmark"), buckets=2)
    none = spark.createDataFrame([], tables.TABLES["collections"])
    jobs.sync_library(
        store, _as_items(passages, tx.string_array([])), none, HASH_MODEL, "given"
    )
    return store, jobs.prepare_library(store, HASH_MODEL, settings)


@query(
    f"""
WITH {SQL_LINES}, {SQL_META},
linked AS (
  SELECT canonical, first_seen, text, doc_id FROM wanted JOIN meta ON canonical = paper_id
  JOIN documents USING (doc_id)
  QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY doc_id DESC) = 1),
{SQL_BENCHMARK_HASH},
{sql_hash("SELECT canonical AS key, 'Abstract: ' || text AS txt FROM linked", "l")},
{sql_lof(SQL_BENCHMARK_LIB, "SELECT key AS q, v FROM l")}
SELECT canonical || 'v2' AS paper_id, {SQL_SCORE} AS max_similarity,
       row_number() OVER (ORDER BY {SQL_SCORE} DESC, first_seen) AS rank
FROM linked JOIN scored ON q = canonical WHERE {SQL_SCORE} >= {PASSAGE_THRESHOLD}"""
)
def score_links(spark: SparkSession, folder: str) -> DataFrame:
    """The links job: linked documents against the library of benchmark passages."""
    settings = Settings(threshold=PASSAGE_THRESHOLD, source="given", score_digits=6)
    store, _ = _benchmark_snapshot(spark, folder, settings)
    path = scratch_path(spark, "links")
    # Range-sorted files: their names follow page order, as line numbers do within each.
    ordered = _link_lines(spark, folder).orderBy("path", "line_no")
    ordered.select("value").write.text(path)
    docs = given.table(spark, folder, "documents").select("doc_id", "text")
    metadata = _metadata(spark, folder).join(docs, "doc_id").select(
        "paper_id",
        F.lit("").alias("title"),
        tx.string_array([]).alias("authors"),
        F.col("text").alias("abstract"),
        tx.paper_url("paper_id").alias("url"),
        F.lit(None).cast("string").alias("date_published"),
        F.lit(None).cast("string").alias("date_updated"),
        F.lit(False).alias("is_update"),
        tx.string_array([]).alias("categories"),
        "ord",
    )
    result = jobs.score_links(
        spark, store, path, metadata, HASH_MODEL, settings, run_date="2024-01-31",
        domain="example.org",
    )
    return digest.ranked(result.items).select("paper_id", "max_similarity", "rank")


@query(
    f"""
WITH {SQL_BENCHMARK_HASH},
{sql_hash("SELECT doc_id AS key, 'Abstract: ' || text AS txt FROM documents", "d")},
{sql_lof(SQL_BENCHMARK_LIB, "SELECT key AS q, v FROM d")}
SELECT q::VARCHAR AS paper_id, {SQL_SCORE} AS max_similarity FROM scored
WHERE {SQL_SCORE} >= {PASSAGE_THRESHOLD}"""
)
def stream_scores(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, read as a stream, against the library of benchmark passages."""
    settings = Settings(threshold=PASSAGE_THRESHOLD, source="given", score_digits=6)
    _, snapshot = _benchmark_snapshot(spark, folder, settings)
    arriving = given.stream(spark, folder, "documents")
    feed = arriving.select(
        F.col("doc_id").cast("string").alias("paper_id"),
        F.lit("").alias("title"),
        tx.string_array([]).alias("authors"),
        F.col("text").alias("abstract"),
        F.lit("").alias("url"),
        F.lit(None).cast("string").alias("date_published"),
        F.lit(None).cast("string").alias("date_updated"),
        F.lit(False).alias("is_update"),
        tx.string_array([]).alias("categories"),
        F.col("doc_id").alias("ord"),
    )
    out = scratch_path(spark, "stream")
    stream.score_stream(
        feed, snapshot, HASH_MODEL, settings, f"{out}/items", f"{out}/progress"
    ).awaitTermination()
    return spark.read.parquet(f"{out}/items").select("paper_id", "max_similarity")
