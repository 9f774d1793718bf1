"""The operators of this subpackage over the given tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import bpe, language, lexical, mixing, near, neighbours, pii, rules, shards, substring, urls, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


SHARDS = tuple(f"shard-{k:03d}" for k in range(64))


#: Exact similarities of all documents that share a run of words, and what they reach.
NEAR_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
runs AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS run
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM runs a JOIN runs b ON a.run = b.run AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN sizes USING (doc_id)
"""


@query(NEAR_SQL)
def op1_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The class of near copies of every document."""
    return near.near_duplicates(table(spark, folder, "documents"), threshold=85)


#: Windows and their first occurrence by an exact comparison of all windows.
REPEATS_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS run
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20)),
repeats AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM repeats),
gone_lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(
         CASE WHEN ps IS NULL THEN w
              ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(ps, x[2])),
                                  lambda x: x[1]) END, ' ')) AS kept_sha256
FROM words LEFT JOIN gone_lists USING (doc_id)
"""


@query(REPEATS_SQL)
def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What repeated passages leave of every document."""
    kept = substring.remove_repeats(table(spark, folder, "documents"), digest=True)
    return kept.withColumnRenamed("kept", "kept_sha256")


def public_vocabulary() -> bpe.Vocabulary:
    """The vocabulary of the third operator's query."""
    import public_tokenizers

    return bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query()
def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the ids of every document and of what they decode to."""
    documents = table(spark, folder, "documents")
    coded = bpe.encode(documents, public_vocabulary(), round_trip=True)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


#: The owner of each slot as a character, from the rule that fills the table.
SHARD_OWNERS = "".join(chr(48 + owner) for owner in shards.lookup_table(SHARDS).tolist())
SHARDS_SQL = f"""
WITH digests AS (
  SELECT doc_id, text, md5(CASE WHEN doc_id IS NULL THEN '-' ELSE '+' || doc_id END) AS digest FROM documents),
slots AS (
  SELECT doc_id, text, CAST(('0x' || substr(digest, 1, 12))::BIGINT % {shards.TABLE_SIZE} AS INTEGER) AS slot FROM digests)
SELECT doc_id, slot, 'shard-' || lpad(CAST(ascii(substr('{SHARD_OWNERS}', slot + 1, 1)) - 48 AS VARCHAR), 3, '0') AS shard,
       sha256(text) AS text_sha256
FROM slots
"""


@query(SHARDS_SQL)
def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as its shard gives it back: whole rows are written to 64 shards and read from there."""
    placed = shards.place(table(spark, folder, "documents"), ["doc_id"], SHARDS)
    path = scratch_path(spark, "shards")
    shards.write(placed, path)
    found = shards.read(spark, path, placed.schema)
    return found.select("doc_id", "slot", "shard", F.sha2("text", 256).alias("text_sha256"))


@query()
def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document."""
    return language.identify(table(spark, folder, "documents"))


#: The records that the archives must give back.
WARC_SQL = """
WITH sized AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
groups AS (SELECT digest, max(page_id) AS keeper FROM sized WHERE n >= 1000 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, s.digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM sized s LEFT JOIN groups g ON s.digest = g.digest
"""


@query(WARC_SQL)
def op6_web_archive(spark: SparkSession, folder: str) -> DataFrame:
    """What the archives of all pages give back."""
    found = warc.round_trip(table(spark, folder, "pages"), keep_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op7_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Base and added spans of every document."""
    documents = table(spark, folder, "documents")
    found = pii.detect(documents, pii.train(documents))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added"
    )


@query(mixing.MIX_SQL)
def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words the mix takes of every document."""
    return mixing.mix(table(spark, folder, "documents"))


@query()
def op9_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector."""
    return neighbours.search(table(spark, folder, "embeddings"), F.pmod(F.col("id"), F.lit(20)) == 0)


@query()
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, base verdict and posterior verdict of every document."""
    return rules.judge(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.round("quality", 6).alias("quality"),
    )


#: The rules of the eleventh operator's query.
URL_RULES = (
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
)

#: Every URL against every rule.
URLS_SQL = f"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES {", ".join(map(str, URL_RULES))}),
cuts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
  FROM cuts),
best AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts)
  JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
"""


@query(URLS_SQL)
def op11_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, folder, "pages"), rules)


@query()
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """The first 32 whitened components of every vector."""
    found = whitening.whiten(table(spark, folder, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


#: Scores of all documents that share a term with an item.
LEXICAL_SQL = r"""
WITH lists AS (
  SELECT doc_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
sizes AS (SELECT doc_id, count(*) AS n FROM lists GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sizes),
postings AS (SELECT doc_id, term, count(*) AS tf FROM lists GROUP BY doc_id, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM postings, totals GROUP BY term, docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
lengths AS (SELECT doc_id, 100 - 50 + ((50 * n * docs) // words) AS m FROM sizes, totals),
scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""


@query(LEXICAL_SQL)
def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
