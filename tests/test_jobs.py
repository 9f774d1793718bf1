"""The jobs end to end on small landed files."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from vicinia.operators import embed
from vicinia.operators.relevance import Settings
from vicinia.plans import jobs
from vicinia.sources import feeds
from vicinia.schemas import PAPERS
from vicinia.sources.files import Folder
from vicinia.sources.tables import TableStore
from vicinia.streaming import stream

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
MODEL = embed.model("hash", "16")


# Workers cannot import test modules.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Picky(embed.TokenHashEmbedder):
    def embed_batch(self, texts):
        if any("unreadable" in t for t in texts):
            raise RuntimeError("no")
        return super().embed_batch(texts)


embed.register_provider("picky", Picky)
PICKY = embed.model("picky", "16")


def item(number, collections):
    words = " ".join(WORDS[(number + i) % 4] for i in range(5))
    return {"key": f"K{number}", "data": {"itemType": "preprint", "title": f"Paper {number} {words}",
            "abstractNote": words, "creators": [], "collections": collections}}


def land(folder, name, rows):
    path = folder / name
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


def entry(key, title, abstract="", updated="2024-01-01"):
    return (f"<entry><id>http://arxiv.org/abs/{key}</id><title>{title}</title><summary>{abstract}</summary>"
            f"<author><name>A</name></author><published>2024-01-01</published><updated>{updated}</updated></entry>")


@pytest.fixture(scope="module")
def landed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("landed")
    items = [item(n, ["c1"] if n % 2 else ["c2"]) for n in range(12)]
    items.append({"key": "empty", "data": {"itemType": "preprint", "title": "", "abstractNote": ""}})
    collections = [{"key": "root", "data": {"name": "Root"}},
                   {"key": "c1", "data": {"name": "One", "parentCollection": "root"}},
                   {"key": "c2", "data": {"name": "Two", "parentCollection": False}}]
    metadata = folder / "meta.xml"
    metadata.write_text("<feed>" + "".join([
        entry("2401.00001v1", "alpha beta gamma delta alpha", "beta gamma"),
        entry("2401.00002v2", "alpha beta gamma delta beta", "gamma", "2024-02-02"),
        entry("2401.00003v1", "unreadable qubit", "text"),
        entry("2401.00004v1", "unreadable only", "text"),
        entry("2401.00005v1", "kappa iota theta", "far qubit kappa kappa kappa"),
        entry("2401.00006v1", "kappa kappa", "iota iota iota iota"),
    ]) + "</feed>")
    listing = folder / "rss.xml"
    ids = ["2401.00001v1", "2401.00002", "2401.00003v1", "2401.00004v1", "2401.00005v1", "2401.00006v1", "2401.09999"]
    listing.write_text("<rss>" + "".join(f"<item><guid>oai:arXiv.org:{i}</guid></item>" for i in ids) + "</rss>")
    links = folder / "links.txt"
    links.write_text("https://arxiv.org/abs/2401.00002v1\nhttps://example.com\n2401.00001\n2401.77777\n")
    return {
        "items": land(folder, "items.json", items), "collections": land(folder, "collections.json", collections),
        "metadata": str(metadata), "listing": str(listing), "links": str(links),
    }


@pytest.fixture(scope="module")
def store(spark, landed, tmp_path_factory):
    store = TableStore(spark, str(tmp_path_factory.mktemp("library") / "store"), buckets=2)
    dry = jobs.sync_landed(store, landed["items"], landed["collections"], PICKY, dry_run=True)
    assert dry.preview.count() == 10 and store.read("embeddings").isEmpty()
    result = jobs.sync_landed(store, landed["items"], landed["collections"], PICKY)
    row = result.stats.first()
    assert (row.retrieved, row.new, row.needing_embedding, row.embedded, row.errors, row.blank) == (13, 0, 13, 12, 0, 1)
    return store


SETTINGS = Settings(threshold=0.55, always_include_terms=("Qubit",), top_k=3)


def test_sync(spark, store, landed):
    assert store.read("papers").count() == 13
    paths = {r.collection_path: r.centroid for r in store.centroids(PICKY.model_id).collect()}
    assert set(paths) == {"Root/One/", "Two/"}
    # A second run embeds the paper without text again, finds none, and changes nothing else.
    stamp = store.embeddings_of(PICKY.model_id).select(F.max("date_embedded")).first()[0]
    row = jobs.sync_landed(store, landed["items"], landed["collections"], PICKY).stats.first()
    assert (row.new, row.needing_embedding, row.embedded) == (0, 1, 0)
    assert store.embeddings_of(PICKY.model_id).select(F.max("date_embedded")).first()[0] == stamp


def test_score_feed(spark, store, landed, tmp_path):
    listing = feeds.read_listings(spark, {"quant-ph": landed["listing"]})
    metadata = feeds.read_metadata(spark, landed["metadata"])
    out = str(tmp_path / "out")
    result = jobs.score_feed(store, listing, metadata, PICKY, SETTINGS, run_date="2024-01-31", out=out)
    rows = {r.paper_id: r for r in result.items.collect()}
    assert set(rows) == {"2401.00001v1", "2401.00002v2", "2401.00003v1", "2401.00005v1"}
    near, failed, far = rows["2401.00001v1"], rows["2401.00003v1"], rows["2401.00005v1"]
    assert near.max_similarity >= 0.55 and not near.override_by_terms and len(near.top_matches) == 3
    assert near.top_matches[0].title.startswith("Paper ") and near.closest_collection in ("Root/One/", "Two/")
    assert rows["2401.00002v2"].is_update
    # Could not be embedded, but a term forces it in.
    assert (failed.max_similarity, failed.top_matches, failed.override_terms) == (0.0, [], ["qubit"])
    assert failed.closest_collection is None and failed.override_by_terms
    assert far.override_by_terms and far.max_similarity < 0.55 and far.closest_collection
    stats = result.stats.first()
    assert (stats.retrieved, stats.errors, stats.included, stats.forced, stats.updates) == (6, 2, 4, 2, 1)
    assert (stats.library_before, stats.library_after, stats.centroids) == (12, 12, 2)
    assert spark.read.parquet(f"{out}/items").where("run_date = '2024-01-31'").count() == 4
    assert spark.read.text(f"{out}/text/run_date=2024-01-31").count() == result.lines.count()
    assert spark.read.parquet(f"{out}/stats").count() == 1
    # Everything passes a threshold of 0 but what failed and no term names.
    low = jobs.score_feed(store, listing, metadata, PICKY, SETTINGS, run_date="d", threshold=0.0)
    assert low.items.count() == 5


def test_a_second_run_reads_the_stored_fit(spark, store, monkeypatch):
    first = jobs.prepare_library(store, PICKY, SETTINGS)

    def fail(*args, **options):
        raise AssertionError("the library was searched again")

    monkeypatch.setattr("vicinia.operators.incremental.knn", fail)
    again = jobs.prepare_library(store, PICKY, SETTINGS)
    assert sorted(again.fitted.about.collect()) == sorted(first.fitted.about.collect())
    assert again.stats["library_left_out"] == 0
    with pytest.raises(AssertionError):
        jobs.prepare_library(store, PICKY, Settings(lof_neighbors=3))


def test_unusable_rows_are_kept_in_quarantine(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"), buckets=2)
    rows = [("a", [1.0, 0.0], None), ("b", [1.0], None), ("c", None, "it failed"), ("d", [float("inf"), 1.0], None)]
    embedded = spark.createDataFrame(rows, "paper_id string, embedding array<double>, error string")
    _, counts = jobs.store_vectors(store, embedded, PICKY, "run-1")
    assert counts == {"embedded": 1, "errors": 3}
    kept = {(r.run, r.table, r.model, r.id) for r in store.read("quarantine").collect()}
    assert kept == {("run-1", "embeddings", PICKY.model_id, k) for k in "bcd"}
    assert {r.reason for r in store.read("quarantine").where("id = 'c'").collect()} == {"it failed"}
    # A vector of another size that is stored already is left out, counted and kept with its reason.
    store.upsert_embeddings(spark.createDataFrame([("e", [1.0, 2.0, 3.0])], "paper_id string, embedding array<double>"), PICKY.model_id)
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PAPERS.fields)
    store.upsert_papers(spark.createDataFrame([(k, "zotero", k, [], "", "", None, None, 0) for k in "ae"], names + ", ord long"))
    snapshot = jobs.prepare_library(store, PICKY, SETTINGS)
    assert (snapshot.stats["library_after"], snapshot.stats["library_left_out"]) == (2, 1)
    assert [r.reason for r in store.read("quarantine").where("id = 'e'").collect()] == ["size 3 instead of 2"]


def test_jobs_leave_no_cut_tables_but_those_of_their_results(spark, store, landed):
    def folders():
        shared = Folder(spark, spark.sparkContext.getCheckpointDir())
        return {name for name in shared.names() if name.startswith("cut-")}

    before = folders()
    listing = feeds.read_listings(spark, {"quant-ph": landed["listing"]})
    metadata = feeds.read_metadata(spark, landed["metadata"])
    result = jobs.score_feed(store, listing, metadata, PICKY, SETTINGS, run_date="d")
    assert result.items.count() and result.lines.count() and result.stats.count() == 1
    assert 0 < len(folders() - before) <= 3
    jobs.sync_landed(store, landed["items"], landed["collections"], PICKY)
    assert len(folders() - before) <= 4


def test_exclusion(spark, store, landed):
    listing = feeds.read_listings(spark, {"quant-ph": landed["listing"]})
    metadata = feeds.read_metadata(spark, landed["metadata"])
    settings = Settings(threshold=0.0, excluded_collections=(" ROOT ",))
    result = jobs.score_feed(store, listing, metadata, PICKY, settings, run_date="d", short=True)
    row = result.stats.first()
    assert (row.library_before, row.library_after, row.centroids) == (12, 6, 1)
    closest = {r.closest_collection for r in result.items.collect()}
    assert closest == {"Two/"}
    everything = Settings(excluded_collections=("root", "two"), always_include_terms=("qubit",))
    nothing = jobs.score_feed(store, listing, metadata, PICKY, everything, run_date="d")
    assert nothing.empty and nothing.lines is None


def test_score_links(spark, store, landed):
    metadata = feeds.read_metadata(spark, landed["metadata"])
    settings = Settings(threshold=0.0)
    result = jobs.score_links(spark, store, landed["links"], metadata, PICKY, settings, run_date="d")
    assert {r.paper_id for r in result.items.collect()} == {"2401.00001v1", "2401.00002v2"}
    assert [(r.line_no, r.value) for r in result.extra["skipped"].collect()] == [(2, "https://example.com")]
    assert [r.paper_id for r in result.extra["missing"].collect()] == ["2401.77777"]


def test_stream_equals_batch(spark, store, landed, tmp_path):
    metadata = feeds.read_metadata(spark, landed["metadata"])
    feed = metadata.withColumn("ord", F.monotonically_increasing_id())
    source = str(tmp_path / "feed")
    for number, part in enumerate(("2401.00001v1", "2401.00002v2")):
        feed.where(F.col("paper_id") == part).coalesce(1).write.mode("append").parquet(source)
    snapshot = jobs.prepare_library(store, PICKY, SETTINGS)
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")

    def run():
        stream.score_stream(
            stream.read_feed(spark, source), snapshot, PICKY, SETTINGS, out, progress
        ).awaitTermination()
        return {r.paper_id: r.max_similarity for r in spark.read.parquet(out).collect()}

    first = run()
    assert set(first) == {"2401.00001v1", "2401.00002v2"}
    feed.where(F.col("paper_id") == "2401.00005v1").coalesce(1).write.mode("append").parquet(source)
    second = run()
    batch = jobs.score_papers(feed, snapshot, PICKY, SETTINGS).items.collect()
    want = {r.paper_id: r.max_similarity for r in batch if r.paper_id in second}
    assert set(second) == {*first, "2401.00005v1"} and second == want


def test_stream_of_papers_is_embedded(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"), buckets=2)
    papers = "id string, source string, title string, authors array<string>, abstract string, url string, " \
             "date_added string, date_published string, ord long"
    rows = [("s:1", "s", "one", [], "a", "", None, None, 0), ("s:1", "s", "two", [], "a", "", None, None, 1),
            ("s:2", "s", "", [], "", "", None, None, 2)]
    source = str(tmp_path / "papers")
    spark.createDataFrame(rows, papers).write.parquet(source)
    arriving = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    for _ in range(2):
        stream.embed_stream(arriving, store, MODEL, "s", str(tmp_path / "progress")).awaitTermination()
    assert store.paper("s:1").first().title == "two"
    assert [r.paper_id for r in store.embeddings_of(MODEL.model_id).collect()] == ["s:1"]


def test_repeats_within_the_watermark(spark, tmp_path):
    source = str(tmp_path / "events")
    rows = spark.sql(
        "select * from values ('a', timestamp'2024-01-01 00:00:00'), ('a', timestamp'2024-01-01 01:00:00'), "
        "('b', timestamp'2024-01-01 00:30:00') as t(paper_id, event_time)")
    rows.write.parquet(source)
    arriving = spark.readStream.schema(rows.schema).parquet(source)
    out = str(tmp_path / "out")
    (stream.drop_repeats(arriving).writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination())
    assert sorted(r.paper_id for r in spark.read.parquet(out).collect()) == ["a", "b"]


ITEMS = "id string, source string, title string, authors array<string>, abstract string, url string, date_added string, " \
        "date_published string, collections array<string>, ord long"


def library_items(spark, rows):
    """``(id, title, collections, ord)`` as library items with long texts."""
    return spark.createDataFrame([(i, "s", t, [], f"{t} " * 50, "", None, None, c, o) for i, t, c, o in rows], ITEMS)


def columns_cut(monkeypatch):
    """The columns of every table that the jobs and the operators below them cut from here on."""
    from vicinia import session
    from vicinia.operators import incremental, knn, ranking, relevance
    from vicinia.sources import layers

    seen, real = [], session.cut

    def cut(df):
        seen.append(set(df.columns))
        return real(df)

    for module in (session, jobs, incremental, knn, ranking, relevance, layers):
        if hasattr(module, "cut"):
            monkeypatch.setattr(module, "cut", cut)
    return seen


def test_a_sync_writes_texts_to_the_store_alone(spark, tmp_path, monkeypatch):
    store = TableStore(spark, str(tmp_path / "store"), buckets=2)
    none = spark.createDataFrame([], "key string, name string, parent_key string, ord long")
    seen = columns_cut(monkeypatch)
    rows = [(f"s:{n}", f"title {n}", ["a"], n) for n in range(6)]
    first = jobs.sync_library(store, library_items(spark, rows), none, MODEL, "s").stats.first()
    assert (first.retrieved, first.new, first.needing_embedding, first.embedded) == (6, 6, 6, 6)
    # One paper again, as two rows, and two new ones: the last row counts, and only the new ones are embedded.
    rows = [("s:3", "older", ["b"], 1), ("s:3", "newer", ["c"], 2), ("s:7", "seven", ["d"], 3), ("s:8", "eight", [], 4)]
    second = jobs.sync_library(store, library_items(spark, rows), none, MODEL, "s").stats.first()
    assert (second.retrieved, second.new, second.needing_embedding, second.embedded) == (3, 2, 2, 2)
    assert store.paper("s:3").first().title == "newer" and store.read("papers").count() == 8
    assert {r.collection_key for r in store.memberships().where("paper_id = 's:3'").collect()} == {"c"}
    assert store.read("papers").columns == PAPERS.names and store.embeddings_of(MODEL.model_id).count() == 8
    # Texts are neither cut nor, on their way to the model, dealt out anew.
    assert seen and not any({"title", "abstract", "text"} & columns for columns in seen)


def test_a_first_sync_reads_waiting_texts_where_they_lie(spark, tmp_path, monkeypatch):
    store = TableStore(spark, str(tmp_path / "store"), buckets=2)
    none = spark.createDataFrame([], "key string, name string, parent_key string, ord long")
    plans, real = [], embed.embed

    def watched(df, *args, **options):
        found = real(df, *args, **options)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(embed, "embed", watched)
    jobs.sync_library(store, library_items(spark, [(f"s:{n}", "t", [], n) for n in range(6)]), none, MODEL, "s")
    assert len(plans) == 1 and "Exchange" not in plans[0]


def test_a_digest_is_ranked_without_its_texts(spark, store, landed, monkeypatch):
    listing = feeds.read_listings(spark, {"quant-ph": landed["listing"]})
    metadata = feeds.read_metadata(spark, landed["metadata"])
    seen = columns_cut(monkeypatch)
    result = jobs.score_feed(store, listing, metadata, PICKY, SETTINGS, run_date="d")
    ranked = [columns for columns in seen if "_range" in columns]
    assert len(ranked) == 1 and not {"abstract", "top_matches"} & ranked[0]
    titles = [r.text for r in result.lines.where("line_no = 0 and rank > 0").orderBy("place", "rank").collect()]
    assert len(titles) == result.items.count() and titles[0].startswith("1. ")


def test_the_latest_of_repeats(spark):
    from vicinia.sources.layers import latest_of_repeats, latest_rows

    rows = [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"), (None, 1, "u"), (None, 3, "v"), ("c", 5, "w")]
    df = spark.createDataFrame(rows, "id string, ord long, text string")
    want = sorted(map(str, latest_rows(df, ["id"], ["ord"]).collect()))
    assert sorted(map(str, latest_of_repeats(df, ["id"], ["ord"]).collect())) == want and len(want) == 4
    once = latest_of_repeats(df.where("ord > 2"), ["id"], ["ord"])
    assert {r.text for r in once.collect()} == {"v", "w"}
