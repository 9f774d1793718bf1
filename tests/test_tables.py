import pytest
from pyspark.sql import functions as F

from vicinia.operators import embed
from vicinia.schemas import PAPERS
from vicinia.sources.layers import KEPT
from vicinia.sources.tables import TableStore


def papers(spark, *rows):
    """Rows of (id, source, title, authors) with nothing else filled in."""
    full = [(i, s, t, a, None, None, None, None, n) for n, (i, s, t, a) in enumerate(rows)]
    return spark.createDataFrame(full, ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in PAPERS.fields) + ", ord long")


def vecs(spark, *rows):
    return spark.createDataFrame(list(rows), "paper_id string, embedding array<double>")


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "store"), buckets=3)


def test_papers(spark, store):
    assert store.read("papers").isEmpty() and store.paper("p1").isEmpty()
    store.upsert_papers(papers(
        spark, ("p1", "zotero", "Old title", ["Alice", "Bob"]), ("p2", "arxiv", "Feed", None),
        ("p1", "zotero", "Newer title", ["Alice", "Bob"]),
    ))
    row = store.paper("p1").first()
    assert (row.title, row.authors, row.source) == ("Newer title", ["Alice", "Bob"], "zotero")
    assert store.paper("p2").first().authors == []
    assert store.paper("does:not:exist").isEmpty()
    assert [r.id for r in store.papers_of("arxiv").collect()] == ["p2"]
    # A whole row is replaced, with its source; nulls overwrite.
    store.upsert_papers(papers(spark, ("p1", "arxiv", None, None), ("p3", "zotero", "Third", [])))
    row = store.paper("p1").first()
    assert (row.title, row.authors, row.source) == (None, [], "arxiv")
    assert {r.id for r in store.read("papers").collect()} == {"p1", "p2", "p3"}
    before = sorted(store.read("papers").collect())
    store.upsert_papers(papers(spark, ("p3", "zotero", "Third", [])))
    assert sorted(store.read("papers").collect()) == before


def test_the_layout_belongs_to_the_data(spark, store):
    store.upsert_papers(papers(spark, ("p1", "s", "t", [])))
    again = TableStore(spark, store.root, buckets=50)
    assert again.buckets == 3
    assert again.paper("p1").first().title == "t"


def test_embeddings(spark, store):
    store.upsert_papers(papers(
        spark, ("p1", "zotero", "First", []), ("p2", "zotero", None, []), ("p3", "arxiv", "Ignored", []),
        ("p4", "zotero", "Waiting", []),
    ))
    assert not store.has_embedding("p1", "a/b")
    store.upsert_embeddings(vecs(spark, ("p1", [1.0, 2.0]), ("p2", [2.0, 0.0]), ("p3", [3.0, 0.0]),
                                 ("orphan", [4.0, 0.0])), "a/b")
    store.upsert_embeddings(vecs(spark, ("p1", [7.0, 7.0])), "other")
    store.upsert_embeddings(vecs(spark, ("p1", [9.0, 8.0])), "a/b")
    assert store.embedding("p1", "a/b").first().embedding == [9.0, 8.0]
    assert store.embedding("p1", "other").first().embedding == [7.0, 7.0]
    assert store.has_embedding("p1", "a/b") and not store.has_embedding("p4", "a/b")
    assert store.embedding("p1", "a/b").first().date_embedded is not None
    rows = embed.library_vectors(store.read("papers"), store.read("embeddings"), "zotero", "a/b")
    assert {r.paper_id: (r.title, r.embedding[0]) for r in rows.collect()} == {
        "p1": ("First", 9.0), "p2": ("", 2.0),
    }
    waiting = embed.unembedded(store.read("papers"), store.read("embeddings"), "zotero", "a/b")
    assert [r.id for r in waiting.collect()] == ["p4"]


def test_memberships(spark, store):
    lists = "paper_id string, collection_keys array<string>"
    store.replace_memberships(spark.createDataFrame(
        [("p1", ["a", "b", "a"]), ("p2", ["a"]), ("p3", ["c"])], lists))
    store.replace_memberships(spark.createDataFrame([("p1", []), ("p2", ["b"])], lists))
    assert {(r.paper_id, r.collection_key) for r in store.memberships().collect()} == {
        ("p2", "b"), ("p3", "c"),
    }
    assert [r.paper_id for r in store.members("c").collect()] == ["p3"]


def test_replaced_collections_may_derive_from_the_stored_ones(spark, store):
    cols = "key string, name string, parent_key string, ord long"
    store.replace_collections(spark.createDataFrame([("a", "A", None, 0)], cols))
    before = store.read("collections")
    for _ in range(3):
        store.replace_collections(store.read("collections").withColumn("name", F.concat("name", F.lit("!"))))
    assert [r.name for r in store.read("collections").collect()] == ["A!!!"]
    del before
    assert len(store.folder.names("collections/data")) == KEPT


def test_the_first_vector_settles_the_size_of_a_model(spark, store):
    none = spark.createDataFrame([], "paper_id string, embedding array<double>")
    assert store.settle_dimension("m", none) is None
    first = vecs(spark, ("b", [1.0]), ("a", [1.0, 2.0]), ("c", [3.0]))
    assert store.settle_dimension("m", first) == 2
    assert store.settle_dimension("m", vecs(spark, ("0", [1.0]))) == 2 and store.dimension("other") is None


def test_collections_and_centroids(spark, store):
    cols = "key string, name string, parent_key string, ord long"
    store.replace_collections(spark.createDataFrame([("a", "A", None, 0), ("b", "B", "a", 1)], cols))
    store.replace_collections(spark.createDataFrame([("c", "C", None, 0)], cols))
    assert [r.key for r in store.read("collections").collect()] == ["c"]
    cents = "collection_path string, centroid array<double>, ord long"
    store.replace_centroids(spark.createDataFrame([("A/", [1.0], 0), ("B/", [2.0], 1)], cents), "x/y:z")
    store.replace_centroids(spark.createDataFrame([("A/", [5.0], 0)], cents), "other")
    store.replace_centroids(spark.createDataFrame([("C/", [3.0], 0)], cents), "x/y:z")
    assert [(r.collection_path, r.centroid) for r in store.centroids("x/y:z").collect()] == [("C/", [3.0])]
    store.replace_centroids(spark.createDataFrame([], cents), "x/y:z")
    assert store.centroids("x/y:z").isEmpty()
    assert store.centroids("other").select(F.count(F.lit(1))).first()[0] == 1
