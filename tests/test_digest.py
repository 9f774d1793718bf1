import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from vicinia.operators import digest, embed, ranking, relevance
from vicinia.schemas import DIGEST_ITEMS, FEED
from vicinia.functions import text


def items(spark, rows):
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in DIGEST_ITEMS.fields) + ", ord long"
    full = []
    for number, row in enumerate(rows):
        base = {"authors": [], "is_update": False, "override_by_terms": False, "override_terms": [],
                "top_matches": [], "ord": number, **row}
        full.append(tuple(base.get(name) for name in [*DIGEST_ITEMS.fieldNames(), "ord"]))
    return spark.createDataFrame(full, fields)


THREE = [
    {"paper_id": "0901.00010", "title": "Salt Marsh Survey", "authors": ["Ines Prado", "Wu"],
     "abstract": "Plots were revisited.", "url": "https://example.org/10",
     "max_similarity": 0.7261, "closest_collection": "coast/marsh", "closest_collection_score": 0.5127},
    {"paper_id": "0901.00011", "title": "A Note on Dunes", "abstract": "z" * 301, "url": "see 11",
     "max_similarity": 0.0405, "override_by_terms": True, "override_terms": ["dune", "wind blown"]},
    {"paper_id": "0901.00012v5", "title": "Kelp, Fifth Draft", "authors": ["Oda Lind"],
     "abstract": "left out", "url": "see 12", "max_similarity": 0.6, "is_update": True},
]


def read(lines):
    return [r.text for r in digest.in_order(lines).collect()]


def test_full_text(spark):
    got = read(digest.digest_lines(items(spark, THREE), "2009-01-31"))
    assert got == [
        "arXiv Feed Digest – 2009-01-31", "=" * 50, "Found 3 relevant arXiv items.",
        "New listings: 2", "Updates: 1", "",
        "New listings", "-" * 50,
        "1. Salt Marsh Survey", "   Authors:    Ines Prado, Wu", "   URL:        https://example.org/10",
        "   Similarity: 0.7261", "   Abstract:   Plots were revisited.", "   Collection: coast/marsh (0.513)", "",
        "2. A Note on Dunes", "   URL:        see 11", "   Similarity: 0.0405",
        "   Override:   keyword(s): dune, wind blown", "   Abstract:   " + "z" * 300 + "…", "",
        "Updates", "-" * 50, "1. Kelp, Fifth Draft",
    ]


def test_short_text_and_subject(spark):
    rows = items(spark, [{**THREE[0], "title": ""}, THREE[2]])
    assert read(digest.digest_lines(rows, "2009-01-31", short=True)) == [
        "", "Found 2 relevant item(s): 1 new listing(s), 1 update(s).", "",
        "New listings", "-" * 50, "1. (no title)", "   Authors:    Ines Prado, Wu",
        "   URL:        https://example.org/10", "   Similarity: 0.7261", "",
        "Updates", "-" * 50, "1. Kelp, Fifth Draft", "",
    ]
    one = items(spark, [{**THREE[2], "title": None}])
    assert read(digest.digest_lines(one, "d"))[2:] == [
        "Found 1 relevant arXiv item.", "New listings: 0", "Updates: 1", "", "Updates", "-" * 50, "1. Unknown title",
    ]
    assert digest.subject(one, "d").first()[0] == "[arXiv Feed] 1 relevant arXiv item – d"
    assert read(digest.digest_lines(items(spark, []), "d")) == []


def test_text_sink_keeps_order(spark, tmp_path):
    lines = digest.digest_lines(items(spark, THREE), "2009-01-31")
    digest.write_text(lines, str(tmp_path / "text"))
    parts = sorted((tmp_path / "text").glob("part-*"))
    assert "".join(p.read_text() for p in parts).splitlines() == read(lines)


def test_order_is_score_then_feed_order(spark):
    rows = items(spark, [
        {"paper_id": "none", "max_similarity": None}, {"paper_id": "b", "max_similarity": 0.5},
        {"paper_id": "a", "max_similarity": 0.5}, {"paper_id": "zero", "max_similarity": 0.0},
        {"paper_id": "u", "max_similarity": 0.9, "is_update": True},
    ])
    got = {(r.section, r["rank"]): r.paper_id for r in digest.ranked(rows).collect()}
    assert got == {("new", 1): "b", ("new", 2): "a", ("new", 3): "none", ("new", 4): "zero", ("update", 1): "u"}


def test_rank_of_one_hot_group(spark):
    rng = random.Random(4)
    groups = ["hot"] * 7 + ["cold", None]
    rows = [(rng.choice(groups), rng.randint(0, 3), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v long, i long").repartition(7)
    ranked = ranking.distributed_rank(df, ["g"], [F.col("v").desc(), F.col("i")])
    want = {}
    for group in ("hot", "cold", None):
        for place, row in enumerate(sorted((r for r in rows if r[0] == group), key=lambda r: (-r[1], r[2])), 1):
            want[row[2]] = place
    assert {r.i: r["rank"] for r in ranked.collect()} == want


def test_gate(spark):
    cases = [(0.5, [], True, True, False), (0.49, [], False, False, False), (0.9, ["t"], True, True, False),
             (0.1, ["t"], False, True, True), (None, ["t"], False, True, True), (None, [], False, False, False)]
    rows = spark.createDataFrame(
        cases, "score double, matched_terms array<string>, rel boolean, inc boolean, over boolean")
    for r in relevance.judge(rows, 0.5).collect():
        assert (r.is_relevant, r.included, r.override_by_terms) == (r.rel, r.inc, r.over)
        assert r.override_terms == (r.matched_terms if r.over else [])


def test_forced_papers_are_completed(spark):
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FEED.fields) + ", ord long"
    feed = spark.createDataFrame(
        [(k, t, [], "", "u", None, None, False, [], i) for i, (k, t) in enumerate(
            [("in", "has Qubit"), ("out", "also qubit"), ("other", "nothing")])], fields)
    have = items(spark, [{"paper_id": "in", "max_similarity": 0.3}])
    rows = {r.paper_id: r for r in relevance.complete_forced(feed, have, ["qubit"]).collect()}
    assert set(rows) == {"in", "out"}
    assert rows["out"].max_similarity == 0.0 and rows["out"].override_terms == ["qubit"]
    assert rows["out"].override_by_terms and rows["out"].closest_collection is None
    assert [r.paper_id for r in relevance.missing_forced(feed, have, ["qubit"]).collect()] == ["out"]


def test_preview_and_skip_report(spark):
    rows = spark.createDataFrame([(f"p{i:02d}", "" if i else "T") for i in range(12)], "id string, title string")
    got = digest.preview(rows).collect()
    assert len(got) == 10 and got[0].label == "T" and got[1].label == "p01"
    skipped = spark.createDataFrame([("f", i, f"v{i}") for i in range(12)], "path string, line_no long, value string")
    report = digest.skip_report(skipped).collect()
    assert len(report) == 10 and {(r.skipped, r.not_shown) for r in report} == {(12, 2)}


# Workers cannot import test modules.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Flaky:
    """Fails on one word, alone or in a batch; gives an unusable vector for another."""

    calls = []

    def __init__(self, name):
        self.name = name

    def embed_batch(self, texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("cannot embed")
        return [[float("nan"), 1.0] if "nan" in t else [float(len(t)), 1.0] for t in texts]


def test_one_bad_text_costs_only_its_row(spark):
    embed.register_provider("flaky", Flaky)
    rows = spark.createDataFrame(
        [(i, t) for i, t in enumerate(["a", "bb", "bad", "nan", "ccc"])], "k long, text string").coalesce(1)
    done = embed.embed(rows, embed.model("Flaky", "m"))
    good, bad = embed.split_errors(done)
    assert {r.k: r.embedding for r in good.collect()} == {0: [1.0, 1.0], 1: [2.0, 1.0], 4: [3.0, 1.0]}
    errors = {r.k: r.error for r in bad.collect()}
    assert errors[2] == "RuntimeError: cannot embed" and "not finite" in errors[3]


def test_models():
    with pytest.raises(ValueError, match="Unknown embedding provider"):
        embed.model("nonexistent", "model-x")
    assert embed.model("hash", "64").model_id == "hash/64"


def test_batches_have_the_wanted_size():
    sizes = []

    class Counting:
        def embed_batch(self, texts):
            sizes.append(len(texts))
            return [[1.0]] * len(texts)

    model = embed.model("hash")
    object.__setattr__(model, "factory", lambda name: Counting())
    object.__setattr__(model, "provider", "counting")
    embedder = model.load()
    assert embedder is model.load()
    embedder.embed_batch(["x"] * 32)
    assert sizes == [32] and embed.BATCH_SIZE == 32


def test_token_hash_vectors_have_length_one():
    model = embed.TokenHashEmbedder("16")
    one, other, none = model.embed_batch(["Some words here", "some  WORDS\nhere ", " "]).tolist()
    assert one == other and sum(x * x for x in one) == pytest.approx(1.0) and none == [0.0] * 16


def test_text_to_embed_is_not_blank(spark):
    rows = spark.createDataFrame(
        [("a", "", [], ""), ("b", "  ", [], ""), ("c", "", [], " \n"), ("d", None, None, None)],
        "paper_id string, title string, authors array<string>, abstract string")
    got = {r.paper_id: r.text for r in embed.with_text(rows).collect()}
    assert got == {"b": "Title:   ", "c": "Abstract:  \n"}
    assert text.has_text is not None
