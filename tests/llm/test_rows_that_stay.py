"""Many labels, no labels, and rows that share an ID: nothing that should stay goes."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vicinia.llm import language, neighbours, shards

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in rows], DOCS)


def words(seed, count=60):
    dice = random.Random(seed)
    return " ".join("".join(dice.choices("abcdefghij", k=5)) for _ in range(count))


def test_a_thousand_labels_are_all_learned(spark):
    dice = random.Random(1)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 1000)]
    rows = [(k, letters[k] * 3 + " " + letters[k] * 2, f"l{k:04d}") for k in range(1000)]
    rows += [(1000 + k, "the of and " * dice.randint(1, 3), "l0000") for k in range(500)]
    docs = docs_of(spark, rows)
    runs, labels, languages = language.sample(docs, "text", "lang", "doc_id", language.SAMPLE_PER_LANGUAGE, 20)
    assert len(languages) == 1000 and set(labels) == set(range(1000))
    model = language.fit(runs[:200], np.arange(200) % 100, languages[:100])
    assert model.weight.shape == (language.DIMENSION, 100) and model.logits.shape == (language.BUCKETS, language.DIMENSION)
    trained = language.train(docs, sample_runs=8)
    found = language.predict(docs, trained, keep=("doc_id",)).collect()
    assert len(found) == 1500 and {r["lang_pred"] for r in found} <= set(languages)


def test_samples_are_bounded_and_keep_rare_labels(spark):
    rows = [(k, "x y z", "en") for k in range(4000)] + [(5000, "rare one", "fr"), (None, "no id", "de")]
    rows += [(None, f"none {k}", "en") for k in range(500)] + [(7, "x y z", "en")] * 500
    runs, labels, languages = language.sample(docs_of(spark, rows), "text", "lang", "doc_id", 100, 50)
    assert languages == ("de", "en", "fr") and set(labels) == {0, 1, 2}
    assert len(runs) < 250


def test_predictions_equal_a_plain_softmax(spark):
    """Running sums over slices against one text at a time, with few and with many labels."""
    texts = [words(k, 5 + k) for k in range(30)] + ["é ü 日本", "a", " ", "ab", "A b!C"]
    for count in (3, 40):
        docs = docs_of(spark, [(k, t, f"l{k % count}") for k, t in enumerate(texts * 2)])
        model = language.train(docs)
        got = {r["doc_id"]: r for r in language.predict(docs, model, keep=("doc_id",)).collect()}
        for k, text in enumerate(texts):
            own = np.frombuffer(b" " + text.encode() + b" ", np.uint8)
            mean = model.logits[np.concatenate(language.run_buckets(own))].astype(np.float64).mean(axis=0)
            x = np.exp((x := model.raw(mean) / model.temperature) - x.max())
            x /= x.sum()
            if not any(c.isalpha() for c in text):
                assert (got[k]["lang_pred"], got[k]["score"]) == ("und", 0)
                continue
            assert got[k]["score"] == pytest.approx(x.max(), abs=1e-6)
            if np.sort(x)[-1] - np.sort(x)[-2] > 1e-6:
                assert got[k]["lang_pred"] == model.languages[int(x.argmax())]


def test_without_labels_only_rows_without_letters_go(spark):
    docs = docs_of(spark, [(1, "some words", None), (2, None, None), (3, "12 34", None), (4, "日本", None)])
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4]


def test_rows_of_one_id_are_told_apart_by_text(spark):
    one, two, three = words(1), words(2), words(3)
    rows = [
        (5, one, "a"), (5, two, "a"), (6, two + " tail", "a"), (7, one + " tail", "a"), (8, three, "b"), (8, three, "a"),
        (None, words(4), "a"), (None, words(4) + " tail", "a"), (None, words(5), "a"), (9, words(5), "a"), (None, None, "a"),
    ]
    docs = docs_of(spark, rows).withColumns({"node": F.lit(1), "c0": F.lit("x"), "fate": F.lit("goes")})
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    found = sorted(((r["doc_id"], r["text"], r["lang"]) for r in kept.collect()), key=str)
    # The first row of the null IDs that share a passage is either: they tie.
    texts = [(i, t) for i, t, _ in found]
    assert (5, one) in texts and (5, two) in texts and (8, three, "a") in found and (9, words(5)) in texts
    assert (None, None) in texts
    assert sum(t in (words(4), words(4) + " tail") for i, t in texts) == 1
    assert len(found) == 6


def test_neighbours_of_products_that_overflow(spark):
    rows = [(k, [1e200, 1e200]) for k in range(44)] + [(44, [-1e200, 1.0]), (45, [1e200, -1e200])]
    found = neighbours.search(
        spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.pmod(F.col("id"), F.lit(20)) == 0
    ).collect()
    assert {r["query_id"] for r in found} == {0, 20, 40}
    for query in (0, 20, 40):
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == query)
        assert [v for _, v, _ in own] == [k for k in range(44) if k != query][:20]
        assert {s for _, _, s in own} == {float("inf")}


def test_shards_give_back_whole_rows(spark, tmp_path):
    docs = docs_of(spark, [(k, f"text {k}", "en") for k in range(50)] + [(None, None, None), (3, "other", "de")])
    names = [f"s{k}" for k in range(5)]
    placed = shards.place(docs, ["doc_id"], names, size=101)
    path = str(tmp_path / "shards")
    shards.write(placed, path)
    back = shards.read(spark, path, placed.schema)
    assert sorted(map(str, back.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    table = shards.lookup_table(names, 101)
    one = shards.read(spark, path, placed.schema, "s2")
    assert {f.split("shard=")[1].split("/")[0] for f in one.inputFiles()} <= set(names)
    for r in back.collect():
        mark = "-" if r["doc_id"] is None else f"+{r['doc_id']}"
        assert r["shard"] == names[table[int(hashlib.md5(mark.encode()).hexdigest()[:12], 16) % 101]]
    assert one.count() == sum(r["shard"] == "s2" for r in back.collect())
