import random

import pytest
from pyspark.sql import functions as F

from vicinia.operators import centroids, hierarchy

SCHEMA = "key string, name string, parent_key string, ord long"


def tree(spark, rows):
    return spark.createDataFrame([(k, n, p, i) for i, (k, n, p) in enumerate(rows)], SCHEMA)


def paths(spark, rows):
    return {r.key: r.path for r in hierarchy.collection_paths(tree(spark, rows)).collect()}


def expected_paths(rows):
    """Walk up from each node in order; on a cycle the node met first is left out above."""
    parents = {k: p for k, _, p in rows}
    names = {k: (n or k).strip() for k, n, _ in rows}
    done = {}
    for key, _, _ in rows:
        chain, at = [], key
        while at in parents and at not in done and at not in chain:
            chain.append(at)
            at = parents[at]
        path = done.get(at, "") if at not in chain else ""
        for node in reversed(chain):
            path = done[node] = f"{path}{names[node]}/"
    return done


def expected_excluded(rows, names):
    parents = {k: p for k, _, p in rows}
    label = {k: (n or "").strip().lower() for k, n, _ in rows}
    out = set()
    for key in parents:
        seen, at = set(), key
        while at in parents and at not in seen:
            seen.add(at)
            if label[at] in names:
                out.add(key)
                break
            at = parents[at]
    return out


def test_paths(spark):
    rows = [
        ("c", "Child", "b"), ("b", " Mid ", "a"), ("a", "Top", None),
        ("orphan", "Lost", "nowhere"), ("x", "", None), ("empty", "E", ""),
    ]
    assert paths(spark, rows) == {
        "c": "Top/Mid/Child/", "b": "Top/Mid/", "a": "Top/", "orphan": "Lost/", "x": "x/", "empty": "E/",
    }


def test_cycles_are_cut_at_their_first_entry(spark):
    # A pair, a node above itself, and a tail that comes first and enters its cycle at Y.
    rows = [("A", "A", "B"), ("B", "B", "A"), ("S", "S", "S"),
            ("tail", "t", "Y"), ("X", "X", "Y"), ("Y", "Y", "Z"), ("Z", "Z", "X")]
    got = paths(spark, rows)
    assert got == expected_paths(rows)
    assert (got["A"], got["B"], got["S"]) == ("B/A/", "B/", "S/")


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests_with_cycles(spark, seed):
    rng = random.Random(seed)
    keys = [f"k{i}" for i in range(60)]
    rng.shuffle(keys)
    rows = [(k, f"n{k}", rng.choice([None, "gone", *keys, *keys, *keys])) for k in keys]
    assert paths(spark, rows) == expected_paths(rows)
    names = ["NK3", " nk7 ", "nk11"]
    got = hierarchy.excluded_collections(tree(spark, rows), names)
    assert {r.key for r in got.collect()} == expected_excluded(rows, {"nk3", "nk7", "nk11"})


def test_deep_chain(spark):
    rows = [(f"k{i}", f"{i}", f"k{i - 1}" if i else None) for i in range(100)]
    got = paths(spark, rows)
    assert got["k99"] == "".join(f"{i}/" for i in range(100))


def test_exclusion_is_inherited(spark):
    rows = [("a", "Archive ", None), ("b", "x", "a"), ("c", "y", "b"), ("d", "other", None)]
    got = hierarchy.excluded_collections(tree(spark, rows), [" aRCHIVE"])
    assert {r.key for r in got.collect()} == {"a", "b", "c"}
    assert hierarchy.excluded_collections(tree(spark, rows), ["", " "]).isEmpty()


def test_only_fully_excluded_papers_go(spark):
    excluded = spark.createDataFrame([("a",), ("b",)], "key string")
    members = spark.createDataFrame(
        [("all", "a"), ("all", "b"), ("some", "a"), ("some", "c"), ("dangling", "a"), ("dangling", "gone")],
        "paper_id string, collection_key string",
    )
    lib = spark.createDataFrame([("all",), ("some",), ("dangling",), ("none",)], "paper_id string")
    kept = hierarchy.library_after_exclusion(lib, members, excluded)
    assert {r.paper_id for r in kept.collect()} == {"some", "dangling", "none"}
    lists = {r.paper_id: r.collection_keys for r in hierarchy.collection_lists(members).collect()}
    assert lists["some"] == ["a", "c"]


def test_centroids(spark):
    cols = tree(spark, [("k1", "Same", None), ("k2", "Same", None), ("k3", "Empty", None), ("k4", "Sub", "k1")])
    members = spark.createDataFrame(
        [("p1", "k1"), ("p2", "k1"), ("p2", "k1"), ("p3", "k2"), ("p4", "k4"), ("unembedded", "k4"),
         ("unembedded", "k3"), ("p1", "gone")],
        "paper_id string, collection_key string",
    )
    vecs = spark.createDataFrame(
        [("p1", [1.0, 0.0]), ("p2", [0.0, 3.0]), ("p3", [5.0, 5.0]), ("p4", [2.0, 2.0])],
        "paper_id string, embedding array<double>",
    )
    all_paths = hierarchy.collection_paths(cols)
    got = {
        r.collection_path: r.centroid
        for r in centroids.collection_centroids(cols, all_paths, members, vecs).collect()
    }
    # k1 and k2 share a path: the later one stands for it. Sub is not rolled up.
    assert got == {"Same/": [5.0, 5.0], "Same/Sub/": [2.0, 2.0]}
    found = centroids.collection_centroids(cols.where("key <> 'k2'"), all_paths, members, vecs)
    assert {r.collection_path: r.centroid for r in found.collect()}["Same/"] == pytest.approx([0.5, 1.5])
    # Excluding one of the two bars the path of both.
    gone = spark.createDataFrame([("k1",)], "key string")
    left = centroids.without_excluded(
        spark.createDataFrame([(p, c, 0) for p, c in got.items()],
                              "collection_path string, centroid array<double>, ord long"),
        all_paths, gone,
    )
    assert [r.collection_path for r in left.collect()] == ["Same/Sub/"]
    assert found.select(F.count(F.lit(1))).first()[0] == 2
