"""k-NN, outlier factor and vectors, against brute force in NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinia.functions import vectors
from vicinia.operators import lof
from vicinia.operators.centroids import nearest_collection
from vicinia.operators.knn import knn, vector_profile

LIB = "paper_id string, ord long, embedding array<double>"
QRY = "query_id string, embedding array<double>"


def library(spark, rows):
    return spark.createDataFrame([(k, i, v) for i, (k, v) in enumerate(rows)], LIB)


def queries(spark, *vectors_):
    return spark.createDataFrame([(f"q{i}", list(v)) for i, v in enumerate(vectors_)], QRY)


def unit(matrix):
    n = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, n, out=np.zeros_like(matrix), where=n > 0)


def brute(q, lib, k, same=False):
    d = np.round(np.clip(1.0 - unit(q) @ unit(lib).T, 0, 2), 12)
    if same:
        np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return {
        (str(i), r + 1): (str(j), d[i, j])
        for i in range(len(q)) for r, j in enumerate(order[i]) if np.isfinite(d[i, j])
    }


def brute_scores(q, lib, neighbors):
    k = max(2, min(neighbors, len(lib) - 1))
    own = brute(lib, lib, k, same=True)
    dist = np.array([[own[str(i), r + 1][1] for r in range(k)] for i in range(len(lib))])
    who = np.array([[int(own[str(i), r + 1][0]) for r in range(k)] for i in range(len(lib))])
    kdist = dist.max(axis=1)
    lrd = 1.0 / (np.maximum(dist, kdist[who]).mean(axis=1) + 1e-10)
    ask = brute(q, lib, k)
    dist = np.array([[ask[str(i), r + 1][1] for r in range(k)] for i in range(len(q))])
    who = np.array([[int(ask[str(i), r + 1][0]) for r in range(k)] for i in range(len(q))])
    own = 1.0 / (np.maximum(dist, kdist[who]).mean(axis=1) + 1e-10)
    factor = lrd[who].mean(axis=1) / own
    return 1.0 / (1.0 + np.exp(-np.clip(1.5 - factor, -60, 60)))


def clustered(rng, n, dim=8, copies=0.0, zeros=0):
    centers = rng.normal(size=(6, dim))
    data = centers[rng.integers(0, 6, n)] + 0.05 * rng.normal(size=(n, dim))
    if copies:
        data[rng.random(n) < copies] = data[0]
    if zeros:
        data[rng.choice(n, zeros, replace=False)] = 0.0
    return data


def as_library(spark, data):
    return spark.createDataFrame([(str(i), i, list(map(float, v))) for i, v in enumerate(data)], LIB)


def as_queries(spark, data):
    return spark.createDataFrame([(str(i), list(map(float, v))) for i, v in enumerate(data)], QRY)


def found(df):
    return {(r.query_id, r["rank"]): (r.neighbor_id, r.distance) for r in df.collect()}


def assert_same(got, want):
    assert got.keys() == want.keys()
    for key, (who, distance) in want.items():
        assert got[key][1] == pytest.approx(distance, abs=2e-12), key
        assert got[key][0] == who, key


@pytest.mark.parametrize("strategy", ["library", "queries", "cells"])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_all_plans_equal_brute_force(spark, strategy, exclude_self):
    # A third of the rows are copies of one vector, and some have no length.
    data = clustered(np.random.default_rng(7), 400, copies=0.33, zeros=12)
    got = knn(
        as_queries(spark, data), as_library(spark, data), 7,
        exclude_self=exclude_self, strategy=strategy, block_rows=25,
    )
    assert_same(found(got), brute(data, data, 7, same=exclude_self))


@pytest.mark.parametrize("strategy", ["library", "queries", "cells"])
def test_fewer_rows_than_neighbours(spark, strategy):
    data = clustered(np.random.default_rng(3), 5, zeros=2)
    got = knn(as_queries(spark, data), as_library(spark, data), 9, strategy=strategy, block_rows=2)
    assert_same(found(got), brute(data, data, 9))


def test_only_zero_vectors(spark):
    data = np.zeros((6, 3))
    got = knn(as_queries(spark, data), as_library(spark, data), 2, strategy="cells", block_rows=2)
    assert_same(found(got), brute(data, data, 2))


def test_cells_leave_far_cells_out():
    """Tight clusters: a query's bound rules out most cells."""
    from vicinia.operators import knn as module

    data = clustered(np.random.default_rng(1), 600)
    pivots = module._far_apart(unit(data), 24)
    gap = module._lengths(unit(data), pivots)
    cell = gap.argmin(axis=1)
    radius = gap[np.arange(len(cell)), cell]
    each = range(len(pivots))
    stats = module._CellStats(
        pivots=pivots,
        n=np.bincount(cell, minlength=len(pivots)),
        inner=np.array([radius[cell == c].min(initial=2.0) for c in each]),
        outer=np.array([radius[cell == c].max(initial=0.0) for c in each]),
        zeros=0,
    )
    want = brute(data, data, 5)
    bound = np.array([want[str(i), 5][1] for i in range(len(data))])
    rows, cells = stats.later_visits(unit(data), bound, 5)
    assert len(rows) < len(data) * len(pivots) / 3
    # No cell left out holds a neighbour.
    seen = {*zip(rows.tolist(), cells.tolist()), *zip(*[x.tolist() for x in stats.first_visit(unit(data), 5)])}
    for (query, _), (neighbour, _) in want.items():
        assert (int(query), int(cell[int(neighbour)])) in seen


def test_sizes_choose_the_plan(spark):
    data = clustered(np.random.default_rng(5), 60)
    lib, ask = as_library(spark, data), as_queries(spark, data[:4])
    want = brute(data[:4], data, 3)
    for budget in (1 << 20, 60 * 8 * 8 - 1, 4 * 8 * 8 - 1):
        assert_same(found(knn(ask, lib, 3, broadcast_bytes=budget, block_rows=10)), want)


def test_invalid_vectors_are_left_out(spark):
    lib = library(
        spark,
        [("a", [1.0, 0.0]), ("nan", [float("nan"), 0.0]), ("long", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0]),
         ("none", None), ("inf", [float("inf"), 1.0])],
    )
    assert vector_profile(lib) == (2, 2)
    got = found(knn(queries(spark, [1.0, 0.0], [1.0]), lib, 5))
    assert {k: v[0] for k, v in got.items()} == {("q0", 1): "a", ("q0", 2): "b"}


def test_cosine(spark):
    rng = np.random.default_rng(31)
    pairs = [*rng.normal(size=(6, 2, 4)), np.array([[2.0, -1.0, 0.5, 3.0], [0.0] * 4])]
    pairs.append(np.array([pairs[0][0], -2.5 * pairs[0][0]]))
    wanted = [float(unit(p)[0] @ unit(p)[1]) for p in pairs]
    cases = [(p[0].tolist(), p[1].tolist(), w) for p, w in zip(pairs, wanted, strict=True)]
    rows = spark.createDataFrame(cases, "a array<double>, b array<double>, wanted double")
    for row in rows.withColumn("got", vectors.cosine("a", "b")).collect():
        assert row.got == pytest.approx(row.wanted)


def test_unit(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in rows.select(vectors.unit("v")).collect()] == [[0.6, 0.8], [0.0, 0.0]]


def scores(spark, ask, lib, **options):
    rows = lof.score(ask, lof.fit(lib), **options).collect()
    return {r.query_id: r for r in rows}


def test_tiny_libraries_score_by_mean_similarity(spark):
    rng = np.random.default_rng(32)
    asked, data = rng.normal(size=(1, 5)), rng.normal(size=(2, 5))
    near = unit(asked) @ unit(data).T
    for rows in (1, 2):
        got = scores(spark, as_queries(spark, asked), as_library(spark, data[:rows]))["0"]
        assert got.score == pytest.approx((near[0, :rows].mean() + 1) / 2)
        assert [m.similarity for m in got.top_matches] == pytest.approx(sorted(near[0, :rows], reverse=True))


def test_empty_library_scores_nothing(spark):
    assert scores(spark, queries(spark, [1.0, 0.0]), spark.createDataFrame([], LIB)) == {}


def test_top_matches_are_the_most_similar_first(spark):
    rng = np.random.default_rng(33)
    data, asked = rng.normal(size=(14, 6)), rng.normal(size=(3, 6))
    got = scores(spark, as_queries(spark, asked), as_library(spark, data), top_k=4)
    near = unit(asked) @ unit(data).T
    for q in range(3):
        order = np.argsort(-near[q])[:4]
        assert [m.title for m in got[str(q)].top_matches] == [str(k) for k in order]
        assert [m.similarity for m in got[str(q)].top_matches] == pytest.approx(near[q][order])
    listed = lof.top_matches(as_queries(spark, asked), as_library(spark, data), 2).where("rank = 1").collect()
    assert {r.query_id: r.neighbor_id for r in listed} == {str(q): str(near[q].argmax()) for q in range(3)}


def test_density_tells_members_from_strangers(spark):
    rng = np.random.default_rng(23)
    data = rng.normal([4.0, 1.0, 0.5], 0.2, (9, 3))
    asked = np.array([[4.1, 0.9, 0.4], [-2.0, 3.0, 1.0]])
    got = scores(spark, as_queries(spark, asked), as_library(spark, data))
    want = brute_scores(asked, data, 20)
    assert [got[k].score for k in sorted(got)] == pytest.approx(list(want), abs=1e-9)
    assert got[sorted(got)[0]].score > 0.5 > got[sorted(got)[1]].score


@pytest.mark.parametrize("strategy", ["library", "cells"])
def test_scores_equal_brute_force(spark, strategy):
    rng = np.random.default_rng(11)
    data, asked = clustered(rng, 150, copies=0.2), clustered(rng, 40)
    fitted = lof.fit(as_library(spark, data), 20, strategy=strategy, block_rows=40)
    rows = lof.score(as_queries(spark, asked), fitted, strategy=strategy, block_rows=40).collect()
    want = brute_scores(asked, data, 20)
    assert len(rows) == 40
    for row in rows:
        assert row.score == pytest.approx(want[int(row.query_id)], abs=1e-8)


def test_routing_many_pivots_needs_little_memory():
    import tracemalloc

    import pyarrow as pa

    from vicinia.operators import knn as plans

    pivots = 100_000
    batch = pa.record_batch({"x": pa.array(range(10_000))})
    rows = [b.num_rows for b in plans._slices(iter([batch]), pivots)]
    assert sum(rows) == 10_000 and max(rows) * pivots <= plans.GAPS_AT_ONCE
    rng = np.random.default_rng(1)
    stats = plans._CellStats(unit(rng.normal(size=(pivots, 4))), np.ones(pivots, int), np.zeros(pivots), np.zeros(pivots), 0)
    tracemalloc.start()
    stats.later_visits(unit(rng.normal(size=(max(rows), 4))), np.full(max(rows), 0.01), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 600e6


def test_neighbours_are_capped_by_library_size():
    assert lof.effective_neighbors(20, 5) == 4
    assert lof.effective_neighbors(20, 3) == 2
    assert lof.effective_neighbors(1, 100) == 2


def test_nearest_collection_takes_the_first_of_equals(spark):
    cents = spark.createDataFrame(
        [("z/", [1.0, 0.0], 0), ("a/", [2.0, 0.0], 1), ("o/", [0.0, 1.0], 2)],
        "collection_path string, centroid array<double>, ord long",
    )
    row = nearest_collection(queries(spark, [1.0, 0.1]), cents).first()
    assert row.closest_collection == "z/"
    assert row.closest_collection_score == pytest.approx(1 / math.sqrt(1.01))
    assert nearest_collection(queries(spark, [1.0, 0.1]), cents.where(F.lit(False))).isEmpty()


def test_mean_similarity(spark):
    lib = library(spark, [("l", [0.0, 1.0]), ("m", [1.0, 0.0])])
    assert lof.mean_similarity(queries(spark, [1.0, 0.0]), lib).first().mean_similarity == pytest.approx(0.5)


def test_cells_shuffle_no_vector_to_the_cells_it_visits(spark):
    data = np.random.default_rng(2).normal(size=(120, 8))
    got = knn(as_queries(spark, data), as_library(spark, data), 3, strategy="cells", block_rows=20)
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "CoGroup" not in plan
    assert_same(found(got), brute(data, data, 3))


def test_running_lists_keep_ties_by_place_within_a_bound():
    from vicinia.operators import knn as plans

    rng = np.random.default_rng(4)
    data = unit(rng.integers(0, 2, (90, 4)).astype(float) + [1.0, 0, 0, 0])
    want = brute(data, data, 5)
    bound = np.array([want[str(i), 5][1] for i in range(90)])
    for start in (np.full(90, 2.0), bound):
        lists = plans._Lists(data, start, 5)
        for places in np.split(rng.permutation(90), 6):
            lists.meet(data[np.sort(places)], np.sort(places), np.arange(90))
        assert [[str(p) for p in row] for row in lists.places] == [[want[str(i), r][0] for r in range(1, 6)] for i in range(90)]


def test_pairs_nearer_than_single_precision_tells_apart_are_ranked_right():
    from vicinia.operators import knn as plans

    rng = np.random.default_rng(8)
    # Rows around one direction, whose distances differ from the tenth digit on, among others far away.
    data = unit(np.concatenate([np.r_[1.0, np.zeros(15)] + 2e-6 * rng.normal(size=(700, 16)), rng.normal(size=(700, 16))]))
    data = data[rng.permutation(len(data))]
    asked = np.concatenate([data[:40], unit(rng.normal(size=(8, 16)))])
    want = brute(asked, data, 6)
    lists = plans._Lists(asked, np.full(len(asked), 2.0), 6)
    for places in np.split(rng.permutation(len(data)), 2):
        lists.meet(data[np.sort(places)], np.sort(places), np.arange(len(asked)))
    for i in range(len(asked)):
        assert list(lists.distances[i]) == pytest.approx([want[str(i), r][1] for r in range(1, 7)], abs=2e-12)
    # Rounding may order two rows differently only where their distances round to neighbouring numbers.
    exact = np.round(np.clip(1.0 - asked @ data.T, 0, 2), 12)
    assert np.abs(np.take_along_axis(exact, lists.places, 1) - lists.distances).max() <= 2e-12


def test_few_pairs_are_worked_out_in_double_precision(monkeypatch):
    from vicinia.operators import knn as plans

    rng = np.random.default_rng(9)
    data = unit(rng.normal(size=(3000, 24)))
    want = brute(data[:200], data, 5)
    bound = np.array([want[str(i), 5][1] for i in range(200)])
    worked, note = [], plans._Lists._note
    monkeypatch.setattr(plans._Lists, "_note", lambda self, owner, *rest: (worked.append(len(owner)), note(self, owner, *rest))[1])
    lists = plans._Lists(data[:200], bound, 5)
    for places in np.split(np.arange(3000), 3):
        lists.meet(data[places], places, np.arange(200))
    # Five a query, and what lies within the error of a single product of the bound.
    assert 1000 <= sum(worked) <= 1010
    assert [[str(p) for p in row] for row in lists.places] == [[want[str(i), r][0] for r in range(1, 6)] for i in range(200)]


def test_a_slice_meets_its_own_blocks_in_one_task_and_goes_on_with_its_bound(spark, monkeypatch):
    from vicinia.operators import knn as plans

    written, cut = [], plans.cut
    monkeypatch.setattr(plans, "cut", lambda df: (written.append(cut(df)), written[-1])[1])
    data = clustered(np.random.default_rng(12), 200)
    want = brute(data, data, 3)
    got = knn(as_queries(spark, data), as_library(spark, data), 3, strategy="cells", block_rows=10)
    rows = written[-1].collect()
    asked = [key for row in rows for key in row["keys"]]
    assert len(asked) == len(set(asked)) == 200
    assert all(len(row["bound"]) == len(row["keys"]) and len(row["vectors"]) == len(row["keys"]) * 8 * 8 for row in rows)
    # No bound is below the distance that it bounds.
    assert sorted(b for row in rows for b in row["bound"])[0] >= min(want[str(i), 3][1] for i in range(200)) - 2e-12
    assert_same(found(got), want)
