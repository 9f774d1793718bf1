"""Mergeable states of mean vectors against plain sums."""

import random

import pytest

from vicinia.operators import states


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "a string, b int, embedding array<double>")


def make(count, seed=1):
    dice = random.Random(seed)
    return [(dice.choice(["hot", "hot", "x", None]), dice.choice([1, 2, None]), [dice.random(), dice.random()]) for _ in range(count)]


def plain(rows, keys):
    out = {}
    for a, b, v in rows:
        if v is None or len(v) != 2:
            continue
        own = out.setdefault(tuple({"a": a, "b": b}[k] for k in keys), [0, 0.0, 0.0])
        own[0], own[1], own[2] = own[0] + 1, own[1] + v[0], own[2] + v[1]
    return {k: (n, round(x / n, 9), round(y / n, 9)) for k, (n, x, y) in out.items()}


def found(df, keys):
    return {tuple(r[k] for k in keys): (r["n"], *[round(x, 9) for x in r["mean"]]) for r in states.means(df).collect()}


def test_cubes_and_rollups(spark):
    rows = [*make(120), ("x", 1, None), ("x", 1, [1.0]), ("x", 2, [float("nan"), 1.0])]
    usable = [r for r in rows if r[2] is None or r[2][0] == r[2][0]]
    got = states.cube(rows_of(spark, rows), ["a", "b"], 2)
    for level, keys in enumerate([("a", "b"), ("a",), ("b",), ()]):
        assert found(got.where(f"level = {level}"), keys) == plain(usable, keys)
    assert {r["level"] for r in states.rollup(rows_of(spark, rows), ["a", "b"], 2).collect()} == {0, 1, 3}
    assert states.cube(rows_of(spark, []), ["a", "b"], 2).collect() == []


@pytest.mark.parametrize("seed", [3, 4])
def test_changes_equal_states_from_scratch(spark, seed):
    old, new = make(60, seed), [*make(20, seed + 10), ("new", 1, [1.0, 2.0])]
    gone = [r for r in old if r[0] == "x"] + old[:1]
    kept = [r for k, r in enumerate(old) if r[0] != "x" and k]
    gone = [r for r in old if r not in kept]
    stored = states.states(rows_of(spark, old), ["a"], 2)
    came, went = (states.states(rows_of(spark, r), ["a"], 2) for r in (new, gone))
    assert found(states.changed(stored, came, went, ["a"]), ["a"]) == plain(kept + new, ["a"])
    emptied = states.changed(stored, came.limit(0), stored, ["a"])
    assert emptied.collect() == []
