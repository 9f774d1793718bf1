"""Ordered work over range borders against plain loops."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from vicinia.operators import ordered


@pytest.fixture(params=[1, 9])
def ranges(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def events(seed, count=160):
    """One group holds most rows, several are small, one is null."""
    dice = random.Random(seed)
    groups = ["hot"] * 12 + ["a", "b", "c", None]
    return [(k, dice.choice(groups), dice.randint(0, 200), dice.randint(0, 9)) for k in range(count)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, g string, t int, v int")


def by_group(rows):
    rows = sorted(rows, key=lambda r: (r[1] is None, r[1] or "", r[2], r[0]))
    return [list(own) for _, own in groupby(rows, key=lambda r: r[1])]


def test_frames_and_previous_rows(spark, ranges):
    rows = events(ranges)
    got = ordered.framed(
        frame(spark, rows), ["g"], ["t", "id"], 6, {"total": F.sum("v"), "n": F.count(F.lit(1)), "first": F.min("id")}
    )
    want = {}
    for own in by_group(rows):
        for k, r in enumerate(own):
            near = own[max(0, k - 6) : k + 1]
            want[r[0]] = (sum(x[3] for x in near), len(near), min(x[0] for x in near))
    assert {r["id"]: (r["total"], r["n"], r["first"]) for r in got.collect()} == want
    got = ordered.with_previous(frame(spark, rows), ["g"], ["t", "id"], {"pid": "id", "pt": "t"})
    want = {r[0]: (own[k - 1][0], own[k - 1][2]) if k else (None, None) for own in by_group(rows) for k, r in enumerate(own)}
    assert {r["id"]: (r["pid"], r["pt"]) for r in got.collect()} == want


def test_running_totals(spark, ranges):
    rows = events(10 + ranges)
    got = ordered.running_total(frame(spark, rows), ["g"], ["t", "id"], {"total": F.col("v")})
    want = {r[0]: sum(x[3] for x in own[: k + 1]) for own in by_group(rows) for k, r in enumerate(own)}
    assert {r["id"]: r["total"] for r in got.collect()} == want


def test_asof_join(spark, ranges):
    left, right = events(20 + ranges, 90), events(30 + ranges, 60)
    # A group whose last value lies many ranges back.
    left += [(1000 + k, "far", 300 + k, 0) for k in range(60)]
    right += [(1000, "far", 1, 7), (1001, "b", 5, None), (1002, "b", 5, 3)]
    got = ordered.asof_join(
        frame(spark, left), frame(spark, right), ["g"], "t", ["id", "v"], left_id="id", right_id="id"
    )
    assert got.columns == ["id", "g", "t", "v", "last_id", "last_v"]
    want = {}
    for r in left:
        before = [x for x in right if x[1] == r[1] and x[2] <= r[2]]
        best = max(before, key=lambda x: (x[2], x[0]), default=(None,) * 4)
        want[r[0]] = (best[0], best[3])
    assert {r["id"]: (r["last_id"], r["last_v"]) for r in got.collect()} == want
    none = ordered.asof_join(
        frame(spark, left), frame(spark, right).limit(0), ["g"], "t", ["v"], left_id="id", right_id="id"
    )
    assert {r["last_v"] for r in none.collect()} == {None} and none.count() == len(left)


def test_sessions(spark, ranges):
    rows = events(40 + ranges)
    df = frame(spark, rows).withColumn("t", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, t, 0)"))
    got = ordered.sessions(df, ["g"], "t", "id", "3 MINUTES", {"sum": F.sum("v")})
    want = []
    for own in by_group(rows):
        parts = [[own[0]]]
        for r in own[1:]:
            if r[2] - parts[-1][-1][2] >= 3:
                parts.append([])
            parts[-1].append(r)
        want += [(own[0][1], k + 1, len(p), sum(x[3] for x in p), p[-1][2] - p[0][2]) for k, p in enumerate(parts)]
    found = [
        (r["g"], r["session"], r["n"], r["sum"], int((r["end"] - r["start"]).total_seconds() // 60)) for r in got.collect()
    ]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_ordered_work_on_empty_tables(spark):
    none = frame(spark, events(1, 5)).limit(0)
    assert ordered.framed(none, ["g"], ["t", "id"], 2, {"n": F.count(F.lit(1))}).collect() == []
    assert ordered.with_previous(none, ["g"], ["t", "id"], {"p": "t"}).collect() == []
    assert ordered.running_total(none, ["g"], ["t", "id"], {"s": F.col("v")}).collect() == []
    assert ordered.asof_join(none, none, ["g"], "t", ["v"], left_id="id", right_id="id").collect() == []


def test_no_plan_has_a_product_or_a_window_over_a_whole_group(spark):
    found = ordered.framed(frame(spark, events(3)), ["g"], ["t", "id"], 2, {"n": F.count(F.lit(1))})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "Window" in plan and "_range" in plan.split("Window")[1]
