"""Interval joins, band joins and quantiles against plain loops."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from vicinia.operators import intervals, quantiles

INF, NAN = math.inf, math.nan


def points(dice, count):
    keys = ["hot"] * 6 + ["a", "b", None]
    return [(k, dice.choice(keys), dice.choice([None, NAN, INF, -INF, *[dice.uniform(-50, 50) for _ in range(20)]])) for k in range(count)]


def spans(dice, count):
    out = []
    for k in range(count):
        low = dice.uniform(-60, 60)
        high = low + dice.choice([0, 0, -1, 1e-9, 0.3, 4, 4, 70, INF])
        out.append((k, dice.choice(["hot"] * 6 + ["a", "c", None]), dice.choice([low] * 9 + [None, NAN, -INF]), high))
    return out


def inside(p, s):
    if p[1] is None or p[1] != s[1] or None in (p[2], *s[2:]) or any(math.isnan(x) for x in (p[2], *s[2:])):
        return False
    return s[2] <= p[2] <= s[3]


@pytest.mark.parametrize("block_rows", [7, 4096])
def test_points_in_intervals(spark, block_rows):
    dice = random.Random(block_rows)
    mine, theirs = points(dice, 200), spans(dice, 120)
    mine += [(k, "hot", theirs[0][2]) for k in range(200, 240)] + mine[:3]  # ties on a bound, repeated rows
    # Columns of one name on both sides, and of the operator's own names.
    left = spark.createDataFrame(mine, "id long, g string, _level double")
    right = spark.createDataFrame(theirs, "id long, g string, _from double, _to double")
    got = intervals.interval_join(left, right, ["g"], "_level", "_from", "_to", block_rows=block_rows)
    want = sorted((p[0], s[0]) for p in mine for s in theirs if inside(p, s))
    assert len(want) > 500
    assert sorted(tuple(r) for r in got.select("point.id", "interval.id").collect()) == want
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_no_block_holds_more_than_stated(spark, monkeypatch):
    tables = []
    kept = intervals.cut
    monkeypatch.setattr(intervals, "cut", lambda df: tables.append(kept(df)) or tables[-1])
    left = spark.createDataFrame([(k, k % 10) for k in range(300)], "id long, v long").withColumn("g", F.lit(1))
    right = spark.createDataFrame([(k, 0, 9) for k in range(90)], "id long, a long, b long").withColumn("g", F.lit(1))
    got = intervals.interval_join(left, right, ["g"], "v", "a", "b", block_rows=20)
    assert got.count() == 300 * 90
    # 300 points and 90 intervals of one bin.
    assert [(r["_p"], r["_q"]) for r in tables[-1].collect()] == [(15, 5)]


def test_intervals_of_times_and_empty_tables(spark):
    day = dt.datetime(2024, 1, 1)
    left = spark.createDataFrame([(k, day + dt.timedelta(hours=k)) for k in range(50)], "id long, at timestamp")
    right = spark.createDataFrame([(k, day + dt.timedelta(hours=3 * k), day + dt.timedelta(hours=3 * k + 5)) for k in range(9)], "id long, a timestamp, b timestamp")
    got = intervals.interval_join(left, right, [], "at", "a", "b", block_rows=4)
    want = sorted((p, s) for p in range(50) for s in range(9) if 3 * s <= p <= 3 * s + 5)
    assert sorted(tuple(r) for r in got.select("point.id", "interval.id").collect()) == want
    for a, b in ((left.limit(0), right), (left, right.limit(0))):
        assert intervals.interval_join(a, b, [], "at", "a", "b").count() == 0


def test_bands(spark):
    dice = random.Random(3)
    a = [(k, dice.choice("xy"), dice.randint(0, 300)) for k in range(120)]
    b = [(k, dice.choice("xyz"), dice.randint(0, 300)) for k in range(90)]
    frame = [spark.createDataFrame(rows, "id long, g string, v long") for rows in (a, b)]
    got = intervals.band_join(*frame, ["g"], "v", 3, block_rows=5)
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] == q[1] and abs(p[2] - q[2]) <= 3)
    assert sorted(tuple(r) for r in got.select("left.id", "right.id").collect()) == want


def plain(own, share):
    own, at = sorted(own), share * (len(own) - 1)
    low, high = own[math.floor(at)], own[math.ceil(at)]
    return low if low == high else low * (1 - (at - math.floor(at))) + high * (at - math.floor(at))


@pytest.mark.parametrize("bins", [2, 16])
def test_quantiles(spark, bins):
    dice = random.Random(bins)
    rows = [("hot", dice.gauss(0, 10) ** 3) for _ in range(300)] + [("hot", 1.0)] * 150
    rows += [(None, dice.randint(0, 4) * 1.0) for _ in range(40)] + [("one", 7.0), ("none", None), ("none", NAN), ("one", None)]
    rows += [("wide", x) for x in (-1.7e308, 1.7e308, 0.0, 5e-324, 1e300)]
    shares = [0.0, 0.03, 0.5, 0.77, 1.0]
    got = quantiles.quantiles(spark.createDataFrame(rows, "_v string, _n double"), ["_v"], "_n", shares, bins=bins)
    assert got.columns == ["_v", "share", "quantile"]
    groups = {}
    for g, v in rows:
        if v is not None and not math.isnan(v):
            groups.setdefault(g, []).append(v)
    want = {(g, s): plain(own, s) for g, own in groups.items() for s in shares}
    found = {(r[0], r[1]): r[2] for r in got.collect()}
    assert found.keys() == want.keys() and len(found) == 4 * len(shares)
    assert all(found[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    empty = spark.createDataFrame([], "g string, v double")
    assert quantiles.quantiles(empty, ["g"], "v", shares).count() == 0
    whole = quantiles.quantiles(spark.createDataFrame([(float(k),) for k in range(101)], "v double"), [], "v", [0.25])
    assert [tuple(r) for r in whole.collect()] == [(0.25, 25.0)]


def test_sketches_merge_and_keep_close(spark):
    dice = random.Random(5)
    rows = [(k % 7, "hot", dice.gauss(0, 5) ** 3) for k in range(20_000)] + [(0, None, 2.0), (1, None, 2.0), (1, "none", None), (1, "none", NAN)]
    df = spark.createDataFrame(rows, "day int, g string, v double").repartition(5)
    parts = quantiles.sketches(df, ["g", "day"], "v")
    again = quantiles.merged_sketches(parts.where("day < 3").unionByName(parts.where("day >= 3")), ["g"])
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {(r["g"], r["share"]): (r["n"], r["quantile"]) for r in quantiles.sketched_quantiles(again, ["g"], shares).collect()}
    assert got.keys() == {(g, s) for g in ("hot", None) for s in shares}
    own = sorted(v for _, g, v in rows if g == "hot")
    for share in shares:
        n, value = got["hot", share]
        rank = sum(v <= value for v in own) / len(own)
        assert n == len(own) and abs(rank - share) <= 0.02 and got[None, share] == (2, 2.0)
