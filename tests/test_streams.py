"""Event-time streams: restarts, late rows, ends of sessions, expiry, repeated batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vicinia.streaming import events as ev

KIND = "event_id long, user_id long, ts timestamp, value double"
START = dt.datetime(2024, 1, 1)


def at(hours):
    return None if hours is None else START + dt.timedelta(hours=hours)


@pytest.fixture
def landed(spark, tmp_path):
    """Land rows ``(event_id, user_id, hours, value)`` and start the query on all that has landed."""

    def land(start, *parts):
        for rows in parts:
            frame = spark.createDataFrame([(i, u, at(h), v) for i, u, h, v in rows], KIND)
            frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(KIND).parquet(f"{tmp_path}/in")
            start(stream, f"{tmp_path}/out", f"{tmp_path}/progress").awaitTermination()
        return f"{tmp_path}/out"

    return land


def windows(stream, out, progress):
    return ev.count_windows(stream, ["user_id"], "ts", "value", "2 HOURS", "1 HOUR", "3 HOURS", out, progress)


def test_windows_slide_and_keep_late_rows(spark, landed):
    first = [(1, 1, 0.5, 1.0), (2, None, 10.0, 2.0), (3, 1, None, 4.0)]
    second = [(4, 1, 6.5, 8.0), (5, 1, 0.0, 16.0), (6, 1, 5.5, None)]
    kept, late = ev.read_windows(spark, landed(windows, first, second), ["user_id"])
    hours = lambda r: (r.user_id, r.start and (r.start - START).total_seconds() / 3600, r.n, r.total)
    # The watermark of the second start is 7:00.
    assert sorted(map(hours, kept.collect()), key=str) == sorted(
        [(1, -1.0, 1, 1.0), (1, 0.0, 1, 1.0), (None, 9.0, 1, 2.0), (None, 10.0, 1, 2.0), (1, 6.0, 1, 8.0)], key=str
    )
    assert sorted(map(hours, late.collect()), key=str) == sorted(
        [(1, None, 1, 4.0), (1, 5.0, 2, 8.0), (1, 4.0, 1, None), (1, -1.0, 1, 16.0), (1, 0.0, 1, 16.0)], key=str
    )


def test_a_batch_that_runs_again_counts_once(spark, landed, tmp_path):
    rows = [(k, k % 2, k / 2, 1.0) for k in range(20)]
    out = landed(windows, rows)
    want = sorted(map(tuple, ev.read_windows(spark, out, ["user_id"])[0].collect()))
    # A lost commit makes the next start run the batch again.
    for commit in (tmp_path / "progress" / "commits").iterdir():
        commit.unlink()
    landed(windows, [])
    assert sorted(map(tuple, ev.read_windows(spark, out, ["user_id"])[0].collect())) == want


def test_sessions_over_restarts(spark, landed):
    def start(stream, out, progress):
        return ev.session_stream(stream, ["user_id"], "ts", "value", "2 HOURS", "1 HOUR", out, progress)

    out = landed(start, [(1, 1, 0, 1.0), (2, 1, 1.5, 3.0), (3, 2, 1, 5.0)], [(4, 1, 3.0, 2.0), (5, 3, 9, 1.0)], [(6, 3, 10, 1.0)])
    got = sorted((r.user_id, r.start, r.end, r.n, r.top) for r in spark.read.parquet(out).collect())
    assert got == [(1, at(0), at(3), 3, 3.0), (2, at(1), at(1), 1, 5.0)]


def test_last_values_merge_pieces_and_expire(spark, landed):
    def start(stream, out, progress):
        return ev.last_values(stream, "user_id", "ts", "event_id", "value", 2, "5 HOURS", "1 HOUR", out, progress, parts=3)

    hot = [(k, 1, k / 100, float(k)) for k in range(100)]
    out = landed(start, [*hot, (200, 2, 0, 1.0), (201, None, 0.5, None)], [(300, 1, 1.5, 7.0), (301, 1, None, 9.0)])
    got = sorted((r.key, r["rank"], r.id, r.value) for r in ev.read_last_values(spark, out, 2).where("key IS NOT NULL").collect())
    assert got == [(1, 1, 300, 7.0), (1, 2, 99, 99.0), (2, 1, 200, 1.0)]
    assert [tuple(r) for r in ev.read_last_values(spark, out, 2).where("key IS NULL").select("id", "value").collect()] == [(201, None)]
    # All but the new row are more than five hours behind the watermark: their timers empty the state.
    landed(start, [(400, 3, 30, 1.0)])
    assert [(r.key, r.id) for r in ev.read_last_values(spark, out, 2).collect()] == [(3, 400)]
    assert spark.read.parquet(out).where(F.size("last") == 0).select("key").distinct().count() == 3


def test_settings_are_given_back(spark, landed):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    landed(lambda s, o, p: ev.last_values(s, "user_id", "ts", "event_id", "value", 1, "1 HOUR", "1 HOUR", o, p), [(1, 1, 0, 1.0)])
    assert spark.conf.get(name) == before


def test_tables_are_streamed_as_a_file_or_a_folder(spark, tmp_path):
    from vicinia.plans import given

    spark.range(10).repartition(2).write.parquet(f"{tmp_path}/folder/t.parquet")
    spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/written")
    (tmp_path / "file").mkdir()
    next((tmp_path / "written").glob("*.parquet")).rename(tmp_path / "file" / "t.parquet")
    for folder in ("folder", "file"):
        query = given.stream(spark, f"{tmp_path}/{folder}", "t").writeStream.format("memory").queryName(folder)
        query.trigger(availableNow=True).start().awaitTermination()
        assert spark.table(folder).count() == 10


def test_last_values_of_many_keys_share_a_state(spark, landed):
    def start(stream, out, progress):
        return ev.last_values(
            stream, "user_id", "ts", "event_id", "value", 2, "5 HOURS", "1 HOUR", out, progress, parts=1, buckets=1
        )

    first = [(10 * u + j, u, u / 2 + j / 10, float(j)) for u in range(30) for j in range(3)]
    out = landed(start, first, [(900, 3, 2.0, 9.0), (901, 77, 15.0, 5.0)])
    got = {(r.key, r["rank"]): r.id for r in ev.read_last_values(spark, out, 2).collect()}
    assert spark.read.parquet(out).select("part").distinct().count() == 1
    # The watermark goes from 13:42 to 14:00: keys whose newest row is five hours older are gone.
    keys = {key for key, _ in got}
    assert keys >= {*range(18, 30), 77} and not keys & {*range(17)}
    assert got[29, 1] == 292 and got[29, 2] == 291 and got[77, 1] == 901
