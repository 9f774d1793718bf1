"""Event-time streams over the given events, each with its SQL. Events land in three parts; each start goes on from the last."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import events as ev
from ..streaming import stream
from . import given
from .catalog import query
from .catalog_events import SESSION_GAP, SQL_ACCOUNTS, _text, accounts

#: Ends of the first two parts. Errors of the first part arrive with the last.
FIRST, SECOND = "2024-01-11", "2024-01-21"
DELAY, LIFE, KEEP = "1 DAY", "5 DAYS", 3
SQL_PARTS = f"CASE WHEN ts < TIMESTAMP '{FIRST}' THEN 0 WHEN ts < TIMESTAMP '{SECOND}' THEN 1 ELSE 2 END"
SQL_ARRIVED = f"CASE WHEN ts < TIMESTAMP '{FIRST}' AND event_type = 'error' THEN 2 ELSE {SQL_PARTS} END"


def in_parts(rows: DataFrame, part: str, run: Callable[[DataFrame, str], object]) -> str:
    """Land ``rows`` part by part, start the stream after each, and return the folder of its results."""
    spark = rows.sparkSession
    root = scratch_path(spark, "landed")
    rows = rows.withColumn("part", F.expr(part))
    for number in range(3):
        rows.where(F.col("part") == number).drop("part").write.mode("append").parquet(f"{root}/events")
        arriving = spark.readStream.schema(rows.drop("part").schema).parquet(f"{root}/events")
        run(arriving, root).awaitTermination()
    return f"{root}/out"


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return given.table(spark, folder, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value"
    )


@query(
    f"""
WITH arrived AS (SELECT *, {SQL_ARRIVED} AS part FROM events),
marks AS (SELECT p.part, (SELECT max(ts) FROM arrived a WHERE a.part < p.part) - INTERVAL {DELAY} AS mark
          FROM (SELECT DISTINCT part FROM arrived) p),
placed AS (
  SELECT a.*, m.mark, time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 12 HOURS AS start
  FROM arrived a JOIN marks m USING (part), (VALUES (0), (1)) s(k))
SELECT event_type, strftime(start, '%Y-%m-%d %H:%M:%S.%f') AS start,
       coalesce(start + INTERVAL 24 HOURS <= mark, false) AS late,
       count(*) AS n, round(sum(value), 4) AS total, max(value) AS top
FROM placed GROUP BY ALL"""
)
def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Days that begin every 12 hours, by type of event; what comes too late for a window is counted beside it."""
    out = in_parts(
        _events(spark, folder), SQL_ARRIVED,
        lambda rows, root: ev.count_windows(
            rows, ["event_type"], "ts", "value", "24 HOURS", "12 HOURS", DELAY, f"{root}/out", f"{root}/progress"
        ),
    )
    kept, late = ev.read_windows(spark, out, ["event_type"])
    both = kept.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    return both.select("event_type", _text("start").alias("start"), "late", "n", F.round("total", 4).alias("total"), "top")


@query(
    f"""
WITH {SQL_ACCOUNTS},
marked AS (
  SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL {SESSION_GAP} THEN 0 ELSE 1 END AS fresh
  FROM accounts WINDOW w AS (PARTITION BY account ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY account ORDER BY ts, event_id) AS session FROM marked)
SELECT account, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS "end",
       count(*) AS n, max(value) AS top
FROM numbered GROUP BY account, session
HAVING max(ts) + INTERVAL {SESSION_GAP} <= (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL {DELAY}"""
)
def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of accounts that are over by the watermark; one account holds about half of the events."""
    rows = accounts(spark, folder).select("event_id", "account", F.col("ts").cast("timestamp").alias("ts"), "value")
    out = in_parts(
        rows, SQL_PARTS,
        lambda arriving, root: ev.session_stream(
            arriving, ["account"], "ts", "value", SESSION_GAP, DELAY, f"{root}/out", f"{root}/progress"
        ),
    )
    return spark.read.parquet(out).select("account", _text("start").alias("start"), _text("end").alias("end"), "n", "top")


@query(
    f"""
WITH recent AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events
  WHERE ts > (SELECT max(ts) FROM events) - INTERVAL {DELAY} - INTERVAL {LIFE})
SELECT user_id, rank, event_id, value FROM recent WHERE rank <= {KEEP}"""
)
def stream_last_values(spark: SparkSession, folder: str) -> DataFrame:
    """The last three values of each user, forgotten five days after the watermark has passed them."""
    rows = _events(spark, folder)
    out = in_parts(
        rows, SQL_PARTS,
        lambda arriving, root: ev.last_values(
            arriving, "user_id", "ts", "event_id", "value", KEEP, LIFE, DELAY, f"{root}/out", f"{root}/progress"
        ),
    )
    newest = rows.agg(F.unix_micros(F.max("ts") - F.expr(f"INTERVAL {DELAY}") - F.expr(f"INTERVAL {LIFE}"))).scalar()
    found = ev.read_last_values(spark, out, KEEP, newest)
    return found.select(F.col("key").alias("user_id"), "rank", F.col("id").alias("event_id"), "value")


@query("SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM events")
def stream_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    """Every event once, although each part also brings the rows of the part before it again."""
    rows = _events(spark, folder).withColumn("first", F.expr(SQL_PARTS))
    rows = rows.withColumn("arrives", F.explode(F.sequence(F.col("first"), F.least("first", F.lit(1)) + 1)))
    out = in_parts(
        rows, "arrives",
        lambda arriving, root: ev._start(
            stream.drop_repeats(arriving, "event_id", "ts", DELAY),
            lambda batch, batch_id: ev._replace(batch, batch_id, f"{root}/out"), f"{root}/progress",
        ),
    )
    return spark.read.parquet(out).select("event_id", "user_id", _text("ts").alias("ts"))
