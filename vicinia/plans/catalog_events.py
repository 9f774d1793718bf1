"""Queries over events in order, each with its SQL. One account holds about half of all events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals, ordered, quantiles
from ..session import cut
from . import given
from .catalog import query

#: Events of less than this value belong to account 0, whoever made them.
HOT_VALUE = 30
SQL_ACCOUNTS = f"""
accounts AS (SELECT *, CASE WHEN value < {HOT_VALUE} THEN 0 ELSE user_id + 1 END AS account FROM events)"""
SESSION_GAP = "2 HOURS"


def accounts(spark: SparkSession, folder: str) -> DataFrame:
    """Events by account."""
    events = given.table(spark, folder, "events")
    owner = F.when(F.col("value") < HOT_VALUE, F.lit(0).cast("bigint")).otherwise(F.col("user_id") + 1)
    return events.withColumn("account", owner)


def _text(time: str):
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss.SSSSSS")


@query(
    f"""
WITH {SQL_ACCOUNTS}
SELECT c.event_id, c.account, v.event_id AS view_id, v.value AS view_value FROM
  (SELECT * FROM accounts WHERE event_type = 'click') c LEFT JOIN LATERAL (
    SELECT event_id, value FROM accounts v WHERE v.event_type = 'view' AND v.account = c.account AND v.ts <= c.ts
    ORDER BY v.ts DESC, v.event_id DESC LIMIT 1) v ON true"""
)
def last_view_before_click(spark: SparkSession, folder: str) -> DataFrame:
    """The last view of each account at or before each of its clicks."""
    events = accounts(spark, folder).select("event_id", "account", "ts", "value", "event_type")
    found = ordered.asof_join(
        events.where("event_type = 'click'"), events.where("event_type = 'view'"), ["account"], "ts",
        ["event_id", "value"], left_id="event_id", right_id="event_id",
    )
    return found.select(
        "event_id", "account", F.col("last_event_id").alias("view_id"), F.col("last_value").alias("view_value")
    )


@query(
    f"""
WITH {SQL_ACCOUNTS},
marked AS (
  SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL {SESSION_GAP} THEN 0 ELSE 1 END AS fresh
  FROM accounts WINDOW w AS (PARTITION BY account ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY account ORDER BY ts, event_id) AS session FROM marked)
SELECT account, CAST(session AS BIGINT) AS session, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS "end", count(*) AS n, max(value) AS top
FROM numbered GROUP BY account, session"""
)
def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of accounts, which end after two hours without an event."""
    events = accounts(spark, folder).select("event_id", "account", "ts", "value")
    found = ordered.sessions(events, ["account"], "ts", "event_id", SESSION_GAP, {"top": F.max("value")})
    return found.withColumns({"start": _text("start"), "end": _text("end"), "session": F.col("session").cast("bigint")})


@query(
    f"""
WITH {SQL_ACCOUNTS}
SELECT event_id, account, round(avg(value) OVER w, 6) AS mean, count(*) OVER w AS n
FROM accounts WINDOW w AS (PARTITION BY account ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""
)
def moving_mean(spark: SparkSession, folder: str) -> DataFrame:
    """Mean value of the last five events of an account."""
    events = accounts(spark, folder).select("event_id", "account", "ts", "value")
    found = ordered.framed(
        events, ["account"], ["ts", "event_id"], 4, {"mean": F.avg("value"), "n": F.count(F.lit(1))}
    )
    return found.select("event_id", "account", F.round("mean", 6).alias("mean"), "n")


@query(
    f"""
WITH {SQL_ACCOUNTS}
SELECT event_id, account, lag(event_id) OVER w AS previous_id,
       date_diff('microsecond', lag(ts) OVER w, ts) AS micros
FROM accounts WINDOW w AS (PARTITION BY account ORDER BY ts, event_id)"""
)
def gap_to_previous(spark: SparkSession, folder: str) -> DataFrame:
    """The event before each one in its account, and the time since."""
    events = accounts(spark, folder).select("event_id", "account", "ts")
    found = ordered.with_previous(
        events, ["account"], ["ts", "event_id"], {"previous_id": "event_id", "previous_ts": "ts"}
    )
    return found.select(
        "event_id", "account", "previous_id", F.expr("timestampdiff(MICROSECOND, previous_ts, ts)").alias("micros")
    )


@query(
    f"""
WITH {SQL_ACCOUNTS}
SELECT event_id, account, round(sum(value) OVER (PARTITION BY account ORDER BY ts, event_id), 4) AS total FROM accounts"""
)
def account_balance(spark: SparkSession, folder: str) -> DataFrame:
    """Sum of the values of an account up to each of its events."""
    events = accounts(spark, folder).select("event_id", "account", "ts", "value")
    # Cents, so that the order of addition does not matter.
    cents = F.round(F.col("value") * 10000).cast("bigint")
    found = ordered.running_total(events, ["account"], ["ts", "event_id"], {"total": cents})
    return found.select("event_id", "account", F.round(F.col("total") / 10000, 4).alias("total"))


#: Events are seen as of so many years before, when orders were made.
YEARS = 25
BAND = 0.05
SHARES = (0.0, 0.05, 0.5, 0.95, 1.0)


@query(
    f"""
WITH {SQL_ACCOUNTS},
open AS (
  SELECT o_orderkey, o_custkey - 1 AS account, o_orderdate AS since, max(l_shipdate) AS until
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT event_id, a.account, o_orderkey FROM accounts a JOIN open o
  ON a.account = o.account AND a.ts - INTERVAL {YEARS} YEARS BETWEEN since AND until"""
)
def orders_open_at_event(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of an account that were made, but not wholly shipped, at the time of each of its events."""
    events = accounts(spark, folder).select(
        "event_id", "account", (F.col("ts") - F.expr(f"INTERVAL {YEARS} YEARS")).alias("at")
    )
    shipped = given.table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("until"))
    orders = given.table(spark, folder, "orders").join(shipped, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "o_orderkey", (F.col("o_custkey") - 1).alias("account"), F.col("o_orderdate").alias("since"), "until"
    )
    found = intervals.interval_join(events, orders, ["account"], "at", "since", "until")
    return found.select("point.event_id", "point.account", "interval.o_orderkey")


@query(
    f"""
WITH {SQL_ACCOUNTS}
SELECT c.event_id AS click_id, v.event_id AS view_id, c.account FROM accounts c JOIN accounts v
  ON c.account = v.account AND c.event_type = 'click' AND v.event_type = 'view'
     AND c.value BETWEEN v.value - {BAND}::DOUBLE AND v.value + {BAND}::DOUBLE"""
)
def close_values(spark: SparkSession, folder: str) -> DataFrame:
    """Clicks and views of an account with about the same value."""
    events = accounts(spark, folder).select("event_id", "account", "value", "event_type")
    kinds = [events.where(F.col("event_type") == kind).drop("event_type") for kind in ("click", "view")]
    found = intervals.band_join(*kinds, ["account"], "value", BAND)
    return found.select(
        F.col("left.event_id").alias("click_id"), F.col("right.event_id").alias("view_id"), "left.account"
    )


@query(
    f"""
WITH {SQL_ACCOUNTS},
found AS (SELECT account, list_sort(list(value)) AS own FROM accounts WHERE value IS NOT NULL GROUP BY account),
asked AS (SELECT account, own, share, share * (len(own) - 1) AS place
          FROM found, (SELECT unnest([{", ".join(f"{s}::DOUBLE" for s in SHARES)}]) AS share))
SELECT account, share, round(own[CAST(floor(place) AS BIGINT) + 1] * (1 - (place - floor(place)))
  + own[CAST(ceil(place) AS BIGINT) + 1] * (place - floor(place)), 6) AS quantile FROM asked"""
)
def score_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Quantiles of the values of each account."""
    found = quantiles.quantiles(accounts(spark, folder), ["account"], "value", SHARES)
    return found.withColumn("quantile", F.round("quantile", 6))


RANK_ERROR = 0.02


@query(
    f"""
WITH {SQL_ACCOUNTS}
SELECT account, count(value) AS n, share, true AS close
FROM accounts, (SELECT unnest([{", ".join(f"{s}::DOUBLE" for s in SHARES)}]) AS share) GROUP BY account, share HAVING count(value) > 0"""
)
def sketched_account_quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Quantiles of accounts from stored sketches of their days, and whether their true ranks are close to those asked for."""
    events = accounts(spark, folder).select("account", F.to_date("ts").alias("day"), "value")
    stored = cut(quantiles.sketches(events, ["account", "day"], "value"))
    found = cut(quantiles.sketched_quantiles(quantiles.merged_sketches(stored, ["account"]), ["account"], SHARES))
    # A few rows per account.
    asked = found.groupBy("account", "n").agg(F.collect_list(F.struct("share", "quantile")).alias("asked"))
    rows = events.join(asked, "account").select("account", "n", "value", F.explode("asked").alias("a"))
    ranks = rows.groupBy("account", "n", F.col("a.share").alias("share")).agg(
        F.count_if(F.col("value") < F.col("a.quantile")).alias("below"),
        F.count_if(F.col("value") <= F.col("a.quantile")).alias("upto"),
    )
    slack = F.lit(RANK_ERROR) * F.col("n") + 1
    at = F.col("share") * F.col("n")
    return ranks.select("account", "n", "share", ((F.col("below") <= at + slack) & (F.col("upto") >= at - slack)).alias("close"))
