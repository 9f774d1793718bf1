"""Event-time streams: windows with late rows kept, sessions, and the last values of a key.

Every function starts a query that works off what has arrived, then stops; the next start goes on from its checkpoint.
Each micro-batch overwrites its own ``batch`` partition, so a batch that is run again does not double its rows.

Defined results: rows without a time are left out of windows (they are counted as late), sessions and last values; null
keys are a key like any other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..session import job_tables, ship

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _replace(batch: DataFrame, batch_id: int, path: str) -> None:
    batch.withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("batch").parquet(path)


def _start(rows: DataFrame, write, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return (
        rows.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


@contextmanager
def _setting(spark, name: str, value: str):
    """A setting for the query that starts inside; a query keeps the settings it started with."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


# ---- windows -------------------------------------------------------------------------


def count_windows(
    events: DataFrame, keys: Sequence[str], time: str, value: str, width: str, slide: str, delay: str, out: str, checkpoint: str
) -> StreamingQuery:
    """Add what arrives to windows of ``width`` every ``slide``; a row that is late for a window goes to a side table.

    The watermark of a batch is the latest time in the batches before it less ``delay``. A row counts for each of its
    windows that end after it, and is kept as late for the others. A batch is reduced to one mergeable row per window and
    key before it is written, so a hot key costs a row per task and nothing is held between batches.
    """
    spark = events.sparkSession
    marks = f"{out}/marks"
    kind = "latest timestamp, batch bigint"

    def write(batch: DataFrame, batch_id: int) -> None:
        with job_tables(spark):
            _replace(batch.agg(F.max(time).cast("timestamp").alias("latest")), batch_id, marks)
            earlier = spark.read.schema(kind).parquet(marks).where(F.col("batch") < batch_id)
            mark = earlier.agg((F.max("latest") - F.expr(f"INTERVAL {delay}")).alias("mark"))
            rows = batch.select(
                *keys, F.col(value).alias("value"), F.explode_outer(_windows(time, width, slide)).alias("window")
            ).withColumn("mark", mark.scalar())
            late = F.col("window").isNull() | F.coalesce(F.col("window.end") <= F.col("mark"), F.lit(False))
            sums = rows.groupBy(*keys, "window", late.alias("late")).agg(
                F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("top")
            )
            _replace(sums, batch_id, f"{out}/parts")

    return _start(events, write, checkpoint)


def _windows(time: str, width: str, slide: str) -> Column:
    """All windows a time lies in, as an array; null for a null time."""
    micros = lambda text: F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP'1970-01-01', TIMESTAMP'1970-01-01' + INTERVAL {text})")
    at, step, size = F.unix_micros(F.col(time).cast("timestamp")), micros(slide), micros(width)
    last = at - F.pmod(at, step)
    # The first start after ``at - width``.
    first = last - F.floor((last - at + size - 1) / step) * step
    return F.transform(
        F.sequence(first.cast("bigint"), last.cast("bigint"), step.cast("bigint")),
        lambda s: F.struct(F.timestamp_micros(s).alias("start"), F.timestamp_micros(s + size.cast("bigint")).alias("end")),
    )


def read_windows(spark, out: str, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(windows, late)``: counts, sums and maxima of all batches, of rows in time and of late ones."""
    parts = spark.read.parquet(f"{out}/parts")
    sums = parts.groupBy(*keys, "window", "late").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("top").alias("top")
    )
    columns = [*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "total", "top"]
    return sums.where(~F.col("late")).select(*columns), sums.where("late").select(*columns)


# ---- sessions ------------------------------------------------------------------------


def session_stream(
    events: DataFrame, keys: Sequence[str], time: str, value: str, gap: str, delay: str, out: str, checkpoint: str
) -> StreamingQuery:
    """Write sessions once the watermark has passed them: ``keys, start, end, n, top``; ``end`` is the last event.

    Sessions that a later event may still join stay in the state. Rows are merged into sessions before their shuffle, so
    that a hot key sends its sessions, not its events.
    """
    found = (
        events.withWatermark(time, delay)
        .groupBy(*keys, F.session_window(time, gap).alias("session"))
        .agg(F.max(time).alias("end"), F.count(F.lit(1)).alias("n"), F.max(value).alias("top"))
        .select(*keys, F.col("session.start").alias("start"), "end", "n", "top")
    )
    with _setting(events.sparkSession, "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true"):
        return _start(found, lambda batch, batch_id: _replace(batch, batch_id, out), checkpoint)


# ---- last values ---------------------------------------------------------------------


class LastValues(StatefulProcessor):
    """The last ``keep`` events of each key of a bucket as one state; a timer drops those ``life`` behind the watermark.

    A bucket holds many keys, so that a batch costs calls per bucket, not per key.
    """

    KIND = "key string, micros bigint, id bigint, value double"

    def __init__(self, keep: int, life_ms: int) -> None:
        self.keep, self.life = keep, life_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", self.KIND)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, touched = self._held(), set()
        for part in rows:
            names, micros, ids = part["key"].tolist(), part["micros"].tolist(), part["id"].tolist()
            values = [None if v is None or v != v else float(v) for v in part["value"].astype(object)]
            fresh: dict[str, list] = {}
            # The ID may be missing from no row: it tells rows of one time apart.
            for name, *row in zip(names, micros, ids, values, strict=True):
                fresh.setdefault(name, []).append(tuple(row))
            for name, found in fresh.items():
                held[name] = sorted({*held.get(name, ()), *found}, key=lambda r: r[:2])[-self.keep :]
            touched |= fresh.keys()
        self._store(held)
        yield self._rows(key, {name: held[name] for name in sorted(touched)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, mark = self._held(), timerValues.getCurrentWatermarkInMs()
        over = sorted(name for name, rows in held.items() if self._end(rows) <= mark)
        for name in over:
            del held[name]
        self._store(held)
        yield self._rows(key, {name: [] for name in over})

    def _held(self) -> dict[str, list]:
        held: dict[str, list] = {}
        for name, *row in self.last.get():
            held.setdefault(name, []).append(tuple(row))
        return held

    def _end(self, rows: list) -> int:
        return rows[-1][0] // 1000 + self.life

    def _store(self, held: dict[str, list]) -> None:
        """Keep the values, and one timer for the key that is over first."""
        if held:
            self.last.put([(name, *row) for name, rows in held.items() for row in rows])
        else:
            self.last.clear()
        wanted = {min(map(self._end, held.values()))} if held else set()
        set_ = set(self.handle.listTimers())
        for timer in set_ - wanted:
            self.handle.deleteTimer(timer)
        for timer in wanted - set_:
            self.handle.registerTimer(timer)

    @staticmethod
    def _rows(bucket, found: dict[str, list]) -> pd.DataFrame:
        last = [[{"micros": m, "id": i, "value": v} for m, i, v in rows] for rows in found.values()]
        return pd.DataFrame({"key": pd.Series(list(found), dtype=object), "part": pd.Series([bucket[0]] * len(found), dtype="int32"), "last": pd.Series(last, dtype=object)})

    def close(self) -> None:
        pass


def last_values(
    events: DataFrame, key: str, time: str, row_id: str, value: str, keep: int, life: str, delay: str, out: str,
    checkpoint: str, parts: int = 4, buckets: int = 256,
) -> StreamingQuery:
    """Keep the last ``keep`` values of each key in state, for ``life`` after its newest event.

    The state of a key lies in ``parts`` pieces by the hash of the row's ID, each with its own last values, so a hot key
    is no single task; :func:`read_last_values` merges them. Pieces of many keys share one of ``buckets`` states for each
    of the ``parts``; set more for more keys than some ten million, and the same at every start. Rows without an ID are left out. Keys need a type that a
    string tells apart.
    """
    spark = events.sparkSession
    ship(spark)
    life_ms = spark.range(1).select(
        F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP'1970-01-01', TIMESTAMP'1970-01-01' + INTERVAL {life})")
    ).first()[0]
    rows = events.select(
        # Grouped state tells no null key from the key before it.
        F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("key"), F.pmod(F.xxhash64(row_id), F.lit(parts)).cast("int").alias("piece"),
        F.col(time).cast("timestamp").alias("at"), F.unix_micros(F.col(time).cast("timestamp")).alias("micros"),
        F.col(row_id).cast("bigint").alias("id"), F.col(value).cast("double").alias("value"),
    ).where("micros IS NOT NULL AND id IS NOT NULL")
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)) * parts + F.col("piece")
    rows = rows.withColumn("part", bucket.cast("int")).drop("piece")
    kind = T.StructType(
        [
            T.StructField("key", T.StringType()), T.StructField("part", T.IntegerType()),
            T.StructField("last", T.ArrayType(T.StructType([
                T.StructField("micros", T.LongType()), T.StructField("id", T.LongType()), T.StructField("value", T.DoubleType()),
            ]))),
        ]
    )
    found = rows.withWatermark("at", delay).groupBy("part").transformWithStateInPandas(
        LastValues(keep, life_ms), kind, "Update", "EventTime"
    )
    given = F.when(F.col("key") != "", F.substr("key", F.lit(2))).cast(events.schema[key].dataType)

    def write(batch: DataFrame, batch_id: int) -> None:
        _replace(batch.withColumn("key", given), batch_id, out)

    with _setting(spark, "spark.sql.streaming.stateStore.providerClass", ROCKSDB):
        return _start(found, write, checkpoint, "update")


def read_last_values(spark, out: str, keep: int, since: Column | None = None) -> DataFrame:
    """``key, rank, id, micros, value``: the last ``keep`` values of each key, newest first.

    The newest row of each piece counts. ``since`` leaves out values not newer than it that their piece still holds.
    """
    pieces = spark.read.parquet(out).groupBy("key", "part").agg(F.max_by("last", "batch").alias("last"))
    values = pieces.select("key", F.explode("last").alias("row")).select("key", "row.*")
    if since is not None:
        values = values.where(F.col("micros") > since)
    # At most ``keep`` values for each piece.
    newest = Window.partitionBy("key").orderBy(F.desc("micros"), F.desc("id"))
    ranked = values.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= keep)
    return ranked.select("key", "rank", "id", "micros", "value")
