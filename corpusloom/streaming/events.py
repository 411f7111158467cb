"""Event-time operators: the same features on streams and on tables."""

from __future__ import annotations

import math
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def windowed_counts(events: DataFrame, size: str = "15 minutes", slide: str = "5 minutes", late: str = "120 minutes") -> DataFrame:
    """Counts per type in sliding windows; with a watermark, so state is bounded on a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "window.end", "event_type", "n", "total")


def split_late(batch: DataFrame, now, minutes: int = 120) -> tuple[DataFrame, DataFrame]:
    """Rows in time, and those for the dead-letter table; for ``foreachBatch``."""
    late = F.col("ts") < now - F.expr(f"INTERVAL {minutes} MINUTES")
    return batch.filter(~late), batch.filter(late)


def _user():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def rolling(events: DataFrame, **seconds: int) -> DataFrame:
    """Per user, events in the last n seconds (the row included), one column per name."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp")))
    return events.withColumns({name: F.count("*").over(w.rangeBetween(-n * 1_000_000, 0)) for name, n in seconds.items()})


def streaks(events: DataFrame) -> DataFrame:
    """Length so far of the run of equal types, and seconds since the type changed."""
    changed = events.withColumn("new", (F.lag("event_type").over(_user()).isNull() | (F.lag("event_type").over(_user()) != F.col("event_type"))).cast("int"))
    run = changed.withColumn("run", F.sum("new").over(_user().rowsBetween(Window.unboundedPreceding, 0)))
    w = Window.partitionBy("user_id", "run").orderBy("ts", "event_id")
    return run.withColumn("streak", F.row_number().over(w).cast("long")).withColumn("since_change", (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.first("ts").over(w).cast("timestamp"))) / 1e6).drop("new", "run")


def lags(events: DataFrame, kind: str, n: int = 3) -> DataFrame:
    """For events of a type, seconds since the 1st to nth before them."""
    own = events.filter(F.col("event_type") == kind)
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    return own.withColumns({f"lag_{i}": (t - F.lag(t, i).over(_user())) / 1e6 for i in range(1, n + 1)})


def calendar(events: DataFrame) -> DataFrame:
    hour = F.hour("ts")
    return events.withColumns({"hour": hour.cast("long"), "weekday": F.dayofweek("ts").cast("long"), "hour_sin": F.round(F.sin(hour * (2 * math.pi / 24)), 9), "hour_cos": F.round(F.cos(hour * (2 * math.pi / 24)), 9)})


def one_hot(events: DataFrame, column: str, values: list[str]) -> DataFrame:
    return events.withColumns({f"is_{v}": (F.col(column) == v).cast("long") for v in values})


def suppressed(x, confidence, least: float = 0.6):
    """The value where the confidence reaches the least; null elsewhere."""
    return F.when(confidence >= least, x)


STATE = "user_id long, event_id long, event_type string, streak long, since_change double"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Streaks(StatefulProcessor):
    """State of a user: the rows that the watermark has not passed, and the run that the rows before them ended with."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event_id long, event_type string")
        self.run = handle.getValueState("run", "last string, streak long, began long, seen long")

    def handleInputRows(self, key, rows, timerValues):
        new = [(int(at), None if pd.isna(i) else int(i), kind) for batch in rows for at, i, kind in batch[["at", "event_id", "event_type"]].itertuples(index=False)]
        self.waiting.appendList(new)
        self.handle.registerTimer(min(at for at, _, _ in new) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000  # no row up to here can still come
        rows = sorted(self.waiting.get(), key=lambda r: (r[0], r[1] is not None, r[1] or 0))
        ready = [r for r in rows if r[0] <= now]
        left = rows[len(ready) :]
        last, streak, began, seen = self.run.get() if self.run.exists() else (None, 0, 0, None)
        out = []
        for at, event_id, kind in ready:
            if seen is None or kind != last or at - seen > self.idle:
                last, streak, began = kind, 0, at
            streak, seen = streak + 1, at
            out.append((key[0], event_id, kind, streak, (at - began) / 1e6))
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(left[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
        if seen is not None and seen + self.idle <= now and not left:
            self.run.clear()
        elif seen is not None:
            self.run.update((last, streak, began, seen))
            self.handle.registerTimer((seen + self.idle) // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=["user_id", "event_id", "event_type", "streak", "since_change"])

    def close(self) -> None:
        pass


def keyed_streaks(events: DataFrame, late: str = "120 minutes", idle: timedelta = timedelta(days=7)) -> DataFrame:
    """The streaks of :func:`streaks` on a stream, whatever the order in which rows come. Rows wait until the watermark, ``late`` behind the latest event, has
    passed them, and are then counted by time and event_id; later ones are dropped (:func:`split_late` keeps them). After ``idle`` without
    an event a user's state goes, and the next event begins a new run; so state is kept for users with recent events alone.

    Rows without a time or a user are left out. State is in RocksDB, which Spark needs for it."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    own = events.filter("ts is not null and user_id is not null").select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    own = own.withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    micros = int(idle.total_seconds() * 1_000_000)
    return own.groupBy("user_id").transformWithStateInPandas(_Streaks(micros), outputStructType=STATE, outputMode="Append", timeMode="EventTime")


def write_daily(events: DataFrame, path: str, checkpoint: str):
    """A stream to Parquet by day, a batch a minute."""
    return events.withColumn("date", F.to_date("ts")).writeStream.trigger(processingTime="60 seconds").partitionBy("date").option("checkpointLocation", checkpoint).format("parquet").start(path)
