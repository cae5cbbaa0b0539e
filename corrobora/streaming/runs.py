"""Runs kept live: transitions, a reaper of silent runs and back-off, as a stream with state and timers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corrobora.functions import scores

#: What an event of a run makes of it; other kinds of events are no events of a run.
BECOMES = {"beat": "running", "done": "completed", "fail": "failed"}
SILENCE, BASE, CAP = 900, 3600, 864_000
SCHEMA = "run long, at timestamp, before string, after string, attempts int, next_at timestamp"
_STORE = "spark.sql.streaming.stateStore.providerClass"


def _rest(attempts: int, base: int, cap: int) -> int:
    return min(cap, int(base * min(16, 2 ** max(attempts - 1, 0))))


class RunKeeper(StatefulProcessor):
    """A run's status, last beat and failures in a row; a timer pauses it when it has been silent."""

    def __init__(self, silence: int = SILENCE, base: int = BASE, cap: int = CAP):
        self.silence, self.base, self.cap = silence, base, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "status string, last long, attempts int")

    def _told(self, run: int, at: int, before: str, after: str, attempts: int, rest: int | None = None) -> Row:
        when = lambda ms: datetime.fromtimestamp(0, timezone.utc) + timedelta(milliseconds=ms)
        return Row(run=run, at=when(at), before=before, after=after, attempts=attempts, next_at=None if rest is None else when(at + 1000 * rest))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        run = key[0]
        status, last, attempts = self.state.get() if self.state.exists() else ("created", None, 0)
        for ms, _, kind in sorted((r["ms"], r["event_id"], r["kind"]) for r in rows):
            quiet = 0 if last is None else last + 1000 * self.silence
            if status == "running" and quiet <= ms:
                yield self._told(run, quiet, "running", "paused", attempts)
                status = "paused"
            after = BECOMES[kind]
            attempts = attempts + 1 if kind == "fail" else 0 if kind == "done" else attempts
            if kind == "fail":
                yield self._told(run, ms, status, after, attempts, _rest(attempts, self.base, self.cap))
            elif after != status:
                yield self._told(run, ms, status, after, attempts)
            status, last = after, ms
        self.state.update((status, last, attempts))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if status == "running":
            self.handle.registerTimer(last + 1000 * self.silence)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, last, attempts = self.state.get()
        quiet = last + 1000 * self.silence
        if status == "running" and quiet <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.update(("paused", last, attempts))
            yield self._told(key[0], quiet, "running", "paused", attempts)

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession):
    """Timers and typed state need the store on RocksDB; the session's own setting comes back afterwards."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def live_transitions(events: DataFrame, silence: int = SILENCE, base: int = BASE, cap: int = CAP, late: str = "10 minutes") -> DataFrame:
    """(run, at, before, after, attempts, next_at) for a stream of (run, ts, event_id, kind): what each event or silence changes.

    A beat makes a run running, done completes it, fail fails it and says when it may be tried
    again (the rest doubles with failures in a row, up to 16 times and ``cap``); a running run
    that is silent for ``silence`` seconds is paused. Each failure is told, other events only
    where they change the status. Events later than ``late`` are dropped.
    """
    rows = events.where(F.col("kind").isin(*BECOMES)).withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    keeper = RunKeeper(silence, base, cap)
    return rows.groupBy("run").transformWithState(statefulProcessor=keeper, outputStructType=SCHEMA, outputMode="Append", timeMode="EventTime")


def transitions(events: DataFrame, horizon: Column, silence: int = SILENCE, base: int = BASE, cap: int = CAP) -> DataFrame:
    """The same from a table: silences that end by ``horizon`` (a condition's time, or null for all) count."""
    of = Window.partitionBy("run").orderBy("ts", "event_id")
    rows = events.where(F.col("kind").isin(*BECOMES))
    status = F.when(F.col("kind") == "beat", "running").when(F.col("kind") == "done", "completed").otherwise("failed")
    quiet = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(silence))
    seen = rows.withColumns({"status": status, "quiet": quiet, "next": F.lead("ts").over(of), "finished": F.count_if(F.col("kind") == "done").over(of)})
    ends = F.coalesce(F.col("next") >= F.col("quiet"), F.lit(True)) & (F.coalesce(F.col("next"), horizon).isNull() | (F.coalesce(F.col("next"), horizon) >= F.col("quiet")))
    seen = seen.withColumn("silent", (F.col("status") == "running") & ends)
    tries = F.count_if(F.col("kind") == "fail").over(Window.partitionBy("run", "finished").orderBy("ts", "event_id")).cast("int")
    seen = seen.withColumns({"attempts": tries, "left": F.when(F.col("silent"), "paused").otherwise(F.col("status"))})
    seen = seen.withColumn("before", F.coalesce(F.lag("left").over(of), F.lit("created")))
    rest = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), scores.backoff(F.col("attempts"), base, cap))
    failed = F.col("kind") == "fail"
    told = seen.where(failed | (F.col("status") != F.col("before"))).select(
        "run", F.col("ts").alias("at"), "before", F.col("status").alias("after"), "attempts", F.when(failed, F.col("ts") + rest).alias("next_at")
    )
    paused = seen.where("silent").select("run", F.col("quiet").alias("at"), F.lit("running").alias("before"), F.lit("paused").alias("after"), "attempts", F.lit(None).cast("timestamp").alias("next_at"))
    return told.unionByName(paused)
