"""What a listener to jobs is sent: events as they come, a heartbeat whenever an interval
passes without one, and nothing after the event that ends the job.

As a stream it is a state for each job with a timer; `sent` gives the same rows from a
whole log at once. Times are event times, in milliseconds: a heartbeat is due when the
watermark has passed it, so a listener is never sent one before a late event. Events later
than the watermark are left out. Ties in time go by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.window import Window

from winnow.operators.state import FINAL
from winnow.sources.packages import ship

INTERVAL_MS = 15_000
SENT = "job_id long, kind string, at_ms long, id long"
#: What the final states are sent as.
_ENDS = {"completed": "complete", "failed": "error"}


class Listener(StatefulProcessor):
    """The state of a job: when it was last heard of, and whether it has ended."""

    def __init__(self, interval_ms: int) -> None:
        self.interval = interval_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.heard = handle.getValueState("heard", "at_ms long, ended boolean")

    def _rest(self, at: int) -> None:
        """Sets the timer to an interval after `at`, and no other."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at + self.interval)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, ended = self.heard.get() if self.heard.exists() else (None, False)
        events = pd.concat(list(rows)).sort_values(["at_ms", "id"])
        out = []
        for e in events.itertuples(index=False):
            if ended:
                break
            if at is not None:
                out += [(key[0], "heartbeat", t, None) for t in range(at + self.interval, e.at_ms, self.interval)]
            ended = e.status in FINAL
            out.append((key[0], _ENDS.get(e.status, "progress"), e.at_ms, e.id))
            at = int(e.at_ms)
        self.heard.update((at, ended))
        if ended:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        else:
            self._rest(at)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, ended = self.heard.get()
        if ended:
            return
        due = range(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() + 1, self.interval)
        if len(due):
            self.heard.update((due[-1], False))
            self._rest(due[-1])
        yield _frame([(key[0], "heartbeat", t, None) for t in due])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["job_id", "kind", "at_ms", "id"])
    return out.astype({"job_id": "int64", "at_ms": "int64", "id": "Int64"})


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Within it, queries start with the state store that states with timers need."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def sent_stream(events: DataFrame, late: str = "1 minute", interval_ms: int = INTERVAL_MS) -> DataFrame:
    """SENT for a stream of events (id, job_id, created_at, status); start the query within `rocksdb`."""
    ship(events.sparkSession)
    e = events.withWatermark("created_at", late).select("job_id", "id", "status", "created_at", F.unix_millis("created_at").alias("at_ms"))
    return e.groupBy("job_id").transformWithStateInPandas(Listener(interval_ms), SENT, "Append", "EventTime")


def sent(events: DataFrame, upto_ms: int, interval_ms: int = INTERVAL_MS) -> DataFrame:
    """SENT for a whole log, with the heartbeats that are due until upto_ms in jobs that haven't ended."""
    e = events.select("job_id", "id", "status", F.unix_millis("created_at").alias("at_ms"))
    w = Window.partitionBy("job_id").orderBy("at_ms", "id")
    e = e.withColumns({"over": F.count_if(F.col("status").isin(*FINAL)).over(w.rowsBetween(Window.unboundedPreceding, -1)), "next": F.lead("at_ms").over(w)}).where("over = 0")
    own = e.select("job_id", F.when(F.col("status") == "completed", "complete").when(F.col("status") == "failed", "error").otherwise("progress").alias("kind"), "at_ms", "id")
    until = F.coalesce(F.col("next") - 1, F.lit(upto_ms))
    open_ = e.where(~F.col("status").isin(*FINAL)).where(until >= F.col("at_ms") + interval_ms)
    beats = open_.select("job_id", F.lit("heartbeat").alias("kind"), F.explode(F.sequence(F.col("at_ms") + interval_ms, until, F.lit(interval_ms))).alias("at_ms"), F.lit(None).cast("long").alias("id"))
    return own.union(beats)
