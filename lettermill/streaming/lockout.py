"""Stateful limiter on a stream: so many failures within a window lock a client out for a while."""

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Keyed state with timers is kept in this store.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Lockouts(StatefulProcessor):
    """State of one client: its last failures, fewer than ``failures``, and the end of its lock; cleared by a timer when neither matters any more."""

    def __init__(self, failures: int, window_ms: int, lock_ms: int):
        self.failures, self.window, self.lock = failures, window_ms, lock_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("client", "recent array<bigint>, until bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        recent, until = self.state.get() if self.state.exists() else ([], 0)
        recent = list(recent)
        for t in sorted(r["ms"] for r in rows):
            if t < until:
                continue
            recent = [x for x in recent if t - x < self.window] + [t]
            if len(recent) >= self.failures:
                recent, until = [], t + self.lock
                yield Row(client=key[0], locked_ms=t, until_ms=until)
        self.state.update((recent, until))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max([until, *[t + self.window for t in recent[-1:]]]))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def lockouts(events: DataFrame, failures: int = 5, window_s: int = 300, lock_s: int = 900, key: str = "client", at: str = "at", late: str = "1 hour") -> DataFrame:
    """(client, locked_at, until): a lock whenever the ``failures``-th failure falls within ``window_s`` of the first; failures while locked do not count.

    ``events`` holds failures only: (client, at as timestamp). Events of one batch are taken in time order. State per client is
    bounded however many events it has, and ends: a timer in event time clears it when its lock is over and its last failure
    has left the window, as soon as the watermark (``late`` behind the newest event) has passed that. Sets the session's state store
    to ``STATE_STORE``, which timers need.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = events.select(F.col(key).cast("string").alias("client"), F.col(at).cast("timestamp").alias("at")).withColumn("ms", F.unix_millis("at"))
    # The first watermark is the epoch, and what is not past it counts as late.
    rows = rows.withColumn("seen", F.col("at") + F.expr("interval 1 millisecond")).withWatermark("seen", late)
    out = rows.groupBy("client").transformWithState(_Lockouts(failures, window_s * 1000, lock_s * 1000), "client string, locked_ms long, until_ms long", "Append", "EventTime")
    return out.select("client", F.timestamp_millis("locked_ms").alias("locked_at"), F.timestamp_millis("until_ms").alias("until"))
