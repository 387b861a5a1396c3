"""Keyed state with timers: runs that get stuck, and cache entries that expire.

State is bounded: a run that ends leaves it, a run without news for a time is
reported and leaves it, and a cache entry leaves it when its time is over.
Timers follow the events' own time, by the stream's watermark, so a replay
gives the same rows. The state lives in the RocksDB store and its checkpoints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DONE = ("complete", "error")


def use_state_store(spark: SparkSession) -> None:
    """Timers need the RocksDB store; call before the stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class _Runs(StatefulProcessor):
    """The last news of an open run, and one timer at its time plus the limit."""

    def __init__(self, limit_us: int) -> None:
        self.limit_us = limit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, ts long, event_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        news = pd.concat([b[["status", "ts", "event_id"]] for b in rows]).assign(at=lambda f: f["ts"].astype("datetime64[us]").astype("int64"))
        if self.last.exists():
            status, at, event_id = self.last.get()
            fresh = (news["at"] > at) | ((news["at"] == at) & (news["event_id"] > event_id))
            news = pd.concat([pd.DataFrame({"status": [status], "at": [at], "event_id": [event_id]}), news[fresh]])
        news = news.sort_values(["at", "event_id", "status"])
        at = news["at"].to_numpy()
        done = news["status"].isin(DONE).to_numpy()
        stuck = ~done & (np.diff(at, append=at[-1]) > self.limit_us)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if done[-1]:
            self.last.clear()
        else:
            self.last.update((news["status"].iloc[-1], int(at[-1]), int(news["event_id"].iloc[-1])))
            self.handle.registerTimer(max((int(at[-1]) + self.limit_us) // 1000, timerValues.getCurrentWatermarkInMs() + 1))
        ended = news[done | stuck]
        if len(ended):
            yield self._rows(key, ended["status"].where(done[done | stuck], "timeout"), ended["at"], ended["event_id"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            _, at, event_id = self.last.get()
            self.last.clear()
            yield self._rows(key, pd.Series(["timeout"]), pd.Series([at]), pd.Series([event_id]))

    def _rows(self, key: tuple, status: pd.Series, at: pd.Series, event_id: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"key": key[0], "status": status.to_numpy(), "ts": pd.to_datetime(at.to_numpy(), unit="us"), "event_id": event_id.to_numpy()})

    def close(self) -> None:
        pass


def ended_runs(events: DataFrame, limit_seconds: int, delay: str = "10 minutes") -> DataFrame:
    """Stream of (key, status, ts, event_id) -> a row when a run ends: complete, error, or timeout.

    timeout: nothing came for more than limit_seconds after the news that the
    row names; it is told by the run's next news or by the watermark, whichever
    is first. Events go by time, then event_id; one that comes in a later batch
    than newer news of an open run is left out, as are rows without key or time.
    A batch's rows of one key meet in one task; the source's limits of rows or
    files a batch bound them.
    """
    rows = events.where("key is not null and ts is not null").select("key", F.coalesce("status", F.lit("")).alias("status"), "ts", F.coalesce(F.col("event_id").cast("long"), F.lit(-1)).alias("event_id"))
    kind = dict(events.dtypes)["key"]
    return rows.withWatermark("ts", delay).groupBy("key").transformWithStateInPandas(_Runs(limit_seconds * 1_000_000), f"key {kind}, status string, ts timestamp, event_id long", "append", "EventTime")


def expired_entries(writes: DataFrame, ttl_seconds: int, delay: str = "10 minutes") -> DataFrame:
    """Stream of cache writes (key, value long, ts) -> each write after which ttl_seconds passed without another, when it leaves the state."""
    rows = writes.select("key", F.lit("live").alias("status"), "ts", F.col("value").alias("event_id"))
    return ended_runs(rows, ttl_seconds, delay).select("key", F.col("event_id").alias("value"), "ts")

