"""Submission lifecycle, caches and rates over event streams; each has the batch form it must equal."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# States and the ones from which they may be entered.
FROM = {"queued": [None], "processing": ["queued", "error"], "complete": ["processing"], "error": ["queued", "processing"]}


def may_start(status: Column) -> Column:
    return status.isin("queued", "error")


def latest_status(events: DataFrame) -> DataFrame:
    """events (key, status, ts, event_id) -> (key, status, ts): the last by time, then event_id."""
    return events.where("key is not null").groupBy("key").agg(F.max_by(F.struct("status", "ts"), F.struct("ts", "event_id")).alias("s")).select("key", "s.*")


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, last_ts, last_id = state.get if state.exists else (None, pd.Timestamp(0).value // 1000, -1)
    for b in batches:
        for r in b.itertuples():
            at = (int(r.ts.value // 1000), int(r.event_id))
            if at > (last_ts, last_id):
                status, last_ts, last_id = r.status, *at
    state.update((status, last_ts, last_id))
    yield pd.DataFrame({"key": [key[0]], "status": [status], "ts": [pd.Timestamp(last_ts * 1000)]})


def status_stream(events: DataFrame) -> DataFrame:
    """Streaming latest_status: emits a key's status whenever it has news (update mode)."""
    return events.where("key is not null").groupBy("key").applyInPandasWithState(_advance, "key long, status string, ts timestamp", "status string, ts long, id long", "update", GroupStateTimeout.NoTimeout)


def illegal_moves(events: DataFrame) -> DataFrame:
    """Events whose status can't follow the one before; adds previous."""
    from pyspark.sql import Window

    order = Window.partitionBy("key").orderBy("ts", "event_id")
    rows = events.withColumn("previous", F.lag("status").over(order))
    fine = F.lit(False)
    for to, before in FROM.items():
        for b in before:
            fine = fine | ((F.col("status") == to) & (F.col("previous").isNull() if b is None else F.coalesce(F.col("previous") == b, F.lit(False))))
    return rows.where(~fine)


def windowed_counts(events: DataFrame, width: str, delay: str | None = None) -> DataFrame:
    """events (ts timestamp, kind, value) -> counts and sums per tumbling window and kind.

    delay: how late events may come on a stream; None for batch.
    """
    rows = events if delay is None else events.withWatermark("ts", delay)
    out = rows.groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "kind", "n", "total")


def over_rate(events: DataFrame, limit: int = 20, width: str = "1 minute", delay: str | None = None) -> DataFrame:
    """Users with more than limit events in a tumbling window."""
    rows = events if delay is None else events.withWatermark("ts", delay)
    out = rows.groupBy(F.window("ts", width).alias("w"), "user_id").agg(F.count("*").alias("n")).where(F.col("n") > limit)
    return out.select(F.col("w.start").alias("start"), "user_id", "n")


def first_seen(events: DataFrame, delay: str) -> DataFrame:
    """One event per event_id on a stream whose repeats come within delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def live_entries(writes: DataFrame, ttl_seconds: int, now: Column) -> DataFrame:
    """Cache writes (key, value, ts) that haven't expired at now: the last write of each key (ties: largest value)."""
    last = writes.groupBy("key").agg(F.max(F.struct("ts", "value")).alias("w")).select("key", "w.value", "w.ts")
    return last.where(F.unix_micros(F.col("ts").cast("timestamp")) + ttl_seconds * 1_000_000 > F.unix_micros(now.cast("timestamp")))
