"""Leases of tasks as a stream: a lease ends when its time is over, without an event that says so.

A claim takes an issue for so many seconds; heartbeats renew it. An issue whose last heartbeat (without one: its last claim)
is longer ago than the lease times ``grace`` has expired, once and for all. State is the last claim, the last heartbeat and
the comments that the watermark hasn't reached, for each issue; comments count in the order of time and id whatever order
they come in, as long as they are within the watermark's delay. A timer wakes an issue when the watermark reaches its next
comment or passes its deadline.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that timers need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
EXPIRED = "issue long, exec_id string, renewed_us long, expired_us long"
GRACE = 1.5


class Leases(StatefulProcessor):
    """Comments (issue, id, at_us, kind, exec_id, lease_seconds) to expired leases."""

    def __init__(self, grace: float = GRACE) -> None:
        self.grace = grace

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at_us long, id long, kind string, exec_id string, lease_seconds long")
        self.lease = handle.getValueState("lease", "exec_id string, claimed_us long, lease_us long, beat_us long, expired boolean")

    def wake(self, ms: int) -> None:
        self.handle.registerTimer(ms)  # one that is set already stays as it is

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        old = self.lease.get()
        if not (old and old[4]):
            new = [x for some in rows for x in zip(*[some[c].tolist() for c in ("at_us", "id", "kind", "exec_id", "lease_seconds")])]
            if new:
                self.waiting.appendList(new)
                self.wake(max(-(-min(new)[0] // 1000), timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now_us = timerValues.getCurrentWatermarkInMs() * 1000
        exec_id, claimed, lease, beat, expired = self.lease.get() or (None, None, None, None, False)
        if expired:
            return
        every = sorted(tuple(x) for x in self.waiting.get())
        due, later = [x for x in every if x[0] <= now_us], [x for x in every if x[0] > now_us]
        over: int | None = None

        def deadline() -> int | None:
            return None if claimed is None else (claimed if beat is None else beat) + int(lease * self.grace)

        for at, _, kind, who, seconds in due:
            if (end := deadline()) is not None and at > end:
                over = end
                break
            if kind == "claim":
                exec_id, claimed, lease = who, at, seconds * 1_000_000
            else:
                beat = at if beat is None else max(beat, at)
        end = deadline()
        if over is None and end is not None and now_us > end:
            over = end
        self.lease.update((exec_id, claimed, lease, beat, over is not None))
        if over is not None:
            self.waiting.clear()
            yield pd.DataFrame({"issue": [int(key[0])], "exec_id": [exec_id], "renewed_us": [claimed if beat is None else beat], "expired_us": [over]})
            return
        if due:
            self.waiting.clear()
            if later:
                self.waiting.put(later)
        marks = [-(-x[0] // 1000) for x in later[:1]] + ([end // 1000 + 1] if end is not None else [])
        if marks:
            self.wake(min(marks))

    def close(self) -> None:
        pass


@contextmanager
def timers(spark: SparkSession) -> Iterator[None]:
    """Within this, streams start with the state store that timers need."""
    old = {k: spark.conf.get(k) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def expiries(comments: DataFrame, grace: float = GRACE, delay: str = "0 seconds") -> DataFrame:
    """issue, exec_id, renewed_at, expired_at: a row for each lease that ends, when the watermark passes its end. ``comments``
    is a stream of issue, id, at, kind, exec_id, lease_seconds; rows of another kind only move time on."""
    rows = comments.withColumn("at_us", F.unix_micros("at")).withWatermark("at", delay)
    # (names the time, else the filter would go below the watermark, which other rows move on too)
    rows = rows.where(F.when(F.col("at").isNotNull(), F.col("kind").isin("claim", "heartbeat")))
    out = rows.groupBy("issue").transformWithStateInPandas(
        statefulProcessor=Leases(grace), outputStructType=EXPIRED, outputMode="Append", timeMode="EventTime",
    )
    return out.select("issue", "exec_id", F.timestamp_micros("renewed_us").alias("renewed_at"), F.timestamp_micros("expired_us").alias("expired_at"))


def expired_by(comments: DataFrame, now: str, grace: float = GRACE) -> DataFrame:
    """The same from a table of comments, for all leases that ended before ``now``."""
    rows = comments.where(F.col("at") <= F.lit(now).cast(comments.schema["at"].dataType)).where(F.col("kind").isin("claim", "heartbeat"))
    order = Window.partitionBy("issue").orderBy("at", "id")
    claim = F.when(F.col("kind") == "claim", F.struct("exec_id", "at", "lease_seconds"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(
        "issue", "at", "id", F.last(claim, ignorenulls=True).over(upto).alias("c"), F.max(F.when(F.col("kind") == "heartbeat", F.col("at"))).over(upto).alias("beat"),
        F.coalesce(F.lead("at").over(order), F.lit(now).cast(comments.schema["at"].dataType)).alias("next"),
    ).where("c is not null")
    renewed = F.coalesce("beat", "c.at")
    rows = rows.withColumn("renewed_at", renewed).withColumn("expired_at", renewed + F.make_dt_interval(secs=(F.col("c.lease_seconds") * grace).cast("decimal(18,6)")))
    late = rows.where("expired_at < next")
    return late.groupBy("issue").agg(F.min_by(F.struct("c.exec_id", "renewed_at", "expired_at"), F.struct("at", "id")).alias("x")).select("issue", "x.*")
