"""Heartbeats with event-time timers: a session whose beats stop is interrupted, its next beat recovers it."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from reelspark.sources.shared import shared_folder
from reelspark.streaming.runner import restarted

CHANGES = "session_id bigint, event_id bigint, at bigint, change string"


class LeaseProcessor(StatefulProcessor):
    """Beats wait until the watermark has passed them, so their order does not depend on micro-batches. A
    timer at a beat's time and one behind its lease settle them. Held are the last settled beat, whether
    its lease ran out, and the beats that wait: a bounded stretch of time."""

    def __init__(self, lease_us: int) -> None:
        self.lease = lease_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("lease", "held string")

    def _settle(self, key, now: int) -> list[tuple]:
        last, out_of_lease, waiting = json.loads(self.held.get()[0]) if self.held.exists() else (None, False, [])
        return self._changes(key, last, out_of_lease, sorted(map(tuple, waiting)), now)

    def _changes(self, key, last, out_of_lease, waiting, now: int) -> list[tuple]:
        found = []
        while True:
            following = waiting[0] if waiting and waiting[0][0] <= now else None
            end = last[0] + self.lease if last else None
            if last and not out_of_lease and end < (following[0] if following else now):
                found.append((key[0], last[1], last[0], "interrupted"))
                out_of_lease = True
            if not following:
                break
            if out_of_lease:
                found.append((key[0], last[1], last[0], "recovered"))
            last, out_of_lease, waiting = following, False, waiting[1:]
        self.held.update((json.dumps([last, out_of_lease, waiting]),))
        if waiting:
            self.handle.registerTimer(waiting[0][0] // 1000 + 1)
        elif last and not out_of_lease:
            self.handle.registerTimer((last[0] + self.lease) // 1000 + 1)
        return found

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, out_of_lease, waiting = json.loads(self.held.get()[0]) if self.held.exists() else (None, False, [])
        for batch in rows:
            waiting += zip(batch["at"].tolist(), batch["event_id"].tolist(), strict=True)
        yield _frame(self._changes(key, last, out_of_lease, sorted(map(tuple, waiting)), timerValues.getCurrentWatermarkInMs() * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield _frame(self._settle(key, timerValues.getCurrentWatermarkInMs() * 1000))

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["session_id", "event_id", "at", "change"])


def lease_changes(beats: DataFrame, lease_seconds: int, delay: str) -> DataFrame:
    """Interrupted and recovered sessions of a stream of beats (session_id, event_id, ts), each with the last
    beat before; beats more than ``delay`` behind the latest one are lost."""
    rows = beats.withColumn("at", F.unix_micros("ts")).withWatermark("ts", delay)
    return rows.groupBy("session_id").transformWithStateInPandas(LeaseProcessor(lease_seconds * 1_000_000), CHANGES, "Append", "EventTime")


def interruptions(spark: SparkSession, beats: DataFrame, lease_seconds: int, batches: int, delay_seconds: int = 60) -> DataFrame:
    """(session_id, event_id, at, outcome) of the holes of ``beats`` (session_id, event_id, ts), run as a stream
    in ``batches`` by time and closed by a mark that brings the watermark one lease behind the last beat. A
    hole that no beat ended is open. Beats without session or time are none; without beats there is no row."""
    beats = beats.where("session_id is not null and ts is not null").select("session_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    lo, hi = beats.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    if lo is None:
        return spark.createDataFrame([], "session_id bigint, event_id bigint, at bigint, outcome string")
    width = (hi - lo) // batches + 1
    by_time = beats.withColumn("_k", F.expr(f"(unix_micros(ts) - {lo}L) div {width}L"))
    mark = spark.range(1).select(F.lit(None).cast("bigint").alias("session_id"), F.lit(None).cast("bigint").alias("event_id"), F.timestamp_micros(F.lit(hi + (lease_seconds + delay_seconds) * 1_000_000)).alias("ts"))
    parts = [by_time.where(f"_k = {k}").drop("_k") for k in range(batches)] + [mark]
    found = restarted(spark, parts, lambda s: lease_changes(s.where("session_id is not null").unionByName(s.where("session_id is null")), lease_seconds, f"{delay_seconds} seconds"), shared_folder(spark, "leases"))
    ended = F.max(F.when(F.col("change") == "recovered", 1)).isNotNull()
    return found.where("session_id is not null").groupBy("session_id", "event_id", "at").agg(F.when(ended, "recovered").otherwise("open").alias("outcome"))
