"""Continuous retries: failed keys come back after a growing pause, until they succeed or are given up."""

from __future__ import annotations

import time as clock
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

OFFER = "file_name string, action string, failures long"


class Retries(StatefulProcessor):
    """Per key: how often it failed since its last success, and a processing-time timer for its next offer."""

    def __init__(self, most: int, pause_ms: int, longest_ms: int):
        self.most, self.pause_ms, self.longest_ms = most, pause_ms, longest_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failures = handle.getValueState("failures", "n long")

    def _offer(self, key: tuple, action: str, n: int) -> pd.DataFrame:
        return pd.DataFrame({"file_name": [key[0]], "action": [action], "failures": [n]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        n = before = self.failures.get()[0] if self.failures.exists() else 0
        for df in rows:
            for status in df.sort_values("attempt", kind="stable")["status"]:
                n = n + 1 if status == "failed" else 0 if n < self.most else n
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if n == 0:
            self.failures.clear()
            return
        self.failures.update((n,))
        if n >= self.most:
            if before < self.most:
                yield self._offer(key, "skip", n)
            return
        pause = min(self.longest_ms, self.pause_ms << (n - 1))
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + pause)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._offer(key, "retry", self.failures.get()[0])

    def close(self) -> None:
        pass


def retry_offers(attempts: DataFrame, most: int = 3, pause_s: float = 30.0, longest_s: float = 3600.0) -> DataFrame:
    """(file_name, action, failures) of a stream of attempts (file_name, attempt, status): retry once a pause after a failure has passed, doubled with each
    further one; skip, once, at the `most`-th failure in a row, from when on the key stays given up. Needs the RocksDB state store."""
    rows = attempts.select("file_name", F.col("attempt").cast("long").alias("attempt"), "status")
    return rows.groupBy("file_name").transformWithStateInPandas(Retries(most, int(pause_s * 1000), int(longest_s * 1000)), OFFER, "Append", "ProcessingTime")


def run_until_idle(query: StreamingQuery, idle_s: float, longest_s: float = 86_400.0, poll_s: float = 0.5) -> None:
    """Lets a query run until it has neither read nor returned a row for idle_s (longer than any pause it waits for), then stops it."""
    begun = last = clock.monotonic()
    seen = None
    while query.isActive and clock.monotonic() - begun < longest_s and clock.monotonic() - last < idle_s:
        for p in query.recentProgress:
            if (seen is None or p["batchId"] > seen) and p["numInputRows"] + max(p["sink"]["numOutputRows"], 0) > 0:
                seen, last = p["batchId"], clock.monotonic()
        clock.sleep(poll_s)
    query.stop()
