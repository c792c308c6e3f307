"""Debounced batches of change events: a batch closes after a quiet gap, or at a longest span from its first event."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

BATCH = "key string, batch long, opened timestamp, closed timestamp, events long, paths long"


def batches(events: DataFrame, gap_s: float, longest_s: float) -> DataFrame:
    """key, batch (from 1), opened, closed, events and distinct paths of each batch of a bounded table (key, path, ts).

    An event joins the open batch if it comes no later than gap_s after the last one and longest_s after the first.
    Keys are independent, and a key's events are read in order of time.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["key", "batch", "opened", "closed", "events", "paths"]
        current: list | None = None  # the open batch, its paths as a set
        closed: list[list] = []
        for part in parts:
            for key, path, ts in zip(part["key"], part["path"], part["ts"], strict=True):
                same_key = current is not None and current[0] == key
                if same_key and (ts - current[3]).total_seconds() <= gap_s and (ts - current[2]).total_seconds() <= longest_s:
                    current[3], current[4] = ts, current[4] + 1
                    current[5].add(path)
                    continue
                if current is not None:
                    closed.append([*current[:5], len(current[5])])
                current = [key, current[1] + 1 if same_key else 1, ts, ts, 1, {path}]
            yield pd.DataFrame(closed, columns=columns)
            closed = []
        if current is not None:
            yield pd.DataFrame([[*current[:5], len(current[5])]], columns=columns)

    # sorted by Spark within each key, so that rows stream through and only the open batch is held
    return events.select("key", "path", "ts").repartition("key").sortWithinPartitions("key", "ts", "path").mapInPandas(run, BATCH)


class Debounce(StatefulProcessor):
    """The same batching for a stream, with processing-time timers: a batch is emitted when it has been quiet or open for long enough."""

    def __init__(self, gap_s: float = 1.5, longest_s: float = 2.0):
        self.gap_ms, self.longest_ms = int(gap_s * 1000), int(longest_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.paths = handle.getMapState("paths", "path string", "nth long")
        self.span = handle.getValueState("span", "opened long, events long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        opened, events = self.span.get() if self.span.exists() else (now, 0)
        for part in rows:
            for path in part["path"]:
                events += 1
                if not self.paths.containsKey((path,)):
                    self.paths.updateValue((path,), (events,))
        self.span.update((opened, events))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(min(now + self.gap_ms, opened + self.longest_ms))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = sorted((nth[0], path[0]) for path, nth in self.paths.iterator())
        events = self.span.get()[1]
        self.paths.clear()
        self.span.clear()
        yield pd.DataFrame({"key": [key[0]], "events": [events], "paths": [[p for _, p in found]]})

    def close(self) -> None:
        pass


def debounced(stream: DataFrame, gap_s: float = 1.5, longest_s: float = 2.0) -> DataFrame:
    """key, events and paths (each once, in order of arrival) of each batch of a stream of (key, path)."""
    return stream.groupBy("key").transformWithStateInPandas(Debounce(gap_s, longest_s), "key string, events long, paths array<string>", "append", "processingTime")


def session_events(events: DataFrame) -> DataFrame:
    """The events table as changes: a user's events, keyed by the user, with the type as the path."""
    return events.select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("path"), "ts")
