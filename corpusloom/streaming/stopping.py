"""The stopping rule and event counts on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def stream_stopping(log: DataFrame, patience: int = 100) -> DataFrame:
    """``reviewer, reviewed, stopped`` as records ``(reviewer, time, label)`` arrive, in order within a reviewer.

    State is three numbers a reviewer: records read, irrelevant ones in a row after the first relevant one, whether the rule has fired.
    """

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        read, run, stopped = state.get if state.exists else (0, -1, False)
        rows = pd.concat(list(chunks)).sort_values("time")
        for label in rows["label"]:
            if stopped:
                break
            read += 1
            run = 0 if label == 1 else run + 1 if run >= 0 else -1
            stopped = run >= patience
        state.update((int(read), int(run), bool(stopped)))
        yield pd.DataFrame({"reviewer": [key[0]], "reviewed": [int(read)], "stopped": [bool(stopped)]})

    return log.groupBy("reviewer").applyInPandasWithState(step, "reviewer long, reviewed long, stopped boolean", "read long, run long, stopped boolean", "update", "NoTimeout")


class OrderedStopping(StatefulProcessor):
    """The stopping rule in the order of event time: rows wait in a buffer until the watermark has passed them.

    A reviewer's state are the three numbers of ``stream_stopping`` and the rows that wait; one timer stands at the earliest of these. Nothing waits longer than the watermark's delay.
    """

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "read long, run long, stopped boolean")
        self.waiting = handle.getListState("waiting", "ms long, record long, label int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [(int(ms), int(r), int(y)) for rows_ in rows for ms, r, y in zip(rows_["ms"], rows_["record"], rows_["label"])]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(ms for ms, _, _ in new))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self.waiting.get())
        due, rest = [r for r in rows if r[0] <= passed], [r for r in rows if r[0] > passed]
        read, run, stopped = self.counts.get() if self.counts.exists() else (0, -1, False)
        for _, _, label in due:
            if stopped:
                break
            read += 1
            run = 0 if label == 1 else run + 1 if run >= 0 else -1
            stopped = run >= self.patience
        self.counts.update((int(read), int(run), bool(stopped)))
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0])
        if due:
            yield pd.DataFrame({"reviewer": [key[0]], "reviewed": [int(read)], "stopped": [bool(stopped)]})

    def close(self) -> None:
        pass


def ordered_stopping(log: DataFrame, patience: int = 100, delay: str = "10 minutes") -> DataFrame:
    """``reviewer, reviewed, stopped`` of a stream ``(reviewer, record, ts, label)`` whose rows may come in any order within ``delay``: what the batch finds in the order of time.

    Rows of one time go by record. Rows later than the delay are left out, and rows wait until the watermark has passed them. The session's state store must be RocksDB's.
    """
    timed = log.withWatermark("ts", delay).select("reviewer", "ts", F.unix_millis("ts").alias("ms"), F.col("record").cast("long").alias("record"), F.col("label").cast("int").alias("label"))
    return timed.groupBy("reviewer").transformWithStateInPandas(OrderedStopping(patience), "reviewer long, reviewed long, stopped boolean", "Update", "EventTime")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events by type and time; rows later than ``late`` are left out on streams."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
