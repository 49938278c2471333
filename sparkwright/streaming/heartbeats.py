"""Runs as a stream of events: heartbeats, progress, completion and time-outs, kept
as state with timers, so that a run whose worker is gone comes out once, when its
time is over and not when somebody asks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: Events: of a run at a time, ``kind`` one of started, heartbeat, progress, completed.
EVENT = "run_id string, at timestamp, kind string, worker_id string, phase string, percent int, status string"
#: What comes out: a run that completed or timed out, with what was known of it.
OUTCOME = "run_id string, outcome string, at timestamp, worker_id string, phase string, percent int, n_events long"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_STATE = "worker_id string, phase string, percent int, last_ms long, n_events long, done boolean"


class _Run(StatefulProcessor):
    """One run.  Its owner is the worker whose start came first or, once it has timed
    out, the next one; other workers' events count for nothing."""

    def __init__(self, timeout_s: int):
        self.timeout_ms = timeout_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        worker, phase, percent, last, n, done = self.state.get() if self.state.exists() else (None, None, None, None, 0, False)
        events = pd.concat(list(rows)).sort_values(["ms", "kind"], kind="stable")
        out = []
        for e in events.itertuples(index=False):
            ms = int(e.ms)
            if done:
                continue
            if last is not None and ms - last > self.timeout_ms:
                # Nothing was heard for too long before this event came.
                out.append(self._row(key, "timed_out", last + self.timeout_ms, worker, phase, percent, n))
                worker, phase, percent, n = None, None, None, 0
            if worker is None:
                worker = e.worker_id
            if e.worker_id != worker:
                continue
            n, last = n + 1, ms if last is None else max(last, ms)
            if e.kind == "progress":
                phase, percent = e.phase, None if pd.isna(e.percent) else int(e.percent)
            if e.kind == "completed":
                done = True
                out.append(self._row(key, e.status or "completed", ms, worker, phase, percent, n))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if last is not None and not done:
            self.handle.registerTimer(last + self.timeout_ms)
        self.state.update((worker, phase, percent, last, n, done))
        if out:
            yield pd.concat(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        worker, phase, percent, last, n, done = self.state.get()
        if not done and last is not None:
            self.state.update((None, None, None, None, 0, False))
            yield self._row(key, "timed_out", last + self.timeout_ms, worker, phase, percent, n)

    def _row(self, key, outcome: str, ms: int, worker, phase, percent, n: int) -> pd.DataFrame:
        return pd.DataFrame({"run_id": [key[0]], "outcome": [outcome], "ms": [ms], "worker_id": [worker], "phase": [phase], "percent": pd.array([percent], "Int32"), "n_events": [n]})

    def close(self) -> None:
        pass


def outcomes(events: DataFrame, timeout_s: int = 300, late_s: int = 0) -> DataFrame:
    """``OUTCOME`` rows of a stream of ``EVENT``s: each completion, and each silence of
    a run that lasts longer than ``timeout_s`` by event time.  Events of a run come
    in any order within ``late_s``; later ones are dropped by the watermark.  Null
    run ids are left out.  Needs the RocksDB state store."""
    known = events.filter("run_id is not null and at is not null").withWatermark("at", f"{late_s} seconds").withColumn("ms", F.unix_millis("at"))
    kind = OUTCOME.replace("at timestamp", "ms long")
    out = known.groupBy("run_id").transformWithStateInPandas(_Run(timeout_s), outputStructType=kind, outputMode="Append", timeMode="EventTime")
    return out.select("run_id", "outcome", F.timestamp_millis("ms").alias("at"), "worker_id", "phase", "percent", "n_events")


def track(events: DataFrame, out: str, checkpoint: str, timeout_s: int = 300, late_s: int = 0, available_now: bool = True) -> StreamingQuery:
    """Writes the outcomes of a stream of events as Parquet.  The state store that
    timers need is chosen for this query alone."""
    conf = events.sparkSession.conf
    before = conf.get(_STORE, None)
    conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        writer = outcomes(events, timeout_s, late_s).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()
    finally:
        conf.unset(_STORE) if before is None else conf.set(_STORE, before)
