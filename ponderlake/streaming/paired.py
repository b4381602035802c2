"""Log entries of a step paired with that step's statistics, however they arrive, as a stream.

A trainer logs a step's metrics when its optimiser has run, and its groups' statistics when its rollouts are scored; the two
come in any order, late, or never.  Each run keeps a queue of what waits for its other half; a pair leaves as soon as it is
whole, and what has waited until event time has passed it by ``patience`` leaves alone, by a timer.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a stream's rows hold: a run, a step, when, which half (``log`` or ``stats``), and its content as JSON text.
ROWS = "run string, step long, at timestamp, kind string, body string"
PAIRS = "run string, step long, log string, stats string"


class Pairing(StatefulProcessor):
    """A queue (step -> halves, until when) and timers for each run."""

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "step long", "log string, stats string, until long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        out = []
        for frame in rows:
            times = frame["at"].astype("datetime64[ms]").astype("int64")
            for step, at, kind, body in zip(frame["step"], times, frame["kind"], frame["body"], strict=True):
                place = (int(step),)
                known = self.waiting.getValue(place) if self.waiting.containsKey(place) else (None, None, int(at) + self.patience)
                log, stats, until = known
                if kind == "log":
                    log = body if log is None else log  # the first of repeated entries counts
                else:
                    stats = body if stats is None else stats
                if log is not None and stats is not None:
                    out.append((key[0], place[0], log, stats))
                    if self.waiting.containsKey(place):
                        self.waiting.removeKey(place)
                else:
                    self.waiting.updateValue(place, (log, stats, until))
                    self.handle.registerTimer(until)
        yield pd.DataFrame(out, columns=["run", "step", "log", "stats"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        late = [(place[0], *value) for place, value in self.waiting.iterator() if value[2] <= now]
        for step, *_ in late:
            self.waiting.removeKey((step,))
        yield pd.DataFrame([(key[0], step, log, stats) for step, log, stats, _ in late], columns=["run", "step", "log", "stats"])

    def close(self) -> None:
        pass


def paired(stream: DataFrame, late: str = "10 minutes", patience_ms: int = 3_600_000) -> DataFrame:
    """run, step, log, stats as they become whole, or with one half missing once the watermark (``late``) passes ``patience_ms``.

    Needs the RocksDB state store (``rocksdb_state``).  Rows later than ``late`` are dropped, as in any stream; rows without run, step, time or content are left out.
    """
    whole = " AND ".join(f"{c} IS NOT NULL" for c in ("run", "step", "at", "body"))
    rows = stream.where(f"{whole} AND kind IN ('log', 'stats')").withWatermark("at", late)
    return rows.groupBy("run").transformWithStateInPandas(
        statefulProcessor=Pairing(patience_ms), outputStructType=PAIRS, outputMode="Append", timeMode="EventTime"
    )


def rocksdb_state(spark) -> None:
    """The state store that stateful processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def paired_batch(rows: DataFrame) -> DataFrame:
    """The same from a table: the first of each half by order of its content, whole pairs only."""
    half = lambda k: F.min(F.when(F.col("kind") == k, F.col("body"))).alias(k)
    return rows.where("run IS NOT NULL AND step IS NOT NULL").groupBy("run", "step").agg(half("log"), half("stats")).where(
        "log IS NOT NULL AND stats IS NOT NULL"
    )
