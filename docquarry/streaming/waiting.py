"""Count or time, whichever comes first: one stateful stream decides when waiting documents are handed over.

Documents wait in the state of their key (a corpus, a source).  When `threshold` of them wait, or when the first has waited `seconds`, all that wait go
out together with one batch number.  State and timer survive a restart.  A key holds fewer than `threshold` documents and those of one micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "key string, id string, batch long, reason string, waited long"


class _Waiting(StatefulProcessor):
    def __init__(self, threshold: int, seconds: float):
        self.threshold, self.wait = threshold, int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ids = handle.getListState("ids", "id string")
        self.since = handle.getValueState("since", "since long, batch long, timer long")

    def _now(self) -> tuple[int, int, int]:
        return self.since.get() if self.since.exists() else (0, 0, 0)

    def _out(self, key: str, now: int, reason: str) -> pd.DataFrame:
        since, batch, timer = self._now()
        rows = [r[0] for r in self.ids.get()]
        self.ids.clear()
        if timer:
            self.handle.deleteTimer(timer)
        self.since.update((0, batch + 1, 0))
        return pd.DataFrame({"key": key, "id": rows, "batch": batch + 1, "reason": reason, "waited": len(rows)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(i,) for pdf in rows for i in pdf["id"]]
        now = timerValues.getCurrentProcessingTimeInMs()
        held = sum(1 for _ in self.ids.get()) if self.ids.exists() else 0
        self.ids.appendList(new)
        since, batch, timer = self._now()
        if held + len(new) >= self.threshold:
            yield self._out(key[0], now, "count")
        elif not timer:
            self.handle.registerTimer(now + self.wait)
            self.since.update((now, batch, now + self.wait))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # a timer that was set before the last handing over says nothing about those that wait now
        if self.ids.exists() and self._now()[2] and expiredTimerInfo.getExpiryTimeInMs() >= self._now()[2]:
            since, batch, _ = self._now()
            self.since.update((since, batch, 0))
            yield self._out(key[0], timerValues.getCurrentProcessingTimeInMs(), "time")

    def close(self) -> None:
        pass


def handed_over(stream: DataFrame, threshold: int = 10, seconds: float = 60.0, id_col: str = "id", key_col: str | None = None) -> DataFrame:
    """OUT rows of a stream of documents: each id once, when its batch is handed over.  Without a key all documents wait together."""
    if threshold < 1 or seconds <= 0:
        raise ValueError("needs threshold >= 1 and seconds > 0")
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    key = F.coalesce(F.col(key_col).cast("string"), F.lit("")) if key_col else F.lit("")
    rows = stream.select(key.alias("key"), F.col(id_col).cast("string").alias("id"))
    return rows.groupBy("key").transformWithStateInPandas(_Waiting(threshold, seconds), OUT, "Append", "ProcessingTime")


def run(stream: DataFrame, state: str, index: Callable[[DataFrame, int], None], threshold: int = 10, seconds: float = 60.0, id_col: str = "id", key_col: str | None = None, every: str = "1 second") -> StreamingQuery:
    """Starts the stream; index(rows of OUT, micro-batch) is called for what is handed over, and must bear a batch that comes again."""
    out = handed_over(stream, threshold, seconds, id_col, key_col)

    def step(df: DataFrame, batch: int) -> None:
        if not df.isEmpty():
            index(df, batch)

    return out.writeStream.foreachBatch(step).outputMode("append").option("checkpointLocation", f"{state}/checkpoint").trigger(processingTime=every).start()
