"""Log records flushed in groups: as soon as enough have come, or after a while by a timer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Records of a flush at most, and seconds that a record waits at most.
FLUSH_ROWS, FLUSH_SECONDS = 10, 5.0

_FLUSHED = "key string, flush long, reason string, ids array<string>"


class Flusher(StatefulProcessor):
    """One buffer for each key. Full flushes leave at once; the first record of a new buffer sets the timer by which the rest leaves."""

    def __init__(self, rows: int = FLUSH_ROWS, seconds: float = FLUSH_SECONDS):
        self.rows, self.seconds = rows, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "id string")
        self.number = handle.getValueState("number", "n long")

    def _flush(self, key: tuple, ids: list[str], reason: str) -> pd.DataFrame:
        n = self.number.get()[0] + 1 if self.number.exists() else 1
        self.number.update((n,))
        return pd.DataFrame({"key": [key[0]], "flush": [n], "reason": [reason], "ids": [ids]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [r[0] for r in self.held.get()] if self.held.exists() else []
        new = held + [i for frame in rows for i in frame["id"].tolist()]
        while len(new) >= self.rows:
            yield self._flush(key, new[: self.rows], "full")
            new, held = new[self.rows :], []
        if new and not held:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.seconds))
        self.held.put([(i,) for i in new]) if new else self.held.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ids = [r[0] for r in self.held.get()] if self.held.exists() else []
        if ids:
            self.held.clear()
            yield self._flush(key, ids, "timer")

    def close(self) -> None:
        pass


def flushed(logs: DataFrame, key: str = "module", rows: int = FLUSH_ROWS, seconds: float = FLUSH_SECONDS) -> DataFrame:
    """(key, flush, reason, ids): the records (id) of a stream in groups of ``rows`` for each key, the last ones when they have waited for ``seconds``.

    Needs the RocksDB state store, and a trigger by processing time: a run over
    what is there, such as availableNow, ends before timers do.
    """
    keyed = logs.selectExpr(f"coalesce(cast(`{key}` AS string), '') AS key", "cast(id AS string) AS id")
    return keyed.groupBy("key").transformWithStateInPandas(Flusher(rows, seconds), _FLUSHED, "append", "processingTime")
