"""Standard-deviation anomalies on a stream that comes in order: the last values of a series are its state."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "fingerprint string, value_id long, range double, mean double, stddev double, direction string"
_Found = Row(*(c.split()[0] for c in OUT.split(", ")))
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Deviation(StatefulProcessor):
    """Rows are taken one by one; what is held of a series is a list of its last `window` values, whatever the micro-batch's size. With idle_ms, the list of a series that had no rows for so long is dropped."""

    def __init__(self, window: int, deviations: float, direction: str, min_points: int, idle_ms: int | None):
        self.window, self.deviations, self.direction, self.min_points, self.idle_ms = window, deviations, direction, min_points, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.past = handle, handle.getListState("past", "x double")
        self.timer = handle.getValueState("timer", "at long") if self.idle_ms else None

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        past = deque((r[0] for r in self.past.get()), maxlen=self.window)
        for row in rows:
            if row["range"] is None:
                continue
            x = float(row["range"])
            if len(past) >= 2 and len(past) + 1 >= self.min_points:
                before = np.array(past)
                mean, sd = float(before.mean()), float(before.std(ddof=1))
                sd = sd if sd > 0 else max(abs(mean) * 0.001, 1e-10)
                if x > mean + self.deviations * sd and self.direction in ("UPPER", "BOTH"):
                    yield _Found(key[0], row["value_id"], x, mean, sd, "above")
                elif x < mean - self.deviations * sd and self.direction in ("LOWER", "BOTH"):
                    yield _Found(key[0], row["value_id"], x, mean, sd, "below")
            past.append(x)
        self.past.put([(x,) for x in past])
        if self.timer is not None:
            if self.timer.exists():
                self.handle.deleteTimer(self.timer.get()[0])
            at = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.past.clear()
        self.timer.clear()
        return iter(())

    def close(self) -> None:
        pass


def online_deviation(values: DataFrame, window: int = 40, deviations: float = 4.0, direction: str = "BOTH", min_points: int = 10, idle_ms: int | None = None) -> DataFrame:
    """values: fingerprint, value_id, range, domain. Equals the batch detector where rows come in the order of their series, within a micro-batch and from one to the next (see ingest.in_order)."""
    values.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return values.groupBy("fingerprint").transformWithState(Deviation(window, deviations, direction, min_points, idle_ms), OUT, "append", "processingTime" if idle_ms else "none")
