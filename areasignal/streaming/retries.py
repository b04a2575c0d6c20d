"""Retries of failed units as state of a stream: the last error, how often it was tried, and when it is due again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Milliseconds before the first retry; each further one waits twice as long, up to the longest wait.
FIRST_WAIT, LONGEST_WAIT = 60_000, 3_600_000
OUTPUT = "unit string, event string, error string, attempts int, due timestamp"
#: What the state store must be.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def wait(attempts: int, first: int = FIRST_WAIT, longest: int = LONGEST_WAIT) -> int:
    """Milliseconds until the next attempt after so many failed ones."""
    return min(longest, first << min(attempts - 1, 40))


class Retries(StatefulProcessor):
    """Of attempts (unit, ok, error, at): a unit that fails is kept with its error, number of failed attempts and due time; one that
    succeeds is forgotten. When it is due, a timer emits it as `retry`."""

    def __init__(self, first: int = FIRST_WAIT, longest: int = LONGEST_WAIT) -> None:
        self.first, self.longest = first, longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("failed", "error string, attempts int, due bigint, at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tried = pd.concat(list(rows)).sort_values("at", kind="stable")
        held = self.state.get() if self.state.exists() else None
        error, attempts, due, last = held if held else (None, 0, None, -1)
        before, out = due, []
        for r in tried.itertuples():
            at = int(r.at.value // 1_000_000)
            if at <= last:  # an attempt that a repeated batch brings again
                continue
            last = at
            if r.ok:
                if attempts:
                    out.append((key[0], "done", None, attempts, None))
                error, attempts, due = None, 0, None
            else:
                error, attempts = r.error, attempts + 1
                due = at + wait(attempts, self.first, self.longest)
                out.append((key[0], "failed", error, attempts, pd.Timestamp(due, unit="ms")))
        if before is not None and before != due:
            self.handle.deleteTimer(before)
        if due is None:
            self.state.clear()
        else:
            self.state.update((error, attempts, due, last))
            if before != due:
                self.handle.registerTimer(due)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            error, attempts, due, _ = self.state.get()
            if due == expiredTimerInfo.getExpiryTimeInMs():
                yield _frame([(key[0], "retry", error, attempts, pd.Timestamp(due, unit="ms"))])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["unit", "event", "error", "attempts", "due"])
    return out.astype({"unit": "object", "event": "object", "error": "object", "attempts": "int32", "due": "datetime64[ns]"})


def tracked(attempts: DataFrame, late: str = "0 seconds", first: int = FIRST_WAIT, longest: int = LONGEST_WAIT) -> DataFrame:
    """OUTPUT rows of a stream of attempts (unit, ok, error, at): `failed` at each failure, `done` when a failed unit succeeds, `retry`
    when the watermark of `at` passes the time that a unit is due. State is keyed by unit, so nothing of the target is read anew;
    it is kept by the checkpoint, and attempts that come again count once. Needs the state store STORE."""
    keyed = attempts.selectExpr("CAST(unit AS STRING) AS unit", "ok", "error", "at").withWatermark("at", late).groupBy("unit")
    return keyed.transformWithStateInPandas(Retries(first, longest), OUTPUT, "Append", "EventTime")
