"""The first n rows of each account in event time, on a stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline.operators.relational import quota


class _Quota(StatefulProcessor):
    """An account's rows wait until the watermark has passed them, so that late ones find their place; then they are counted and let through while fewer than n were.

    State: how many were let through, one number; and the rows that wait, of
    which no more than the n first are kept, as no others can be among the
    first n.  A timer at the first waiting row's time wakes the account.
    """

    def __init__(self, n: int, schema: str, key: str, at: str, order: list[str]):
        self.n, self.schema, self.key, self.at, self.order = n, schema, key, at, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.passed = handle.getValueState("passed", "n long")
        self.waiting = handle.getListState("waiting", self.schema)

    def handleInputRows(self, key, rows, timerValues):
        have = int(self.passed.get()[0]) if self.passed.exists() else 0
        if have < self.n:
            frames = [pd.DataFrame(list(self.waiting.get()), columns=self._columns(), dtype=object), *rows] if self.waiting.exists() else list(rows)
            keep = pd.concat(frames).sort_values([self.at, *self.order], kind="stable").head(self.n - have)
            self._put(keep)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        have = int(self.passed.get()[0]) if self.passed.exists() else 0
        rows = pd.DataFrame(list(self.waiting.get()), columns=self._columns(), dtype=object)
        limit = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
        times = pd.to_datetime(rows[self.at])
        ready = rows[times < limit].head(self.n - have)
        self.passed.update((have + len(ready),))
        left = rows[times >= limit].head(max(0, self.n - have - len(ready)))
        self._put(left)
        if len(ready):
            yield ready

    def close(self) -> None:
        pass

    def _columns(self) -> list[str]:
        return [c.strip().split(" ")[0].strip("`") for c in self.schema.split(",")]

    def _put(self, rows: pd.DataFrame) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if len(rows):
            self.waiting.put([tuple(x) for x in rows[self._columns()].itertuples(index=False, name=None)])
            self.handle.registerTimer(int(pd.to_datetime(rows[self.at]).min().timestamp() * 1000) + 1)
        else:
            self.waiting.clear()


def stream_quota(rows: DataFrame, key: str, at: str, order: list[str], n: int, late: str = "10 minutes") -> DataFrame:
    """The first n rows of each key by (at, order), for a table or a stream.

    On a stream a row is let through once the watermark, `late` behind the
    latest row, has passed it; rows that come after that are dropped, as late
    rows are.  Over all batches the result is that of the table, its late rows
    aside.  Rows without a key or a time are left out.
    """
    d = rows.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    if not rows.isStreaming:
        return quota(d, [key], [at, *order], n)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    out = d.withWatermark(at, late).groupBy(key).transformWithStateInPandas(statefulProcessor=_Quota(n, schema, key, at, order), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return out
