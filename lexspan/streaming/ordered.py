"""Token bucket and warning suppression as stateful processors with timers.

The rows of a key come in frames of bounded size. One frame is put in order where it is;
of several, each is sorted, cut into cells that wait in the state store, and the sorted
frames are merged cell by cell, so a hot key never stands in memory as one table. What
stays between batches is one value for each key, removed by an event-time timer.

The state store must be RocksDB (`with_state_store`).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from contextlib import contextmanager
from heapq import merge
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexspan.streaming.limits import CAPACITY, REFILL_PER_SECOND, STATE_SECONDS, WARNING_SECONDS

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a cell, and of a frame that goes out.
CELL, OUT_ROWS = 256, 8192


@contextmanager
def with_state_store(spark: SparkSession):
    """RocksDB for the streams started inside, the session's own setting afterwards."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class _InOrder(StatefulProcessor):
    """Walks the rows of a key in order of time; subclasses say what a row does."""

    STATE = ""

    def __init__(self, out: list[str], life: float, cell: int = CELL):
        self.out, self.life, self.cell = out, life, cell

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", f"{self.STATE}, last double, timer long")
        self.cells = handle.getMapState("cells", "run int, cell int", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.kept.get() if self.kept.exists() else None
        timer = state[-1] if state else None
        own = list(state[:-1]) if state else None
        made: list[tuple] = []
        for seconds, request in self._ordered(rows):
            own, result = self.step(own, seconds)
            if result is not None:
                made.append((key[0], request, seconds, *result))
            if len(made) == OUT_ROWS:
                yield pd.DataFrame(made, columns=self.out)
                made = []
        if own is not None:
            due = max(int((own[-1] + self.life) * 1000) + 1, timerValues.getCurrentWatermarkInMs() + 1)
            if timer is not None and timer != due:
                self.handle.deleteTimer(timer)
            if timer != due:
                self.handle.registerTimer(due)
            self.kept.update((*own, due))
        yield pd.DataFrame(made, columns=self.out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        yield pd.DataFrame([], columns=self.out)

    def close(self) -> None:
        pass

    def _ordered(self, frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        first, second = next(frames, None), next(frames, None)
        if first is None:
            return
        if second is None:
            yield from _sorted(first)
            return
        runs = []
        for run, frame in enumerate(chain([first, second], frames)):
            rows = _sorted(frame)
            for place, start in enumerate(range(0, len(rows), self.cell)):
                self.cells.updateValue((run, place), (pickle.dumps(rows[start:start + self.cell]),))
            runs.append(-(-len(rows) // self.cell))
        yield from merge(*[self._run(run, count) for run, count in enumerate(runs)])

    def _run(self, run: int, count: int) -> Iterator[tuple]:
        for place in range(count):
            rows = pickle.loads(self.cells.getValue((run, place))[0])
            self.cells.removeKey((run, place))
            yield from rows

    def step(self, own: list | None, now: float) -> tuple[list | None, tuple | None]:
        raise NotImplementedError


def _sorted(frame: pd.DataFrame) -> list[tuple]:
    return sorted(zip(frame["seconds"].tolist(), frame["request_id"].tolist(), strict=True))


class _Bucket(_InOrder):
    """State: tokens, time of the last request that passed."""

    STATE = "tokens double"

    def __init__(self, out, capacity: float, rate: float, ttl: float, cell: int):
        super().__init__(out, ttl, cell)
        self.capacity, self.rate = float(capacity), rate

    def step(self, own, now):
        if own is not None and now - own[1] >= self.life:
            own = None
        filled = self.capacity if own is None else min(self.capacity, own[0] + max(0.0, now - own[1]) * self.rate)
        if filled < 1.0:
            return own, (False, filled)
        return [filled - 1.0, now if own is None else max(now, own[1])], (True, filled - 1.0)


class _Suppress(_InOrder):
    """State: a count of what was held back, time of the last warning shown."""

    STATE = "held long"

    def step(self, own, now):
        if own is None or now - own[1] >= self.life:
            return [0, now], ()
        return [own[0] + 1, own[1]], None


def _timed(rows: DataFrame, key: str, delay: str) -> DataFrame:
    stamped = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return stamped.select(key, "request_id", "ts", F.col("ts").cast("double").alias("seconds"))


def token_bucket(requests: DataFrame, capacity: float = CAPACITY, rate: float = REFILL_PER_SECOND, ttl: float = STATE_SECONDS,
                 delay: str = "1 minute", cell: int = CELL) -> DataFrame:
    """Decision per request (`client_id, request_id, seconds, allowed, tokens`), ties in time by request id.

    A bucket refills with time up to its capacity; a denied request changes nothing; a bucket
    without a passing request for `ttl` seconds starts full again and leaves the state store.
    """
    timed = _timed(requests, "client_id", delay)
    types = dict(timed.dtypes)
    out = f"client_id {types['client_id']}, request_id {types['request_id']}, seconds double, allowed boolean, tokens double"
    names = ["client_id", "request_id", "seconds", "allowed", "tokens"]
    return timed.groupBy("client_id").transformWithStateInPandas(_Bucket(names, capacity, rate, ttl, cell), out, "append", "eventTime")


def suppress_repeats(warnings: DataFrame, interval: float = WARNING_SECONDS, delay: str = "1 minute", cell: int = CELL) -> DataFrame:
    """At most one warning per key and interval (`key, request_id, seconds`), ties in time by request id."""
    timed = _timed(warnings, "key", delay)
    types = dict(timed.dtypes)
    out = f"key {types['key']}, request_id {types['request_id']}, seconds double"
    return timed.groupBy("key").transformWithStateInPandas(_Suppress(["key", "request_id", "seconds"], interval, cell), out, "append", "eventTime")
