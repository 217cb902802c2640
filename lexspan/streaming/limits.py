"""Keyed limits over request streams: token bucket and warning suppression.

Both keep a small state per key in Spark's state store, so a restarted query
continues where its checkpoint left off. Event time decides; within one batch a
key's rows are put in order, and a late row never moves its clock back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# ---- fixed values ---------------------------------------------------------
CAPACITY, REFILL_PER_SECOND, STATE_SECONDS, WARNING_SECONDS = 50, 2.0, 60, 60.0
# ---------------------------------------------------------------------------


def _in_order(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(["seconds", "request_id"], kind="stable")


def token_bucket(requests: DataFrame, capacity: float = CAPACITY, rate: float = REFILL_PER_SECOND, ttl: float = STATE_SECONDS,
                 delay: str = "1 minute") -> DataFrame:
    """Decision per request (`client_id, request_id, ts`): `allowed, tokens`.

    A bucket refills with time up to its capacity; a denied request changes
    nothing; a bucket untouched for `ttl` seconds starts full again. The state of
    a bucket is dropped once the watermark has passed that point.
    """
    stamped = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    timed = stamped.select("client_id", "request_id", "ts", F.col("ts").cast("double").alias("seconds"))

    def decide(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (float(capacity), 0.0)
        known = state.exists
        rows = _in_order(frames)
        allowed, left = [], []
        for now in rows["seconds"]:
            if known and now - last >= ttl:
                tokens, known = float(capacity), False
            filled = min(float(capacity), tokens + max(0.0, now - last) * rate) if known else float(capacity)
            passes = filled >= 1.0
            if passes:
                tokens, last, known = filled - 1.0, max(now, last), True
            allowed.append(passes)
            left.append(tokens if passes else filled)
        if known:
            state.update((tokens, last))
            state.setTimeoutTimestamp(max(int((last + ttl) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({
            "client_id": key[0], "request_id": rows["request_id"].to_numpy(), "seconds": rows["seconds"].to_numpy(),
            "allowed": allowed, "tokens": left,
        })

    types = dict(timed.dtypes)
    out = f"client_id {types['client_id']}, request_id {types['request_id']}, seconds double, allowed boolean, tokens double"
    return timed.groupBy("client_id").applyInPandasWithState(
        decide, out, "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout)


def suppress_repeats(warnings: DataFrame, interval: float = WARNING_SECONDS, delay: str = "1 minute") -> DataFrame:
    """At most one warning per key and interval (`key, request_id, ts`).

    What was last shown of a key matters for one interval; its state is dropped once the
    watermark has passed that.
    """
    stamped = warnings.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    timed = stamped.select("key", "request_id", "ts", F.col("ts").cast("double").alias("seconds"))

    def emit(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else float("-inf")
        rows = _in_order(frames)
        keep = []
        for now in rows["seconds"]:
            shown = now - last >= interval
            last = now if shown else last
            keep.append(shown)
        state.update((last,))
        state.setTimeoutTimestamp(max(int((last + interval) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield rows.loc[keep, ["key", "request_id", "seconds"]]

    types = dict(timed.dtypes)
    return timed.groupBy("key").applyInPandasWithState(
        emit, f"key {types['key']}, request_id {types['request_id']}, seconds double", "last double", "append", GroupStateTimeout.EventTimeTimeout)
