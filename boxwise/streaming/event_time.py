"""Streams in the order of their events: meters that wait for the watermark, windows, sessions and joins.

A row is taken when the watermark has passed it, so that rows of one key are taken in
the order of their times whatever files or batches they come in; rows that come after the
watermark are late, are left out by Spark, and are counted in the stream's progress.
State is what waits: the rows within the delay, and a meter's own numbers for each key, by
buckets of keys.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from math import exp
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: State, and a row of (microseconds, event, value), to new state and an output row without the key.
Fold = Callable[[tuple, tuple[int, int, float]], tuple[tuple, tuple]]


#: A row that waits. Those of a batch are one value of the list, so that calls to the state store do not grow with them.
ROW = np.dtype([("key", "<i8"), ("missing", "?"), ("us", "<i8"), ("event", "<i8"), ("value", "<f8")])

#: Keys whose hashes agree in this modulus wait in one list, so that calls to the state store do not grow with the keys.
BUCKETS = 512


class InEventOrder(StatefulProcessor):
    """Rows of a bucket of keys in the order (time, event): they wait in a list, with a timer at the first; when the watermark reaches it, those that it has passed are folded, each into the state of its own key."""

    def __init__(self, fold: Fold, start: tuple, columns: list[str]) -> None:
        self.fold, self.start, self.columns = fold, start, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.folded = handle.getValueState("folded", "states binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frames = [f for f in rows if len(f)]
        new = np.zeros(sum(map(len, frames)), ROW)
        for c in ROW.names:
            new[c] = np.concatenate([f[c].to_numpy() for f in frames])
        self.waiting.appendValue((new.tobytes(),))
        self._wake(int(new["us"].min()))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = np.concatenate([np.zeros(0, ROW), *(np.frombuffer(r[0], ROW) for r in self.waiting.get())])
        rows = rows[np.lexsort((rows["value"], rows["event"], rows["us"]))]
        at = int(np.searchsorted(rows["us"], passed, side="right"))
        ready, rest = rows[:at], rows[at:]
        if len(rest):
            self.waiting.put([(rest.tobytes(),)])
            self.handle.registerTimer(-(-int(rest["us"][0]) // 1000))  # the timer that has just run out is still in the list
        else:
            self.waiting.clear()
        states = pickle.loads(self.folded.get()[0]) if self.folded.exists() else {}
        out = []
        for k, missing, *row in ready.tolist():
            own = None if missing else k
            states[own], made = self.fold(states.get(own, self.start), tuple(row))
            out.append((own, *made))
        self.folded.update((pickle.dumps(states),))
        if out:
            made = pd.DataFrame(out, columns=self.columns)
            made["key"] = pd.array([r[0] for r in out], dtype="Int64")
            yield made

    def _wake(self, us: int) -> None:
        """One timer a bucket, at the first row that waits."""
        at = -(-us // 1000)
        timers = list(self.handle.listTimers())
        if not timers or at < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)


def _folded(stream: DataFrame, key: str, time: str, order: str, value: str, delay: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the process that sets up state does not see the files shipped to executors
    own = F.col(key).cast("long")
    timed = stream.select(F.pmod(F.xxhash64(own), F.lit(BUCKETS)).alias("bucket"), F.coalesce(own, F.lit(0).cast("long")).alias("key"), own.isNull().alias("missing"), F.col(time).alias("ts"), F.unix_micros(time).alias("us"), F.col(order).cast("long").alias("event"), F.col(value).cast("double").alias("value")).where("value is not null and ts is not null")
    return timed.withWatermark("ts", delay).groupBy("bucket").transformWithStateInPandas(processor, schema, "append", "EventTime")


def rolling(stream: DataFrame, key: str, time: str, order: str, value: str, delay: str, size: int = 20) -> DataFrame:
    """key, event, median (the lower middle), avg, max, value_now, global_avg of each row once the watermark has passed it.

    State holds the last `size` values and what waits. Rows without a time or a value have no place and are left out.
    """

    def fold(state: tuple, row: tuple[int, int, float]) -> tuple[tuple, tuple]:
        last, n, total = [*state[0], row[2]][-size:], state[1] + 1, state[2] + row[2]
        return (last, n, total), (row[1], sorted(last)[(len(last) - 1) // 2], sum(last) / len(last), max(last), row[2], total / n)

    columns = ["key", "event", "median", "avg", "max", "value_now", "global_avg"]
    processor = InEventOrder(fold, ([], 0, 0.0), columns)
    return _folded(stream, key, time, order, value, delay, processor, "key long, event long, median double, avg double, max double, value_now double, global_avg double")


def ema(stream: DataFrame, key: str, time: str, order: str, value: str, delay: str, decay: float = 0.9999, warmups: float = 2000.0) -> DataFrame:
    """key, event, n and ema after each row in the order of events (R4, W12); the state is what a restart goes on from."""

    def fold(state: tuple, row: tuple[int, int, float]) -> tuple[tuple, tuple]:
        n, mean = state
        d = decay * (1 - exp(-n / warmups)) if n else 0.0
        n, mean = n + 1, d * mean + (1 - d) * row[2]
        return (n, mean), (row[1], n, mean)

    processor = InEventOrder(fold, (0, 0.0), ["key", "event", "n", "ema"])
    return _folded(stream, key, time, order, value, delay, processor, "key long, event long, n long, ema double")


def windows(stream: DataFrame, time: str, delay: str, length: str, group: list[str], value: str, slide: str | None = None) -> DataFrame:
    """start, end, group..., n, total and largest of each window of some length, that begins every `slide` (None: every length), when the watermark has passed its end."""
    w = F.window(time, length, slide or length)
    counts = stream.withWatermark(time, delay).groupBy(w.alias("w"), *group).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.max(value).alias("largest"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *group, "n", "total", "largest")


def sessions(stream: DataFrame, time: str, delay: str, gap: str, group: list[str], value: str) -> DataFrame:
    """start, end (the last row's time and the gap), group..., n and total of rows that follow each other within the gap, when the watermark has passed it."""
    counts = stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), *group).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *group, "n", "total")


def followed(first: DataFrame, second: DataFrame, key: str, time: str, delay: str, within: str) -> DataFrame:
    """The pairs of rows of two streams with one key where the second's time is at most `within` after the first's; both have key, time and other columns of distinct names.

    Both sides have a watermark and the times a bound, so a row is kept for the delay and `within` only.
    """
    a = first.withColumnRenamed(time, "first_ts").withWatermark("first_ts", delay)
    b = second.withColumnRenamed(time, "second_ts").withColumnRenamed(key, "_key").withWatermark("second_ts", delay)
    return a.join(b, F.expr(f"{key} = _key and second_ts >= first_ts and second_ts <= first_ts + interval {within}")).drop("_key")


#: The state store that keeps lists and timers, and what it writes at the end of a batch: the changes, not all of its files.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """STORE, for the queries that begin meanwhile."""
    before = {name: spark.conf.get(name, None) for name in STORE}
    for name, value in STORE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def drain(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes all that a stream has now as Parquet to path, and goes on from the checkpoint of an earlier call."""
    with _state_store(df.sparkSession):
        query = df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def late_rows(query: StreamingQuery) -> int:
    """Rows that a stream has left out as late, in the progress that it still holds."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
