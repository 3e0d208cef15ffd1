"""Meters and accumulators over streams, whose last state equals the batch result over all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import exp

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from boxwise.operators import statistics as T

SIZE = 20


def accumulated(stream: DataFrame, group: list[str], value: str) -> DataFrame:
    """group..., total and n so far (R1): what merges to the mean by statistics.merge_partials(). Spark keeps one row of state a group."""
    return stream.groupBy(*group).agg(F.sum(value).alias("total"), F.count(value).alias("n"))


def merge_into(path: str, group: list[str]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: adds the batch's partials (group..., total, n) as the table of its number, so that a batch that runs again replaces itself; finished() sums them."""

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy(*group).agg(F.sum("total").alias("total"), F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return add


def finished(partials: DataFrame, group: list[str]) -> DataFrame:
    """group..., n, mean of all partials that merge_into() has written."""
    return T.merge_partials(partials, group)


def rolling(stream: DataFrame, key: str, order: str, value: str, size: int = SIZE) -> DataFrame:
    """key, event, median (the lower middle), avg, max, value_now, global_avg of each row when it arrives.

    State is the last `size` values, their number and total so far. Rows of one key are
    taken in the order of their long column `order` within a batch; batches bring later rows.
    """

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n, total = state.get if state.exists else ([], 0, 0.0)
        last = list(last)
        rows = []
        for event, v in pd.concat(list(frames)).sort_values(order)[[order, value]].itertuples(index=False):
            last, n, total = [*last[1 - size :], v] if len(last) >= size else [*last, v], n + 1, total + v
            rows.append((keys[0], event, sorted(last)[(len(last) - 1) // 2], sum(last) / len(last), max(last), v, total / n))
        state.update((last, n, total))
        yield pd.DataFrame(rows, columns=["key", "event", "median", "avg", "max", "value_now", "global_avg"])

    rows = stream.select(F.col(key).cast("long").alias(key), F.col(order).cast("long").alias(order), F.col(value).cast("double").alias(value))
    return rows.groupBy(key).applyInPandasWithState(step, "key long, event long, median double, avg double, max double, value_now double, global_avg double", "last array<double>, n long, total double", "append", GroupStateTimeout.NoTimeout)


def ema(stream: DataFrame, key: str, order: str, value: str, decay: float = 0.9999, warmups: float = 2000.0) -> DataFrame:
    """key, n, ema after each batch that has rows of the key (R4, W12); the state is what a restart goes on from."""

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean = state.get if state.exists else (0, 0.0)
        for v in pd.concat(list(frames)).sort_values(order)[value].tolist():
            d = decay * (1 - exp(-n / warmups)) if n else 0.0
            n, mean = n + 1, d * mean + (1 - d) * v
        state.update((n, mean))
        yield pd.DataFrame({"key": [keys[0]], "n": [n], "ema": [mean]})

    rows = stream.select(F.col(key).cast("long").alias(key), F.col(order).cast("long").alias(order), F.col(value).cast("double").alias(value))
    return rows.groupBy(key).applyInPandasWithState(step, "key long, n long, ema double", "n long, mean double", "update", GroupStateTimeout.NoTimeout)
