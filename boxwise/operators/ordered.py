"""Running totals and maxima over groups of any size, by one sort.

Rows are dealt into ranges of (group, order) and sorted there, once, and kept in the shared
folder. A group that goes on from one partition to the next needs what came before from
the partitions in between, and nothing else does; so each partition leaves one small row, of
its first and last group, and the sums over partitions are taken of those. Then every
partition adds its own. Half of all rows may have one group, or one value: they are
many partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from boxwise.session import checkpointed


def in_order(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """df sorted by group and order over all partitions, as many as a shuffle has, and kept with them."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(df.repartitionByRange(parts, *(F.col(g) for g in group), *order).sortWithinPartitions(*(F.col(g) for g in group), *order))


def group_starts(batch: pa.RecordBatch, group: list[str]) -> np.ndarray:
    """Rows at which another group begins, 0 among them."""
    new = np.zeros(len(batch), dtype=bool)
    new[:1] = True
    for g in group:
        a, b = batch[g].slice(1), batch[g].slice(0, max(0, len(batch) - 1))
        differ = pc.fill_null(pc.not_equal(a, b), True)
        new[1:] |= pc.and_not(differ, pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def key_at(batch: pa.RecordBatch, group: list[str], row: int) -> tuple:
    return tuple(batch[g][row].as_py() for g in group)


def _wide(kind: T_.DataType) -> T_.DataType:
    return T_.LongType() if isinstance(kind, T_.IntegralType) else T_.DoubleType()


def _columns(batch: pa.RecordBatch, names: list[str], kinds: list[pa.DataType]) -> list[np.ndarray]:
    return [pc.fill_null(batch[c].cast(k), 0).to_numpy(zero_copy_only=False) for c, k in zip(names, kinds, strict=True)]


def running_totals(placed: DataFrame, group: list[str], sums: list[str]) -> DataFrame:
    """placed, from in_order, with cum_<s> for each of sums: the total of the group up to and with each row. Nulls add nothing."""
    wide = [_wide(placed.schema[s].dataType) for s in sums]
    kinds = [pa.int64() if isinstance(k, T_.LongType) else pa.float64() for k in wide]

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partition, its first and its last group, and the totals of the last one's rows in it."""
        first = last = None
        totals = [0] * len(sums)
        for batch in batches:
            if not len(batch):
                continue
            at = int(group_starts(batch, group)[-1])
            first = key_at(batch, group, 0) if first is None else first
            key = key_at(batch, group, at)
            own = [x[at:].sum().item() for x in _columns(batch, sums, kinds)]
            totals = [a + b for a, b in zip(totals, own, strict=True)] if key == last and at == 0 else own
            last = key
        if first is not None:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()]), *(pa.array([x], t) for x, t in zip((*first, *last), types * 2, strict=True)), *(pa.array([t], k) for t, k in zip(totals, kinds, strict=True))], names)

    types = [_arrow(placed.schema[g].dataType) for g in group]
    names = ["part", *(f"f{k}" for k in range(len(group))), *(f"l{k}" for k in range(len(group))), *(f"t{k}" for k in range(len(sums)))]
    fields = [placed.schema[g].dataType for g in group]
    schema = T_.StructType([T_.StructField(n, k) for n, k in zip(names, [T_.LongType(), *fields, *fields, *wide], strict=True)])
    carried: dict[int, tuple[tuple, list]] = {}  # one entry a partition
    before: tuple | None = None
    totals: list = []
    for row in sorted(placed.select(*group, *sums).mapInArrow(tails, schema).collect()):
        part, first, last, own = row[0], tuple(row[1 : 1 + len(group)]), tuple(row[1 + len(group) : 1 + 2 * len(group)]), list(row[1 + 2 * len(group) :])
        if first == before:
            carried[part] = first, totals
        totals = [a + b for a, b in zip(totals, own, strict=True)] if first == before == last else own
        before = last

    def cumulated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, offset = carried.get(TaskContext.get().partitionId(), (None, [0] * len(sums)))
        for batch in batches:
            if not len(batch):
                continue
            starts = group_starts(batch, group)
            out = []
            goes_on = key == key_at(batch, group, 0)
            for k, x in enumerate(_columns(batch, sums, kinds)):
                total = np.cumsum(x)
                base = np.concatenate([[offset[k] if goes_on else 0], -total[starts[1:] - 1]]).astype(total.dtype)
                out.append(total + np.repeat(base, np.diff(np.append(starts, len(x)))))
            key, offset = key_at(batch, group, int(starts[-1])), [x[-1].item() for x in out]
            yield pa.record_batch([*batch.columns, *(pa.array(x) for x in out)], [*batch.schema.names, *(f"cum_{s}" for s in sums)])

    return placed.mapInArrow(cumulated, T_.StructType([*placed.schema, *(T_.StructField(f"cum_{s}", k) for s, k in zip(sums, wide, strict=True))]))


def highest_after(rows: DataFrame, group: list[str], values: list[str]) -> DataFrame:
    """rows, in the order and partitions of in_order, with max_<v> for each of values (double): the largest of the group from each row on.

    A partition's groups, and these columns alone, are held by its task while it goes back over them.
    """
    types = [_arrow(rows.schema[g].dataType) for g in group]
    names = ["part", *(f"f{k}" for k in range(len(group))), *(f"l{k}" for k in range(len(group))), *(f"t{k}" for k in range(len(values)))]
    fields = [rows.schema[g].dataType for g in group]
    schema = T_.StructType([T_.StructField(n, k) for n, k in zip(names, [T_.LongType(), *fields, *fields, *[T_.DoubleType()] * len(values)], strict=True)])

    def numbers(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [pc.fill_null(batch[v].cast(pa.float64()), -np.inf).to_numpy(zero_copy_only=False) for v in values]

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partition, its first and its last group, and the largest of the first one's rows in it."""
        first = last = None
        tops, within = [-np.inf] * len(values), True
        for batch in batches:
            if not len(batch):
                continue
            starts = group_starts(batch, group)
            first = key_at(batch, group, 0) if first is None else first
            if within and key_at(batch, group, 0) == first:
                end = starts[1] if len(starts) > 1 else len(batch)
                tops = [max(t, float(x[:end].max())) for t, x in zip(tops, numbers(batch), strict=True)]
            last = key_at(batch, group, int(starts[-1]))
            within = last == first
        if first is not None:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()]), *(pa.array([x], t) for x, t in zip((*first, *last), types * 2, strict=True)), *(pa.array([t], pa.float64()) for t in tops)], names)

    carried: dict[int, tuple[tuple, list[float]]] = {}
    after: tuple | None = None
    tops: list[float] = []
    for row in sorted(rows.select(*group, *values).mapInArrow(heads, schema).collect(), reverse=True):
        part, first, last, own = row[0], tuple(row[1 : 1 + len(group)]), tuple(row[1 + len(group) : 1 + 2 * len(group)]), list(row[1 + 2 * len(group) :])
        if last == after:
            carried[part] = last, tops
        tops = [max(a, b) for a, b in zip(tops, own, strict=True)] if first == last == after else own
        after = first

    def topped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        key, top = carried.get(TaskContext.get().partitionId(), (None, [-np.inf] * len(values)))
        out: list[list[np.ndarray]] = []
        for batch in reversed(held):
            starts = group_starts(batch, group)
            goes_on = key == key_at(batch, group, len(batch) - 1)
            tops = []
            for k, x in enumerate(numbers(batch)):
                top_x = np.empty_like(x)
                ends = np.append(starts[1:], len(x))
                for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                    top_x[a:b] = np.maximum.accumulate(x[a:b][::-1])[::-1]
                if goes_on:
                    top_x[starts[-1] :] = np.maximum(top_x[starts[-1] :], top[k])
                tops.append(top_x)
            key, top = key_at(batch, group, 0), [x[0] for x in tops]
            out.append(tops)
        for batch, tops in zip(held, reversed(out), strict=True):
            yield pa.record_batch([*batch.columns, *(pa.array(x, mask=np.isneginf(x)) for x in tops)], [*batch.schema.names, *(f"max_{v}" for v in values)])

    return rows.mapInArrow(topped, T_.StructType([*rows.schema, *(T_.StructField(f"max_{v}", T_.DoubleType()) for v in values)]))


def _arrow(kind: T_.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def rolling(df: DataFrame, group: list[str], order: list[Column], x: str, size: int = 20) -> DataFrame:
    """df with median (the lower middle), avg, max and value_now of the last `size` rows, and global_avg of all so far (W1-W5); rows where x is null are left out.

    A partition begins with the last size - 1 values of its first group before it, so a key with all rows is as many tasks as any.
    """
    own = [c for c in df.columns if c not in ("median", "avg", "max", "value_now", "global_avg")]
    rows = df.where(F.col(x).isNotNull()).select(*own, F.col(x).cast("double").alias("_x"), F.lit(1).alias("_one"))
    placed = in_order(rows, group, order)
    types = [_arrow(placed.schema[g].dataType) for g in group]
    fields = [placed.schema[g].dataType for g in group]
    names = ["part", *(f"f{k}" for k in range(len(group))), *(f"l{k}" for k in range(len(group))), "tail"]
    schema = T_.StructType([T_.StructField(n, k) for n, k in zip(names, [T_.LongType(), *fields, *fields, T_.ArrayType(T_.DoubleType())], strict=True)])
    keep = size - 1

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        tail = np.zeros(0)
        for batch in batches:
            if not len(batch):
                continue
            at = int(group_starts(batch, group)[-1])
            first = key_at(batch, group, 0) if first is None else first
            key = key_at(batch, group, at)
            values = batch["_x"].to_numpy()[at:]
            tail = (np.concatenate([tail, values]) if key == last and at == 0 else values)[-keep:] if keep else tail
            last = key
        if first is not None:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()]), *(pa.array([v], t) for v, t in zip((*first, *last), types * 2, strict=True)), pa.array([tail.tolist()], pa.list_(pa.float64()))], names)

    carried: dict[int, tuple[tuple, list[float]]] = {}
    before: tuple | None = None
    tail: list[float] = []
    for row in sorted(placed.select(*group, "_x").mapInArrow(tails, schema).collect()):
        part, first, last, values = row[0], tuple(row[1 : 1 + len(group)]), tuple(row[1 + len(group) : 1 + 2 * len(group)]), list(row[-1])
        if first == before:
            carried[part] = first, tail
        tail = ([*tail, *values] if first == before == last else values)[-keep:] if keep else []
        before = last

    def windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tail = carried.get(TaskContext.get().partitionId(), (None, []))
        tail = np.array(tail, dtype=float)
        for batch in batches:
            if not len(batch):
                continue
            starts = group_starts(batch, group)
            x = batch["_x"].to_numpy()
            if key != key_at(batch, group, 0):
                tail = np.zeros(0)
            parts = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(x)], strict=True):
                tail = tail if a == 0 else np.zeros(0)
                line = np.concatenate([np.full(keep - len(tail), np.nan), tail, x[a:b]])
                sorted_ = np.sort(np.lib.stride_tricks.sliding_window_view(line, size), axis=1)  # NaN last
                n = np.minimum(len(tail) + 1 + np.arange(b - a), size)
                each = np.arange(b - a)
                parts.append((sorted_[each, (n - 1) // 2], np.nansum(sorted_, axis=1) / n, sorted_[each, n - 1]))
                tail = np.concatenate([tail, x[a:b]])[-keep:] if keep else tail
            key = key_at(batch, group, int(starts[-1]))
            yield pa.record_batch([*batch.columns, *(pa.array(np.concatenate([p[k] for p in parts])) for k in range(3))], [*batch.schema.names, "median", "avg", "max"])

    totals = running_totals(placed, group, ["_one", "_x"])
    out = totals.mapInArrow(windowed, T_.StructType([*totals.schema, *(T_.StructField(c, T_.DoubleType()) for c in ("median", "avg", "max"))]))
    return out.select(*own, "median", "avg", "max", F.col("_x").alias("value_now"), (F.col("cum__x") / F.col("cum__one")).alias("global_avg"))


def ema(df: DataFrame, group: list[str], order: list[str], x: str, decay: float = 0.9999, warmups: float = 2000.0, start: float | None = None) -> DataFrame:
    """group..., n and ema: the average with decay * (1 - exp(-t / warmups)) at step t (W12); rows where x is null are left out.

    start: what the average begins with, its first step being t = 1; None: it begins
    with the first value, which is t = 0. A run of rows is an affine map of the average; runs
    of a batch each are composed where they lie, and a group's few maps are composed in order.
    """
    placed = in_order(df.where(F.col(x).isNotNull()).select(*group, *order, F.col(x).cast("double").alias("_x"), F.lit(1).alias("_one")), group, [F.asc(c) for c in order])
    ranked = running_totals(placed, group, ["_one"]).select(*group, "_x", F.col("cum__one").alias("_t"))
    fields = [ranked.schema[g] for g in group]
    schema = T_.StructType([*fields, T_.StructField("place", T_.LongType()), T_.StructField("n", T_.LongType()), T_.StructField("scale", T_.DoubleType()), T_.StructField("shift", T_.DoubleType())])

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            starts = group_starts(batch, group)
            t = batch["_t"].to_numpy() - (1 if start is None else 0)
            d = decay * (1 - np.exp(-t / warmups))
            values = batch["_x"].to_numpy()
            rows = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(t)], strict=True):
                later = np.append(np.cumprod(d[a:b][::-1])[::-1], 1.0)
                rows.append((int(t[a]), b - a, float(later[0]), float(((1 - d[a:b]) * values[a:b] * later[1:]).sum())))
            at = pa.array(starts)
            yield pa.record_batch([*(batch[g].take(at) for g in group), *(pa.array(c) for c in zip(*rows, strict=True))], [*group, "place", "n", "scale", "shift"])

    fold = "aggregate(array_sort(maps), cast({} as double), (v, m) -> m.scale * v + m.shift)"
    composed = ranked.mapInArrow(maps, schema).groupBy(*group).agg(F.sum("n").alias("n"), F.collect_list(F.struct("place", "scale", "shift")).alias("maps"))
    return composed.select(*group, "n", F.expr(fold.format(0.0 if start is None else start)).alias("ema"))
