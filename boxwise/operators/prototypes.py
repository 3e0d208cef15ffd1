"""Prototypes of groups of vectors: k-means with several D²-weighted starts, all carried through the same passes.

Rows are stored once, sorted by group, so that a task sees few groups and a large group is
many tasks. A pass reads them, with the centres of all starts at hand, and leaves one
small row for each group, start and centre that a task has met: a race for the next
seed, or sums for the next means. Only those meet in a shuffle, and only centres come to the
driver. Where the centres of all groups are more than CENTRES_BYTES, groups go in
waves, which the number of groups decides, not that of rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxwise.session import shared_folder

#: Bytes of centres that a wave of groups may have.
CENTRES_BYTES = 64 << 20

#: Centres of each start of a group.
Starts = list[np.ndarray]


def uniform(keys: np.ndarray, *salt: int) -> np.ndarray:
    """A number in (0, 1) for each 64-bit key, which key and salt decide."""
    x = keys.astype(np.uint64)
    with np.errstate(over="ignore"):
        for s in salt:
            x = (x + np.uint64(s + 1)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = x ^ (x >> np.uint64(29))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest centre, the first of equal ones, and the squared distance to it."""
    far = np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)
    at = far.argmin(axis=1)
    return at, far[np.arange(len(x)), at]


def _seeds(number: int, trials: int) -> Callable[[dict, int, np.ndarray, np.ndarray, Starts], None]:
    """Races for candidates of seed `number`: rows win as their squared distance from the seeds so far, by the least of exponential variables with that rate."""

    def step(best: dict, group: int, h: np.ndarray, x: np.ndarray, starts: Starts) -> None:
        for s, centres in enumerate(starts):
            rate = nearest(x, centres)[1] if len(centres) else np.ones(len(x))
            for t in range(trials if number else 1):
                with np.errstate(divide="ignore"):
                    race = np.where(rate > 0, -np.log(uniform(h, s, number, t)) / rate, np.inf)
                i = int(race.argmin())
                if race[i] < best.get((group, s, t), (np.inf,))[0]:
                    best[group, s, t] = (float(race[i]), 1, x[i])

    return step


def _left(best: dict, group: int, h: np.ndarray, x: np.ndarray, starts: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Squared distances that would be left with each candidate; starts: seeds so far and candidates."""
    for s, (centres, candidates) in enumerate(starts):
        far = nearest(x, centres)[1] if len(centres) else np.full(len(x), np.inf)
        for t, c in enumerate(candidates):
            own = float(np.minimum(far, ((x - c) ** 2).sum(axis=1)).sum())
            best[group, s, t] = (best.get((group, s, t), (0.0,))[0] + own, 1, c)


def _sums(best: dict, group: int, h: np.ndarray, x: np.ndarray, starts: Starts) -> None:
    """Squared distances, rows and sum of the rows nearest to each centre; starts without centres have settled."""
    for s, centres in enumerate(starts):
        if not len(centres):
            continue
        at, far = nearest(x, centres)
        for c in np.unique(at).tolist():
            own = at == c
            inertia, n, total = best.get((group, s, c), (0.0, 0, 0.0))
            best[group, s, c] = (inertia + float(far[own].sum()), n + int(own.sum()), total + x[own].sum(axis=0))


def _pass(rows: DataFrame, starts: dict[int, Starts], step: Callable) -> DataFrame:
    """(grp, start, centre, value, n, x): what `step` leaves of each task's rows of a group."""
    held = rows.sparkSession.sparkContext.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int, int], tuple[float, int, np.ndarray]] = {}

        def out() -> pa.RecordBatch:
            keys, values = list(best), list(best.values())
            columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))]
            columns += [pa.array([v[0] for v in values], pa.float64()), pa.array([v[1] for v in values], pa.int64()), pa.array([v[2] for v in values], pa.list_(pa.float64()))]
            best.clear()
            return pa.record_batch(columns, ["grp", "start", "centre", "value", "n", "x"])

        for batch in batches:
            groups = batch["grp"].to_numpy()
            h = batch["h"].to_numpy()
            for group in np.unique(groups).tolist():
                own = np.flatnonzero(groups == group)
                part = batch["x"].take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                if any(k[0] != group for k in best):
                    yield out()
                step(best, group, h[own], part, held.value[group])
        yield out()

    return rows.select("grp", "h", "x").mapInArrow(run, "grp long, start int, centre int, value double, n long, x array<double>")


def _means(parts: DataFrame, size: int) -> list[tuple]:
    """(grp, start, centre, inertia, n, mean) of the tasks' sums."""
    sums = F.array(*(F.sum(F.col("x")[i]) for i in range(size)))
    return parts.groupBy("grp", "start", "centre").agg(F.sum("value").alias("value"), F.sum("n").alias("n"), sums.alias("x")).collect()


def _wave(rows: DataFrame, groups: list[int], size: int, k: int, starts: int, rounds: int) -> list[tuple[int, int, int, list[float]]]:
    """(grp, cluster_id, n, m) of the groups' best starts."""
    centres: dict[int, Starts] = {g: [np.empty((0, size)) for _ in range(starts)] for g in groups}
    trials = 2 + int(log(k))
    for number in range(k):
        # Of several candidates the one that leaves the least becomes the seed.
        races = _pass(rows, centres, _seeds(number, trials)).groupBy("grp", "start", "centre").agg(F.min_by("x", F.struct("value", "x")).alias("x"))
        drawn: dict[int, list[list]] = {g: [[] for _ in range(starts)] for g in groups}
        for g, s, _, x in sorted(races.collect()):
            drawn[g][s].append(x)
        tried = {g: [(c, np.array(xs).reshape(-1, size)) for c, xs in zip(centres[g], drawn[g], strict=True)] for g in groups}
        left = _pass(rows, tried, _left).groupBy("grp", "start", "centre").agg(F.sum("value").alias("value"))
        for g, s, t in left.groupBy("grp", "start").agg(F.min_by("centre", F.struct("value", "centre")).alias("centre")).collect():
            centres[g][s] = np.vstack([centres[g][s], tried[g][s][1][t]])
    # What each start of a group has come to; a start that no longer moves is not looked at again.
    reached: dict[int, dict[int, list[tuple]]] = {g: {} for g in groups}
    for _ in range(rounds):
        found: dict[int, dict[int, list]] = {}
        for g, s, c, inertia, n, total in _means(_pass(rows, centres, _sums), size):
            found.setdefault(g, {}).setdefault(s, []).append((c, inertia, n, np.array(total) / n))
        for g, own in found.items():
            for s, parts in own.items():
                parts.sort(key=lambda p: p[0])
                reached[g][s] = parts
                new = np.array([p[3] for p in parts])
                # Sums in another order may differ in the last digits.
                moved = new.shape != centres[g][s].shape or bool(np.abs(new - centres[g][s]).max() > 1e-12 * max(1.0, np.abs(new).max()))
                centres[g][s] = new if moved else np.empty((0, size))
            if not any(map(len, centres[g])):
                del centres[g]
        if not centres:
            break
        rows = rows.where(F.col("grp").isin(list(centres))) if len(centres) < len(found) else rows
    settled = {g: own[min(own, key=lambda s: (sum(p[1] for p in own[s]), s))] for g, own in reached.items() if own}
    return [(g, c, n, m.tolist()) for g, parts in settled.items() for c, (_, _, n, m) in enumerate(parts)]


def clusters(vectors: DataFrame, group: list[str], key: str, x: str, k: int = 4, starts: int = 10, rounds: int = 3000) -> DataFrame:
    """group..., cluster_id (from 0), n and m of up to k prototypes of each group: of `starts` runs of k-means the one of least inertia (A5).

    Seeds are drawn with probabilities that grow with the squared distance from those so
    far, from the rows' keys, so runs repeat. Rounds end when no centre of any start
    moves. Prototypes are the exact means of their rows; empty ones vanish, and a group with
    fewer distinct rows has fewer. Vectors of a group have one length; null ones are left out.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(x).isNotNull()).select(*group, F.xxhash64(F.col(key)).alias("h"), F.col(x).cast("array<double>").alias("x"))
    names = rows.groupBy(*group).agg(F.max(F.size("x")).alias("size")).withColumn("grp", F.row_number().over(Window.orderBy("size", *group)).cast("long"))
    folder = f"{shared_folder(spark)}/prototypes-{uuid.uuid4().hex}"
    names.write.parquet(f"{folder}/groups")
    names = spark.read.parquet(f"{folder}/groups")
    placed = rows.join(names, group).select("grp", "h", "x")
    placed.repartitionByRange("grp", "h").sortWithinPartitions("grp").write.parquet(f"{folder}/rows")
    stored = spark.read.parquet(f"{folder}/rows")

    found: list[tuple] = []
    for size, first, last in names.groupBy("size").agg(F.min("grp"), F.max("grp")).orderBy("size").collect():
        wave = max(1, CENTRES_BYTES // (8 * starts * k * max(1, size)))
        for g in range(first, last + 1, wave):
            own = list(range(g, min(last + 1, g + wave)))
            found += _wave(stored.where(F.col("grp").between(own[0], own[-1])), own, size, k, starts, rounds)
    means = spark.createDataFrame(found, "grp long, cluster_id int, n long, m array<double>")
    return names.join(means, "grp").select(*group, "cluster_id", "n", "m")
