"""Matching of detections and ground truth.

Every spatial join has the image (and mostly the label) as an equality, so it is a hash or
sort-merge join whose groups are as large as an image's boxes. What is inherently
sequential runs inside one such group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwise.functions import boxes as B
from boxwise.functions import masks as K


def greedy_match(det: DataFrame, gt: DataFrame, threshold: float = 0.5) -> DataFrame:
    """image_id, label, det_id, score, gt_id (NULL: unmatched), matched.

    Detections of an image and label in the order (score descending, det_id) each take the
    free ground truth of the highest IoU, if that reaches the threshold; of equal IoU
    the larger gt_id. Ground truth is used once. det has det_id, score, dx0, dy0, dx1,
    dy1; gt has gt_id, gx0, gy0, gx1, gy1. Only pairs that reach the threshold are
    gathered, at most an image's boxes squared.
    """
    a, b = B.columns("gx0", "gy0", "gx1", "gy1"), B.columns("dx0", "dy0", "dx1", "dy1")
    joined = overlapping(det, gt, ["image_id", "label"], ("dx0", "dy0", "dx1", "dy1"), ("gx0", "gy0", "gx1", "gy1")) if threshold > 0 else det.join(gt, ["image_id", "label"])
    near = joined.withColumn("iou", B.iou(a, b)).where(F.col("iou") >= threshold)
    wishes = near.groupBy("image_id", "label", "det_id", "score").agg(F.sort_array(F.collect_list(F.struct("iou", "gt_id")), asc=False).alias("wishes"))
    order = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("order"), "det_id", F.col("wishes.gt_id").alias("wishes"))))

    def take(done: Column, d: Column) -> Column:
        free = F.get(F.filter(d["wishes"], lambda g: ~F.array_contains(done["used"], g)), F.lit(0))
        pair = F.struct(d["det_id"].alias("det_id"), free.alias("gt_id"))
        return F.when(free.isNull(), done).otherwise(F.struct(F.array_append(done["used"], free).alias("used"), F.array_append(done["pairs"], pair).alias("pairs")))

    start = F.expr("named_struct('used', cast(array() as array<bigint>), 'pairs', cast(array() as array<struct<det_id:bigint,gt_id:bigint>>))")
    taken = wishes.groupBy("image_id", "label").agg(order.alias("order")).select("image_id", "label", F.inline(F.aggregate("order", start, take, lambda done: done["pairs"])))
    joined = det.join(taken, ["image_id", "label", "det_id"], "left")
    return joined.select("image_id", "label", "det_id", "score", "gt_id", F.col("gt_id").isNotNull().alias("matched"))


def _areas(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Areas of the overlap and of the union of boxes (..., row, corners), each of a with each of b."""
    wide, high = (np.minimum(a[..., :, None, k + 2], b[..., None, :, k + 2]) - np.maximum(a[..., :, None, k], b[..., None, :, k]) for k in range(2))
    inside = np.clip(wide, 0, None) * np.clip(high, 0, None)
    x, y = ((c[..., 2] - c[..., 0]) * (c[..., 3] - c[..., 1]) for c in (a, b))
    return inside, x[..., :, None] + y[..., None, :] - inside


def _iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    inside, whole = _areas(a, b)
    return np.divide(inside, whole, out=np.zeros_like(inside), where=whole > 0)


#: Boxes of an image past which pairs are found by cells, and pairs in memory at once.
CROWD, PAIRS = 512, 1 << 22


def near_pairs(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of the boxes of a and b that overlap, in runs; every pair once, and no pair that shares no cell is formed.

    Boxes are dealt to all cells of a grid that they touch. Of the cells that a pair shares,
    the one with the corner where its overlap begins counts.
    """
    sides_ = np.concatenate([x[:, 2:] - x[:, :2] for x in (a, b)])
    if not len(a) or not len(b):
        return
    low = np.minimum(a[:, :2].min(axis=0), b[:, :2].min(axis=0))
    # Large enough that the largest box touches a bounded number of cells.
    cell = max(float(np.quantile(sides_, 0.9)), float(sides_.max()) / 16, 1e-9)

    def cells(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first, last = (np.floor((x[:, k : k + 2] - low) / cell).astype(np.int64) for k in (0, 2))
        wide, high = (np.maximum(last - first, 0) + 1).T
        n = wide * high
        own = np.repeat(np.arange(len(x)), n)
        place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        return own, first[own, 0] + place % wide[own], first[own, 1] + place // wide[own]

    (i, ix, iy), (j, jx, jy) = cells(a), cells(b)
    rows = int(max(iy.max(), jy.max())) + 1
    left, right = ix * rows + iy, jx * rows + jy
    order = np.argsort(right, kind="stable")
    right, j = right[order], j[order]
    start = np.searchsorted(right, left)
    n = np.searchsorted(right, left, side="right") - start
    ends = np.cumsum(n)
    at = 0
    while at < len(left):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        own = np.repeat(np.arange(at, stop), n[at:stop])
        place = np.arange(len(own)) - np.repeat(ends[at:stop] - n[at:stop] - (ends[at - 1] if at else 0), n[at:stop]) + start[own]
        p, q = i[own], j[place]
        corner = np.maximum(a[p, :2], b[q, :2])
        here = np.floor((corner - low) / cell).astype(np.int64)
        ok = (here[:, 0] == ix[own]) & (here[:, 1] == iy[own]) & (corner < np.minimum(a[p, 2:], b[q, 2:])).all(axis=1)
        yield p[ok], q[ok]
        at = stop


def _pair_iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of boxes in pairs."""
    inside = np.prod(np.clip(np.minimum(a[:, 2:], b[:, 2:]) - np.maximum(a[:, :2], b[:, :2]), 0, None), axis=1)
    whole = np.prod(a[:, 2:] - a[:, :2], axis=1) + np.prod(b[:, 2:] - b[:, :2], axis=1) - inside
    return np.divide(inside, whole, out=np.zeros_like(inside), where=whole > 0)


def suppressed(xy: np.ndarray, threshold: float) -> np.ndarray:
    """Which boxes are left, the first before all others, when each that is left drops later ones whose IoU with it is more than the threshold."""
    alive = np.ones(len(xy), dtype=bool)
    if len(xy) <= CROWD or threshold < 0:
        over = _iou_matrix(xy, xy) > threshold
        for i in range(len(xy)):
            if alive[i]:
                alive[i + 1 :] &= ~over[i, i + 1 :]
        return alive
    found = []
    for i, j in near_pairs(xy, xy):
        i, j = i[i < j], j[i < j]
        over = _pair_iou(xy[i], xy[j]) > threshold
        found.append(np.stack([i[over], j[over]]))
    i, j = np.concatenate(found, axis=1)
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    first = np.searchsorted(i, np.arange(len(xy) + 1))
    for k in np.unique(i).tolist():
        if alive[k]:
            alive[j[first[k] : first[k + 1]]] = False
    return alive


def overlapping(left: DataFrame, right: DataFrame, on: list[str], a: tuple[str, str, str, str], b: tuple[str, str, str, str], cell: float = 128.0) -> DataFrame:
    """The pairs of rows of left and right with equal `on` whose boxes overlap, by a join on cells, so that a crowded image is many keys.

    A box lies in a grid whose cells are cell, 2 cell, 4 cell ... wide, the first that is four times as wide as
    the box, and so in one cell mostly and in four at most; smaller ones look in its grid too. Of the cells
    that a pair shares, the one with the corner where its overlap begins counts.
    """

    def level(x: tuple[str, str, str, str]) -> Column:
        side = F.greatest(F.col(x[2]) - F.col(x[0]), F.col(x[3]) - F.col(x[1]))
        return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(4 * side, F.lit(1e-300)) / cell))).cast("int")

    def cells(df: DataFrame, x: tuple[str, str, str, str], width: Column) -> DataFrame:
        spread = lambda p, q: F.explode(F.sequence(F.floor(F.col(p) / width), F.floor(F.greatest(F.col(p), F.col(q)) / width)))
        return df.withColumn("_cx", spread(x[0], x[2])).withColumn("_cy", spread(x[1], x[3]))

    width = F.lit(cell) * F.pow(F.lit(2.0), F.col("_level"))
    sized = [df.withColumn("_own", level(x)) for df, x in ((left, a), (right, b))]
    levels = [df.select("_own").distinct() for df in sized]  # a few numbers
    every = F.broadcast(levels[0].union(levels[1]).distinct().withColumnRenamed("_own", "_level"))
    both = [cells(df.join(every, F.col("_level") >= F.col("_own")), x, width) for df, x in zip(sized, (a, b), strict=True)]
    joined = both[0].withColumnRenamed("_own", "_a").join(both[1].withColumnRenamed("_own", "_b"), [*on, "_level", "_cx", "_cy"])
    x, y = (F.greatest(F.col(a[k]), F.col(b[k])) for k in range(2))
    inside = (x < F.least(F.col(a[2]), F.col(b[2]))) & (y < F.least(F.col(a[3]), F.col(b[3])))
    here = (F.floor(x / width) == F.col("_cx")) & (F.floor(y / width) == F.col("_cy")) & (F.col("_level") == F.greatest("_a", "_b"))
    return joined.where(inside & here).drop("_level", "_cx", "_cy", "_a", "_b")


def nms(boxes: DataFrame, threshold: float = 0.7, keep: int = 300, floor: float | None = None) -> DataFrame:
    """The boxes (image_id, label, box_id, score, x0, y0, x1, y1) that suppression leaves, `keep` of an image at most.

    Within an image and label, in the order (score descending, box_id), a box drops later
    ones whose IoU with it is more than the threshold. floor: scores must be more than it.
    """
    schema = "image_id long, label int, box_id long, score double, x0 double, y0 double, x1 double, y1 double"

    def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(batch["boxes"]).to_numpy())])
            flat = pa.RecordBatch.from_struct_array(batch["boxes"].flatten())
            xy = np.stack([flat[c].to_numpy() for c in ("x0", "y0", "x1", "y1")], axis=1)
            alive = np.ones(len(flat), dtype=bool)
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                alive[a:b] = suppressed(xy[a:b], threshold)
            group = pa.array(np.repeat(np.arange(len(batch)), np.diff(ends))[alive])
            left = flat.filter(pa.array(alive))
            yield pa.record_batch([batch["image_id"].take(group), batch["label"].take(group), left["box_id"], pc.negate(left["order"]), *(left[c] for c in ("x0", "y0", "x1", "y1"))], ["image_id", "label", "box_id", "score", "x0", "y0", "x1", "y1"])

    rows = boxes.select("image_id", F.col("label").cast("int").alias("label"), "box_id", "score", "x0", "y0", "x1", "y1")
    if floor is not None:
        rows = rows.where(F.col("score") > floor)
    first = F.struct((-F.col("score").cast("double")).alias("order"), "box_id", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
    kept = rows.groupBy("image_id", "label").agg(F.array_sort(F.collect_list(first)).alias("boxes")).mapInArrow(survivors, schema)
    return top_per_group(kept, ["image_id"], [F.desc("score"), F.asc("box_id")], keep).drop("rank")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with rank from 1. Spark drops the rest of a partition before the shuffle."""
    from pyspark.sql import Window

    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def assign(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of an assignment of least total cost, as many pairs as the smaller side has."""
    if cost.shape[0] > cost.shape[1]:
        cols, rows = assign(cost.T)
        order = np.argsort(rows)
        return rows[order], cols[order]
    return assign_rows(cost.__getitem__, *cost.shape)


def assign_rows(costs: Callable[[int], np.ndarray], n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The assignment of n rows to m columns, n at most m, of least total cost, where costs(row) makes one row when it is wanted.

    A row whose cheapest column is free takes it. Each of the others then finds the
    cheapest path to a free column in reduced costs; of columns as near, a free one ends
    the path. Memory is a few vectors of m numbers, besides what costs() holds.
    """
    row_potential, col_potential = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    crowded = []
    for row in range(n):
        cost = costs(row)
        row_potential[row] = cost.min()
        free = np.flatnonzero((cost == row_potential[row]) & (owner < 0))
        if len(free):
            owner[free[0]] = row
        else:
            crowded.append(row)
    free = np.flatnonzero(owner < 0)
    for row in crowded:
        near, before = np.full(m, np.inf), np.full(m, -1)  # of the columns not yet visited
        potential = col_potential.copy()
        visited: list[tuple[int, float]] = []
        i, reached, column = row, 0.0, -1
        while True:
            way = costs(i) - potential
            way += reached - row_potential[i]
            shorter = way < near
            near[shorter], before[shorter] = way[shorter], column
            column = int(near.argmin())
            reached = float(near[column])
            end = free[near[free].argmin()]
            if near[end] <= reached:
                column = int(end)
                break
            visited.append((column, reached))
            near[column], potential[column] = np.inf, -np.inf
            i = owner[column]
        row_potential[row] += reached
        for c, distance in visited:
            row_potential[owner[c]] += reached - distance
            col_potential[c] -= reached - distance
        free = free[free != column]
        while column >= 0:  # the path's columns move one owner on
            earlier = before[column]
            owner[column] = owner[earlier] if earlier >= 0 else row
            column = earlier
    cols = np.flatnonzero(owner >= 0)
    order = np.argsort(owner[cols])
    return owner[cols][order], cols[order]


#: Cells of a cost matrix past which its rows are made when they are wanted, and cells of many small matrices in memory at once.
DENSE, COSTS = 1 << 20, 1 << 20


def assign_many(cost: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The row of each column (-1: none) in what assign_rows() finds for every group of finite costs (group, row, column), of which n rows and m columns count, n at most m.

    Each group takes the steps of assign_rows(), and a step of all groups is taken at once.
    """
    groups, most, width = cost.shape
    cost = np.where(np.arange(width) < m[:, None, None], cost, np.inf)
    row_potential, col_potential = cost.min(axis=2), np.zeros((groups, width))
    owner = np.full((groups, width), -1)
    crowded = np.zeros((groups, most), dtype=bool)
    for k in range(most):
        open_ = (cost[:, k] == row_potential[:, k, None]) & (owner < 0)
        some = open_.any(axis=1)
        here = np.flatnonzero(some & (k < n))
        owner[here, open_[here].argmax(axis=1)] = k
        crowded[:, k] = ~some & (k < n)
    wait = crowded.sum(axis=1)
    queue = np.argsort(~crowded, axis=1, kind="stable")
    live = np.flatnonzero(wait)
    turn = np.zeros(len(live), np.int64)
    row = queue[live, 0]
    i, reached, column = row.copy(), np.zeros(len(live)), np.full(len(live), -1)
    near, before = np.full((len(live), width), np.inf), np.full((len(live), width), -1)
    potential, distance, visited = np.zeros_like(near), np.zeros_like(near), np.zeros(near.shape, bool)
    free = (owner[live] < 0) & (np.arange(width) < m[live, None])
    while len(live):
        way = cost[live, i]
        way -= potential
        way += (reached - row_potential[live, i])[:, None]
        shorter = way < near
        np.copyto(near, way, where=shorter)
        np.copyto(before, column[:, None], where=shorter)
        column = near.argmin(axis=1)
        reached = near[np.arange(len(live)), column]
        ends = (near == reached[:, None]) & free
        ended = ends.any(axis=1)
        on, end = np.flatnonzero(~ended), np.flatnonzero(ended)
        c = column[on]
        distance[on, c], visited[on, c], near[on, c], potential[on, c] = reached[on], True, np.inf, -np.inf
        i[on] = owner[live[on], c]
        if not len(end):
            continue
        g = live[end]
        k, c = np.nonzero(visited[end])
        less = reached[end[k]] - distance[end[k], c]
        row_potential[g, row[end]] += reached[end]
        row_potential[g[k], owner[g[k], c]] += less
        col_potential[g[k], c] -= less
        c = ends[end].argmax(axis=1)
        free[end, c] = False
        k = end
        while len(k):  # the path's columns move one owner on
            earlier = before[k, c]
            owner[live[k], c] = np.where(earlier < 0, row[k], owner[live[k], earlier])
            k, c = k[earlier >= 0], earlier[earlier >= 0]
        turn[end] += 1
        k = end[turn[end] < wait[g]]
        row[k] = i[k] = queue[live[k], turn[k]]
        reached[k], column[k], near[k], before[k], potential[k], visited[k] = 0.0, -1, np.inf, -1, col_potential[live[k]], False
        if len(k) < len(end):
            stay = turn < wait[live]
            free[~stay] = False  # one that has no row left ends no more
            if 8 * stay.sum() > 7 * len(live):
                continue  # few have left, which take empty steps until more do
            live, turn, row, i, reached, column, near, before, potential, distance, visited, free = (x[stay] for x in (live, turn, row, i, reached, column, near, before, potential, distance, visited, free))
    return owner


def assign_groups(d_ends: np.ndarray, g_ends: np.ndarray, costs: Callable[[np.ndarray, np.ndarray], np.ndarray], crowd: Callable[[slice, slice], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the assignments of least cost of all groups, whose sides begin at d_ends and g_ends (one entry more), by i.

    costs(i, j) is of the places i (group, row) with j (group, column), each with each; crowd() assigns the sides of a group
    that has more than DENSE pairs. Groups of like size are assigned together, COSTS cells, or one group, at a time.
    """
    n, m = np.diff(d_ends), np.diff(g_ends)
    few, many = np.minimum(n, m), np.maximum(n, m)
    found = [(np.zeros(0, np.int64),) * 2]
    for k in np.flatnonzero(n * m > DENSE).tolist():
        i, j = crowd(slice(d_ends[k], d_ends[k + 1]), slice(g_ends[k], g_ends[k + 1]))
        found.append((i + d_ends[k], j + g_ends[k]))
    for turned in (False, True):
        own = np.flatnonzero((n * m <= DENSE) & (few > 0) & ((n > m) == turned))
        own = own[np.lexsort((few[own], many[own]))]
        while len(own):
            # As many as keep the padded costs within bounds; the widest is the last.
            cells = np.arange(1, len(own) + 1) * np.maximum.accumulate(few[own]) * many[own]
            k, own = np.split(own, [max(1, int(np.searchsorted(cells, COSTS, side="right")))])
            i, j = (e[k, None] + np.minimum(np.arange(s[k].max()), s[k, None] - 1) for e, s in ((d_ends, n), (g_ends, m)))
            cost = costs(i, j)
            if turned:
                cost = cost.transpose(0, 2, 1)
            finite = np.isfinite(cost).all(axis=(1, 2))
            owner = assign_many(cost[finite], few[k[finite]], many[k[finite]])
            group, second = np.nonzero(owner >= 0)
            parts = [(np.flatnonzero(finite)[group], owner[group, second], second)]
            for p in np.flatnonzero(~finite).tolist():
                first, second = assign(cost[p, : few[k[p]], : many[k[p]]])
                parts.append((np.full(len(first), p), first, second))
            for group, first, second in parts:
                found.append((i[group, second], j[group, first]) if turned else (i[group, first], j[group, second]))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(i)
    return i[order], j[order]


def assign_overlaps(a: np.ndarray, b: np.ndarray, a_label: np.ndarray, b_label: np.ndarray, penalty: float = 1000.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in a and b, and IoU, of the assignment of least total 1 - IoU, plus the penalty where labels differ.

    A crowded image keeps the overlapping pairs alone: a row of costs is the same for all
    rows of its label but for those.
    """
    n, m = len(a), len(b)
    if n * m <= DENSE:
        iou = _iou_matrix(a, b)
        i, j = assign(1 - iou + penalty * (a_label[:, None] != b_label[None]))
        return i, j, iou[i, j]
    if n > m:
        j, i, iou = assign_overlaps(b, a, b_label, a_label, penalty)
        order = np.argsort(i)
        return i[order], j[order], iou[order]
    places = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *near_pairs(a, b)]
    i, j = (np.concatenate(x) for x in zip(*places, strict=True))
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    iou = _pair_iou(a[i], b[j])
    first = np.searchsorted(i, np.arange(n + 1))
    plain = {label: 1 + penalty * (b_label != label) for label in np.unique(a_label).tolist()}

    def costs(row: int) -> np.ndarray:
        cost = plain[a_label[row]].copy()
        own = slice(first[row], first[row + 1])
        cost[j[own]] -= iou[own]
        return cost

    rows, cols = assign_rows(costs, n, m)
    key, wanted = np.append(i * m + j, n * m), rows * m + cols
    at = np.searchsorted(key, wanted)
    return rows, cols, np.where(key[at] == wanted, np.append(iou, 0.0)[at], 0.0)


def _giou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    inside, whole = _areas(a, b)
    iou = np.divide(inside, whole, out=np.zeros_like(inside), where=whole > 0)
    wide, high = (np.maximum(a[..., :, None, k + 2], b[..., None, :, k + 2]) - np.minimum(a[..., :, None, k], b[..., None, :, k]) for k in range(2))
    hull = wide * high
    return iou - (hull - whole) / hull


def by_image(det: DataFrame, gt: DataFrame, keys: list[str], det_values: list[str], gt_values: list[str], how: str = "inner") -> DataFrame:
    """keys..., d and g: the detections and the ground truth of each group as sorted arrays of structs, which are as large as an image."""
    d = det.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*det_values))).alias("d"))
    g = gt.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*gt_values))).alias("g"))
    return d.join(g, keys, how)


def flat_sides(batch: pa.RecordBatch) -> list[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """For detections and ground truth of by_image(): where each row's begin (one entry more), and all of them by column; a missing side is empty."""

    def columns(name: str) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        column = batch[name]
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        flat = column.flatten()
        return ends, {f.name: part.to_numpy(zero_copy_only=False) for f, part in zip(flat.type, flat.flatten(), strict=True)}

    return [columns("d"), columns("g")]


def sides(batch: pa.RecordBatch) -> Iterator[tuple[int, dict[str, np.ndarray], dict[str, np.ndarray]]]:
    """Row number, detections and ground truth, by column, of each row of by_image(); a missing side is empty."""
    (d_ends, d), (g_ends, g) = flat_sides(batch)
    for row in range(len(batch)):
        yield row, {k: v[d_ends[row] : d_ends[row + 1]] for k, v in d.items()}, {k: v[g_ends[row] : g_ends[row + 1]] for k, v in g.items()}


def corners(g: dict[str, np.ndarray], names: tuple[str, str, str, str]) -> np.ndarray:
    return np.stack([g[c].astype(float) for c in names], axis=1)


def _assigned(rows: DataFrame, value: str, solve: Callable[[np.ndarray, dict, np.ndarray, dict], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """image_id, det_id, gt_id and the value of the pairs that solve() returns for a batch's sides (ends and columns, as flat_sides() has them) as places and values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (d_ends, d), (g_ends, g) = flat_sides(batch)
            i, j, values = solve(d_ends, d, g_ends, g)
            own = batch["image_id"].take(pa.array(np.searchsorted(d_ends, i, side="right") - 1))
            yield pa.record_batch([own, *(pa.array(x.astype(t)) for x, t in ((d["det_id"][i], np.int64), (g["gt_id"][j], np.int64), (values, np.float64)))], ["image_id", "det_id", "gt_id", value])

    return rows.mapInArrow(run, f"image_id long, det_id long, gt_id long, {value} double")


def hungarian_match(det: DataFrame, gt: DataFrame, class_weight: float = 2.0, box_weight: float = 5.0, giou_weight: float = 2.0, alpha: float = 0.25, gamma: float = 2.0, focal: bool = True) -> DataFrame:
    """image_id, det_id, gt_id, cost of the assignment of least cost in each image.

    det: image_id, det_id, logits (one for each class), cx, cy, w, h; gt: image_id, gt_id, label,
    cx, cy, w, h. The class cost of a pair is of the detection's probability for the target's
    class: the focal cost of its sigmoid (F17), or, without focal, its negative softmax; the
    others are the L1 distance and the negative GIoU of the boxes. Images without either
    side have no rows.
    """
    shape = ("cx", "cy", "w", "h")

    def solve(d_ends: np.ndarray, d: dict, g_ends: np.ndarray, g: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(d["det_id"]):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        # Logits one after the other, as images may have other numbers of classes.
        x = np.concatenate(d["logits"]).astype(float)
        sizes = np.fromiter(map(len, d["logits"]), np.int64, len(d["logits"]))
        begin = np.cumsum(sizes) - sizes
        a, b = corners(d, shape), corners(g, shape)
        a_ends, b_ends = (np.concatenate([c[:, :2] - c[:, 2:] / 2, c[:, :2] + c[:, 2:] / 2], axis=1) for c in (a, b))
        if focal:
            p = 1 / (1 + np.exp(-x))
            kind = alpha * (1 - p) ** gamma * -np.log(p + 1e-8) - (1 - alpha) * p**gamma * -np.log(1 - p + 1e-8)
        else:
            e = np.exp(x - np.repeat(np.maximum.reduceat(x, begin), sizes))
            kind = -(e / np.repeat(np.add.reduceat(e, begin), sizes))

        def costs(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            far = sum(np.abs(a[i, k][..., :, None] - b[j, k][..., None, :]) for k in range(4))
            return class_weight * kind[begin[i][..., :, None] + g["label"][j][..., None, :]] + box_weight * far - giou_weight * _giou_matrix(a_ends[i], b_ends[j])

        def crowd(own: slice, other: slice) -> tuple[np.ndarray, np.ndarray]:
            every, others = np.arange(own.start, own.stop), np.arange(other.start, other.stop)
            if len(every) <= len(others):
                return assign_rows(lambda k: costs(every[k : k + 1], others)[0], len(every), len(others))
            j, i = assign_rows(lambda k: costs(every, others[k : k + 1])[:, 0], len(others), len(every))
            return i, j

        i, j = assign_groups(d_ends, g_ends, costs, crowd)
        return i, j, costs(i[:, None], j[:, None])[:, 0, 0]

    return _assigned(by_image(det, gt, ["image_id"], ["det_id", "logits", *shape], ["gt_id", "label", *shape]), "cost", solve)


def _overlap_rows(det: DataFrame, gt: DataFrame, how: str) -> DataFrame:
    return by_image(det, gt, ["image_id"], ["det_id", "label", "dx0", "dy0", "dx1", "dy1"], ["gt_id", "label", "gx0", "gy0", "gx1", "gy1"], how)


def _overlap_pairs(d_ends: np.ndarray, d: dict, g_ends: np.ndarray, g: dict, least: float, penalty: float = 1000.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and IoU of the pairs of one label and at least `least` IoU that assign_overlaps() finds in each image."""
    a, b = corners(d, ("dx0", "dy0", "dx1", "dy1")), corners(g, ("gx0", "gy0", "gx1", "gy1"))

    def costs(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return 1 - _iou_matrix(a[i], b[j]) + penalty * (d["label"][i][..., :, None] != g["label"][j][..., None, :])

    def crowd(own: slice, other: slice) -> tuple[np.ndarray, np.ndarray]:
        return assign_overlaps(a[own], b[other], d["label"][own], g["label"][other], penalty)[:2]

    i, j = assign_groups(d_ends, g_ends, costs, crowd)
    iou = _pair_iou(a[i], b[j])
    ok = (d["label"][i] == g["label"][j]) & (iou >= least)
    return i[ok], j[ok], iou[ok]


def overlap_assignment(det: DataFrame, gt: DataFrame, least: float = 0.1) -> DataFrame:
    """image_id, det_id, gt_id, iou: the assignment of least total 1 - IoU, plus 1000 where labels differ; only pairs of one label and at least `least` IoU are kept."""
    return _assigned(_overlap_rows(det, gt, "inner"), "iou", lambda *sides: _overlap_pairs(*sides, least))


def overlap_outcomes(det: DataFrame, gt: DataFrame, least: float = 0.1) -> DataFrame:
    """What with_errors() gives for overlap_assignment(), whose assignments are found once, with what is left over beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (d_ends, d), (g_ends, g) = flat_sides(batch)
            free = np.ones(len(d["det_id"]), bool), np.ones(len(g["gt_id"]), bool)
            i, j, iou = _overlap_pairs(d_ends, d, g_ends, g, least)
            free[0][i], free[1][j] = False, False
            false, lost = (np.flatnonzero(x) for x in free)
            row = np.concatenate([np.searchsorted(e, x, side="right") - 1 for e, x in ((d_ends, i), (d_ends, false), (g_ends, lost))])
            n, m, k = len(i), len(false), len(lost)
            ids = lambda x, size: pa.nulls(size, pa.int64()) if x is None else pa.array(x.astype(np.int64))
            det_id = pa.concat_arrays([ids(d["det_id"][i], n), ids(d["det_id"][false], m), ids(None, k)])
            gt_id = pa.concat_arrays([ids(g["gt_id"][j], n), ids(None, m), ids(g["gt_id"][lost], k)])
            outcome = pa.array(np.repeat(["match", "false_positive", "missed"], [n, m, k]))
            yield pa.record_batch([batch["image_id"].take(pa.array(row)), outcome, det_id, gt_id, pa.concat_arrays([pa.array(iou.astype(float)), pa.nulls(m + k, pa.float64())])], ["image_id", "outcome", "det_id", "gt_id", "iou"])

    return _overlap_rows(det, gt, "full_outer").mapInArrow(run, "image_id long, outcome string, det_id long, gt_id long, iou double")


#: Pairs of masks in memory at once.
MASK_PAIRS = 1 << 17


def mask_overlaps(det: DataFrame, gt: DataFrame) -> DataFrame:
    """image_id, gt_id, det_id, iou of all pairs of masks of an image and label (J9); of crowds, over the detection's own area, and 0 without any pixel.

    det: image_id, label, det_id, counts (run lengths); gt: image_id, label, gt_id, counts, crowd. Masks move once
    and not once a pair, and pairs are formed in a task, MASK_PAIRS (or one detection's) at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (d_ends, d), (g_ends, g) = ((np.concatenate([[0], np.cumsum(pc.list_value_length(batch[c]).to_numpy())]), pa.RecordBatch.from_struct_array(batch[c].flatten())) for c in ("d", "g"))
            (d_mask, begin, end), (g_mask, start, stop) = K.set_runs(d["counts"]), K.set_runs(g["counts"])
            area_d, area_g = (np.bincount(m, weights=y - x, minlength=len(s)) for m, x, y, s in ((d_mask, begin, end, d), (g_mask, start, stop, g)))
            crowd = pc.fill_null(g["crowd"], False).to_numpy(zero_copy_only=False)
            det_id, gt_id = d["det_id"].to_numpy(), g["gt_id"].to_numpy()
            # All ground truth on one line: its set pixels before a place are a line that rises along its runs.
            width = int(max(end.max(initial=0), stop.max(initial=0))) + 1
            places = np.stack([start + g_mask * width, stop + g_mask * width], axis=1).ravel() if len(g_mask) else np.zeros(1)
            before = np.concatenate([[0], np.cumsum(stop - start)])
            rises = np.stack([before[:-1], before[1:]], axis=1).ravel() if len(g_mask) else np.zeros(1)
            first = np.searchsorted(d_mask, np.arange(len(d) + 1))
            group = np.repeat(np.arange(len(batch)), np.diff(d_ends))
            n = np.diff(g_ends)[group]
            ends = np.cumsum(n)
            at = 0
            while at < len(d):
                done = ends[at - 1] if at else 0
                last = max(at + 1, int(np.searchsorted(ends, done + MASK_PAIRS, side="right")))
                i = np.repeat(np.arange(at, last), n[at:last])
                j = np.arange(len(i)) - np.repeat(ends[at:last] - n[at:last] - done, n[at:last]) + g_ends[:-1][group[i]]
                own = np.repeat(np.arange(len(i)), np.diff(first)[i])
                r = np.arange(len(own)) - np.repeat(np.cumsum(np.diff(first)[i]) - np.diff(first)[i], np.diff(first)[i]) + first[i][own]
                line = j[own] * width
                inside = np.interp(end[r] + line, places, rises) - np.interp(begin[r] + line, places, rises)
                shared = np.bincount(own, weights=inside, minlength=len(i)).round()
                whole = np.where(crowd[j], area_d[i], area_d[i] + area_g[j] - shared)
                iou = np.divide(shared, whole, out=np.zeros(len(i)), where=whole > 0)
                yield pa.record_batch([batch["image_id"].take(pa.array(group[i])), pa.array(gt_id[j].astype(np.int64)), pa.array(det_id[i].astype(np.int64)), pa.array(iou)], ["image_id", "gt_id", "det_id", "iou"])
                at = last

    masks = by_image(det, gt, ["image_id", "label"], ["det_id", "counts"], ["gt_id", "counts", "crowd"])
    return masks.mapInArrow(run, "image_id long, gt_id long, det_id long, iou double")


def with_errors(det: DataFrame, gt: DataFrame, matches: DataFrame) -> DataFrame:
    """image_id, outcome ('match', 'false_positive' or 'missed'), det_id, gt_id, iou: every detection and ground truth once.

    Images with one side only have rows too.
    """
    found = matches.select("image_id", F.lit("match").alias("outcome"), "det_id", "gt_id", "iou")
    false = det.select("image_id", "det_id").join(matches.select("image_id", "det_id"), ["image_id", "det_id"], "left_anti")
    lost = gt.select("image_id", "gt_id").join(matches.select("image_id", "gt_id"), ["image_id", "gt_id"], "left_anti")
    none, no_iou = F.lit(None).cast("long"), F.lit(None).cast("double").alias("iou")
    return found.unionByName(false.select("image_id", F.lit("false_positive").alias("outcome"), "det_id", none.alias("gt_id"), no_iou)).unionByName(lost.select("image_id", F.lit("missed").alias("outcome"), none.alias("det_id"), "gt_id", no_iou))


def state_match(state: DataFrame, wanted: DataFrame, key: str, shape: str) -> DataFrame:
    """key, outcome: 'matched' where both have the key with one shape, 'unmatched' with another, 'missed' where state lacks it, 'extra' where only state has it."""
    a, b = state.select(F.col(key), F.col(shape).alias("_a")), wanted.select(F.col(key), F.col(shape).alias("_b"))
    outcome = F.when(F.col("_b").isNull(), "extra").when(F.col("_a").isNull(), "missed").when(F.col("_a") == F.col("_b"), "matched").otherwise("unmatched")
    return a.join(b, key, "full_outer").select(key, outcome.alias("outcome"))
