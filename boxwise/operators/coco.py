"""Average precision by the rules of the COCO evaluation.

Matching runs per image and category, at all IoU thresholds and areas at once; precision
and recall are built by running totals over each (category, area, maxDets, threshold),
and sampled at 101 recalls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwise.operators import matching as M
from boxwise.operators import ordered as O
from boxwise.session import checkpointed

#: The protocol's IoU thresholds, areas and numbers of detections.
THRESHOLDS = [round(0.5 + 0.05 * k, 2) for k in range(10)]
AREAS = {"all": (0.0, 1e10), "small": (0.0, 1024.0), "medium": (1024.0, 9216.0), "large": (9216.0, 1e10)}
MAX_DETS = (1, 10, 100)

MATCH_SCHEMA = "image_id long, category_id int, area_range string, iou_thr double, det_id long, det_rank int, score double, gt_id long, ignored boolean"


def match_image(d: dict[str, np.ndarray], g: dict[str, np.ndarray], thresholds: list[float], areas: dict[str, tuple[float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """For the detections of one image and category, highest score first, the place of the ground truth taken (-1: none) and whether it is ignored, by (area, threshold).

    Ground truth is ignored if it is a crowd or outside of the area. A detection takes the
    regular one of highest IoU that is free, the later of equal ones; only without one an
    ignored one, and crowds may be taken again. The IoU with a crowd is over the detection's
    own area. A detection is ignored if what it took is, or if it took nothing and is
    outside of the area.
    """
    return match_groups(d, np.array([0, len(d["x0"])]), g, np.array([0, len(g["x0"])]), thresholds, areas)


#: Pairs of a detection and a ground truth in memory at once, and cells of detections.
PAIRS, CELLS = 1 << 20, 1 << 22


def _overlaps(a: np.ndarray, b: np.ndarray, crowd: np.ndarray, d_ends: np.ndarray, g_ends: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (i, j) and IoU of the pairs within one group whose IoU is at least `least`."""
    area_a, area_b = (np.prod(x[:, 2:] - x[:, :2], axis=1) for x in (a, b))
    group = np.repeat(np.arange(len(d_ends) - 1), np.diff(d_ends))
    n, first = np.diff(g_ends)[group], g_ends[group]
    ends = np.cumsum(n)
    found, at = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
    while at < len(a):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
        i = np.repeat(np.arange(at, stop), n[at:stop])
        j = np.arange(len(i)) - np.repeat(ends[at:stop] - n[at:stop] - done, n[at:stop]) + first[i]
        wide, high = (np.clip(np.minimum(a[i, k + 2], b[j, k + 2]) - np.maximum(a[i, k], b[j, k]), 0, None) for k in range(2))
        if least > 0:  # most pairs share nothing
            some = np.flatnonzero((wide > 0) & (high > 0))
            i, j, wide, high = i[some], j[some], wide[some], high[some]
        inside = wide * high
        whole = np.where(crowd[j], area_a[i], area_a[i] + area_b[j] - inside)
        iou = np.divide(inside, whole, out=np.zeros_like(inside), where=whole > 0)
        near = iou >= least
        found.append((i[near], j[near], iou[near]))
        at = stop
    i, j, iou = (np.concatenate(x) for x in zip(*found, strict=True))
    return i, j, iou


def match_groups(d: dict[str, np.ndarray], d_ends: np.ndarray, g: dict[str, np.ndarray], g_ends: np.ndarray, thresholds: list[float], areas: dict[str, tuple[float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """What match_image() gives, for groups one after the other, which begin at d_ends and g_ends.

    Only pairs that reach the least threshold are looked at one by one, with a bit for each
    cell (area, threshold) where a ground truth is taken or a detection has none yet.
    """
    a, b = M.corners(d, ("x0", "y0", "x1", "y1")), M.corners(g, ("x0", "y0", "x1", "y1"))
    crowd, own = g["iscrowd"].astype(bool), g["area"].astype(float)
    floor = np.minimum(thresholds, 1 - 1e-10)
    cells, wide = len(areas) * len(floor), len(floor)
    least, largest = (np.array([r[k] for r in areas.values()]) for k in range(2))
    area_d = np.prod(a[:, 2:] - a[:, :2], axis=1)[:, None]
    void = np.repeat((area_d < least) | (area_d > largest), wide, axis=1)
    taken = np.full((len(a), cells), -1)
    i, j, iou = _overlaps(a, b, crowd, d_ends, g_ends, float(floor.min()))
    if not len(i):
        return taken, void
    order = np.lexsort((-j, -iou, i))
    i, j, iou = i[order], j[order], iou[order]
    ignored = np.repeat(crowd[:, None] | (own[:, None] < least) | (own[:, None] > largest), wide, axis=1)
    size = -(-cells // 8)
    hits: list[tuple[int, int, bytes]] = []
    used: dict[int, int] = {}
    every = (1 << cells) - 1
    last, kept = -1, every
    later: list[tuple[int, int]] = []

    def leave() -> None:
        """Cells where no regular ground truth was left take an ignored one."""
        left = kept
        for at, bits in later:
            bits &= left if crowd[at] else left & ~used.get(at, 0)
            if bits:
                used[at] = used.get(at, 0) | bits
                left &= ~bits
                hits.append((last, at, bits.to_bytes(size, "little")))
        later.clear()

    for at in range(0, len(i), CELLS // cells + 1):
        some = slice(at, at + CELLS // cells + 1)
        able = np.tile(iou[some, None] >= floor, len(areas))
        void_g = ignored[j[some]]
        regular, other = (np.packbits(x, axis=1, bitorder="little").tobytes() for x in (able & ~void_g, able & void_g))
        for k, (row, col) in enumerate(zip(i[some].tolist(), j[some].tolist(), strict=True)):
            if row != last:
                leave()
                last, kept = row, every
            bits = int.from_bytes(regular[k * size : (k + 1) * size], "little") & kept & ~used.get(col, 0)
            if bits:
                used[col] = used.get(col, 0) | bits
                kept &= ~bits
                hits.append((row, col, bits.to_bytes(size, "little")))
            if bits := int.from_bytes(other[k * size : (k + 1) * size], "little"):
                later.append((col, bits))
    leave()
    for at in range(0, len(hits), CELLS // cells + 1):
        rows, cols, bits = zip(*hits[at : at + CELLS // cells + 1], strict=True)
        k, cell = np.nonzero(np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(-1, size), axis=1, count=cells, bitorder="little"))
        row, col = np.array(rows)[k], np.array(cols)[k]
        taken[row, cell], void[row, cell] = col, ignored[col, cell]
    return taken, void


def match(det: DataFrame, gt: DataFrame, thresholds: list[float] | None = None, areas: dict[str, tuple[float, float]] | None = None, most: int = 100) -> DataFrame:
    """A row of MATCH_SCHEMA for each detection, threshold and area. See match_packed for one row a detection.

    det: image_id, category_id, det_id, score, x0, y0, x1, y1; gt: image_id, category_id, gt_id,
    x0, y0, x1, y1, area, iscrowd. Detections of an image and category are taken in the
    order (score descending, det_id), the first `most`. An image without detections has
    no rows; detections without ground truth match nothing.
    """
    thresholds, areas = thresholds or THRESHOLDS, areas or AREAS
    names = list(areas)
    cells = len(names) * len(thresholds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, det_id, rank, score, gt_id, hit, void in _matched(batch, thresholds, areas):
                each = np.repeat(row, cells)
                yield pa.record_batch(
                    [
                        *(batch[c].take(pa.array(each)) for c in ("image_id", "category_id")),
                        pa.array(np.tile(np.repeat(names, len(thresholds)), len(row))),
                        pa.array(np.tile(np.array(thresholds, dtype=float), len(row) * len(names))),
                        pa.array(np.repeat(det_id, cells)),
                        pa.array(np.repeat(rank, cells), pa.int32()),
                        pa.array(np.repeat(score.astype(float), cells)),
                        pa.array(gt_id.ravel(), mask=~hit.ravel()),
                        pa.array(void.ravel()),
                    ],
                    ["image_id", "category_id", "area_range", "iou_thr", "det_id", "det_rank", "score", "gt_id", "ignored"],
                )

    return _paired(det, gt, most).mapInArrow(run, MATCH_SCHEMA)


def _matched(batch: pa.RecordBatch, thresholds: list[float], areas: dict[str, tuple[float, float]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Row of the batch, det_id, rank and score of the detections, and gt_id, hit and ignored of each in each cell (area, threshold)."""
    (d_ends, d), (g_ends, g) = M.flat_sides(batch)
    most = max(1, CELLS // (len(thresholds) * len(areas)))
    ids = np.append(g["gt_id"].astype(np.int64), 0)
    at = 0
    while at < len(batch):
        stop = max(at + 1, int(np.searchsorted(d_ends, d_ends[at] + most, side="right")) - 1)
        here, there = slice(d_ends[at], d_ends[stop]), slice(g_ends[at], g_ends[stop])
        taken, void = match_groups({k: v[here] for k, v in d.items()}, d_ends[at : stop + 1] - d_ends[at], {k: v[there] for k, v in g.items()}, g_ends[at : stop + 1] - g_ends[at], thresholds, areas)
        n = np.diff(d_ends[at : stop + 1])
        rank = np.arange(1, len(taken) + 1) - np.repeat(np.cumsum(n) - n, n)
        if len(taken):
            hit = taken >= 0
            yield np.repeat(np.arange(at, stop), n), d["det_id"][here].astype(np.int64), rank, -d["order"][here], ids[np.where(hit, taken + g_ends[at], -1)], hit, void
        at = stop


def _paired(det: DataFrame, gt: DataFrame, most: int) -> DataFrame:
    """A row for each image and category, with its detections, the first `most` alone, and its ground truth."""
    # What lies beyond the largest number of detections never moves.
    top = M.top_per_group(det, ["image_id", "category_id"], [F.desc("score"), F.asc("det_id")], most).withColumn("order", -F.col("score").cast("double"))
    xyxy = ["x0", "y0", "x1", "y1"]
    typed = [f.select(F.col("image_id").cast("long").alias("image_id"), F.col("category_id").cast("int").alias("category_id"), *cols) for f, cols in ((top, ["order", "det_id", *xyxy]), (gt, ["gt_id", *xyxy, "area", "iscrowd"]))]
    return M.by_image(*typed, ["image_id", "category_id"], ["order", "det_id", *xyxy], ["gt_id", *xyxy, "area", "iscrowd"], "left")


PACKED = "image_id long, category_id int, det_id long, det_rank int, score double, matched binary, ignored binary"


def match_packed(det: DataFrame, gt: DataFrame, thresholds: list[float] | None = None, areas: dict[str, tuple[float, float]] | None = None, most: int = 100) -> DataFrame:
    """match() with one row a detection: matched and ignored hold a bit for each cell (area, threshold), areas first."""
    thresholds, areas = thresholds or THRESHOLDS, areas or AREAS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, det_id, rank, score, _, hit, void in _matched(batch, thresholds, areas):
                bits = [pa.array([x.tobytes() for x in np.packbits(b, axis=1)], pa.binary()) for b in (hit, void)]
                yield pa.record_batch([*(batch[c].take(pa.array(row)) for c in ("image_id", "category_id")), pa.array(det_id), pa.array(rank, pa.int32()), pa.array(score.astype(float)), *bits], ["image_id", "category_id", "det_id", "det_rank", "score", "matched", "ignored"])

    return _paired(det, gt, most).mapInArrow(run, PACKED)


BLOCKS = "category_id int, ranks binary, matched binary, ignored binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of BLOCKS for each run of one category in a batch: sorted detections are read three times, and a row each costs more than its bits."""
    for batch in batches:
        bounds = [*O.group_starts(batch, ["category_id"]).tolist(), len(batch)] if len(batch) else [0]
        runs = [batch.slice(a, b - a) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        ranks = [r["det_rank"].to_numpy().astype(np.int32).tobytes() for r in runs]
        bits = [[b"".join(r[c].to_pylist()) for r in runs] for c in ("matched", "ignored")]
        yield pa.record_batch([batch["category_id"].take(pa.array(bounds[:-1], pa.int64())), *(pa.array(x, pa.binary()) for x in (ranks, *bits))], ["category_id", "ranks", "matched", "ignored"])


def _bits(rows: bytes, n: int, cells: int) -> np.ndarray:
    """The bits of match_packed() for n detections, by (cell, detection)."""
    return np.ascontiguousarray(np.unpackbits(np.frombuffer(rows, np.uint8).reshape(n, -1), axis=1, count=cells).T).astype(bool)


def hit_precisions(rank: np.ndarray, counted: np.ndarray, hit: np.ndarray, most: list[int], n: np.ndarray, tp: np.ndarray) -> list[np.ndarray]:
    """The precisions at the hits of some detections, one array for each (max_det, cell), after n that count and tp hits.

    counted and hit are by (cell, detection), n and tp by (max_det, cell). Nothing is kept of a detection that takes nothing.
    """
    out, at = [], 0
    for m in most:
        kept = rank <= m
        some, own = (counted, hit) if kept.all() else (counted[:, kept], hit[:, kept])
        so_far = np.cumsum(some, axis=1, dtype=np.int32)
        cell, place = np.nonzero(own)
        ends = np.searchsorted(cell, np.arange(len(own) + 1))
        each = np.arange(1, len(cell) + 1) - ends[cell] + tp[at + cell]
        out += np.split(each / (so_far[cell, place] + n[at + cell]), ends[1:-1])
        at += len(own)
    return out


def accumulate(packed: DataFrame, npos: DataFrame, thresholds: list[float] | None = None, areas: dict[str, tuple[float, float]] | None = None, max_dets: tuple[int, ...] = MAX_DETS) -> DataFrame:
    """What average_precision() gives, from match_packed(): one sort by category and score, and sums over cells by bit columns.

    Each partition of the sorted detections leaves the counts of its last category, then,
    knowing what came before, the highest precisions of its first one, and then its share of
    every category's sums. So three passes read the sorted rows, and none moves them again; a task
    holds a number for each hit of its partition.
    Collected are a number for each cell and partition, and for each category and area.
    """
    thresholds, areas = thresholds or THRESHOLDS, areas or AREAS
    spots = list(areas)
    cells, most = len(spots) * len(thresholds), list(max_dets)
    wide = cells * len(most)
    pieces = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Dealing rows into ranges looks at them twice; they are matched once.
    kept = packed.where(F.col("det_rank") <= max(most)).persist(StorageLevel.DISK_ONLY)
    order = [F.col("category_id"), F.desc("score"), F.asc("image_id"), F.asc("det_id")]
    placed = checkpointed(kept.repartitionByRange(pieces, *order).sortWithinPartitions(*order).select("category_id", "det_rank", "matched", "ignored").mapInArrow(_blocks, BLOCKS))
    kept.unpersist()
    known = npos.collect()
    truth = {(r["category_id"], r["area_range"]): r["npos"] for r in known}
    npos = packed.sparkSession.createDataFrame(known, npos.schema)  # a row for each category and area

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Category, ranks, whether each detection counts and hits, by (cell, detection), and the numbers of both, by (max_det, cell), for runs of one category."""
        for batch in batches:
            for block in batch.to_pylist():
                rank = np.frombuffer(block["ranks"], np.int32)
                counted = ~_bits(block["ignored"], len(rank), cells)
                hit = counted & _bits(block["matched"], len(rank), cells)
                own = [rank <= m for m in most]
                n, tp = (np.concatenate([np.count_nonzero(x if k.all() else x[:, k], axis=1) for k in own]) for x in (counted, hit))
                yield block["category_id"], rank, counted, hit, n, tp

    edges = "part long, first int, last int, x array<double>, y array<double>"

    def edge(first: int, last: int, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array([TaskContext.get().partitionId()]), pa.array([first], pa.int32()), pa.array([last], pa.int32()), pa.array([x.tolist()], pa.list_(pa.float64())), pa.array([y.tolist()], pa.list_(pa.float64()))], ["part", "first", "last", "x", "y"])

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for category, _, _, _, own_n, own_tp in parts(batches):
            first = category if first is None else first
            if category != last:
                n = tp = np.zeros(wide, dtype=np.int64)
            n, tp, last = n + own_n, tp + own_tp, category
        if first is not None:
            yield edge(first, last, n, tp)

    def curves(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        """Category, the hits before, by (max_det, cell), and the precisions at those that follow."""
        last, n, tp = before.get(TaskContext.get().partitionId(), (None, 0, 0))
        for category, rank, counted, hit, own_n, own_tp in parts(batches):
            if category != last:
                last, n, tp = category, np.zeros(wide, np.int64), np.zeros(wide, np.int64)
            yield category, tp, hit_precisions(rank, counted, hit, most, n, tp)
            n, tp = n + own_n, tp + own_tp

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for category, _, precisions in curves(batches):
            if first is None:
                first, top = category, np.full(wide, -1.0)
            if category == first:
                top = np.maximum(top, [p.max(initial=-1.0) for p in precisions])
            last = category
        if first is not None:
            yield edge(first, last, top, top)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each category: the sum over its hits here of the recall samples that each covers times its envelope, and the hits up to here."""
        sums: dict[int, np.ndarray] = {}
        found: dict[int, np.ndarray] = {}
        last, top = after.get(TaskContext.get().partitionId(), (None, None))
        for category, tp, precisions in reversed(list(curves(batches))):
            if category != last:
                last, top = category, np.full(wide, -1.0)
            else:
                top = top.copy()
            own = np.tile(np.repeat([max(truth.get((category, s), 0), 1) for s in spots], len(thresholds)), len(most))
            share = np.zeros(wide)
            for w, p in enumerate(precisions):
                if len(p):
                    envelope = np.maximum(np.maximum.accumulate(p[::-1])[::-1], top[w])
                    # Sample k is taken at the first hit whose recall reaches k / 100, and sample 0 at the first hit: nothing before it has a higher envelope.
                    sample = np.floor(np.arange(tp[w], tp[w] + len(p) + 1) / own[w] * 100 + 1e-9)
                    sample[0] = sample[0] if tp[w] else -1
                    share[w], top[w] = (np.diff(sample) * envelope).sum(), envelope[0]
            sums[category] = sums.get(category, 0) + share
            found.setdefault(category, tp + [len(p) for p in precisions])
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64())), pa.array([found[c].tolist() for c in sums], pa.list_(pa.int64()))], ["category_id", "sums", "found"])

    before: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    category = None
    for part, first, last, n, tp in sorted(placed.mapInArrow(tails, edges).collect()):
        if first == category:
            before[part] = category, total_n, total_tp
        goes_on = first == category == last
        total_n, total_tp = np.array(n, np.int64) + (total_n if goes_on else 0), np.array(tp, np.int64) + (total_tp if goes_on else 0)
        category = last
    after: dict[int, tuple[int, np.ndarray]] = {}
    category = None
    for part, first, last, x, _ in sorted(placed.mapInArrow(heads, edges).collect(), reverse=True):
        if last == category:
            after[part] = category, top
        top = np.maximum(x, top) if first == last == category else np.array(x)
        category = first

    keys = [(m, a, t) for m in most for a in spots for t in thresholds]
    each = F.arrays_zip(F.array(*(F.struct(F.lit(m).alias("max_det"), F.lit(a).alias("area_range"), F.lit(t).alias("iou_thr")) for m, a, t in keys)).alias("k"), "sums", "found")
    rows = placed.mapInArrow(shares, "category_id int, sums array<double>, found array<long>").select("category_id", F.explode(each).alias("e")).select("category_id", "e.k.*", "e.sums", "e.found")
    total = rows.groupBy("category_id", "area_range", "max_det", "iou_thr").agg((F.sum("sums") / 101).alias("ap"), F.max("found").alias("found"))
    every = npos.where("npos > 0").select("category_id", "area_range", "npos", F.explode(F.array(*(F.struct(F.lit(m).alias("max_det"), F.lit(t).alias("iou_thr")) for m in most for t in thresholds))).alias("k")).select("category_id", "area_range", "npos", "k.*")
    joined = every.join(total, ["category_id", "area_range", "max_det", "iou_thr"], "left")
    return joined.select("category_id", "area_range", "max_det", "iou_thr", F.coalesce("ap", F.lit(0.0)).alias("ap"), F.coalesce(F.col("found") / F.col("npos"), F.lit(0.0)).alias("recall"))


def positives(gt: DataFrame, areas: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """category_id, area_range, npos: the ground truth that is not ignored."""
    ranges = F.array(*(F.struct(F.lit(k).alias("area_range"), F.lit(a).alias("low"), F.lit(b).alias("high")) for k, (a, b) in (areas or AREAS).items()))
    rows = gt.select("category_id", "area", "iscrowd", F.inline(ranges))
    return rows.where("iscrowd = 0 and area >= low and area <= high").groupBy("category_id", "area_range").agg(F.count(F.lit(1)).alias("npos"))


def precision_recall(matches: DataFrame, npos: DataFrame, max_dets: tuple[int, ...] = MAX_DETS, hits_only: bool = False) -> DataFrame:
    """For each key (category_id, area_range, max_det, iou_thr) and detection that counts, by score: rank, hit, recall, precision and envelope (the highest precision from there on).

    All of max_dets share one sort, as a lower number only leaves rows out. hits_only:
    leaves out detections that took nothing, which neither the envelope nor the average
    precision depends on once ranks are counted.
    """
    keys = ["category_id", "area_range", "iou_thr"]
    counts = {m: F.col("det_rank") <= m for m in max_dets}
    flags = {f"n_{m}": w.cast("int") for m, w in counts.items()} | {f"tp_{m}": (w & F.col("gt_id").isNotNull()).cast("int") for m, w in counts.items()}
    rows = matches.where(~F.col("ignored") & (F.col("det_rank") <= max(max_dets))).select(*keys, "image_id", "det_id", "score", *(v.alias(k) for k, v in flags.items()))
    cum = O.running_totals(O.in_order(rows, keys, [F.desc("score"), F.asc("image_id"), F.asc("det_id")]), keys, list(flags))
    curve = cum.withColumns({f"p_{m}": F.when(F.col(f"n_{m}") > 0, F.col(f"cum_tp_{m}") / F.col(f"cum_n_{m}")) for m in max_dets})
    if hits_only:
        curve = curve.where(" or ".join(f"tp_{m} > 0" for m in max_dets))
    tops = O.highest_after(curve, keys, [f"p_{m}" for m in max_dets]).join(npos.where("npos > 0"), ["category_id", "area_range"])
    each = F.array(*(F.struct(F.lit(m).alias("max_det"), F.col(f"n_{m}").alias("n"), F.col(f"tp_{m}").alias("hit"), F.col(f"cum_n_{m}").alias("rank"), F.col(f"cum_tp_{m}").alias("tp"), F.col(f"p_{m}").alias("precision"), F.col(f"max_p_{m}").alias("envelope")) for m in max_dets))
    return tops.select(*keys, "score", "npos", F.inline(each)).where("hit > 0" if hits_only else "n > 0").select("category_id", "area_range", "max_det", "iou_thr", "rank", "score", "hit", "precision", (F.col("tp") / F.col("npos")).alias("recall"), "envelope", "tp", "npos")


def average_precision(curve: DataFrame, npos: DataFrame, thresholds: list[float] | None = None, max_dets: tuple[int, ...] = MAX_DETS) -> DataFrame:
    """Keys..., ap (mean envelope at recalls 0, 0.01 ... 1, 0 past the curve's end) and recall (its largest).

    One row for each category and area with ground truth, also where nothing was found. The
    number of samples that a step of recall covers is counted, so no join on ranges is needed.
    """
    keys = ["category_id", "area_range", "max_det", "iou_thr"]
    # Sample k is taken at the first hit whose recall reaches k / 100, and sample 0 at the first hit: nothing before it has a higher envelope.
    samples = lambda tp: F.floor(tp / F.col("npos") * 100 + 1e-9)
    taken = samples(F.col("tp")) - F.when(F.col("tp") == 1, F.lit(-1)).otherwise(samples(F.col("tp") - 1))
    found = curve.groupBy(*keys).agg((F.sum(F.when(F.col("hit") > 0, taken * F.col("envelope")).otherwise(0.0)) / 101).alias("ap"), F.max("recall").alias("recall"))
    every = npos.where("npos > 0").select("category_id", "area_range", F.explode(F.array(*map(F.lit, max_dets))).alias("max_det")).select("*", F.explode(F.array(*map(F.lit, thresholds or THRESHOLDS))).alias("iou_thr"))
    return every.join(found, keys, "left").select(*keys, F.coalesce("ap", F.lit(0.0)).alias("ap"), F.coalesce("recall", F.lit(0.0)).alias("recall"))


def summary(cube: DataFrame) -> DataFrame:
    """stat, value: the twelve summary numbers, means over the cells of average_precision(); NULL where there is none."""
    cell = lambda area, dets, thr=None: (F.col("area_range") == area) & (F.col("max_det") == dets) & (F.lit(True) if thr is None else F.abs(F.col("iou_thr") - thr) < 1e-9)
    most = max(MAX_DETS)
    wanted = {"AP": ("ap", cell("all", most)), "AP50": ("ap", cell("all", most, 0.5)), "AP75": ("ap", cell("all", most, 0.75))}
    wanted |= {f"AP_{a}": ("ap", cell(a, most)) for a in ("small", "medium", "large")}
    wanted |= {f"AR{n}": ("recall", cell("all", n)) for n in MAX_DETS} | {f"AR_{a}": ("recall", cell(a, most)) for a in ("small", "medium", "large")}
    row = cube.agg(*(F.avg(F.when(where, F.col(c))).alias(k) for k, (c, where) in wanted.items()))
    return row.select(F.inline(F.array(*(F.struct(F.lit(k).alias("stat"), F.col(k).alias("value")) for k in wanted))))
