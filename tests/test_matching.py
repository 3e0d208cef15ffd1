"""Matching, suppression, average precision and spanning trees against plain loops."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwise.operators import coco as C
from boxwise.operators import matching as M
from boxwise.operators import ranking as R
from boxwise.operators import statistics as T
from boxwise.operators import topology as U
from boxwise.plans import model_queries, table_queries

Box = tuple[float, float, float, float]


def plain_iou(a: Box, b: Box, crowd: bool = False) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inside = max(w, 0) * max(h, 0)
    size = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    whole = size(a) if crowd else size(a) + size(b) - inside
    return inside / whole if whole > 0 else 0.0


def random_box(rng: random.Random) -> Box:
    x, y = rng.randrange(60), rng.randrange(60)
    return (float(x), float(y), float(x + rng.choice((10, 20, 40, 110))), float(y + rng.choice((10, 20, 40, 110))))


@pytest.fixture(scope="module")
def scenes() -> tuple[list[dict], list[dict]]:
    """Images with both sides; 90 has detections only, 91 ground truth only."""
    rng = random.Random(3)
    det, gt = [], []
    for image in [*range(12), 90, 91]:
        for k in range(0 if image == 91 else 9):
            det.append({"image_id": image, "category_id": k % 2, "label": k % 2, "det_id": k, "score": rng.randrange(8) / 8, "box": random_box(rng)})
        for k in range(0 if image == 90 else 7):
            near = rng.random() < 0.8 and image < 12
            source = rng.choice([d for d in det if d["image_id"] == image]) if near else None
            gt.append({"image_id": image, "category_id": source["category_id"] if source else k % 2, "label": k % 2, "gt_id": k + 1, "iscrowd": int(k == 5), "box": tuple(v + (i > 1) * rng.randrange(6) for i, v in enumerate(source["box"])) if source else random_box(rng)})
    return det, gt


def frames(spark: SparkSession, scenes: tuple[list[dict], list[dict]], prefix: tuple[str, str] = ("", "")) -> tuple[DataFrame, DataFrame]:
    flat = [[{**{k: v for k, v in r.items() if k != "box"}, **{f"{p}{n}": v for n, v in zip(("x0", "y0", "x1", "y1"), r["box"], strict=True)}, **({"area": (r["box"][2] - r["box"][0]) * (r["box"][3] - r["box"][1])} if "gt_id" in r else {})} for r in side] for side, p in zip(scenes, prefix, strict=True)]
    return spark.createDataFrame(flat[0]), spark.createDataFrame(flat[1])


def plain_coco(det: list[dict], gt: list[dict], thr: float, low: float, high: float, most: int) -> list[tuple]:
    """(image, category, det_id, gt_id or None, ignored), one detection after the other."""
    out = []
    for image, category in sorted({(d["image_id"], d["category_id"]) for d in det}):
        ds = sorted((d for d in det if (d["image_id"], d["category_id"]) == (image, category)), key=lambda d: (-d["score"], d["det_id"]))[:most]
        gs = [g for g in gt if (g["image_id"], g["category_id"]) == (image, category)]
        size = lambda x: (x[2] - x[0]) * (x[3] - x[1])
        off = {g["gt_id"]: bool(g["iscrowd"]) or not low <= size(g["box"]) <= high for g in gs}
        gs.sort(key=lambda g: (off[g["gt_id"]], g["gt_id"]))
        used: set[int] = set()
        for d in ds:
            best, got = min(thr, 1 - 1e-10), None
            for g in gs:
                if g["gt_id"] in used and not g["iscrowd"]:
                    continue
                if got is not None and not off[got] and off[g["gt_id"]]:
                    break
                iou = plain_iou(d["box"], g["box"], bool(g["iscrowd"]))
                if iou >= best:
                    best, got = iou, g["gt_id"]
            if got is not None:
                used.add(got)
            out.append((image, category, d["det_id"], got, off[got] if got is not None else not low <= size(d["box"]) <= high))
    return out


def test_coco_matches(spark: SparkSession, scenes) -> None:  # noqa: ANN001
    det, gt = frames(spark, scenes)
    found = C.match(det, gt, [0.5, 0.75])
    for (area, (low, high)), thr in itertools.product(C.AREAS.items(), (0.5, 0.75)):
        rows = found.where((F.col("area_range") == area) & (F.col("iou_thr") == thr))
        assert sorted(tuple(r) for r in rows.select("image_id", "category_id", "det_id", F.coalesce("gt_id", F.lit(-1)), "ignored").collect()) == sorted((a, b, c, -1 if g is None else g, i) for a, b, c, g, i in plain_coco(*scenes, thr, low, high, 100))
    assert found.count() == len(scenes[0]) * 8
    assert found.select("score").count() == found.count()


def test_coco_summary(spark: SparkSession, scenes) -> None:  # noqa: ANN001
    """All twelve numbers by an evaluation that walks each cell's detections in order."""
    det, gt = scenes
    cells: dict[tuple, tuple[float, float]] = {}
    scores = {(d["image_id"], d["category_id"], d["det_id"]): d["score"] for d in det}
    size = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    for (area, (low, high)), thr, most in itertools.product(C.AREAS.items(), C.THRESHOLDS, C.MAX_DETS):
        rows = plain_coco(det, gt, thr, low, high, most)
        for category in (0, 1):
            npos = sum(g["category_id"] == category and not g["iscrowd"] and low <= size(g["box"]) <= high for g in gt)
            own = sorted((r for r in rows if r[1] == category and not r[4]), key=lambda r: (-scores[r[:3]], r[0], r[2]))
            if not npos:
                continue
            hits = np.cumsum([r[3] is not None for r in own]) if own else np.zeros(0)
            precision = hits / np.arange(1, len(own) + 1)
            envelope = np.maximum.accumulate(precision[::-1])[::-1]
            at = np.searchsorted(hits / npos, np.arange(101) / 100 - 1e-12)
            cells[area, thr, most, category] = (float(np.mean([envelope[k] if k < len(own) else 0.0 for k in at])), float(hits[-1] / npos) if len(own) else 0.0)
    mean = lambda i, area, most, thr=None: (lambda v: float(np.mean(v)) if v else None)([c[i] for (a, t, m, _), c in cells.items() if a == area and m == most and thr in (None, t)])
    expected = {"AP": mean(0, "all", 100), "AP50": mean(0, "all", 100, 0.5), "AP75": mean(0, "all", 100, 0.75)} | {f"AP_{a}": mean(0, a, 100) for a in ("small", "medium", "large")} | {f"AR{m}": mean(1, "all", m) for m in C.MAX_DETS} | {f"AR_{a}": mean(1, a, 100) for a in ("small", "medium", "large")}
    d, g = frames(spark, scenes)
    npos = C.positives(g)
    cubes = [C.average_precision(C.precision_recall(C.match(d, g), npos, hits_only=hits_only), npos) for hits_only in (False, True)]
    for cube in [*cubes, C.accumulate(C.match_packed(d, g), npos)]:
        got = {r["stat"]: r["value"] for r in C.summary(cube).collect()}
        assert got.keys() == expected.keys()
        for k, v in expected.items():
            assert got[k] == (None if v is None else pytest.approx(v, abs=1e-9)), k


def test_assignments(spark: SparkSession, scenes) -> None:  # noqa: ANN001
    rng = np.random.default_rng(2)
    for n, m in itertools.product(range(1, 6), range(1, 6)):
        cost = rng.integers(0, 6, (n, m)).astype(float)
        i, j = M.assign(cost)
        best = min(sum(cost[a, b] for a, b in zip(p, q, strict=False)) for p in itertools.permutations(range(n), min(n, m)) for q in itertools.combinations(range(m), min(n, m)))
        assert len(i) == min(n, m) == len(set(j)) == len(set(i))
        assert cost[i, j].sum() == pytest.approx(best)


def test_overlap_assignment_is_best_and_complete(spark: SparkSession, scenes) -> None:  # noqa: ANN001
    det, gt = frames(spark, scenes, ("d", "g"))
    pairs = M.overlap_assignment(det, gt)
    assert pairs.count() == len(pairs.collect()) == len(pairs.select("iou").collect())
    rows = M.with_errors(det, gt, pairs).collect()
    assert sorted((r["image_id"], r["det_id"]) for r in rows if r["outcome"] != "missed") == sorted((d["image_id"], d["det_id"]) for d in scenes[0])
    assert sorted((r["image_id"], r["gt_id"]) for r in rows if r["outcome"] != "false_positive") == sorted((g["image_id"], g["gt_id"]) for g in scenes[1])
    image = 4
    ds, gs = [d for d in scenes[0] if d["image_id"] == image][:9], [g for g in scenes[1] if g["image_id"] == image][:7]
    cost = lambda d, g: 1 - plain_iou(d["box"], g["box"]) + 1000 * (d["label"] != g["label"])
    best = min(sum(cost(ds[a], g) for a, g in zip(p, gs, strict=True)) for p in itertools.permutations(range(len(ds)), len(gs)))
    i, j = M.assign(np.array([[cost(d, g) for g in gs] for d in ds]))
    assert sum(cost(ds[a], gs[b]) for a, b in zip(i, j, strict=True)) == pytest.approx(best)
    assert sorted((r["det_id"], r["gt_id"]) for r in pairs.where(f"image_id = {image}").collect()) == sorted((ds[a]["det_id"], gs[b]["gt_id"]) for a, b in zip(i, j, strict=True) if ds[a]["label"] == gs[b]["label"] and plain_iou(ds[a]["box"], gs[b]["box"]) >= 0.1)


def test_crowded_assignment_equals_the_dense_one(monkeypatch: pytest.MonkeyPatch) -> None:
    """Costs made row by row, from overlapping pairs alone, give the total of the whole matrix; a crowd of thousands ends."""
    rng = np.random.default_rng(8)

    def crowd(n: int, m: int, side: float) -> tuple[np.ndarray, ...]:
        at = rng.uniform(0, side, (n + m, 2))
        xy = np.concatenate([at, at + rng.uniform(10, 30, (n + m, 2))], axis=1)
        moved = min(n, m) // 2
        xy[:moved] = xy[n : n + moved] + rng.normal(0, 2, (moved, 4))
        return xy[:n], xy[n:], rng.integers(0, 3, n), rng.integers(0, 3, m)

    for n, m in ((1, 1), (1, 40), (40, 1), (60, 50), (150, 200), (200, 150), (180, 180)):
        a, b, p, q = crowd(n, m, 120)
        totals = []
        for dense in (1 << 20, 0):
            monkeypatch.setattr(M, "DENSE", dense)
            i, j, iou = M.assign_overlaps(a, b, p, q)
            assert len(i) == len(set(i)) == len(set(j)) == min(n, m) and (np.diff(i) > 0).all()
            assert iou == pytest.approx(M._iou_matrix(a, b)[i, j])
            totals.append((1 - iou + 1000 * (p[i] != q[j])).sum())
        assert totals[0] == pytest.approx(totals[1])
    monkeypatch.undo()
    a, b, p, q = crowd(5000, 4000, 1500)
    i, j, _ = M.assign_overlaps(a, b, p, q)
    assert len(set(i)) == len(set(j)) == 4000


def test_hungarian_match_of_a_crowd_equals_the_dense_one(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    rng = np.random.default_rng(6)
    side = lambda n, extra: [{"image_id": 1, **{k: float(v) for k, v in zip(("cx", "cy", "w", "h"), rng.uniform(0.1, 0.5, 4), strict=True)}, **extra(k)} for k in range(n)]
    for n, m in ((30, 12), (12, 30)):
        det = spark.createDataFrame(side(n, lambda k: {"det_id": k, "logits": rng.normal(size=3).tolist()}))
        gt = spark.createDataFrame(side(m, lambda k: {"gt_id": k, "label": k % 3}))
        found = []
        for dense in (1 << 20, 0):
            monkeypatch.setattr(M, "DENSE", dense)
            found.append(sorted((r["det_id"], r["gt_id"], round(r["cost"], 9)) for r in M.hungarian_match(det, gt).collect()))
        assert found[0] == found[1] and len(found[0]) == 12


@pytest.mark.parametrize("focal", [True, False])
def test_hungarian_cost(spark: SparkSession, focal: bool) -> None:
    rng = np.random.default_rng(5)
    det = [{"image_id": 1, "det_id": k, "logits": rng.normal(size=3).tolist(), "cx": 0.2 + k / 10, "cy": 0.5, "w": 0.2, "h": 0.1 + k / 20} for k in range(4)]
    gt = [{"image_id": 1, "gt_id": k, "label": k % 3, "cx": 0.3 + k / 10, "cy": 0.45, "w": 0.25, "h": 0.2} for k in range(3)] + [{"image_id": 2, "gt_id": 0, "label": 0, "cx": 0.5, "cy": 0.5, "w": 0.1, "h": 0.1}]
    xyxy = lambda b: (b["cx"] - b["w"] / 2, b["cy"] - b["h"] / 2, b["cx"] + b["w"] / 2, b["cy"] + b["h"] / 2)

    def cost(d: dict, g: dict) -> float:
        x = np.array(d["logits"])
        if focal:
            p = 1 / (1 + np.exp(-x[g["label"]]))
            kind = 0.25 * (1 - p) ** 2 * -np.log(p + 1e-8) - 0.75 * p**2 * -np.log(1 - p + 1e-8)
        else:
            kind = -np.exp(x[g["label"]]) / np.exp(x).sum()
        a, b = xyxy(d), xyxy(g)
        size = lambda q: (q[2] - q[0]) * (q[3] - q[1])
        iou = plain_iou(a, b)
        union = (size(a) + size(b)) / (1 + iou)
        hull = (max(a[2], b[2]) - min(a[0], b[0])) * (max(a[3], b[3]) - min(a[1], b[1]))
        return 2 * kind + 5 * sum(abs(d[k] - g[k]) for k in ("cx", "cy", "w", "h")) - 2 * (iou - (hull - union) / hull)

    got = M.hungarian_match(spark.createDataFrame(det), spark.createDataFrame(gt), focal=focal)
    best = min(itertools.permutations(range(4), 3), key=lambda p: sum(cost(det[a], gt[b]) for b, a in enumerate(p)))
    assert {(r["det_id"], r["gt_id"]): r["cost"] for r in got.collect()} == {(a, b): pytest.approx(cost(det[a], gt[b])) for b, a in enumerate(best)}
    assert got.count() == 3


@pytest.mark.parametrize("name", ["j9_coco_match", "j10_hungarian_match", "j11_overlap_assignment", "j11_false_and_missed"])
def test_counting_and_collecting_agree(spark: SparkSession, sf_dir: str, name: str) -> None:
    query = (table_queries.__dict__ | model_queries.__dict__)[name]
    df = query(spark, sf_dir)
    assert df.count() == len(df.collect()) == len(df.select("image_id").collect()) > 0


def test_nms(spark: SparkSession, scenes) -> None:  # noqa: ANN001
    det = frames(spark, scenes)[0].withColumnRenamed("det_id", "box_id")
    expected = []
    for image in {d["image_id"] for d in scenes[0]}:
        kept: list[dict] = []
        for label in (0, 1):
            own: list[dict] = []
            for d in sorted((d for d in scenes[0] if (d["image_id"], d["label"]) == (image, label) and d["score"] > 0.2), key=lambda d: (-d["score"], d["det_id"])):
                if all(plain_iou(d["box"], k["box"]) <= 0.3 for k in own):
                    own.append(d)
            kept += own
        expected += [(image, d["det_id"]) for d in sorted(kept, key=lambda d: (-d["score"], d["det_id"]))[:5]]
    got = M.nms(det, 0.3, 5, 0.2)
    assert sorted((r["image_id"], r["box_id"]) for r in got.collect()) == sorted(expected)
    assert got.count() == len(expected)


def kruskal(x: np.ndarray, w: np.ndarray) -> list[float]:
    edges = sorted(((abs(w[o, i]) * abs(x[i]), i, len(x) + o) for o in range(len(w)) for i in range(len(x))), reverse=True)
    root = list(range(len(x) + len(w)))

    def top(v: int) -> int:
        while root[v] != v:
            v = root[v]
        return v

    out = []
    for weight, a, b in edges:
        if top(a) != top(b):
            root[top(a)] = top(b)
            out.append(weight)
    return out


def test_spanning_trees() -> None:
    rng = np.random.default_rng(1)
    for inputs, outputs in ((1, 1), (1, 4), (5, 1), (4, 3), (6, 6)):
        x, w = rng.integers(-3, 4, (6, inputs)).astype(float), rng.normal(size=(outputs, inputs)).round(1)
        assert U.spanning_tree(x, w) == pytest.approx(np.array([kruskal(row, w) for row in x]))
        assert U.spanning_tree(x, w).shape[1] == inputs + outputs - 1
    assert U.spanning_tree(np.array([[1.0, 0.0], [0.0, 1.0]]), 5 * np.eye(2)).tolist() == [[5, 0, 0], [5, 0, 0]]


def test_topological_uncertainty(spark: SparkSession, sf_dir: str) -> None:
    """u1 and u2 from Kruskal's trees and plain means."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    weights = model_queries.layer_weights()
    trees = {(r["vec_id"], layer): np.array(kruskal(np.array(r["embedding"], dtype=float), w)) for r in rows[:60] for layer, w in weights.items()}
    got = model_queries.tree_diagrams(spark, sf_dir).where(F.col("vec_id").isin([r["vec_id"] for r in rows[:60]])).collect()
    assert len(got) == len(trees)
    for r in got:
        assert r["diagram"] == pytest.approx(trees[r["vec_id"], r["layer"]], abs=1e-6)
    every = {(r["vec_id"], r["layer"]): (r["label"], np.array(r["diagram"])) for r in model_queries.tree_diagrams(spark, sf_dir).collect()}
    means = {}
    for label, layer in {(v[0], k[1]) for k, v in every.items()}:
        own = [d for (i, at), (kind, d) in every.items() if (kind, at) == (label, layer) and i % 5]
        means[label, layer] = np.mean(own, axis=0) if own else None
    for r in model_queries.u2_topological_uncertainty(spark, sf_dir).collect():
        far = [np.sqrt(np.mean((every[r["vec_id"], layer][1] - means[r["label"], layer]) ** 2)) for layer in weights if means[r["label"], layer] is not None]
        assert r["tu"] == pytest.approx(np.mean(far), abs=2e-6)


def test_quantiles_and_ranked_bins(spark: SparkSession) -> None:
    rng = np.random.default_rng(4)
    rows = [(g, int(k), float(rng.integers(0, 9)), int(rng.integers(0, 2))) for g, n in (("a", 1), ("b", 7), ("c", 103)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, k long, x double, y int")
    for r in R.quantiles(df, ["g"], "x", {"low": 0.05, "mid": 0.5, "high": 0.95}).collect():
        own = [x for g, _, x, _ in rows if g == r["g"]]
        assert (r["n"], r["low"], r["mid"], r["high"]) == (len(own), *(pytest.approx(np.quantile(own, q)) for q in (0.05, 0.5, 0.95)))
    expected = T.equal_bins(df, ["g"], [F.asc("x"), F.asc("k")], 10).select("g", "k", "bin")
    got = T.ranked_bins(df, ["g"], "x", "k", ["y"], 10).select("g", F.col("key").alias("k"), "bin")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_pairs_by_cells_are_all_pairs(spark: SparkSession) -> None:
    rng = np.random.default_rng(9)
    for n, size in ((300, 10.0), (200, 400.0), (1, 1.0)):
        low = rng.random((2, n, 2)) * 500 - 100
        side = rng.exponential(size, (2, n, 2)) * (rng.random((2, n, 1)) > 0.1)
        side[0, 0] = 900.0
        a, b = np.concatenate([low, low + side], axis=2)
        iou = M._iou_matrix(a, b)
        expected = sorted(zip(*map(list, np.nonzero(iou > 0)), strict=True))
        found = sorted((int(i), int(j)) for p, q in M.near_pairs(a, b) for i, j in zip(p, q, strict=True))
        assert [x for x in found if iou[x] > 0] == expected and len(found) == len(set(found))
        rows = lambda x, kind: spark.createDataFrame([(1, k, *map(float, r)) for k, r in enumerate(x)], f"image_id long, {kind}_id long, {kind}0 double, {kind}1 double, {kind}2 double, {kind}3 double")
        pairs = M.overlapping(rows(a, "a"), rows(b, "b"), ["image_id"], ("a0", "a1", "a2", "a3"), ("b0", "b1", "b2", "b3"), 8.0).select("a_id", "b_id").collect()
        assert sorted(map(tuple, pairs)) == found


def test_suppression_in_a_crowd(spark: SparkSession) -> None:
    """By cells as by the whole matrix; and a hundred thousand boxes in one image."""
    rng = np.random.default_rng(4)
    low = rng.random((1500, 2)) * 300
    xy = np.concatenate([low, low + rng.random((1500, 2)) * 40], axis=1)
    over = M._iou_matrix(xy, xy) > 0.3
    alive = np.ones(len(xy), dtype=bool)
    for i in range(len(xy)):
        if alive[i]:
            alive[i + 1 :] &= ~over[i, i + 1 :]
    assert (M.suppressed(xy, 0.3) == alive).all() and not alive.all()
    low = rng.random((100_000, 2)) * 4000
    left = M.suppressed(np.concatenate([low, low + 20 + rng.random((100_000, 2)) * 20], axis=1), 0.5)
    assert 0 < left.sum() < 100_000
