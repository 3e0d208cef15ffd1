"""What a query does once a row, or once a group, does not come back."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pytest
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession

import __spark_entry__
from boxwise.operators import coco as C
from boxwise.operators import matching as M
from boxwise.plans.boxes_queries import sides
from boxwise.plans.model_queries import coco_tables
from boxwise.plans.views import view
from boxwise.streaming import event_time as E
from tests.comparing import rows_of


def plan(spark: SparkSession, sf_dir: str, name: str) -> str:
    return __spark_entry__.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_interval_levels_are_rows_after_the_averages(spark: SparkSession, sf_dir: str) -> None:
    text = plan(spark, sf_dir, "a20_a21_interval_coverage")
    assert text.index("Generate") < text.index("Aggregate")


def test_assignments_of_outcomes_are_found_once(spark: SparkSession, sf_dir: str) -> None:
    gt, det = sides(view(spark, sf_dir, "boxes"))
    assert plan(spark, sf_dir, "j11_false_and_missed").count("MapInArrow") == 1
    assert rows_of(M.overlap_outcomes(det, gt)) == rows_of(M.with_errors(det, gt, M.overlap_assignment(det, gt)))


def test_outcomes_of_images_with_one_side(spark: SparkSession) -> None:
    shape = "image_id long, label int, {0}_id long, {1}x0 double, {1}y0 double, {1}x1 double, {1}y1 double"
    det = spark.createDataFrame([(1, 0, 5, 0.0, 0.0, 9.0, 9.0), (None, 0, 6, 0.0, 0.0, 9.0, 9.0)], shape.format("det", "d"))
    gt = spark.createDataFrame([(2, 0, 7, 0.0, 0.0, 9.0, 9.0), (None, 0, 8, 0.0, 0.0, 9.0, 9.0)], shape.format("gt", "g"))
    found = {(r["image_id"], r["outcome"], r["det_id"], r["gt_id"]) for r in M.overlap_outcomes(det, gt).collect()}
    assert found == {(1, "false_positive", 5, None), (None, "false_positive", 6, None), (2, "missed", None, 7), (None, "missed", None, 8)}


def _groups(count: int, n: int, span: int) -> list[tuple[dict, dict]]:
    rng = np.random.default_rng(3)

    def boxes() -> dict:
        at, size = rng.integers(0, span, (n, 2)).astype(float), rng.integers(1, 40, (n, 2))
        return {"x0": at[:, 0], "y0": at[:, 1], "x1": at[:, 0] + size[:, 0], "y1": at[:, 1] + size[:, 1]}

    sides = [(boxes(), boxes()) for _ in range(count)]
    return [(d, g | {"area": (g["x1"] - g["x0"]) * (g["y1"] - g["y0"]), "iscrowd": rng.integers(0, 8, n) == 0}) for d, g in sides]


def test_groups_of_coco_are_matched_together() -> None:
    for span in (10, 200):
        groups = _groups(1000, 13, span)
        ends = np.arange(len(groups) + 1) * 13
        d, g = ({k: np.concatenate([x[s][k] for x in groups]) for k in groups[0][s]} for s in range(2))
        begin = time.perf_counter()
        taken, void = C.match_groups(d, ends, g, ends, C.THRESHOLDS, C.AREAS)
        spent = time.perf_counter() - begin
        for k, (a, b) in enumerate(groups[:50]):
            one, own_void = C.match_image(a, b, C.THRESHOLDS, C.AREAS)
            here = taken[13 * k : 13 * k + 13]
            assert (np.where(here >= 0, here - 13 * k, -1) == one).all() and (void[13 * k : 13 * k + 13] == own_void).all()
    assert spent < 0.6  # a step for each detection takes 1.4 s


def test_lines_are_dealt_to_images_once(spark: SparkSession, sf_dir: str) -> None:
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = __spark_entry__.queries()["j9_coco_match"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert text.count("FileScan") == 1 and "ReusedExchange" in text
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_rows_that_wait_are_one_value_a_batch() -> None:
    """The list of a bucket takes one value for all rows of a call, and gives them back in order."""
    kept: list = []

    class Fake:
        def __getattr__(self, name: str):  # noqa: ANN204
            return lambda *a, **k: self if name.startswith("get") and a else {"listTimers": [], "getCurrentWatermarkInMs": 1, "exists": False, "get": list(kept)}.get(name)

        def appendValue(self, value: tuple) -> None:  # noqa: N802
            kept.append(value)

        def appendList(self, values: list) -> None:  # noqa: N802
            kept.extend(values)

    made = E.InEventOrder(lambda state, row: (state, (row[1], row[2])), (), ["key", "event", "value"])
    made.init(Fake())
    frame = pd.DataFrame({"key": [1, 2, 1], "missing": [False, False, True], "us": [30, 10, 20], "event": [3, 1, 2], "value": [0.3, 0.1, 0.2]})
    list(made.handleInputRows((0,), iter([frame, frame[:0]]), None))
    assert len(kept) == 1
    (out,) = made.handleExpiredTimer((0,), Fake(), None)
    assert out["event"].tolist() == [1, 2, 3] and out["key"].isna().tolist() == [False, True, False]


def test_masks_move_once_and_not_once_a_pair(spark: SparkSession, sf_dir: str) -> None:
    assert "ArrowEvalPython" not in plan(spark, sf_dir, "j9_mask_overlap").split("MapInArrow")[0]


def test_detections_of_a_summary_are_matched_once_and_truth_counted_once(spark: SparkSession, sf_dir: str) -> None:
    det, gt = coco_tables(spark, sf_dir)
    matched, counted = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def watched(rows: DataFrame, seen: Accumulator) -> DataFrame:
        def run(batches):  # noqa: ANN001, ANN202
            for batch in batches:
                seen.add(len(batch))
                yield batch

        return rows.mapInArrow(run, rows.schema)

    npos = C.positives(gt)
    cube = C.accumulate(watched(C.match_packed(det, gt), matched), watched(npos, counted))
    assert cube.where("ap > 0").count() and cube.count()
    assert matched.value == det.count()
    assert counted.value == npos.count()


def test_precisions_at_hits_equal_a_loop() -> None:
    rng = np.random.default_rng(4)
    rank, counted = rng.integers(1, 6, 300), rng.random((3, 300)) < 0.8
    hit = counted & (rng.random((3, 300)) < [[0.3], [1.0], [0.0]])
    n, tp = rng.integers(5, 9, 6), rng.integers(0, 5, 6)
    got = C.hit_precisions(rank, counted, hit, [2, 5], n, tp)
    for w, (m, cell) in enumerate((m, cell) for m in (2, 5) for cell in range(3)):
        some, taken, expected = n[w], tp[w], []
        for k in np.flatnonzero((rank <= m) & counted[cell]):
            some, taken = some + 1, taken + hit[cell, k]
            expected += [taken / some] * int(hit[cell, k])
        assert got[w].tolist() == expected


def test_assignments_of_many_images_are_found_together(monkeypatch: pytest.MonkeyPatch) -> None:
    rng = np.random.default_rng(5)
    n, m = rng.integers(0, 12, (2, 300))
    d_ends, g_ends = (np.concatenate([[0], np.cumsum(x)]) for x in (n, m))
    # Some of these costs are equal.
    table = rng.integers(0, 40, (int(n.sum()), int(m.sum()))).astype(float)

    def costs(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return table[i[..., :, None], j[..., None, :]]

    def one_by_one() -> list[tuple[int, int]]:
        found = []
        for k in np.flatnonzero((n > 0) & (m > 0)).tolist():
            i, j = M.assign(table[d_ends[k] : d_ends[k + 1], g_ends[k] : g_ends[k + 1]])
            found += zip((i + d_ends[k]).tolist(), (j + g_ends[k]).tolist(), strict=True)
        return found

    def together() -> list[tuple[int, int]]:
        i, j = M.assign_groups(d_ends, g_ends, costs, lambda own, other: M.assign(table[own, other]))
        return list(zip(i.tolist(), j.tolist(), strict=True))

    expected = one_by_one()
    with monkeypatch.context() as patch:
        patch.setattr(M, "COSTS", 500)
        patch.setattr(M, "assign_rows", None)  # no group is assigned alone
        assert together() == expected
    with monkeypatch.context() as patch:
        patch.setattr(M, "DENSE", 60)
        assert together() == expected
    table[::9] = np.nan
    assert together() == one_by_one()
