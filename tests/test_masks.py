"""Run-length masks against plain pixels."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from boxwise.functions import masks as K
from boxwise.sources import coco


def plain_runs(mask: np.ndarray) -> list[int]:
    runs, value = [0], False
    for v in mask.ravel(order="F"):
        if v != value:
            runs.append(0)
            value = v
        runs[-1] += 1
    return runs


def test_masks_equal_pixels(spark: SparkSession) -> None:
    rng = np.random.default_rng(3)
    rows = []
    for k in range(300):
        h, w = int(rng.integers(1, 9)), int(rng.integers(1, 9))
        a, b = ((rng.random((h, w)) < rng.choice([0.0, 0.1, 0.5, 1.0])).astype(float) for _ in range(2))
        rows.append((k, h, w, a.tolist(), b.tolist()))
    rows.append((300, 200, 300, np.kron(rng.random((2, 3)) > 0.5, np.ones((100, 100))).astype(float).tolist(), np.eye(200, 300).tolist()))
    df = spark.createDataFrame(rows, "id long, h int, w int, a array<array<double>>, b array<array<double>>").repartition(3)
    r = df.select("*", K.encode("a").alias("ra"), K.encode("b").alias("rb"))
    found = r.select("id", "h", "w", "a", "b", "ra", "rb", K.area("ra").alias("area"), K.box("ra", F.col("h")).alias("box"), K.shared("ra", "rb").alias("both"), K.iou("ra", "rb").alias("iou"), K.iou("ra", "rb", F.col("id") % 2 == 0).alias("crowd"), K.decode("ra", F.col("h")).alias("back"), K.from_text(K.to_text("ra")).alias("again")).collect()
    assert len(found) == 301
    for x in found:
        a, b = np.array(x["a"]) > 0.5, np.array(x["b"]) > 0.5
        assert x["ra"] == x["again"] == plain_runs(a)
        assert x["back"] == a.astype(int).tolist()
        assert x["area"] == a.sum() and x["both"] == (a & b).sum()
        i, j = np.nonzero(a)
        assert (None if x["box"] is None else tuple(x["box"])) == ((j.min(), i.min(), j.max(), i.max()) if len(i) else None)
        whole = (a | b).sum()
        assert abs(x["iou"] - ((a & b).sum() / whole if whole else 0)) < 1e-12
        over = a.sum() if x["id"] % 2 == 0 else whole
        assert abs(x["crowd"] - ((a & b).sum() / over if over else 0)) < 1e-12


def test_texts_of_runs(spark: SparkSession) -> None:
    """Texts of the public format, written down by hand: 5 bits a character from '0' on, the sixth for more to come, differences from the fourth run on."""
    rows = [([0, 1], "01"), ([6, 1, 40, 4, 5, 4, 5, 4, 21], "61X13mN000`0"), ([100_000], None), ([5, 3, 5, 1], None), ([], ""), (None, None)]
    df = spark.createDataFrame([(r,) for r, _ in rows], "r array<int>")
    for (runs, text), x in zip(rows, df.select("r", K.to_text("r").alias("t"), K.from_text(K.to_text("r")).alias("b")).collect(), strict=True):
        assert x["b"] == runs
        assert text is None or x["t"] == text


def test_odd_masks(spark: SparkSession) -> None:
    df = spark.createDataFrame([(None, 3), ([6], 3), ([0, 6], 3), ([], 3)], "r array<int>, h int")
    out = df.select(K.area("r"), K.box("r", F.col("h")), K.shared("r", F.array(F.lit(0), F.lit(6)).cast("array<int>"))).collect()
    assert [x[0] for x in out] == [0, 0, 6, 0] and [x[2] for x in out] == [0, 0, 6, 0]
    assert [x[1] and tuple(x[1]) for x in out] == [None, None, (0, 0, 1, 2), None]


def test_predictions_flatten(spark: SparkSession) -> None:
    schema = "image_id long, masks array<array<array<double>>>, keypoints array<array<array<double>>>, labels array<int>, scores array<double>"
    df = spark.createDataFrame([(1, [[[0.4, 0.6]], [[0.9, 0.5]]], [[[1.0, 2.0, 2.0], [3.0, 4.0, 0.0]], [[5.0, 6.0, 1.0]]], [3, 4], [0.5, 0.25]), (2, [], [], [], [])], schema)
    m = coco.flattened_masks(df).collect()
    assert [(r["image_id"], r["category_id"], r["height"], r["width"], r["counts"], r["score"]) for r in m] == [(1, 3, 1, 2, [1, 1], 0.5), (1, 4, 1, 2, [0, 1, 1], 0.25)]
    k = coco.flattened_keypoints(df).collect()
    assert [(r["category_id"], r["keypoints"]) for r in k] == [(3, [1.0, 2.0, 2.0, 3.0, 4.0, 0.0]), (4, [5.0, 6.0, 1.0])]


def test_many_small_masks_take_no_step_each(spark: SparkSession) -> None:
    """100,000 masks of 7 x 8 pixels to runs, to texts and back: a Python step for each run or mask would take much longer. Sliced and odd arrays give the same."""
    rng = np.random.default_rng(5)
    bits = rng.random((100_000, 7, 8)) < 0.4
    rows = pa.ListArray.from_arrays(pa.array(np.arange(0, bits.size + 1, 8, dtype=np.int32)), pa.array(bits.astype(float).ravel()))
    pixels = pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) + 1, 7, dtype=np.int32)), rows)
    began = time.process_time()
    runs = K._encode.func(pixels, pa.array(np.full(len(bits), 0.5)))
    texts = K._text.func(runs)
    back = K._from_text.func(texts)
    assert time.process_time() - began < 3
    assert back.equals(runs)
    assert all(runs[k].as_py() == plain_runs(bits[k]) for k in range(0, 100_000, 997))
    part = K._encode.func(pixels.slice(50, 20), pa.array(np.full(20, 0.5)))
    assert part.to_pylist() == runs.slice(50, 20).to_pylist() == K._from_text.func(K._text.func(runs.slice(50, 20))).to_pylist()
    odd = pa.array([None, [], [[]], [[1.0]], [[0.0, None, 1.0]]], pa.list_(pa.list_(pa.float64())))
    assert K._encode.func(odd, pa.array([0.5] * 5)).to_pylist() == [None, [0], [0], [0, 1], [2, 1]]
