"""Files that others wrote, whole pipelines against plain loops, and streams against batches."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import __spark_entry__
from boxwise.operators import populations as P
from boxwise.operators import statistics as T
from boxwise.plans import pipeline_queries as Q
from boxwise.plans import stream_queries as V
from boxwise.plans.model_queries import layer_weights
from boxwise.plans.views import view
from boxwise.sources import coco, reports, voc
from boxwise.streaming import event_time as E
from boxwise.streaming import meters
from tests.comparing import rows_of, sql_rows
from tests.test_matching import kruskal


def test_coco_of_another_writer(spark: SparkSession, tmp_path: Path) -> None:
    """A missing iscrowd, boxes past the image, boxes without area, images without annotations."""
    doc = {
        "info": {"year": 2017},
        "images": [{"id": 7, "file_name": "a.jpg", "width": 100, "height": 50}, {"id": 9, "file_name": "b.jpg", "width": 10, "height": 10}],
        "annotations": [
            {"id": 1, "image_id": 7, "category_id": 18, "bbox": [10, 10, 200, 20], "area": 4000, "iscrowd": 0},
            {"id": 2, "image_id": 7, "category_id": 3, "bbox": [5, 5, 0, 5], "area": 0},
            {"id": 3, "image_id": 7, "category_id": 3, "bbox": [1, 2, 3, 4], "area": 12, "iscrowd": 1},
            {"id": 4, "image_id": 7, "category_id": 3, "bbox": [1, 2, 3, 4], "area": 12, "segmentation": [[1, 2]]},
        ],
        "categories": [{"id": 3, "name": "car", "supercategory": "v"}, {"id": 18, "name": "dog"}, {"id": 20, "name": "none"}],
    }
    (tmp_path / "ann.json").write_text(json.dumps(doc, indent=1))
    c = coco.read(spark, str(tmp_path / "ann.json"))
    rows = sorted((r["ann_id"], r["label"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in c.without_crowds().boxes().collect())
    assert rows == [(1, 1, 10, 10, 100, 30), (4, 0, 1, 2, 4, 6)]
    assert sorted((r["ann_id"], r["label"]) for r in c.boxes(remap=False).collect()) == [(1, 18), (3, 3), (4, 3)]
    assert sorted((r["image_id"], len(r["boxes"])) for r in c.images_with_boxes().collect()) == [(7, 4), (9, 0)]


def test_coco_shards_are_whole_documents(spark: SparkSession, sf_dir: str, tmp_path: Path) -> None:
    images, boxes = Q._ground_truth(spark, sf_dir)
    coco.write(images, boxes, str(tmp_path / "out"), 3)
    docs = [json.loads(line) for p in (tmp_path / "out").glob("*.json") for line in p.read_text().splitlines()]
    assert len(docs) == 3 and len({json.dumps(d["categories"]) for d in docs}) == 1
    for d in docs:
        assert {a["image_id"] for a in d["annotations"]} <= {i["id"] for i in d["images"]}
    assert sorted(a["id"] for d in docs for a in d["annotations"]) == list(range(1, boxes.count() + 1))


def test_voc_corners_are_read_by_name(spark: SparkSession, tmp_path: Path) -> None:
    (tmp_path / "a.xml").write_text("<annotation><folder>f</folder><filename>a.jpg</filename><object><bndbox><ymax>9</ymax><xmin>1</xmin><xmax>5</xmax><ymin>2</ymin></bndbox><name>dog</name></object><object><name>yak</name><bndbox><xmin>0</xmin><ymin>0</ymin><xmax>1</xmax><ymax>1</ymax></bndbox></object></annotation>")
    (tmp_path / "b.xml").write_text("<annotation><filename>b.jpg</filename></annotation>")
    rows = voc.read(spark, str(tmp_path / "*.xml"), ["cat", "dog"]).collect()
    assert sorted((tuple(r) for r in rows), key=repr) == [("a.jpg", 0, 1, 1.0, 2.0, 5.0, 9.0), ("a.jpg", 1, None, 0.0, 0.0, 1.0, 1.0)]
    (tmp_path / "train.txt").write_text("img/a.jpg xml/a.xml\n\nimg/b.jpg  xml/b.xml\n")
    assert sorted(map(tuple, voc.read_split(spark, str(tmp_path / "train.txt")).collect())) == [("img/a.jpg", "xml/a.xml"), ("img/b.jpg", "xml/b.xml")]


def test_reports_have_blanks_and_no_nan(spark: SparkSession, tmp_path: Path) -> None:
    df = spark.createDataFrame([("a", 1, 0.5, float("nan")), ("", 2, -1.23456, None), ("c", 3, float("inf"), 2.0)], "name string, n int, x double, y double")
    reports.write_metrics_csv(df.coalesce(1), str(tmp_path / "csv"))
    assert next((tmp_path / "csv").glob("*.csv")).read_text().splitlines() == ["name,n,x,y", "a,1,0.5000,", ",2,-1.2346,", "c,3,,2.0000"]
    assert sorted(map(tuple, reports.read_metrics_csv(spark, str(tmp_path / "csv"), "name string, n int, x double, y double").collect())) == [("", 2, -1.2346, None), ("a", 1, 0.5, None), ("c", 3, None, 2.0)]
    assert [json.loads(r["json"]) for r in reports.to_json(df, ["name"]).orderBy("n").collect()] == [{"n": 1, "x": 0.5, "y": None}, {"n": 2, "x": -1.23456, "y": None}, {"n": 3, "x": None, "y": 2.0}]


@pytest.fixture(scope="module")
def model(spark: SparkSession, sf_dir: str) -> tuple[dict, dict, dict]:
    """Outputs by (image, query), ground truth by image, and diagrams by (image, query, layer), all plain."""
    outputs, gt, acts = Q._model_outputs(spark, sf_dir)
    weights = layer_weights()
    trees = {(r["image_id"], r["query_idx"], r["layer"]): np.array(kruskal(np.array(r["x"], dtype=float), weights[r["layer"]])) for r in acts.where("image_id < 8").collect()}
    by_image: dict[int, list] = {}
    for r in gt.collect():
        by_image.setdefault(r["image_id"], []).append(r)
    return {(r["image_id"], r["query_idx"]): r for r in outputs.collect()}, by_image, trees


def test_uncertainty_head(spark: SparkSession, sf_dir: str, model) -> None:  # noqa: ANN001
    """U4 and U6 on eight images: the best cells, the score and reference filters, mean diagrams, mean distances."""
    outputs, _, trees = model
    frames = [f.where("image_id < 8") for f in Q._model_outputs(spark, sf_dir)]
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def best(image: int, k: int) -> list[tuple[float, int, int]]:
        cells = [(-v, q, c) for (i, q), r in outputs.items() if i == image for c, v in enumerate(r["logits"])]
        return sorted(cells)[:k]

    sums: dict[tuple, list] = {}
    for image in range(4):
        for s, q, c in best(image, 10):
            if sigmoid(-s) >= 0.5:
                for layer in layer_weights():
                    sums.setdefault((c, layer), []).append(trees[image, q, layer])
    means = {k: np.mean(v, axis=0) for k, v in sums.items()}
    got = P.class_means(frames[0].where("image_id < 4"), frames[2], layer_weights(), 10, 0.5)
    found = {(r["class_id"], r["layer"]): r for r in got.collect()}
    assert found.keys() == means.keys()
    assert all(found[k]["m"] == pytest.approx(means[k], abs=1e-9) and found[k]["n"] == len(sums[k]) for k in means)
    expected = {}
    for image in range(4, 8):
        for s, q, c in best(image, 20):
            if sigmoid(-s) > 0.3 and (c, "linear0") in means:
                expected[image, q, c] = (sigmoid(-s), np.mean([np.sqrt(np.mean((trees[image, q, layer] - means[c, layer]) ** 2)) for layer in layer_weights()]))
    rows = P.scored_detections(frames[0].where("image_id >= 4"), frames[2], layer_weights(), got, 20, 0.3).collect()
    assert {(r["image_id"], r["query_idx"], r["label"]): (pytest.approx(r["score"]), pytest.approx(r["tu"])) for r in rows} == expected


def test_matched_means_and_distances(spark: SparkSession, sf_dir: str, model) -> None:  # noqa: ANN001
    """Matched and correct queries only."""
    outputs, gt, trees = model
    frames = [f.where("image_id < 8") for f in Q._model_outputs(spark, sf_dir)]
    q = {(r["image_id"], r["query_idx"]): (r["predicted"], r["target"]) for r in P.predictions(frames[0], frames[1]).collect()}
    for i in range(8):
        assert sorted(t for (image, _), (_, t) in q.items() if image == i and t >= 0) == sorted(r["label"] for r in gt.get(i, []))
    assert all(p == int(np.argmax(outputs[k]["logits"])) for k, (p, _) in q.items())
    sums: dict[tuple, list] = {}
    for (image, query), (p, t) in q.items():
        if p == t and p != 9:
            for layer in layer_weights():
                sums.setdefault((p, layer), []).append(trees[image, query, layer])
    allowed = list(range(9))
    means = P.matched_means(*frames, layer_weights(), allowed)
    found = {(r["class_id"], r["layer"]): r["m"] for r in means.collect()}
    assert found.keys() == sums.keys() and all(found[k] == pytest.approx(np.mean(v, axis=0), abs=1e-9) for k, v in sums.items())
    queries = P.predictions(frames[0], frames[1])
    for which in ("correct", "predicted"):
        rows = P.conformal_distances(queries, frames[2], layer_weights(), means, which).collect()
        expected = {(*k, p, layer): np.sqrt(np.mean((trees[*k, layer] - found[p, layer]) ** 2)) for k, (p, t) in q.items() for layer in layer_weights() if (p, layer) in found and (which == "predicted" or p == t)}
        assert {(r["image_id"], r["query_idx"], r["class_id"], r["layer"]): pytest.approx(r["distance"], abs=1e-9) for r in rows} == expected


def test_classification_means(spark: SparkSession) -> None:
    """Two of three images are classified correctly and confidently; the third drops out."""
    images = spark.createDataFrame([(0, [5.0, 0.0], 0), (1, [0.0, 5.0], 1), (2, [0.0, 5.0], 0)], "image_id long, logits array<double>, label int")
    acts = spark.createDataFrame([(0, "linear", [1.0, 0.0]), (1, "linear", [0.0, 1.0]), (2, "linear", [0.0, 1.0])], "image_id long, layer string, x array<double>")
    rows = P.image_class_means(images, acts, {"linear": 5 * np.eye(2)}, 0.9).collect()
    assert sorted((r["label"], r["n"], r["m"]) for r in rows) == [(0, 1, [5, 0, 0]), (1, 1, [5, 0, 0])]


def streamed(spark: SparkSession, meter: DataFrame, folder: Path) -> DataFrame:
    """meter as a stream of five files, in the order of the events, a file a batch."""
    for k in range(5):
        meter.where(f"event_id % 1000 div 200 = {k}").coalesce(1).write.mode("append").json(str(folder / "in"))
    return spark.readStream.schema("user_id long, event_id long, value double").option("maxFilesPerTrigger", 1).json(str(folder / "in"))


@pytest.fixture(scope="module")
def meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thousand events, whose ids follow their times."""
    return view(spark, sf_dir, "meter").where("event_id < 1000").select("user_id", "event_id", "value").cache()


def drained(spark: SparkSession, df: DataFrame, mode: str, name: str, folder: Path) -> DataFrame:
    df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(folder / name)).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def test_rolling_meter_stream(spark: SparkSession, meter: DataFrame, tmp_path: Path) -> None:
    got = drained(spark, meters.rolling(streamed(spark, meter, tmp_path), "user_id", "event_id", "value"), "append", "rolling", tmp_path)
    expected = T.rolling(meter, ["user_id"], [F.asc("event_id")], "value")
    names = ["median", "avg", "max", "value_now", "global_avg"]
    plain = lambda df, key, event: {(r[key], r[event]): [pytest.approx(r[c]) for c in names] for r in df.collect()}
    assert got.count() == 1000
    assert {k: [x.expected for x in v] for k, v in plain(got, "key", "event").items()} == plain(expected, "user_id", "event_id")


def test_accumulating_stream(spark: SparkSession, meter: DataFrame, tmp_path: Path) -> None:
    """Partials of all batches, one of them written twice, merge to the mean of the whole."""
    stream = streamed(spark, meter, tmp_path)
    out = str(tmp_path / "partials")
    add = meters.merge_into(out, ["user_id"])

    def each(batch: DataFrame, number: int) -> None:
        partial = batch.groupBy("user_id").agg(F.sum("value").alias("total"), F.count("value").alias("n"))
        add(partial, number)
        add(partial, number)

    stream.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    expected = {r["user_id"]: (r["n"], pytest.approx(r["m"])) for r in meter.groupBy("user_id").agg(F.count("value").alias("n"), F.avg("value").alias("m")).collect()}
    assert {r["user_id"]: (r["n"], r["mean"]) for r in meters.finished(spark.read.parquet(out), ["user_id"]).collect()} == expected
    running = drained(spark, meters.accumulated(stream, ["user_id"], "value"), "complete", "running", tmp_path)
    assert {r["user_id"]: (r["n"], r["total"] / r["n"]) for r in running.collect()} == expected


def test_ema_stream_goes_on_after_a_restart(spark: SparkSession, meter: DataFrame, tmp_path: Path) -> None:
    source = streamed(spark, meter, tmp_path)
    out, place = str(tmp_path / "out"), str(tmp_path / "c")

    def run() -> None:
        write = lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)
        meters.ema(source, "user_id", "event_id", "value", 0.99, 10.0).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()

    run()
    more = meter.withColumn("event_id", F.col("event_id") + 1000).withColumn("value", F.col("value") + 1)
    more.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    run()
    last = spark.read.parquet(out).groupBy("key").agg(F.max_by(F.struct("n", "ema"), "batch").alias("s"))
    expected = T.ema(meter.unionByName(more), ["user_id"], ["event_id"], "value", 0.99, 10.0)
    assert {r["key"]: (r["s"]["n"], pytest.approx(r["s"]["ema"])) for r in last.collect()} == {r["user_id"]: (r["n"], r["ema"]) for r in expected.collect()}


def test_voc_files_do_not_grow_with_the_table(spark: SparkSession, tmp_path: Path) -> None:
    boxes = spark.range(25_000).select(F.col("id").cast("string").alias("file_name"), F.lit(0).alias("label"), *(F.lit(float(k)).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))))
    voc.write(boxes.coalesce(1), str(tmp_path / "voc"), ["cat"])
    assert len(list((tmp_path / "voc").glob("*.xml*"))) >= 3
    assert voc.read(spark, str(tmp_path / "voc"), ["cat"]).select("file_name").distinct().count() == 25_000


def test_boxes_without_a_width_are_counted_and_add_nothing(spark: SparkSession, sf_dir: str, tmp_path: Path) -> None:
    """Lines without a quantity have boxes without x; the sum of an image is of the others, as in SQL."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("l_quantity", F.when(F.col("l_partkey") % 5 > 0, F.col("l_quantity")))
    lines.coalesce(1).write.parquet(str(tmp_path / "lines"))
    next((tmp_path / "lines").glob("*.parquet")).rename(tmp_path / "lineitem.parquet")
    names, expected = sql_rows(str(tmp_path), __spark_entry__.oracle_sql()["s2_s3_coco_images"])
    found = Q.s2_s3_coco_images(spark, str(tmp_path))
    assert sorted(found.columns) == names and rows_of(found) == expected


def test_a_span_of_events_is_several_files(spark: SparkSession, sf_dir: str, tmp_path: Path, monkeypatch: pytest.MonkeyPatch) -> None:
    """A file holds so many rows, not a share of the table, and a batch takes a span's files."""
    monkeypatch.setattr(V, "FILE", 50)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(8).write.parquet(str(tmp_path / "events.parquet"))
    stream, n = V.out_of_order(spark, str(tmp_path), str(tmp_path)), events.count()
    sizes = [spark.read.parquet(str(f)).count() for f in (tmp_path / "in").glob("*.parquet")]
    assert sum(sizes) == n + 1 and max(sizes) < n / 12
    query = E.drain(E.rolling(stream, "user_id", "ts", "event_id", "value", V.DELAY), str(tmp_path / "out"), str(tmp_path / "state"))
    assert E.late_rows(query) == 0
    assert spark.read.parquet(str(tmp_path / "out")).where("key is not null").count() == n
