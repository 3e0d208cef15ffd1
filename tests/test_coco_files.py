"""Ranges of large annotation files against a plain parser, and writing that leaves no half file."""

from __future__ import annotations

import json
import random
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from boxwise.sources import coco, coco_files


def document(rng: random.Random, n: int) -> dict:
    odd = ["plain.jpg", 'a"b\\', "{[}]", '\\"', "images\":[{", "é\\\\", "x" * 50, ""]
    images = [{"id": k, "file_name": rng.choice(odd), "width": 10, "height": 20, "extra": {"annotations": [{"id": -1}], "s": rng.choice(odd)}} for k in range(n)]
    boxes = [{"id": k, "image_id": rng.randrange(n), "category_id": k % 3, "bbox": [1, 2.5, 3, 4], "area": 12, "segmentation": [[1.5, 2, 3]] if k % 2 else {"counts": rng.choice(odd), "size": [1, 2]}, "iscrowd": k % 2} for k in range(2 * n)]
    return {"info": {"version": "1", "images": [{"id": -5}], "categories": {"id": 9}}, "licenses": [{"id": 1, "name": "n"}], "images": images, "other" : [{"id": -7, "name": "o"}] * 9, "annotations": boxes, "categories": [{"id": k, "name": rng.choice(odd), "supercategory": "s"} for k in range(3)]}


@pytest.mark.parametrize(("indent", "size"), [(None, 97), (2, 300), (None, 1 << 20), (1, 7)])
def test_ranges_equal_a_plain_parser(spark: SparkSession, tmp_path: Path, indent: int | None, size: int) -> None:
    doc = document(random.Random(size), 3 if size == 7 else 40)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=size == 97))
    (tmp_path / "in" / "b.json").write_text('{"categories":[{"id":7,"name":"z"}],"images":[]}')
    (tmp_path / "in" / ".hidden").write_text("{")
    (tmp_path / "in" / "c.json").write_text("")
    every = coco_files.ranges(spark, str(tmp_path / "in"), size)
    for section in coco_files.SECTIONS:
        names = [c.split(" ")[0] for c in coco_files.SECTIONS[section].split(", ")]
        expected = [tuple(o.get(n) for n in names) for o in doc[section]] + ([(7, "z")] if section == "categories" else [])
        found = [tuple(o.get(n) for n in names) for r in every for o in coco_files.objects(r, section)]
        assert sorted(found, key=repr) == sorted(expected, key=repr)
    if size > 97:
        got = coco_files.read_sections(spark, str(tmp_path / "in"), size)
        rows = sorted((tuple(r) for r in got["annotations"].collect()), key=repr)
        assert rows == sorted(((o["id"], o["image_id"], o["category_id"], [float(x) for x in o["bbox"]], 12.0, o["iscrowd"], None) for o in doc["annotations"]), key=repr)
        assert got["images"].count() == 40 and got["categories"].count() == 4


def test_documents_round_trip(spark: SparkSession, tmp_path: Path) -> None:
    images = spark.range(50).select(F.col("id").alias("image_id"), F.format_string('i"%d', "id").alias("file_name"), F.lit(100).alias("width"), F.lit(100).alias("height"))
    boxes = spark.range(500).select((F.col("id") % 40).alias("image_id"), F.col("id").alias("box_id"), (F.col("id") % 7).cast("int").alias("label"), F.lit(1.0).alias("x0"), F.lit(2.0).alias("y0"), (F.col("id") % 9 + 2.5).alias("x1"), F.lit(5.0).alias("y1"))
    out = str(tmp_path / "out")
    coco.write_documents(images, boxes, out, 3)
    names = sorted(p.name for p in Path(out).iterdir())
    assert names[-1] == "part-00001.json" or len(names) <= 4
    assert "_SUCCESS" in names and not [n for n in names if n.startswith(".")]
    docs = [json.loads(p.read_text()) for p in Path(out).glob("part-*.json")]
    assert sorted(i["id"] for d in docs for i in d["images"]) == list(range(50))
    assert sorted(a["id"] for d in docs for a in d["annotations"]) == list(range(1, 501))
    assert all(sorted(c["id"] for c in d["categories"]) == list(range(7)) for d in docs)
    for d in docs:
        assert {a["image_id"] for a in d["annotations"]} <= {i["id"] for i in d["images"]}
    back = coco.read_ranges(spark, out, 1000)
    assert sorted(map(tuple, back.boxes().select("image_id", "x1", "category_id").collect())) == sorted((r["image_id"], r["x1"], r["label"]) for r in boxes.collect())
    with pytest.raises(FileExistsError):
        coco.write_documents(images, boxes, out, 3)


def test_a_failed_task_leaves_no_file(spark: SparkSession, tmp_path: Path) -> None:
    broken = spark.range(100).select("id", F.when(F.col("id") == 70, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")).cast("string").alias("file_name"))
    spark.sparkContext.setLogLevel("OFF")
    with pytest.raises(Exception, match="broken"):
        coco_files.write_sections({"images": broken}, {"images": "id"}, str(tmp_path / "out"), 4)
    spark.sparkContext.setLogLevel("ERROR")
    assert list((tmp_path / "out").iterdir()) == []


def test_every_shard_is_a_file_and_is_read_whole(spark: SparkSession, tmp_path: Path) -> None:
    """Rows of many partitions: two shards must not meet in one file."""
    images = spark.range(0, 400, 1, 8).select(F.col("id").alias("image_id"), F.lit("i").alias("file_name"), F.lit(100).alias("width"), F.lit(100).alias("height"))
    boxes = spark.range(0, 4000, 1, 8).select((F.col("id") % 400).alias("image_id"), F.col("id").alias("box_id"), (F.col("id") % 3).cast("int").alias("label"), F.lit(1.0).alias("x0"), F.lit(2.0).alias("y0"), F.lit(9.5).alias("x1"), F.lit(5.0).alias("y1"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small partitions are not put together, as large ones are not
    try:
        for _ in range(2):
            coco.write(images, boxes, str(tmp_path / "out"), 7)
        assert len(list((tmp_path / "out").glob("*.json"))) == 7
        back = coco.read(spark, str(tmp_path / "out"))
        assert back.boxes().count() == 4000 and back.images_with_boxes().count() == 400
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_a_task_is_not_sent_the_other_ranges() -> None:
    every = [{"path": "p" * 50, "first": k, "last": k + 1, "size": 10_000, "state": 0, "depth": 1, "section": "images", "ends": "images"} for k in range(10_000)]
    reader = coco_files._Reader("images", every, StructType())
    assert len(reader.partitions()) == 10_000
    assert len(cloudpickle.dumps(reader)) < 10_000
