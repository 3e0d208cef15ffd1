"""Annotation files in the COCO layout, as tables and back.

Files may have any size: the data source in coco_files reads them by ranges of bytes and writes
them object by object, a file to each document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxwise.functions import boxes as B
from boxwise.functions import masks as K
from boxwise.operators import ranking as R
from boxwise.sources import coco_files


@dataclass(frozen=True)
class Coco:
    """images (image_id, file_name, width, height), annotations (ann_id, image_id, category_id, x, y, w, h, area, iscrowd, keypoints) and categories (category_id, name)."""

    images: DataFrame
    annotations: DataFrame
    categories: DataFrame

    def without_crowds(self) -> Coco:
        """A missing iscrowd counts as 0."""
        return Coco(self.images, self.annotations.where("coalesce(iscrowd, 0) = 0"), self.categories)

    def labels(self) -> DataFrame:
        """category_id, name and label: contiguous numbers from 0 in the order of the ids."""
        return self.categories.withColumn("label", (F.row_number().over(Window.orderBy("category_id")) - 1).cast("int"))  # a row for each category

    def boxes(self, remap: bool = True) -> DataFrame:
        """The annotations with corners, clipped to their image, without those that have no area left (S1, P2, P3), and with the label, or the category_id as it."""
        a = self.annotations.join(self.images.select("image_id", "width", "height"), "image_id")
        corners = B.clip_to_image(B.xywh_to_xyxy(B.columns("x", "y", "w", "h")), F.col("width"), F.col("height"))
        a = a.select("image_id", "ann_id", "category_id", "area", "iscrowd", *(c.alias(n) for c, n in zip(corners, ("x0", "y0", "x1", "y1"), strict=True))).where(B.is_valid(B.columns("x0", "y0", "x1", "y1")))
        if remap:
            return a.join(self.labels().select("category_id", "label"), "category_id")
        return a.withColumn("label", F.col("category_id"))

    def images_with_boxes(self) -> DataFrame:
        """Every image, those without annotations too, with its boxes as an array by ann_id."""
        own = self.annotations.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("ann_id", "category_id", "x", "y", "w", "h"))).alias("boxes"))
        return self.images.join(own, "image_id", "left").withColumn("boxes", F.coalesce("boxes", F.expr("cast(array() as array<struct<ann_id:bigint,category_id:int,x:double,y:double,w:double,h:double>>)")))


def read(spark: SparkSession, path: str) -> Coco:
    """The tables of one file or of all files of a folder. Categories that several files name are taken once."""
    return read_ranges(spark, path)


def _tables(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> Coco:
    a = annotations.select(F.col("id").alias("ann_id"), "image_id", "category_id", *(F.get("bbox", F.lit(k)).alias(n) for k, n in enumerate("xywh")), "area", "iscrowd", "keypoints")
    return Coco(images.select(F.col("id").alias("image_id"), "file_name", "width", "height"), a, categories.distinct().withColumnRenamed("id", "category_id"))


def read_ranges(spark: SparkSession, path: str, range_bytes: int = coco_files.RANGE) -> Coco:
    """read() with a task for every range_bytes of a file."""
    sections = coco_files.read_sections(spark, path, range_bytes)
    return _tables(*(sections[s] for s in coco_files.SECTIONS))


def _numbered(boxes: DataFrame) -> DataFrame:
    """image_id and annotation a of boxes (image_id, box_id, label, x0, y0, x1, y1), numbered from 1 in the order (image_id, box_id)."""
    per_image = boxes.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).withColumn("_all", F.lit(0))
    before = R.running(per_image, ["_all"], "image_id", ["n"]).select("image_id", (F.col("cum_n") - F.col("n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("box_id"))
    x, y, w, h = B.xyxy_to_xywh(B.columns("x0", "y0", "x1", "y1"))
    return boxes.join(before, "image_id").select("image_id", F.struct((F.col("_before") + place).alias("id"), "image_id", F.col("label").alias("category_id"), F.array(*(c.cast("double") for c in (x, y, w, h))).alias("bbox"), (w * h).alias("area"), F.lit(0).alias("iscrowd")).alias("a"))


def write_documents(images: DataFrame, boxes: DataFrame, path: str, documents: int | None = None) -> None:
    """write() to a new folder, object by object; documents: None for one for each coco_files.DOCUMENT boxes."""
    documents = documents or -(-boxes.count() // coco_files.DOCUMENT) or 1
    sections = {
        "images": images.select(F.col("image_id").alias("id"), "file_name", "width", "height"),
        "annotations": _numbered(boxes).select("a.*"),
        "categories": boxes.select(F.col("label").alias("id"), F.col("label").cast("string").alias("name")).distinct(),
    }
    coco_files.write_sections(sections, {"images": "id", "annotations": "image_id"}, path, documents)


def write(images: DataFrame, boxes: DataFrame, path: str, shards: int = 1) -> None:
    """write_documents(), instead of what path holds (S6): images (image_id, file_name, width, height) and boxes (image_id, box_id, label, x0, y0, x1, y1) as `shards` documents, a file each.

    Annotations are numbered from 1 over all shards, in the order (image_id, box_id);
    categories are the distinct labels.
    """
    coco_files.remove(path)
    write_documents(images, boxes, path, shards)


def flattened(predictions: DataFrame) -> DataFrame:
    """One row (image_id, category_id, x, y, w, h, score) for each box of predictions (image_id, boxes, labels, scores), whose arrays go together; empty predictions have none."""
    each = predictions.select("image_id", F.inline(F.arrays_zip("boxes", "labels", "scores")))
    corner = [F.get("boxes", F.lit(k)) for k in range(4)]
    return each.select("image_id", F.col("labels").alias("category_id"), *(c.alias(n) for c, n in zip(B.xyxy_to_xywh(tuple(corner)), "xywh", strict=True)), F.col("scores").alias("score"))


def flattened_masks(predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row (image_id, category_id, height, width, counts, segmentation, score) for each mask of predictions (image_id, masks, labels, scores).

    masks: arrays of rows of numbers, set where they are more than the threshold; counts
    are their runs, and segmentation the compressed text of these. Empty predictions have no rows.
    """
    each = predictions.select("image_id", F.inline(F.arrays_zip("masks", "labels", "scores")))
    sized = each.select("image_id", F.col("labels").alias("category_id"), F.size("masks").alias("height"), F.size(F.get("masks", F.lit(0))).alias("width"), K.encode(F.col("masks"), threshold).alias("counts"), F.col("scores").alias("score"))
    return sized.select("image_id", "category_id", "height", "width", "counts", K.to_text(F.col("counts")).alias("segmentation"), "score")


def flattened_keypoints(predictions: DataFrame) -> DataFrame:
    """One row (image_id, category_id, keypoints, score) for each instance of predictions (image_id, keypoints, labels, scores), whose points (x, y, visible) are one flat array."""
    each = predictions.select("image_id", F.inline(F.arrays_zip("keypoints", "labels", "scores")))
    return each.select("image_id", F.col("labels").alias("category_id"), F.flatten("keypoints").alias("keypoints"), F.col("scores").alias("score"))
