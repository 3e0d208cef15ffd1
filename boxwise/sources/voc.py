"""Annotation files in the VOC layout: one XML document an image, a list of files, and a list of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Images in a file: a file of XML is read by one task, and must not grow with the table.
IMAGES = 10_000

SCHEMA = "filename string, object array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"


def read(spark: SparkSession, annotations: str, names: list[str]) -> DataFrame:
    """file_name, box (from 0), label (the name's place in names), x0, y0, x1, y1 (S4). Corners are read by name, whatever their order in the file.

    annotations: a file, a folder or a pattern of them. Names that are not in the list have
    a NULL label.
    """
    raw = spark.read.format("xml").schema(SCHEMA).option("rowTag", "annotation").load(annotations)
    each = raw.select(F.col("filename").alias("file_name"), F.posexplode("object").alias("box", "o"))
    place = F.array_position(F.array(*map(F.lit, names)), F.col("o.name")).cast("int") - 1
    corners = [F.col(f"o.bndbox.{k}").alias(n) for k, n in (("xmin", "x0"), ("ymin", "y0"), ("xmax", "x1"), ("ymax", "y1"))]
    return each.select("file_name", "box", F.when(place >= 0, place).alias("label"), *corners)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """image and annotation: the two paths on each line of a split file."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(F.get(parts, F.lit(0)).alias("image"), F.get(parts, F.lit(1)).alias("annotation"))


def write(boxes: DataFrame, path: str, names: list[str]) -> None:
    """Writes boxes (file_name, label, x0, y0, x1, y1) as XML documents, up to IMAGES of them in a file."""
    o = F.struct(F.element_at(F.array(*map(F.lit, names)), F.col("label") + 1).alias("name"), F.struct(*(F.col(n).alias(k) for k, n in (("xmin", "x0"), ("ymin", "y0"), ("xmax", "x1"), ("ymax", "y1")))).alias("bndbox"))
    grouped = boxes.groupBy(F.col("file_name").alias("filename")).agg(F.array_sort(F.collect_list(o), lambda a, b: F.when(F.struct(a["bndbox"], a["name"]) < F.struct(b["bndbox"], b["name"]), -1).otherwise(1)).alias("object"))
    grouped.write.mode("overwrite").format("xml").option("rootTag", "annotations").option("rowTag", "annotation").option("maxRecordsPerFile", IMAGES).save(path)
