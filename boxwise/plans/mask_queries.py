"""Queries on masks, keypoints and box geometry, and on the metrics by class, coordinate and layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwise.functions import boxes as B
from boxwise.functions import masks as K
from boxwise.operators import matching as M
from boxwise.operators import populations as P
from boxwise.operators import ranking as R
from boxwise.operators import statistics as T
from boxwise.operators import topology as U
from boxwise.plans.boxes_queries import PAIRS, det_box, gt_box, pairs, r6, sides, xyxy
from boxwise.plans.pipeline_queries import POOLS
from boxwise.plans.registry import query
from boxwise.plans.table_queries import EMB, vectors
from boxwise.plans.views import table, view
from boxwise.sources import coco

#: Rows and columns of a mask; a pixel's number, column after column, is a bit of a 64-bit integer in the SQL.
HEIGHT, WIDTH = 7, 8
#: A disc for each box, whose centre and radius follow from the box: the value of pixel (i, j).
_DISC = "1.0 / (1 + (i - box_id % 7) * (i - box_id % 7) + (j - image_id % 8) * (j - image_id % 8)) + 0.05 * (box_id % 5)"
PIXELS = f"""m AS (SELECT image_id, box_id, label, kind, score, i, j, {_DISC.replace("1.0 /", "1.0::DOUBLE /")} > 0.21 AS bit FROM boxes, range({HEIGHT}) y(i), range({WIDTH}) x(j)),
    b AS (SELECT image_id, box_id, label, kind, score, sum(CASE WHEN bit THEN 1::HUGEINT << (j * {HEIGHT} + i) ELSE 0 END)::BIGINT AS bits, min(j) FILTER (bit) AS x0, min(i) FILTER (bit) AS y0, max(j) FILTER (bit) AS x1, max(i) FILTER (bit) AS y1 FROM m GROUP BY ALL)"""


def masks(boxes: DataFrame) -> DataFrame:
    """boxes with the pixels of a mask each."""
    # The squares are columns of their own, so that each is worked out once a row and not once a pixel.
    squared = lambda n, c, most: (F.lit(n) - F.col(c) % most) * (F.lit(n) - F.col(c) % most)
    rows, columns = [f"_i{i}" for i in range(HEIGHT)], [f"_j{j}" for j in range(WIDTH)]
    parts = {c: squared(i, "box_id", 7).cast("double") for i, c in enumerate(rows)} | {c: squared(j, "image_id", 8).cast("double") + 1 for j, c in enumerate(columns)} | {"_rise": F.lit(0.05) * (F.col("box_id") % 5)}
    pixels = F.array(*(F.array(*(F.lit(1.0) / (F.col(i) + F.col(j)) + F.col("_rise") for j in columns)) for i in rows))
    return boxes.withColumns(parts).withColumn("pixels", pixels).drop(*parts)


def runs(boxes: DataFrame) -> DataFrame:
    return masks(boxes).withColumn("counts", K.encode(F.col("pixels"), 0.21)).drop("pixels")


@query(
    "p19_flat_masks",
    f"""WITH {PIXELS}, e AS (SELECT *, j * {HEIGHT} + i AS k, bit IS DISTINCT FROM lag(bit) OVER (PARTITION BY image_id, box_id ORDER BY j, i) AS new FROM m WHERE kind = 'DET'),
        g AS (SELECT image_id, box_id, label, score, k, bit, sum(new::INT) OVER (PARTITION BY image_id, box_id ORDER BY k) AS run FROM e),
        n AS (SELECT image_id, box_id, label, score, run, bool_or(bit) AS bit, count(*)::INT AS n FROM g GROUP BY image_id, box_id, label, score, run)
        SELECT image_id, label AS category_id, {HEIGHT} AS height, {WIDTH} AS width, CASE WHEN first(bit ORDER BY run) THEN [0] ELSE []::INT[] END || list(n ORDER BY run) AS counts, score FROM n GROUP BY image_id, box_id, label, score""",
)
def p19_flat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks nested by image, as rows of runs."""
    m = masks(view(spark, sf_dir, "boxes").where("kind = 'DET'"))
    r = F.collect_list(F.struct("pixels", "label", "score")).alias("r")
    nested = m.groupBy("image_id").agg(r).select("image_id", F.col("r.pixels").alias("masks"), F.col("r.label").alias("labels"), F.col("r.score").alias("scores"))
    return coco.flattened_masks(nested, 0.21).drop("segmentation")


@query("p19_flat_keypoints", "SELECT image_id, label AS category_id, [x0, y0, 2, x1, y1, CAST(box_id % 3 AS DOUBLE)] AS keypoints, score FROM boxes WHERE kind = 'DET'")
def p19_flat_keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = view(spark, sf_dir, "boxes")
    points = F.array(F.array("x0", "y0", F.lit(2.0)), F.array("x1", "y1", (F.col("box_id") % 3).cast("double")))
    r = F.collect_list(F.when(F.col("kind") == "DET", F.struct(points.alias("points"), "label", "score"))).alias("r")
    nested = b.groupBy("image_id").agg(r).select("image_id", F.col("r.points").alias("keypoints"), F.col("r.label").alias("labels"), F.col("r.score").alias("scores"))
    return coco.flattened_keypoints(nested)


@query("a42_mask_boxes", f"WITH {PIXELS} SELECT image_id, box_id, bit_count(bits)::BIGINT AS area, x0::INT AS x0, y0::INT AS y0, x1::INT AS x1, y1::INT AS y1 FROM b")
def a42_mask_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas and boxes from runs that have been through the compressed text."""
    m = runs(view(spark, sf_dir, "boxes")).withColumn("counts", K.from_text(K.to_text(F.col("counts"))))
    return m.select("image_id", "box_id", K.area(F.col("counts")).alias("area"), K.box(F.col("counts"), F.lit(HEIGHT)).alias("b")).select("image_id", "box_id", "area", "b.*")


@query(
    "j9_mask_overlap",
    f"""WITH {PIXELS} SELECT g.image_id, g.box_id AS gt_id, d.box_id AS det_id, round(coalesce(bit_count(g.bits & d.bits) / CAST(nullif(CASE WHEN g.box_id % 17 = 0 THEN bit_count(d.bits) ELSE bit_count(g.bits | d.bits) END, 0) AS DOUBLE), 0), 6) AS iou
        FROM b g JOIN b d ON g.image_id = d.image_id AND g.label = d.label AND g.kind = 'GT' AND d.kind = 'DET'""",
)
def j9_mask_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask IoU of the pairs of an image and category; of crowds, over the detection's own area."""
    m = runs(view(spark, sf_dir, "boxes"))
    det = m.where("kind = 'DET'").select("image_id", "label", F.col("box_id").alias("det_id"), "counts")
    gt = m.where("kind = 'GT'").select("image_id", "label", F.col("box_id").alias("gt_id"), "counts", (F.col("box_id") % 17 == 0).alias("crowd"))
    return M.mask_overlaps(det, gt).withColumn("iou", r6(F.col("iou")))


@query(
    "f3_revert_modes",
    """WITH n AS (SELECT image_id, box_id, unnest(['x0', 'y0', 'x1', 'y1']) AS side, unnest([x0, y0, x1, y1]) / 640 AS v, unnest([640, 480, 640, 480])::DOUBLE AS orig, unnest([300, 225, 300, 225])::DOUBLE AS inner_size, unnest([8, 4, 8, 4])::DOUBLE AS pad FROM boxes)
       SELECT image_id, box_id, side, round(v * orig, 6) AS stretched, round(v * 320 * (orig / inner_size), 6) AS keep_ratio, round((v * 320 - pad) * (orig / inner_size), 6) AS padded FROM n""",
)
def f3_revert_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sides of each box back to the original image, by each of the three ways that it was fitted into the input."""
    n, orig, inner, model = B.normalise(xyxy(), 640.0, 640.0), (F.lit(640.0), F.lit(480.0)), (F.lit(300.0), F.lit(225.0)), (320.0, 320.0)
    modes = {"stretched": B.revert(n, (F.lit(1.0), F.lit(1.0)), orig), "keep_ratio": B.revert(n, model, orig, inner), "padded": B.revert(n, model, orig, inner, (8.0, 4.0))}
    each = F.array(*(F.struct(F.lit(s).alias("side"), *(r6(b[k]).alias(m) for m, b in modes.items())) for k, s in enumerate(("x0", "y0", "x1", "y1"))))
    return view(spark, sf_dir, "boxes").select("image_id", "box_id", F.inline(each))


@query(
    "f4_box_transforms_all_sides",
    """SELECT image_id, box_id, 200 - x1 AS flip_x0, y0 AS flip_y0, 200 - x0 AS flip_x1, y1 AS flip_y1, greatest(0, least(50, x0 - 10)) AS crop_x0, greatest(0, least(40, y0 - 5)) AS crop_y0, greatest(0, least(50, x1 - 10)) AS crop_x1, greatest(0, least(40, y1 - 5)) AS crop_y1,
              round(x0 * 1.5, 6) AS resize_x0, round(y0 * 0.5, 6) AS resize_y0, round(x1 * 1.5, 6) AS resize_x1, round(y1 * 0.5, 6) AS resize_y1, x0 / 216 AS pad_x0, y0 / 166 AS pad_y0, x1 / 216 AS pad_x1, y1 / 166 AS pad_y1 FROM boxes""",
)
def f4_box_transforms_all_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padding right of and below an image moves no box, and makes the size larger that boxes are normalised by."""
    kinds = {"flip": B.flip(xyxy(), 200.0), "crop": B.crop(xyxy(), 5.0, 10.0, 40.0, 50.0), "resize": tuple(map(r6, B.resize(xyxy(), 1.5, 0.5))), "pad": B.normalise(xyxy(), 200.0 + 16, 150.0 + 16)}
    return view(spark, sf_dir, "boxes").select("image_id", "box_id", *(b[k].alias(f"{kind}_{s}") for kind, b in kinds.items() for k, s in enumerate(("x0", "y0", "x1", "y1"))))


LEVELS = {"50": 0.67448975, "80": 1.28155157, "90": 1.64485363, "95": 1.95996398}
COORDINATES = ("cx", "cy", "w", "h")
_SQL_ERRORS = "[(dx0 + dx1 - gx0 - gx1) / 200, (dy0 + dy1 - gy0 - gy1) / 200, (dx1 - dx0 - gx1 + gx0) / 100, (dy1 - dy0 - gy1 + gy0) / 100]"


@query(
    "a20_a21_four_coordinates",
    f"""WITH {PAIRS}, q AS (SELECT row_number() OVER () AS r, {_SQL_ERRORS} AS e, [2 * score - 4, score - 3, score / 2 - 4, -3 - score]::DOUBLE[] AS v FROM pairs), u AS (SELECT r, unnest(range(4)) AS k, unnest(e) AS e, unnest(v) AS v FROM q),
        z(nominal, z) AS (VALUES {", ".join(f"('{k}', {z}::DOUBLE)" for k, z in LEVELS.items())}), c AS (SELECT nominal, r, sum((abs(e) <= z * exp(v / 2))::INT) AS n FROM u, z GROUP BY nominal, r),
        l AS (SELECT nominal, round(avg(n / 4.0::DOUBLE), 6) AS coordinate, round(avg((n = 4)::INT), 6) AS whole FROM c GROUP BY nominal),
        m AS (SELECT round(avg(0.5 * (e * e / exp(v) + v + ln(2 * pi()))), 6) AS nll, {", ".join(f"round(sqrt(avg(e * e) FILTER (k = {i})), 6) AS rmse_{c}, round(avg(exp(v / 2)) FILTER (k = {i}), 6) AS mean_std_{c}" for i, c in enumerate(COORDINATES))} FROM u)
        SELECT * FROM l, m""",
)
def a20_a21_four_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four coordinates of every pair of an image and class, each with its own variance."""
    half = lambda a, b: F.col(a) + F.col(b)
    e = F.array((half("dx0", "dx1") - half("gx0", "gx1")) / 200, (half("dy0", "dy1") - half("gy0", "gy1")) / 200, (F.col("dx1") - F.col("dx0") - F.col("gx1") + F.col("gx0")) / 100, (F.col("dy1") - F.col("dy0") - F.col("gy1") + F.col("gy0")) / 100)
    s = F.col("score")
    rows = pairs(view(spark, sf_dir, "boxes")).select(e.alias("e"), F.array(2 * s - 4, s - 3, s / 2 - 4, -3 - s).alias("v"))
    m = T.gaussian_metrics(rows, "e", "v", LEVELS, list(COORDINATES))
    return m.select("nominal", *(r6(F.col(c)).alias(c) for c in m.columns if c != "nominal"))


_AREAS = """w AS (SELECT label, avg(y) OVER (PARTITION BY label ORDER BY {by}, id ROWS UNBOUNDED PRECEDING) AS r, row_number() OVER (PARTITION BY label ORDER BY {by}, id) AS k, count(*) OVER (PARTITION BY label) AS n FROM v)
    SELECT label, sum((r + r0) / 2 / n) AS area FROM (SELECT *, lag(r) OVER (PARTITION BY label ORDER BY k) AS r0 FROM w) GROUP BY label"""


@query(
    "a13_class_risk_areas",
    f"""WITH {POOLS.replace("SELECT image_id", "SELECT image_id * 1000 + box_id AS id, image_id")}, v AS (SELECT * FROM d WHERE y = 1 OR label <> 2), s AS (SELECT label FROM v GROUP BY label HAVING min(y) = 0 AND max(y) = 1),
        a AS (SELECT * FROM (WITH {_AREAS.format(by="unc")})), o AS (SELECT * FROM (WITH {_AREAS.format(by="y")}))
        SELECT a.label, round(a.area, 6) AS aurc, round(a.area - o.area, 6) AS eaurc FROM a JOIN o ON a.label = o.label WHERE a.label IN (SELECT label FROM s)""",
)
def a13_class_risk_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the risk-coverage curve of each class that both pools have, and its excess over the best order."""
    b = view(spark, sf_dir, "boxes").where("kind = 'DET' and (dataset >= 4 or label <> 2)")
    v = b.select("label", (F.col("image_id") * 1000 + F.col("box_id")).alias("id"), (F.col("dataset") >= 4).cast("int").alias("y"), (F.col("y0") * (1 + F.col("dataset") % 3)).alias("unc"))
    shared = v.groupBy("label").agg(F.min("y").alias("a"), F.max("y").alias("b")).where("a = 0 and b = 1").select("label")
    own = R.aurc_trapezoid(R.selective_risk(v, ["label"], "y", "unc", "id"), ["label"])
    best = R.aurc_trapezoid(R.selective_risk(v, ["label"], "y", "y", "id"), ["label"]).withColumnRenamed("aurc", "best")
    return own.join(best, "label").join(shared, "label").select("label", r6(F.col("aurc")).alias("aurc"), r6(F.col("aurc") - F.col("best")).alias("eaurc"))


@query(
    "j13_several_prototypes",
    f"""WITH {EMB}, u AS (SELECT vec_id, label, vec_id % 3 AS c, unnest(range(64)) AS i, unnest(x) AS v FROM e), m AS (SELECT label, c, i, avg(v) AS m FROM u WHERE vec_id % 5 <> 0 GROUP BY label, c, i),
        d AS (SELECT u.vec_id, u.label, m.c, sqrt(avg((v - m) * (v - m))) AS d FROM u JOIN m ON u.label = m.label AND u.i = m.i WHERE u.vec_id % 5 = 0 GROUP BY ALL)
        SELECT vec_id, label, round(max(d), 6) AS farthest, round(min(d), 6) AS nearest FROM d GROUP BY vec_id, label""",
)
def j13_several_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to the farthest and to the nearest of three prototypes of a class."""
    v = vectors(spark, sf_dir)
    means = T.vector_mean(v.where("vec_id % 5 <> 0").withColumn("c", F.col("vec_id") % 3), ["label", "c"], "x")
    held = v.where("vec_id % 5 = 0").select("vec_id", "label", "x")
    far, near = (U.prototype_distances(held, means, ["label"], "x", how).withColumnRenamed("distance", name) for how, name in (("max", "farthest"), ("min", "nearest")))
    return far.join(near, ["vec_id", "label"]).select("vec_id", "label", r6(F.col("farthest")).alias("farthest"), r6(F.col("nearest")).alias("nearest"))


MODULES = ("decoder.layers.0.linear1", "decoder.layers.0.linear2", "decoder.layers.1.linear1", "decoder.layers.1.linear2")


@query(
    "u2_linear1_layers",
    f"""WITH {EMB}, u AS (SELECT vec_id, label, i // 16 AS k, i, v FROM (SELECT vec_id, label, unnest(range(64)) AS i, unnest(x) AS v FROM e)), m AS (SELECT label, i, avg(v) AS m FROM u WHERE vec_id % 5 <> 0 GROUP BY label, i),
        d AS (SELECT u.vec_id, u.label, k, sqrt(avg((v - m) * (v - m))) AS d FROM u JOIN m ON u.label = m.label AND u.i = m.i WHERE u.vec_id % 5 = 0 GROUP BY ALL)
        SELECT vec_id, label, round(sum(d) FILTER (k IN (0, 2)) / 4, 6) AS tu FROM d GROUP BY vec_id, label""",
)
def u2_linear1_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of the linear1 layers alone, over the number of all four captured layers. Here a layer's diagram is a quarter of the vector."""
    layers = F.array(*(F.struct(F.lit(m).alias("layer"), F.slice("x", 16 * k + 1, 16).alias("diagram")) for k, m in enumerate(MODULES)))
    d = vectors(spark, sf_dir).where("x is not null").select("vec_id", "label", F.inline(layers))
    means = T.vector_mean(d.where("vec_id % 5 <> 0"), ["label", "layer"], "diagram")
    distances = U.prototype_distances(d.where("vec_id % 5 = 0"), means, ["label", "layer"], "diagram")
    return U.named_uncertainty(distances, ["vec_id", "label"], len(MODULES)).withColumn("tu", r6(F.col("tu")))


NAMES = ("linear1", "linear2", "score_head", "bbox_head_0", "sampling_offsets", "attention_weights", "value_proj", "output_proj", "enc_output_proj", "enc_score_head", "enc_bbox_head_2")
WANTED = ["attention_weights", "value_proj", "output_proj", "enc_output", "enc_score_head", "enc_bbox_head"]


@query(
    "u5_attention_and_encoder_layers",
    f"""WITH m(module, k) AS (VALUES {", ".join(f"('{n}', {k})" for k, n in enumerate(NAMES))})
        SELECT vec_id, CASE WHEN module NOT LIKE 'enc%' THEN CAST(vec_id % 3 AS INT) END AS layer, module FROM embeddings JOIN m ON k = vec_id % 11 WHERE k >= 8 OR k BETWEEN 5 AND 7 AND vec_id % 3 = 1""",
)
def u5_attention_and_encoder_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of attention in one decoder layer, and those of the encoder, which is in none."""
    module = F.get(F.array(*map(F.lit, NAMES)), (F.col("vec_id") % len(NAMES)).cast("int"))
    c = table(spark, sf_dir, "embeddings").select("vec_id", module.alias("module")).withColumn("layer", F.when(~F.col("module").startswith("enc"), (F.col("vec_id") % 3).cast("int")))
    return P.selected_layers(c, WANTED, 1).select("vec_id", "layer", "module")


@query(
    "j4_overlapping_pairs",
    f"WITH {PAIRS} SELECT image_id, gt_id, det_id, round(i / CAST(s - i AS DOUBLE), 6) AS iou FROM pairs WHERE i > 0",
)
def j4_overlapping_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of an image and class that overlap, found by cells of a grid."""
    gt, det = sides(view(spark, sf_dir, "boxes"))
    near = M.overlapping(gt, det, ["image_id", "label"], ("gx0", "gy0", "gx1", "gy1"), ("dx0", "dy0", "dx1", "dy1"))
    return near.select("image_id", "gt_id", "det_id", r6(B.iou(gt_box(), det_box())).alias("iou"))
