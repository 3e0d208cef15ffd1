"""Queries on average precision, topology, conformal scores and losses."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwise.functions import boxes as B
from boxwise.functions import scalars as S
from boxwise.operators import coco as C
from boxwise.operators import prototypes as P
from boxwise.operators import ranking as R
from boxwise.operators import statistics as T
from boxwise.operators import topology as U
from boxwise.plans.boxes_queries import PAIRS, det_box, gt_box, pairs, r6
from boxwise.plans.registry import query
from boxwise.plans.table_queries import EMB, vectors
from boxwise.plans.views import table, view


def coco_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Detections and ground truth of the boxes view; every 17th ground truth is a crowd."""
    b = view(spark, sf_dir, "boxes").withColumn("category_id", F.col("label"))
    det = b.where("kind = 'DET'").selectExpr("image_id", "category_id", "box_id AS det_id", "score", "x0", "y0", "x1", "y1")
    gt = b.where("kind = 'GT'").selectExpr("image_id", "category_id", "box_id AS gt_id", "x0", "y0", "x1", "y1", "(x1 - x0) * (y1 - y0) AS area", "CAST(box_id % 17 = 0 AS INT) AS iscrowd")
    return det, gt


#: One detection after the other, for all images, categories, areas and thresholds at once; `used` is the ground truth that is taken.
COCO_MATCH = """WITH RECURSIVE d AS (SELECT image_id, label AS category_id, box_id AS det_id, score, x0, y0, x1, y1, (x1 - x0) * (y1 - y0) AS area, row_number() OVER (PARTITION BY image_id, label ORDER BY score DESC, box_id)::INT AS det_rank FROM boxes WHERE kind = 'DET'),
    g AS (SELECT image_id, label AS category_id, box_id AS gt_id, x0, y0, x1, y1, (x1 - x0) * (y1 - y0) AS area, box_id % 17 = 0 AS crowd FROM boxes WHERE kind = 'GT'),
    o AS (SELECT d.image_id, d.category_id, det_rank, gt_id, crowd, d.area AS da, g.area AS ga, greatest(least(d.x1, g.x1) - greatest(d.x0, g.x0), 0) * greatest(least(d.y1, g.y1) - greatest(d.y0, g.y0), 0) AS i FROM d JOIN g ON d.image_id = g.image_id AND d.category_id = g.category_id WHERE det_rank <= 100),
    l AS (SELECT image_id, category_id, det_rank, list({'iou': i / CASE WHEN crowd THEN da ELSE da + ga - i END, 'gt_id': gt_id, 'crowd': crowd, 'area': ga}) AS c FROM o WHERE i > 0 GROUP BY ALL),
    areas(area_range, low, high) AS (VALUES ('all', 0.0::DOUBLE, 1e10::DOUBLE), ('small', 0.0, 1024.0), ('medium', 1024.0, 9216.0), ('large', 9216.0, 1e10)), thresholds(iou_thr) AS (VALUES (0.5::DOUBLE), (0.75)),
    s AS (SELECT DISTINCT image_id, category_id, area_range, low, high, iou_thr, 0::INT AS det_rank, []::BIGINT[] AS used, {'regular': true, 'iou': 0.0::DOUBLE, 'gt_id': NULL::BIGINT} AS pick, false AS ignored FROM d, areas, thresholds
        UNION ALL
        SELECT image_id, category_id, area_range, low, high, iou_thr, det_rank, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick.gt_id) END, pick, CASE WHEN pick IS NULL THEN area < low OR area > high ELSE NOT pick.regular END
        FROM (SELECT s.image_id, s.category_id, area_range, low, high, iou_thr, d.det_rank, used, d.area, list_sort(list_transform(list_filter(c, lambda x: x.iou >= iou_thr AND (x.crowd OR NOT list_contains(used, x.gt_id))), lambda x: {'regular': NOT (x.crowd OR x.area < low OR x.area > high), 'iou': x.iou, 'gt_id': x.gt_id}))[-1] AS pick
              FROM s JOIN d ON d.image_id = s.image_id AND d.category_id = s.category_id AND d.det_rank = s.det_rank + 1 AND d.det_rank <= 100 LEFT JOIN l ON l.image_id = d.image_id AND l.category_id = d.category_id AND l.det_rank = d.det_rank))
    SELECT s.image_id, s.category_id, area_range, iou_thr, d.det_id, s.det_rank, d.score, s.pick.gt_id AS gt_id, ignored FROM s JOIN d ON d.image_id = s.image_id AND d.category_id = s.category_id AND d.det_rank = s.det_rank"""


@query("j9_coco_match", COCO_MATCH)
def j9_coco_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.match(*coco_tables(spark, sf_dir), thresholds=[0.5, 0.75])


@query("a25_a26_coco_summary", None)
def a25_a26_coco_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    det, gt = coco_tables(spark, sf_dir)
    npos = C.positives(gt)
    return C.summary(C.accumulate(C.match_packed(det, gt), npos))


def _flagged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Matches by a rule that SQL can state, to check what follows matching."""
    det = view(spark, sf_dir, "boxes").where("kind = 'DET'")
    rows = det.selectExpr("image_id", "label AS category_id", "'all' AS area_range", "CAST(0.5 AS DOUBLE) AS iou_thr", "box_id AS det_id", "1 AS det_rank", "score", "CASE WHEN box_id % 3 <> 0 THEN box_id END AS gt_id", "box_id % 11 = 0 AS ignored")
    npos = det.groupBy(F.col("label").alias("category_id"), F.lit("all").alias("area_range")).agg(F.count(F.lit(1)).alias("npos"))
    return rows, npos


CURVE = """r AS (SELECT label, row_number() OVER o AS rank, sum(CASE WHEN box_id % 3 <> 0 THEN 1 ELSE 0 END) OVER o AS tp FROM boxes WHERE kind = 'DET' AND box_id % 11 <> 0 WINDOW o AS (PARTITION BY label ORDER BY score DESC, image_id, box_id ROWS UNBOUNDED PRECEDING)),
    n AS (SELECT label, count(*) AS npos FROM boxes WHERE kind = 'DET' GROUP BY label),
    e AS (SELECT r.label, rank, tp / CAST(npos AS DOUBLE) AS recall, max(tp / CAST(rank AS DOUBLE)) OVER (PARTITION BY r.label ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS envelope, tp / CAST(rank AS DOUBLE) AS prec FROM r JOIN n ON r.label = n.label)"""


@query("w6_w7_precision_envelope", f"WITH {CURVE} SELECT label, rank, round(recall, 6) AS recall, round(prec, 6) AS prec, round(envelope, 6) AS envelope FROM e")
def w6_w7_precision_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = C.precision_recall(*_flagged(spark, sf_dir), max_dets=(100,))
    return curve.select(F.col("category_id").alias("label"), F.col("rank").cast("long").alias("rank"), r6(F.col("recall")).alias("recall"), r6(F.col("precision")).alias("prec"), r6(F.col("envelope")).alias("envelope"))


@query(
    "w8_interpolated_ap",
    f"""WITH {CURVE}, t AS (SELECT k / 100.0::DOUBLE AS thr FROM range(101) x(k)), s AS (SELECT e.label, thr, arg_min(envelope, rank) AS p FROM e JOIN t ON recall >= thr - 1e-11 GROUP BY e.label, thr)
        SELECT n.label, round(coalesce(sum(p), 0) / 101, 6) AS ap FROM n LEFT JOIN s ON n.label = s.label GROUP BY n.label""",
)
def w8_interpolated_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, npos = _flagged(spark, sf_dir)
    ap = C.average_precision(C.precision_recall(rows, npos, (100,), hits_only=True), npos, [0.5], (100,))
    return ap.select(F.col("category_id").alias("label"), r6(F.col("ap")).alias("ap"))


def layer_weights(layers: int = 3, outputs: int = 8, inputs: int = 64) -> dict[str, np.ndarray]:
    """Weights by a rule, the same everywhere."""
    o, i = np.meshgrid(np.arange(outputs), np.arange(inputs), indexing="ij")
    return {f"linear{k}": ((k * 31 + o * 17 + i * 7) % 13 - 6) / 6.0 for k in range(layers)}


def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector, seen by every layer."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    return e.select("vec_id", "label", F.explode(F.array(*(F.lit(k) for k in layer_weights()))).alias("layer"), F.col("embedding").alias("x"))


def tree_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.diagrams(activations(spark, sf_dir), layer_weights(), ["vec_id", "label"])


@query("u1_spanning_tree_diagrams", None)
def u1_spanning_tree_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tree_diagrams(spark, sf_dir)
    return d.select("vec_id", "label", "layer", F.size("diagram").alias("n_edges"), r6(F.col("diagram")[0]).alias("largest"), r6(S.total(F.col("diagram"))).alias("total"))


@query("u2_topological_uncertainty", None)
def u2_topological_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on four fifths of the vectors, scored on the rest (U2, U4, U6): class means, then the mean distance over layers."""
    d = tree_diagrams(spark, sf_dir)
    means = T.vector_mean(d.where("vec_id % 5 <> 0"), ["label", "layer"], "diagram")
    held = d.where("vec_id % 5 = 0").select("vec_id", "label", "layer", "diagram")
    return U.uncertainty(U.prototype_distances(held, means, ["label", "layer"], "diagram"), ["vec_id", "label"]).withColumn("tu", r6(F.col("tu")))


@query("u3_clustered_uncertainty", None)
def u3_clustered_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same against up to four prototypes of each class and layer."""
    d = tree_diagrams(spark, sf_dir)
    prototypes = P.clusters(d.where("vec_id % 5 <> 0"), ["label", "layer"], "vec_id", "diagram")
    held = d.where("vec_id % 5 = 0").select("vec_id", "label", "layer", "diagram")
    return U.uncertainty(U.prototype_distances(held, prototypes, ["label", "layer"], "diagram", "max"), ["vec_id", "label"]).withColumn("tu", r6(F.col("tu")))


@query("a5_cluster_prototypes", None)
def a5_cluster_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return P.clusters(v, ["label", "layer"], "vec_id", "x").select("label", "layer", "cluster_id", "n", r6(F.col("m")[0]).alias("m0"))


@query(
    "f12_j13_prototype_distance",
    f"""WITH {EMB}, u AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(x) AS v FROM e), m AS (SELECT label, i, avg(v) AS m FROM u WHERE vec_id % 5 <> 0 GROUP BY label, i)
        SELECT u.vec_id, u.label, round(sqrt(avg((v - m) * (v - m))), 6) AS distance FROM u JOIN m ON u.label = m.label AND u.i = m.i WHERE u.vec_id % 5 = 0 GROUP BY u.vec_id, u.label""",
)
def f12_j13_prototype_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    means = T.vector_mean(v.where("vec_id % 5 <> 0"), ["label"], "x")
    return U.prototype_distances(v.where("vec_id % 5 = 0").select("vec_id", "label", "x"), means, ["label"], "x").withColumn("distance", r6(F.col("distance")))


#: Percentiles by running counts, for all detections.
CELLS = """d AS (SELECT image_id, box_id, label, CAST(dataset AS INT) AS layer, round(score, 3) AS distance, kind FROM boxes),
    w AS (SELECT *, count(*) FILTER (kind = 'GT') OVER (PARTITION BY layer, label ORDER BY distance RANGE UNBOUNDED PRECEDING) AS below, count(*) FILTER (kind = 'GT') OVER (PARTITION BY layer, label) AS n FROM d),
    p AS (SELECT image_id, box_id, label, layer, distance, below / CAST(n AS DOUBLE) AS percentile FROM w WHERE kind = 'DET' AND n >= 10)"""


def _cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = view(spark, sf_dir, "boxes").selectExpr("image_id", "box_id", "label", "dataset AS layer", "round(score, 3) AS distance", "kind")
    return d.where("kind = 'DET'").drop("kind"), d.where("kind = 'GT'").select("label", "layer", "distance")


@query("f13_conformal_percentiles", f"WITH {CELLS} SELECT image_id, box_id, label, layer, round(percentile, 6) AS percentile FROM p")
def f13_conformal_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, reference = _cells(spark, sf_dir)
    return U.percentiles(rows, reference, ["layer", "label"], "distance").select("image_id", "box_id", "label", "layer", r6(F.col("percentile")).alias("percentile"))


@query(
    "u11_conformal_auroc",
    f"""WITH {CELLS}, v AS (SELECT label, box_id % 2 AS y, 'percentile' AS variant, percentile AS s FROM p UNION ALL SELECT label, box_id % 2, 'raw', distance FROM p),
        r AS (SELECT label, variant, y, rank() OVER (PARTITION BY label, variant ORDER BY s) + (count(*) OVER (PARTITION BY label, variant, s) - 1) / 2.0::DOUBLE AS k FROM v),
        g AS (SELECT label, variant, sum(CASE WHEN y = 1 THEN k ELSE 0 END) AS k, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM r GROUP BY label, variant)
        SELECT label, variant, round((k - pos * (pos + 1) / 2) / (pos * neg), 6) AS auroc FROM g WHERE pos > 0 AND neg > 0""",
)
def u11_conformal_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, reference = _cells(spark, sf_dir)
    scored = U.percentiles(rows, reference, ["layer", "label"], "distance").withColumn("y", F.col("box_id") % 2)
    return R.auroc(R.variants(scored, ["label", "y"], {"percentile": "percentile", "raw": "distance"}), ["label", "variant"], "y", "score").select("label", "variant", r6(F.col("auroc")).alias("auroc"))


@query(
    "a7_distance_buckets",
    "SELECT dataset AS layer, label, count(*) AS n, round(list_sort(list(score))[1], 6) AS least, round(list_sort(list(score))[count(*)], 6) AS largest FROM boxes GROUP BY dataset, label",
)
def a7_distance_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and ends of each cell's distances; the sorted table itself stays in rows."""
    return view(spark, sf_dir, "boxes").groupBy(F.col("dataset").alias("layer"), "label").agg(F.count(F.lit(1)).alias("n"), r6(F.min("score")).alias("least"), r6(F.max("score")).alias("largest"))


LOGITS = "l AS (SELECT vec_id, label, unnest(range(10)) AS c, 20 * CAST(unnest(embedding[1:10]) AS DOUBLE) AS x FROM embeddings), t AS (SELECT *, CASE WHEN c = label THEN 1.0::DOUBLE ELSE 0 END AS y, 1 / (1 + exp(-x)) AS p FROM l)"


@query(
    "a31_class_losses",
    f"""WITH {LOGITS}, q AS (SELECT label, vec_id, (0.25 * y + 0.75 * (1 - y)) * pow(1 - (p * y + (1 - p) * (1 - y)), 2) * -(y * ln(p) + (1 - y) * ln(1 - p)) AS focal,
          -(y * ln(p) + (1 - y) * ln(1 - p)) AS bce, -(0.75 * p * p * (1 - y) + 0.5 * y) * (0.5 * y * ln(p) + (1 - 0.5 * y) * ln(1 - p)) AS vfl, 2 * 0.25 * 0 AS z FROM t)
        SELECT label, round(sum(focal) / greatest(count(DISTINCT vec_id), 1), 6) AS loss_focal, round(sum(bce) / greatest(count(DISTINCT vec_id), 1), 6) AS loss_bce, round(sum(vfl) / greatest(count(DISTINCT vec_id), 1), 6) AS loss_vfl FROM q GROUP BY label""",
)
def a31_class_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over a query's classes are taken in the row; groups divide by their number of queries, one at least."""
    e = table(spark, sf_dir, "embeddings").select("label", F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 10), lambda v: 20 * v).alias("x"))

    def over(loss) -> F.Column:  # noqa: ANN001
        return S.total(F.transform("x", lambda x, c: loss(x, F.when(c == F.col("label"), 1.0).otherwise(0.0))))

    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    losses = {
        "loss_focal": over(lambda x, y: S.focal(x, y, 0.25, 2.0)),
        "loss_bce": over(lambda x, y: -(y * S.log_sigmoid(x) + (1 - y) * S.log_sigmoid(-x))),
        "loss_vfl": over(lambda x, y: S.varifocal(x, y, F.lit(0.5), 0.75, 2.0)),
    }
    return e.select("label", *(v.alias(k) for k, v in losses.items())).groupBy("label").agg(*(r6(F.sum(k) / n).alias(k) for k in losses))


@query(
    "a31_box_losses",
    f"""WITH {PAIRS}, m AS (SELECT * FROM pairs WHERE det_id = gt_id + 1) SELECT label, count(*) AS n, round(sum(abs(gx0 - dx0) + abs(gy0 - dy0) + abs(gx1 - dx1) + abs(gy1 - dy1)) / greatest(count(*), 1), 6) AS loss_bbox,
        round(sum(1 - (i / (s - i) - (c - (s - i)) / c)) / greatest(count(*), 1), 6) AS loss_giou, round(sum((1 - (i / (s - i) - (c - (s - i)) / c)) * (i / (s - i))) / greatest(count(*), 1), 6) AS loss_giou_weighted,
        round(sum(0.5 * (exp(-greatest(-10, least(4, score))) * (dx0 - gx0) * (dx0 - gx0) + greatest(-10, least(4, score)))) / greatest(count(*), 1), 6) AS loss_nll FROM m GROUP BY label""",
)
def a31_box_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1, GIoU, GIoU weighted by IoU (A43) and Gaussian likelihood of matched pairs."""
    m = pairs(view(spark, sf_dir, "boxes")).where("det_id = gt_id + 1")
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    gap = 1 - B.giou(det_box(), gt_box())
    nll = S.gaussian_nll(F.col("dx0") - F.col("gx0"), S.clamp(F.col("score"), -10.0, 4.0), constant=False)
    return m.groupBy("label").agg(F.count(F.lit(1)).alias("n"), r6(F.sum(B.l1(det_box(), gt_box())) / n).alias("loss_bbox"), r6(F.sum(gap) / n).alias("loss_giou"), r6(F.sum(gap * B.iou(det_box(), gt_box())) / n).alias("loss_giou_weighted"), r6(F.sum(nll) / n).alias("loss_nll"))


@query(
    "a32_weighted_loss_map",
    """WITH w(name, weight, stages) AS (VALUES ('loss_value', 2.0::DOUBLE, 3), ('loss_nll', 0.5, 1)), l AS (SELECT CAST(user_id % 3 AS INT) AS stage, avg(value) AS loss_value, avg(value * value) / 2 AS loss_nll FROM events GROUP BY ALL),
       u AS (SELECT stage, 'loss_value' AS name, loss_value AS v FROM l UNION ALL SELECT stage, 'loss_nll', loss_nll FROM l)
       SELECT CASE stage WHEN 0 THEN u.name WHEN 1 THEN u.name || '_aux_0' ELSE u.name || '_dn_0' END AS name, round(v * weight, 6) AS loss FROM u JOIN w ON u.name = w.name WHERE stage < stages""",
)
def a32_weighted_loss_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of the main, auxiliary and denoising outputs in one map, weighted by name; one of them counts for the main output alone."""
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 3).cast("int").alias("stage")).agg(F.avg("value").alias("loss_value"), (F.avg(F.col("value") * F.col("value")) / 2).alias("loss_nll"))
    long = e.select("stage", F.expr("stack(2, 'loss_value', loss_value, 'loss_nll', loss_nll) AS (name, v)"))
    weights = spark.createDataFrame([("loss_value", 2.0, 3), ("loss_nll", 0.5, 1)], "name string, weight double, stages int")
    suffix = F.element_at(F.array(F.lit(""), F.lit("_aux_0"), F.lit("_dn_0")), F.col("stage") + 1)
    return long.join(weights, "name").where("stage < stages").select(F.concat("name", suffix).alias("name"), r6(F.col("v") * F.col("weight")).alias("loss"))
