"""Queries on files, populations, whole pipelines and denoising."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwise.functions import boxes as B
from boxwise.functions import scalars as S
from boxwise.operators import populations as P
from boxwise.operators import ranking as R
from boxwise.operators import statistics as T
from boxwise.plans.boxes_queries import r6, xyxy
from boxwise.plans.model_queries import activations, layer_weights
from boxwise.plans.registry import query
from boxwise.plans.views import table, view
from boxwise.session import shared_folder
from boxwise.sources import coco, reports, voc


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _ground_truth(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = view(spark, sf_dir, "boxes")
    images = b.select("image_id").distinct().select("image_id", F.concat(F.lit("img_"), F.col("image_id").cast("string"), F.lit(".jpg")).alias("file_name"), F.lit(110).alias("width"), F.lit(2000000).alias("height"))
    return images, b.where("kind = 'GT'").select("image_id", "box_id", "label", "x0", "y0", "x1", "y1")


def _coco(spark: SparkSession, sf_dir: str) -> coco.Coco:
    folder = _folder(spark, "coco")
    coco.write(*_ground_truth(spark, sf_dir), folder, 4)
    return coco.read(spark, folder)


GT_ROWS = "g AS (SELECT *, row_number() OVER (ORDER BY image_id, box_id) AS ann_id FROM boxes WHERE kind = 'GT')"


@query(
    "s1_s6_coco_round_trip",
    f"WITH {GT_ROWS} SELECT ann_id, image_id, label, x0, y0, least(x1, 110) AS x1, y1, (x1 - x0) * (y1 - y0) AS area FROM g WHERE least(x1, 110) > x0",
)
def s1_s6_coco_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written in the COCO layout (S6), scanned again: crowds dropped, boxes clipped to their image, labels contiguous."""
    return _coco(spark, sf_dir).without_crowds().boxes().select("ann_id", "image_id", "label", "x0", "y0", "x1", "y1", "area")


@query(
    "s1_s6_s15_coco_ranges",
    f"WITH {GT_ROWS} SELECT ann_id, image_id, label, x0, y0, least(x1, 110) AS x1, y1, (x1 - x0) * (y1 - y0) AS area FROM g WHERE least(x1, 110) > x0",
)
def s1_s6_s15_coco_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document, written object by object and named when all is written (S6, S15), and read by ranges of bytes."""
    folder = _folder(spark, "coco-documents")
    coco.write_documents(*_ground_truth(spark, sf_dir), folder, 1)
    return coco.read_ranges(spark, folder, 1 << 18).without_crowds().boxes().select("ann_id", "image_id", "label", "x0", "y0", "x1", "y1", "area")


@query(
    "s2_s3_coco_images",
    f"""WITH {GT_ROWS}, i AS (SELECT DISTINCT image_id FROM boxes) SELECT i.image_id, 'img_' || i.image_id || '.jpg' AS file_name, count(ann_id) AS n_boxes, round(coalesce(sum(x1 - x0), 0), 6) AS width
        FROM i LEFT JOIN g ON g.image_id = i.image_id GROUP BY i.image_id""",
)
def s2_s3_coco_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image with its boxes as an array, images without too, crowds kept."""
    rows = _coco(spark, sf_dir).images_with_boxes()
    return rows.select("image_id", "file_name", F.size("boxes").cast("long").alias("n_boxes"), r6(S.total(F.filter(F.transform("boxes", lambda b: b["w"]), lambda w: w.isNotNull()))).alias("width"))


@query("s4_voc_scan", "SELECT 'img_' || image_id || '.jpg' AS file_name, label, x0, y0, x1, y1 FROM boxes WHERE kind = 'GT'")
def s4_voc_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, names = _folder(spark, "voc"), ["cat", "dog", "cow"]
    images, gt = _ground_truth(spark, sf_dir)
    voc.write(gt.join(images.select("image_id", "file_name"), "image_id"), folder, names)
    return voc.read(spark, folder, names).drop("box")


@query(
    "s13_p17_split_files",
    """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY (o_orderkey * 2654435761 + 42) % 4294967296, o_orderkey) AS k, count(*) OVER () AS n FROM orders),
       s AS (SELECT o_orderkey, n, k <= least(greatest(1, CAST(round_even(0.2 * n, 0) AS BIGINT)), n - 1) AS c FROM r)
       SELECT l_linenumber AS line, count(*) AS n, max(n) AS pool_size, max(num) AS num_calibration FROM (SELECT o_orderkey, n, sum(CAST(c AS INT)) OVER () AS num, c FROM s) s JOIN lineitem ON l_orderkey = o_orderkey WHERE c GROUP BY l_linenumber""",
)
def s13_p17_split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split is written, read, and its calibration side selects rows."""
    folder = _folder(spark, "split")
    reports.write_split(T.split(table(spark, sf_dir, "orders"), "o_orderkey", 0.2, 42), folder, "o_orderkey", 42, 0.2, {"table": "orders"})
    members, about = reports.read_split(spark, folder)
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("line"))
    counts = reports.chosen(lines, members, "calibration").groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(about.select("pool_size", "num_calibration")))  # one row


@query("s14_state_tables", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def s14_state_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accumulators of two halves, each written and read, merge to the whole."""
    parts = table(spark, sf_dir, "events").groupBy("event_type", (F.col("event_id") % 2).alias("half")).agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))
    folder = _folder(spark, "state")
    reports.write_state({f"half{k}": parts.where(F.col("half") == k).drop("half") for k in range(2)}, folder)
    halves = reports.read_state(spark, folder, ["half0", "half1"])
    return T.merge_partials(halves["half0"].unionByName(halves["half1"]), ["event_type"]).select("event_type", "n", r6(F.col("mean")).alias("mean"))


@query(
    "s16_s18_report_csv",
    """SELECT event_type, count(*) AS n, round(round(avg(value), 4), 4) AS mean, CASE WHEN event_type = 'click' THEN NULL ELSE round(max(value), 4) END AS top FROM events GROUP BY event_type""",
)
def s16_s18_report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report with four decimals and blank cells, written as CSV and read by its schema."""
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("top"))
    folder = _folder(spark, "report")
    reports.write_metrics_csv(e.withColumn("top", F.when(F.col("event_type") == "click", F.lit(float("nan"))).otherwise(F.col("top"))), folder)
    return reports.read_metrics_csv(spark, folder, "event_type string, n long, mean double, top double")


@query("s17_match_rows_csv", "SELECT image_id, box_id, x0 AS pred_x0, y1 AS pred_y1, (x0 + x1) / 2 AS gt_cx, y1 - y0 AS gt_h FROM boxes WHERE kind = 'DET'")
def s17_match_rows_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match rows with nested boxes, flattened, written as CSV and read."""
    cx, _, _, h = B.xyxy_to_cxcywh(xyxy())
    rows = view(spark, sf_dir, "boxes").where("kind = 'DET'").select("image_id", "box_id", F.struct("x0", "y1").alias("pred"), F.struct(cx.alias("cx"), h.alias("h")).alias("gt"))
    folder = _folder(spark, "matches")
    reports.write_csv(rows, folder)
    return reports.read_metrics_csv(spark, folder, "image_id long, box_id long, pred_x0 double, pred_y1 double, gt_cx double, gt_h double")


@query(
    "s19_f23_metrics_json",
    "SELECT user_id, round(avg(value), 6) AS mean, CASE WHEN user_id % 3 = 0 THEN NULL ELSE round(max(value), 6) END AS top, count(*) AS n FROM events GROUP BY user_id",
)
def s19_f23_metrics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested metrics as JSON without NaN or infinities, and back."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("mean"), F.max("value").alias("top"), F.count(F.lit(1)).alias("n"))
    bad = F.when(F.col("user_id") % 2 == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    nested = e.select("user_id", F.struct("mean", F.array(F.when(F.col("user_id") % 3 == 0, bad).otherwise(F.col("top"))).alias("tops")).alias("stats"), "n")
    back = reports.to_json(nested, ["user_id"]).select("user_id", F.from_json("json", "stats struct<mean:double,tops:array<double>>, n bigint").alias("m"))
    return back.select("user_id", r6(F.col("m.stats.mean")).alias("mean"), r6(F.col("m.stats.tops")[0]).alias("top"), F.col("m.n").alias("n"))


@query("s20_s21_scalar_log", "SELECT event_id AS step, event_type AS tag, round(value, 6) AS value FROM events")
def s20_s21_scalar_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars appended to a log in two runs, as JSON lines."""
    folder = _folder(spark, "log")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.col("event_type").alias("tag"), "value")
    for run in (e.where("step % 2 = 0"), e.where("step % 2 = 1")):
        reports.append_log(run, folder)
    return spark.read.schema("step long, tag string, value double").json(folder).withColumn("value", r6(F.col("value")))


@query("p1_drop_crowds", "SELECT image_id, box_id, label FROM boxes WHERE kind = 'GT' AND box_id % 17 <> 0")
def p1_drop_crowds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = view(spark, sf_dir, "boxes").where("kind = 'GT'").withColumn("iscrowd", F.when(F.col("box_id") % 17 == 0, 1).when(F.col("box_id") % 2 == 0, 0))
    return coco.Coco(b, b, b).without_crowds().annotations.select("image_id", "box_id", "label")


@query(
    "p4_keypoint_images",
    "SELECT image_id, count(*) AS n FROM boxes WHERE label <> 2 GROUP BY image_id HAVING NOT bool_and(x1 - x0 <= 22 OR y1 - y0 <= 22) AND sum(box_id % 4) >= 10",
)
def p4_keypoint_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of the listed categories with boxes that are not all thin, and ten visible keypoints at least; a box has some triples (x, y, v)."""
    points = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.array(F.col("x0"), F.col("y0"), F.when(k < F.col("box_id") % 4, 2.0).otherwise(0.0))))
    b = view(spark, sf_dir, "boxes").where("label <> 2").withColumn("keypoints", points)
    visible = F.size(F.filter("keypoints", lambda v, i: (i % 3 == 2) & (v > 0)))
    thin = (F.col("x1") - F.col("x0") <= 22) | (F.col("y1") - F.col("y0") <= 22)
    return b.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(thin).alias("thin"), F.sum(visible).alias("visible")).where("not thin and visible >= 10").select("image_id", "n")


@query(
    "p7_a41_finite_only",
    """WITH b AS (SELECT label, score, box_id % 5 = 1 AS a, box_id % 7 = 1 AS c FROM boxes WHERE kind = 'DET')
       SELECT label, count(*) FILTER (NOT a AND NOT c) AS n, count(*) FILTER (a OR c) AS n_drop, round(avg(score) FILTER (NOT a AND NOT c), 6) AS mean FROM b GROUP BY label""",
)
def p7_a41_finite_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncertainties that are NaN or infinite are dropped and counted."""
    u = F.when(F.col("box_id") % 5 == 1, F.lit(float("nan"))).when(F.col("box_id") % 7 == 1, F.lit(float("-inf"))).otherwise(F.col("score"))
    b = view(spark, sf_dir, "boxes").where("kind = 'DET'").select("label", u.alias("u")).withColumn("ok", S.finite(F.col("u")))
    return b.groupBy("label").agg(F.count_if("ok").alias("n"), F.count_if(~F.col("ok")).alias("n_drop"), r6(F.avg(F.when(F.col("ok"), F.col("u")))).alias("mean"))


def _labelled_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = view(spark, sf_dir, "boxes").where("kind = 'DET'")
    return b.select("image_id", F.col("box_id").alias("query_idx"), F.col("label").alias("predicted"), F.when(F.col("box_id") % 4 == 0, -1).otherwise(((F.col("label") + F.when(F.col("box_id") % 3 == 0, 1).otherwise(0)) % 3).cast("int")).alias("target"))


@query(
    "p10_p11_populations",
    """WITH q AS (SELECT label AS predicted, CASE WHEN box_id % 4 = 0 THEN -1 ELSE (label + CASE WHEN box_id % 3 = 0 THEN 1 ELSE 0 END) % 3 END AS target FROM boxes WHERE kind = 'DET')
       SELECT 'correct' AS population, predicted AS class_id, count(*) AS n FROM q WHERE target >= 0 AND predicted = target AND predicted <> 1 GROUP BY predicted UNION ALL SELECT 'predicted', predicted, count(*) FROM q GROUP BY predicted""",
)
def p10_p11_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _labelled_queries(spark, sf_dir)
    count = lambda which, allowed: P.population(q, which, allowed).groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(which).alias("population"), "class_id", "n")
    return count("correct", [0, 2]).unionByName(count("predicted", None))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten logits of each vector; the label's own is raised for some."""
    x = F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 10), lambda v, c: 4 * v + F.when((c == F.col("label")) & (F.col("vec_id") % 3 != 0), 2.0).otherwise(0.0))
    return table(spark, sf_dir, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("image_id"), "label", x.alias("logits"))


CONFIDENT = """l AS (SELECT vec_id, label, unnest(range(10)) AS c, 4 * CAST(unnest(embedding[1:10]) AS DOUBLE) AS x FROM embeddings), m AS (SELECT vec_id, label, c, x + CASE WHEN c = label AND vec_id % 3 <> 0 THEN 2 ELSE 0 END AS x FROM l),
    s AS (SELECT vec_id, label, max(x) AS top, max(x) FILTER (c = label) AS own, sum(exp(x)) AS z, min(c) FILTER (c = label) AS at FROM m GROUP BY vec_id, label), ok AS (SELECT vec_id, label, own FROM s WHERE own = top AND exp(own) / z >= 0.3)"""


@query("p12_confident_images", f"WITH {CONFIDENT} SELECT vec_id AS image_id, label, round(own, 6) AS logit FROM ok")
def p12_confident_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.confident(_classified(spark, sf_dir), 0.3).select("image_id", "label", r6(F.get("logits", F.col("label"))).alias("logit"))


@query("p19_flat_predictions", "SELECT image_id, label AS category_id, x0 AS x, y0 AS y, x1 - x0 AS w, y1 - y0 AS h, score FROM boxes WHERE kind = 'DET'")
def p19_flat_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions nested by image, images without any too, as rows."""
    b = view(spark, sf_dir, "boxes")
    det = F.col("kind") == "DET"
    r = F.collect_list(F.when(det, F.struct(F.array("x0", "y0", "x1", "y1").alias("b"), "label", "score"))).alias("r")
    nested = b.groupBy("image_id").agg(r).select("image_id", F.col("r.b").alias("boxes"), F.col("r.label").alias("labels"), F.col("r.score").alias("scores"))
    return coco.flattened(nested)


@query(
    "j18_gathered_activations",
    "SELECT vec_id // 5 AS image_id, CAST(vec_id % 5 AS INT) AS query_idx, label, round(CAST(embedding[1] AS DOUBLE) + CAST(embedding[64] AS DOUBLE), 6) AS ends FROM embeddings WHERE vec_id % 5 IN (1, 3) AND label > 2",
)
def j18_gathered_activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 5").alias("image_id"), (F.col("vec_id") % 5).cast("int").alias("query_idx"), "label", F.col("embedding").cast("array<double>").alias("x"))
    wanted = e.where("query_idx in (1, 3) and label > 2").select("image_id", "query_idx", "label")
    return P.gathered(e.drop("label"), wanted).select("image_id", "query_idx", "label", r6(F.col("x")[0] + F.col("x")[63]).alias("ends"))


@query("a7_sorted_cells", "SELECT dataset AS layer, label, row_number() OVER (PARTITION BY dataset, label ORDER BY score) AS place, round(score, 6) AS distance FROM boxes WHERE kind = 'GT'")
def a7_sorted_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = view(spark, sf_dir, "boxes").where("kind = 'GT'").select(F.col("dataset").alias("layer"), "label", F.col("score").alias("distance"))
    return P.distance_cells(b, ["layer", "label"]).withColumn("distance", r6(F.col("distance")))


#: Detections with an uncertainty, a pool (in or out of distribution) and correctness.
POOLS = "d AS (SELECT image_id, label, CAST(dataset >= 4 AS INT) AS y, y0 * (1 + dataset % 3) AS unc, score AS conf, box_id % 2 = 0 AS correct FROM boxes WHERE kind = 'DET')"
#: AUROC of table v (variant, y, s) by mean ranks.
RANKED = """r AS (SELECT {keys}, y, rank() OVER (PARTITION BY {keys} ORDER BY s) + (count(*) OVER (PARTITION BY {keys}, s) - 1) / 2.0::DOUBLE AS k FROM v),
    g AS (SELECT {keys}, sum(CASE WHEN y = 1 THEN k ELSE 0 END) AS k, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM r GROUP BY {keys})
    SELECT {keys}, round((k - pos * (pos + 1) / 2) / (pos * neg), 6) AS auroc FROM g WHERE pos > 0 AND neg > 0"""


def _pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = view(spark, sf_dir, "boxes").where("kind = 'DET'")
    return b.select("image_id", "label", (F.col("dataset") >= 4).cast("int").alias("y"), (F.col("y0") * (1 + F.col("dataset") % 3)).alias("unc"), F.col("score").alias("conf"), (F.col("box_id") % 2 == 0).alias("correct"))


@query(
    "a12_eight_auroc_variants",
    f"""WITH {POOLS}, i AS (SELECT y, image_id, avg(unc) AS unc, avg(conf) AS conf, avg(unc) FILTER (correct) AS uncc, avg(conf) FILTER (correct) AS confc FROM d GROUP BY y, image_id),
        v AS (SELECT 'det_unc' AS variant, y, unc AS s FROM d UNION ALL SELECT 'det_1conf', y, 1 - conf FROM d UNION ALL SELECT 'detC_unc', y, unc FROM d WHERE correct UNION ALL SELECT 'detC_1conf', y, 1 - conf FROM d WHERE correct
              UNION ALL SELECT 'img_unc', y, round(unc, 9) FROM i UNION ALL SELECT 'img_1conf', y, round(1 - conf, 9) FROM i UNION ALL SELECT 'imgC_unc', y, round(uncc, 9) FROM i WHERE uncc IS NOT NULL UNION ALL SELECT 'imgC_1conf', y, round(1 - confc, 9) FROM i WHERE confc IS NOT NULL),
        {RANKED.format(keys="variant")}""",
)
def a12_eight_auroc_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By detection and by image mean, uncertainty and 1 - confidence, all detections and correct ones."""
    d = _pools(spark, sf_dir)
    own = {"det_unc": F.col("unc"), "det_1conf": 1 - F.col("conf"), "detC_unc": F.when(F.col("correct"), F.col("unc")), "detC_1conf": F.when(F.col("correct"), 1 - F.col("conf"))}
    mean = lambda c: F.avg(F.when(F.col("correct"), F.col(c)))
    i = d.groupBy("y", "image_id").agg(F.avg("unc").alias("unc"), F.avg("conf").alias("conf"), mean("unc").alias("uncc"), mean("conf").alias("confc"))
    means = {"img_unc": F.round("unc", 9), "img_1conf": F.round(1 - F.col("conf"), 9), "imgC_unc": F.round("uncc", 9), "imgC_1conf": F.round(1 - F.col("confc"), 9)}
    v = R.variants(d, ["y"], own).unionByName(R.variants(i, ["y"], means))
    return R.auroc(v, ["variant"], "y", "score").select("variant", r6(F.col("auroc")).alias("auroc"))


@query(
    "a13_j15_shared_class_metrics",
    f"""WITH {POOLS}, shared AS (SELECT label FROM d WHERE y = 0 AND label <> 2 INTERSECT SELECT label FROM d WHERE y = 1),
        v AS (SELECT label, y, unc AS s FROM d WHERE label IN (SELECT label FROM shared) AND (y = 1 OR label <> 2)),
        n AS (SELECT label, count(*) FILTER (y = 0) AS n_id, count(*) FILTER (y = 1) AS n_ood FROM v GROUP BY label),
        h AS (SELECT label, s, sum(y) AS p, count(*) AS c FROM v GROUP BY label, s), t AS (SELECT *, sum(p) OVER w AS cp, sum(c) OVER w AS cc, sum(p) OVER (PARTITION BY label) AS tp, sum(c) OVER (PARTITION BY label) AS tc FROM h WINDOW w AS (PARTITION BY label ORDER BY s DESC)),
        f AS (SELECT label, round(min((cc - cp) / CAST(tc - tp AS DOUBLE)) FILTER (cp >= 0.95 * tp), 6) AS fpr95, round(sum(p * cp / CAST(cc AS DOUBLE)) / max(tp), 6) AS aupr FROM t GROUP BY label),
        a AS ({RANKED.format(keys="label").replace("r AS (", "SELECT * FROM (WITH r AS (", 1)}))
        SELECT n.label, n_id, n_ood, auroc, fpr95, aupr FROM n JOIN f ON n.label = f.label JOIN a ON a.label = n.label""",
)
def a13_j15_shared_class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by class, for the classes that both pools have; here class 2 is missing from the in-distribution pool."""
    d = _pools(spark, sf_dir).where("y = 1 or label <> 2")
    counts = d.groupBy("label").agg(F.count_if(F.col("y") == 0).alias("n_id"), F.count_if(F.col("y") == 1).alias("n_ood")).where("n_id > 0 and n_ood > 0")
    v = d.join(F.broadcast(counts.select("label")), "label", "left_semi")  # a row for each class
    parts = [R.auroc(v, ["label"], "y", "unc"), R.fpr_at_tpr(v, ["label"], "y", "unc"), R.average_precision(v, ["label"], "y", "unc")]
    out = counts
    for p in parts:
        out = out.join(p, "label")
    return out.select("label", "n_id", "n_ood", *(r6(F.col(c)).alias(c) for c in ("auroc", "fpr95", "aupr")))


@query(
    "o6_distinct_first_index",
    "SELECT l_partkey AS value, min((l_orderkey * 8 + l_linenumber) * 100000 + l_suppkey) AS first FROM lineitem GROUP BY l_partkey",
)
def o6_distinct_first_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct value and the index of its first occurrence in a stated order."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("value"), ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("l_suppkey")).alias("index"))
    return rows.groupBy("value").agg(F.min("index").alias("first"))


@query(
    "t3_one_to_many",
    """WITH l AS (SELECT vec_id // 20 AS image_id, vec_id % 20 AS q, unnest(range(64)) AS c, unnest(embedding) AS s FROM embeddings), r AS (SELECT image_id, q, row_number() OVER (PARTITION BY image_id ORDER BY s DESC, q, c) AS k FROM l)
       SELECT image_id, CAST(q AS INT) AS query_idx, count(*) AS times FROM r WHERE k <= 10 GROUP BY image_id, q""",
)
def t3_one_to_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best (query, class) cells of an image choose queries, a query as often as it has cells among them."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null").select(F.expr("vec_id div 20").alias("image_id"), (F.col("vec_id") % 20).cast("int").alias("query_idx"), F.col("embedding").alias("logits"))
    return P.best_queries(e, 10).groupBy("image_id", "query_idx").agg(F.count(F.lit(1)).alias("times"))


@query(
    "f15_layer_means",
    """WITH e AS (SELECT vec_id, label, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
       SELECT vec_id, round(avg(x) FILTER (vec_id % 5 <> 0 AND (i + vec_id) % 3 <> 0), 6) AS mean, count(*) FILTER (NOT (vec_id % 5 <> 0 AND (i + vec_id) % 3 <> 0)) AS n_missing FROM e GROUP BY vec_id""",
)
def f15_layer_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over the layers that have a finite distance; the class is -1 for the others. A row without any has no mean."""
    nan = F.lit(float("nan"))
    d = F.transform(F.col("embedding").cast("array<double>"), lambda v, i: F.when((F.col("vec_id") % 5 != 0) & ((i + F.col("vec_id")) % 3 != 0), v).otherwise(nan))
    mean, kinds = P.layer_mean(F.col("d"), F.col("label"))
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", "label", d.alias("d"))
    return rows.select("vec_id", r6(mean).alias("mean"), F.size(F.filter(kinds, lambda k: k == -1)).cast("long").alias("n_missing"))


@query("f17_focal_cost", "SELECT image_id, box_id, round(0.25 * pow(1 - score, 2) * -ln(score + 1e-8) - 0.75 * pow(score, 2) * -ln(1 - score + 1e-8), 6) AS cost FROM boxes WHERE kind = 'DET'")
def f17_focal_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "boxes").where("kind = 'DET'").select("image_id", "box_id", r6(S.focal_cost(F.col("score"), 0.25, 2.0)).alias("cost"))


_MIX = "((image_id % 100003) * 9973 + query_idx * 31 + {salt}) * 2654435761 + 11"
_DRAW = lambda salt: f"(({_MIX.format(salt=salt)}) % 4294967296) / 4294967296.0::DOUBLE"
_MOVED = ", ".join(
    f"round(greatest(0, least(1, {n} + CASE WHEN {_DRAW(3 + 2 * c)} < 0.5 THEN -1 ELSE 1 END * ({_DRAW(4 + 2 * c)} + CASE WHEN negative THEN 1 ELSE 0 END) * ({n[0]}1 - {n[0]}0) * 0.5 * 0.4)), 6) AS {n}" for c, n in enumerate(("x0", "y0", "x1", "y1"))
)


@query(
    "x5_denoising_noise",
    f"""WITH g AS (SELECT image_id, box_id AS gt_id, label, x0 / 150 AS x0, y0 / 2000 AS y0, x1 / 150 AS x1, y1 / 2000 AS y1, count(*) OVER (PARTITION BY image_id) AS n, row_number() OVER (PARTITION BY image_id ORDER BY box_id) - 1 AS k FROM boxes WHERE kind = 'GT'),
        t AS (SELECT *, tile // 2 AS grp, tile % 2 = 1 AS negative, tile * n + k AS query_idx FROM g, range(4) r(tile))
        SELECT image_id, gt_id, CAST(grp AS INT) AS grp, negative, query_idx, CAST(CASE WHEN {_DRAW(1)} < 0.25 THEN floor({_DRAW(2)} * 3) ELSE label END AS INT) AS label, {_MOVED} FROM t""",
)
def x5_denoising_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = view(spark, sf_dir, "boxes").where("kind = 'GT'").select("image_id", F.col("box_id").alias("gt_id"), "label", *((F.col(c) / s).alias(c) for c, s in (("x0", 150), ("y0", 2000), ("x1", 150), ("y1", 2000))))
    n = P.noised(g, 2, 3, 0.5, 0.4, 11)
    return n.select("image_id", "gt_id", F.col("grp").cast("int").alias("grp"), "negative", "query_idx", "label", *(r6(F.col(c)).alias(c) for c in ("x0", "y0", "x1", "y1")))


def _model_outputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Outputs (image_id, query_idx, logits, cx, cy, w, h) and activations of ten queries an image, and ground truth for some of them."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", "label", F.expr("vec_id div 10").alias("image_id"), (F.col("vec_id") % 10).cast("int").alias("query_idx"), F.col("embedding").cast("array<double>").alias("x"))
    logits = F.transform(F.slice("x", 1, 10), lambda v, c: 4 * v + F.when(c == F.col("label"), 3.0).otherwise(0.0))
    box = [(0.1 + F.col("query_idx") * 0.08).alias("cx"), (0.2 + (F.col("vec_id") % 7) * 0.1).alias("cy"), F.lit(0.1).alias("w"), F.lit(0.2).alias("h")]
    outputs = e.select("image_id", "query_idx", logits.alias("logits"), *box)
    gt = e.where("query_idx % 2 = 0").select("image_id", F.col("query_idx").cast("long").alias("gt_id"), F.when(F.col("vec_id") % 3 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int").alias("label"), *box)
    a = activations(spark, sf_dir).select(F.expr("vec_id div 10").alias("image_id"), (F.col("vec_id") % 10).cast("int").alias("query_idx"), "layer", "x")
    return outputs, gt, a


@query("u4_scored_detections", None)
def u4_scored_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the images outside of every fifth, as prototypes; the head scores the others."""
    outputs, _, a = _model_outputs(spark, sf_dir)
    means = P.class_means(outputs.where("image_id % 5 <> 0"), a, layer_weights(), 10, 0.5)
    held = outputs.where("image_id % 5 = 0")
    return P.scored_detections(held, a, layer_weights(), means, 20, 0.3).select("image_id", "query_idx", "label", r6(F.col("score")).alias("score"), r6(F.col("tu")).alias("tu"))


@query(
    "u5_selected_layers",
    """WITH m(module, k) AS (VALUES ('linear1', 0), ('linear2', 1), ('score_head', 2), ('bbox_head_0', 3), ('sampling_offsets', 4), ('value_proj', 5))
       SELECT vec_id, CAST(vec_id % 3 AS INT) AS layer, module FROM embeddings JOIN m ON k = vec_id % 6 WHERE module IN ('linear1', 'linear2', 'score_head', 'sampling_offsets') AND vec_id % 3 IN (0, 1)""",
)
def u5_selected_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("linear1", "linear2", "score_head", "bbox_head_0", "sampling_offsets", "value_proj")))
    c = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 3).cast("int").alias("layer"), F.get(names, (F.col("vec_id") % 6).cast("int")).alias("module"))
    return P.selected_layers(c, ["score", "deformable_sampling_offsets"], [0, 1])


@query("u7_classification_means", None)
def u7_classification_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = activations(spark, sf_dir).select(F.col("vec_id").alias("image_id"), "layer", "x")
    m = P.image_class_means(_classified(spark, sf_dir), a, layer_weights(), 0.3)
    return m.select("label", "layer", "n", r6(F.col("m")[0]).alias("first"), r6(S.total(F.col("m"))).alias("total"))


@query("u8_matched_means", None)
def u8_matched_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.matched_means(*_model_outputs(spark, sf_dir), layer_weights())
    return m.select("class_id", "layer", "n", r6(F.col("m")[0]).alias("first"), r6(S.total(F.col("m"))).alias("total"))


@query("u9_conformal_distances", None)
def u9_conformal_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means from matched and correct queries of some images; distances of the correct ones of the others, as sorted cells."""
    outputs, gt, a = _model_outputs(spark, sf_dir)
    part = lambda df, own: df.where(f"image_id % 4 {'=' if own else '<>'} 0")
    means = P.matched_means(part(outputs, False), part(gt, False), a, layer_weights())
    d = P.conformal_distances(P.predictions(part(outputs, True), part(gt, True)), a, layer_weights(), means)
    return P.distance_cells(d, ["layer", "class_id"]).withColumn("distance", r6(F.col("distance")))
