"""Queries on boxes and scores of detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwise.functions import boxes as B
from boxwise.functions import scalars as S
from boxwise.operators import ranking as R
from boxwise.plans.registry import query
from boxwise.plans.views import table, view



def xyxy() -> B.Box:
    return B.columns("x0", "y0", "x1", "y1")


def gt_box() -> B.Box:
    return B.columns("gx0", "gy0", "gx1", "gy1")


def det_box() -> B.Box:
    return B.columns("dx0", "dy0", "dx1", "dy1")


def sides(boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ground truth and detections, with columns gt_id, gx0... and det_id, dx0..., score."""
    gt = boxes.where("kind = 'GT'").selectExpr("image_id", "label", "box_id AS gt_id", "x0 AS gx0", "y0 AS gy0", "x1 AS gx1", "y1 AS gy1")
    det = boxes.where("kind = 'DET'").selectExpr("image_id", "label", "box_id AS det_id", "score", "x0 AS dx0", "y0 AS dy0", "x1 AS dx1", "y1 AS dy1")
    return gt, det


def pairs(boxes: DataFrame) -> DataFrame:
    """Ground truth and detections of one image and label."""
    gt, det = sides(boxes)
    return gt.join(det, ["image_id", "label"])


def r6(c: F.Column) -> F.Column:
    return F.round(c, 6)


#: Pairs in DuckDB.
PAIRS = """pairs AS (
    SELECT g.image_id, g.label, g.box_id AS gt_id, d.box_id AS det_id, d.score,
           g.x0 AS gx0, g.y0 AS gy0, g.x1 AS gx1, g.y1 AS gy1, d.x0 AS dx0, d.y0 AS dy0, d.x1 AS dx1, d.y1 AS dy1,
           greatest(least(g.x1, d.x1) - greatest(g.x0, d.x0), 0) * greatest(least(g.y1, d.y1) - greatest(g.y0, d.y0), 0) AS i,
           (g.x1 - g.x0) * (g.y1 - g.y0) + (d.x1 - d.x0) * (d.y1 - d.y0) AS s,
           (greatest(g.x1, d.x1) - least(g.x0, d.x0)) * (greatest(g.y1, d.y1) - least(g.y0, d.y0)) AS c
    FROM boxes g JOIN boxes d ON g.image_id = d.image_id AND g.label = d.label AND g.kind = 'GT' AND d.kind = 'DET')"""


@query(
    "f1_box_formats",
    """SELECT image_id, box_id, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, x1 - x0 AS w, y1 - y0 AS h, (x1 - x0) * (y1 - y0) AS area,
              round((x0 + x1) / 2 / 160, 6) AS ncx, round((y1 - y0) / 130, 6) AS nh, x0 AS back_x0, y1 AS back_y1 FROM boxes""",
)
def f1_box_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.xyxy_to_cxcywh(xyxy())
    n = B.normalise(c, 160.0, 130.0)
    back = B.xywh_to_xyxy(B.xyxy_to_xywh(xyxy()))
    return view(spark, sf_dir, "boxes").select("image_id", "box_id", *(x.alias(k) for x, k in zip(c, ("cx", "cy", "w", "h"), strict=True)), B.area(xyxy()).alias("area"), r6(n[0]).alias("ncx"), r6(n[3]).alias("nh"), back[0].alias("back_x0"), back[3].alias("back_y1"))


@query(
    "p2_clip_and_drop_degenerate",
    """SELECT * FROM (SELECT image_id, box_id, greatest(0, least(90, x0)) AS x0, greatest(0, least(60, y0)) AS y0, greatest(0, least(90, x1)) AS x1, greatest(0, least(60, y1)) AS y1 FROM boxes)
       WHERE x1 > x0 AND y1 > y0""",
)
def p2_clip_and_drop_degenerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    clipped = B.clip_to_image(xyxy(), 90.0, 60.0)
    out = view(spark, sf_dir, "boxes").select("image_id", "box_id", *(x.alias(k) for x, k in zip(clipped, ("x0", "y0", "x1", "y1"), strict=True)))
    return out.where(B.is_valid(xyxy()))


@query(
    "j4_pairwise_overlap",
    f"""WITH {PAIRS} SELECT image_id, label, count(*) AS n_pairs, round(sum(i / (s - i)), 6) AS sum_iou, round(sum(i / (s - i) - (c - (s - i)) / c), 6) AS sum_giou,
        round(sum(abs(gx0 - dx0) + abs(gy0 - dy0) + abs(gx1 - dx1) + abs(gy1 - dy1)), 6) AS sum_l1, CAST(sum(CASE WHEN i / (s - i) >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS n_half
        FROM pairs GROUP BY image_id, label""",
)
def j4_pairwise_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(view(spark, sf_dir, "boxes"))
    return p.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("n_pairs"), r6(F.sum(B.iou(gt_box(), det_box()))).alias("sum_iou"), r6(F.sum(B.giou(gt_box(), det_box()))).alias("sum_giou"), r6(F.sum(B.l1(gt_box(), det_box()))).alias("sum_l1"), F.count_if(B.iou(gt_box(), det_box()) >= 0.5).alias("n_half"))


@query(
    "f2_iou_guards",
    f"""WITH {PAIRS} SELECT image_id, gt_id, det_id, round(i / (s - i), 6) AS zero, round(i / (s - i), 6) AS floor, round(i / (s - i), 6) AS none FROM pairs
        UNION ALL SELECT image_id, box_id, box_id, 0, 0, NULL FROM boxes""",
)
def f2_iou_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each guard on all pairs, and on every box collapsed to a point."""
    b, point = view(spark, sf_dir, "boxes"), B.columns("x0", "y0", "x0", "y0")
    guarded = lambda x, y: [r6(B.iou(x, y)).alias("zero"), r6(B.iou(x, y, "floor")).alias("floor"), r6(B.iou(x, y, "null")).alias("none")]
    points = b.select("image_id", F.col("box_id").alias("gt_id"), F.col("box_id").alias("det_id"), *guarded(point, point))
    return pairs(b).select("image_id", "gt_id", "det_id", *guarded(gt_box(), det_box())).unionByName(points)


@query(
    "p15_points_in_boxes",
    f"""WITH {PAIRS}, q AS (SELECT *, (dx0 + dx1) / 2 AS px, (dy0 + dy1) / 2 AS py FROM pairs)
        SELECT image_id, count(*) AS n, CAST(sum(CASE WHEN least(px - gx0, py - gy0, gx1 - px, gy1 - py) > 1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS n_inside,
               sum(px - gx0) AS sum_left, sum(gy1 - py) AS sum_bottom FROM q GROUP BY image_id""",
)
def p15_points_in_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, py = (F.col("dx0") + F.col("dx1")) / 2, (F.col("dy0") + F.col("dy1")) / 2
    d = B.edge_distances(px, py, gt_box())
    back = B.box_of_distances(px, py, d)
    p = pairs(view(spark, sf_dir, "boxes")).where(F.abs(back[0] - F.col("gx0")) < 1e-6)
    return p.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(B.contains(px, py, gt_box())).alias("n_inside"), F.sum(d[0]).alias("sum_left"), F.sum(d[3]).alias("sum_bottom"))


@query(
    "f3_f4_box_transforms",
    """SELECT image_id, box_id, 200 - x1 AS flip_x0, 200 - x0 AS flip_x1, greatest(0, least(50, x0 - 10)) AS crop_x0, greatest(0, least(40, y1 - 5)) AS crop_y1,
              round(x0 * 1.5, 6) AS resize_x0, round((x0 / 640 * 640 - 8) * (200 / 300.0::DOUBLE), 6) AS revert_x0 FROM boxes""",
)
def f3_f4_box_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    flipped, cropped, resized = B.flip(xyxy(), 200.0), B.crop(xyxy(), 5.0, 10.0, 40.0, 50.0), B.resize(xyxy(), 1.5, 1.0)
    back = B.revert(B.normalise(xyxy(), 640.0, 640.0), (640.0, 640.0), (F.lit(200.0), F.lit(150.0)), (F.lit(300.0), F.lit(225.0)), (8.0, 0.0))
    return view(spark, sf_dir, "boxes").select("image_id", "box_id", flipped[0].alias("flip_x0"), flipped[2].alias("flip_x1"), cropped[0].alias("crop_x0"), cropped[3].alias("crop_y1"), r6(resized[0]).alias("resize_x0"), r6(back[0]).alias("revert_x0"))


@query(
    "f11_uncertainty_envelope",
    """WITH n AS (SELECT image_id, box_id, (x0 + x1) / 400 AS cx, (x1 - x0) / 200 AS w, exp(greatest(-10, least(4, -6 + score)) / 2) AS s FROM boxes)
       SELECT image_id, box_id, round(greatest(0, least(1, cx - 1.96 * s - (w + 1.96 * s) / 2)), 6) AS low, round(greatest(0, least(1, cx + 1.96 * s + (w + 1.96 * s) / 2)), 6) AS high FROM n""",
)
def f11_uncertainty_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = B.normalise(B.xyxy_to_cxcywh(xyxy()), 200.0, 200.0)
    s = F.exp(S.clamp(F.col("score") - 6, -10.0, 4.0) / 2)
    e = B.envelope(n, (s, s, s, s))
    return view(spark, sf_dir, "boxes").select("image_id", "box_id", r6(e[0]).alias("low"), r6(e[2]).alias("high"))


@query("p5_p6_confidence_filters", "SELECT label, CAST(sum(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS inclusive, CAST(sum(CASE WHEN score > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS strict FROM boxes WHERE kind = 'DET' GROUP BY label")
def p5_p6_confidence_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "boxes").where("kind = 'DET'").groupBy("label").agg(F.count_if(F.col("score") >= 0.5).alias("inclusive"), F.count_if(F.col("score") > 0.5).alias("strict"))


@query(
    "f6_f7_logit_functions",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings)
       SELECT vec_id, CAST(list_position(x, list_max(x)) - 1 AS INT) AS best, round(list_max(x), 6) AS top, round(1 / (1 + exp(-x[1])), 6) AS sig,
              round(exp(x[1] - list_max(x)) / list_sum(list_transform(x, lambda v: exp(v - list_max(x)))), 6) AS soft,
              round(ln(greatest(least(greatest(x[2], 0), 1), 1e-5) / greatest(1 - least(greatest(x[2], 0), 1), 1e-5)), 6) AS inv, vec_id // 7 AS query_idx, vec_id % 7 AS class_idx FROM e""",
)
def f6_f7_logit_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return e.select("vec_id", S.argmax(F.col("x")).alias("best"), r6(F.array_max("x")).alias("top"), r6(S.sigmoid(F.col("x")[0])).alias("sig"), r6(S.softmax(F.col("x"))[0]).alias("soft"), r6(S.inverse_sigmoid(F.col("x")[1])).alias("inv"), F.expr("vec_id div 7").alias("query_idx"), F.expr("vec_id % 7").alias("class_idx"))


@query(
    "f10_logvar_uncertainty",
    """WITH e AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: greatest(-10, least(4, 20 * CAST(x AS DOUBLE)))) AS v FROM embeddings)
       SELECT vec_id, round(list_avg(list_transform(v, lambda x: exp(x / 2))), 6) AS mean_std, round(list_max(list_transform(v, lambda x: exp(x / 2))), 6) AS max_std, round(list_sum(v), 6) AS logdet FROM e""",
)
def f10_logvar_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 4), lambda x: 20 * x)
    return table(spark, sf_dir, "embeddings").select("vec_id", *(r6(S.uncertainty(v, m)).alias(m) for m in ("mean_std", "max_std", "logdet")))


@query(
    "f19_f21_text_functions",
    """SELECT event_id, regexp_replace(regexp_replace(props, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, printf('%.4f', value) AS fixed,
              TRY_CAST(event_type AS DOUBLE) AS parsed, CASE WHEN event_type LIKE 'p%' THEN substr(event_type, 2) ELSE event_type END AS stripped, 'img_' || event_id AS stem FROM events""",
)
def f19_f21_text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("data/v1.0/img_"), F.col("event_id").cast("string"), F.lit(".jpg"))
    return table(spark, sf_dir, "events").select("event_id", S.slug(F.col("props")).alias("slug"), S.fixed4(F.col("value")).alias("fixed"), S.parse_float(F.col("event_type")).alias("parsed"), S.strip_prefix(F.col("event_type"), "p").alias("stripped"), S.stem(path).alias("stem"))


@query(
    "f18_anchor_grid",
    """WITH l(level, n) AS (VALUES (0, 80), (1, 40), (2, 20)), g AS (SELECT level, n, unnest(range(n)) AS x FROM l), h AS (SELECT level, n, x, unnest(range(n)) AS y FROM g),
       a AS (SELECT CAST(level AS INT) AS level, CAST(x AS INT) AS gx, CAST(y AS INT) AS gy, (x + 0.5::DOUBLE) / n AS cx, (y + 0.5::DOUBLE) / n AS cy, 0.05::DOUBLE * pow(2.0::DOUBLE, level) AS side FROM h)
       SELECT level, gx, gy, round(ln(cx / (1 - cx)), 6) AS logit_cx, round(ln(cy / (1 - cy)), 6) AS logit_cy, round(ln(side / (1 - side)), 6) AS logit_side FROM a WHERE cx > 0.01 AND cx < 0.99 AND cy > 0.01 AND cy < 0.99""",
)
def f18_anchor_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors whose coordinates all lie within (eps, 1 - eps), in logits."""
    levels = spark.createDataFrame([(0, 80), (1, 40), (2, 20)], "level int, n int")
    cells = levels.select("level", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("gx")).select("level", "n", "gx", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("gy"))
    side = 0.05 * F.pow(F.lit(2.0), F.col("level"))
    anchor = F.array((F.col("gx") + 0.5) / F.col("n"), (F.col("gy") + 0.5) / F.col("n"), side, side)
    inside = cells.withColumn("a", anchor).where(F.forall("a", lambda v: (v > 0.01) & (v < 0.99)))
    logit = lambda k: r6(F.log(F.col("a")[k] / (1 - F.col("a")[k])))
    return inside.select("level", "gx", "gy", logit(0).alias("logit_cx"), logit(1).alias("logit_cy"), logit(2).alias("logit_side"))


# Ranking metrics. y: 1 for the kind that should score high.

POOL = "SELECT label AS grp, CASE WHEN kind = 'GT' THEN 1 ELSE 0 END AS y, round(score, 2) AS u, image_id * 1000 + box_id AS id, score AS risk FROM boxes"


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "boxes").selectExpr("label AS grp", "CASE WHEN kind = 'GT' THEN 1 ELSE 0 END AS y", "round(score, 2) AS u", "image_id * 1000 + box_id AS id", "score AS risk")


@query(
    "a11_auroc",
    """SELECT round(sum(CASE WHEN a.u > b.u THEN 1.0::DOUBLE WHEN a.u = b.u THEN 0.5 ELSE 0 END) / count(*), 6) AS auroc
       FROM (SELECT u FROM scores WHERE y = 1) a, (SELECT u FROM scores WHERE y = 0) b""",
)
def a11_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = view(spark, sf_dir, "scores").withColumn("g", F.lit(0))
    return R.auroc(one, ["g"], "y", "u").select(r6(F.col("auroc")).alias("auroc"))


@query(
    "a13_auroc_per_class",
    f"""WITH p AS ({POOL}), r AS (SELECT grp, y, avg(k) OVER (PARTITION BY grp, u) AS k FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY u) AS k FROM p))
        SELECT grp, round((sum(CASE WHEN y = 1 THEN k ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y))), 6) AS auroc FROM r GROUP BY grp""",
)
def a13_auroc_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.auroc(pool(spark, sf_dir), ["grp"], "y", "u").select("grp", r6(F.col("auroc")).alias("auroc"))


@query(
    "a12_auroc_variants",
    """WITH v AS (SELECT 'unc' AS variant, 1 - y AS y, u AS s FROM scores UNION ALL SELECT 'one_minus_conf', 1 - y, 1 - u / 1000 FROM scores
                  UNION ALL SELECT 'unc_toxic', toxic, u FROM scores)
       SELECT a.variant, round(sum(CASE WHEN a.s > b.s THEN 1.0::DOUBLE WHEN a.s = b.s THEN 0.5 ELSE 0 END) / count(*), 6) AS auroc
       FROM (SELECT * FROM v WHERE y = 1) a JOIN (SELECT * FROM v WHERE y = 0) b ON a.variant = b.variant GROUP BY a.variant""",
)
def a12_auroc_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "scores")
    ood = R.variants(s.withColumn("y", 1 - F.col("y")), ["y"], {"unc": "u", "one_minus_conf": 1 - F.col("u") / 1000})
    toxic = R.variants(s.withColumn("y", F.col("toxic")), ["y"], {"unc_toxic": "u"})
    return R.auroc(ood.unionByName(toxic), ["variant"], "y", "score").select("variant", r6(F.col("auroc")).alias("auroc"))


@query(
    "a14_average_precision",
    f"""WITH p AS ({POOL}), h AS (SELECT grp, u, sum(y) AS p, count(*) AS c FROM p GROUP BY grp, u),
        w AS (SELECT a.grp, a.u, any_value(a.p) AS p, sum(b.p) AS cp, sum(b.c) AS cc FROM h a JOIN h b ON a.grp = b.grp AND b.u >= a.u GROUP BY a.grp, a.u)
        SELECT grp, round(sum(p * cp / cc::DOUBLE) / sum(p), 6) AS aupr FROM w GROUP BY grp""",
)
def a14_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.average_precision(pool(spark, sf_dir), ["grp"], "y", "u").select("grp", r6(F.col("aupr")).alias("aupr"))


@query(
    "a15_average_precision_ordered",
    f"""WITH p AS ({POOL}), w AS (SELECT grp, y, sum(y) OVER o AS cp, row_number() OVER o AS k FROM p WINDOW o AS (PARTITION BY grp ORDER BY u DESC, id))
        SELECT grp, round(sum(y * cp / k::DOUBLE) / sum(y), 6) AS aupr_ordered FROM w GROUP BY grp""",
)
def a15_average_precision_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.average_precision_ordered(pool(spark, sf_dir), ["grp"], "y", "u", "id").select("grp", r6(F.col("aupr_ordered")).alias("aupr_ordered"))


@query(
    "a16_fpr95",
    f"""WITH p AS ({POOL}), h AS (SELECT DISTINCT grp, u FROM p),
        t AS (SELECT h.grp, h.u, avg(CASE WHEN y = 1 THEN CASE WHEN p.u >= h.u THEN 1.0::DOUBLE ELSE 0 END END) AS tpr, avg(CASE WHEN y = 0 THEN CASE WHEN p.u >= h.u THEN 1.0::DOUBLE ELSE 0 END END) AS fpr FROM h JOIN p ON h.grp = p.grp GROUP BY h.grp, h.u)
        SELECT grp, round(coalesce(min(CASE WHEN tpr >= 0.95 THEN fpr END), 1), 6) AS fpr95 FROM t GROUP BY grp""",
)
def a16_fpr95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fpr_at_tpr(pool(spark, sf_dir), ["grp"], "y", "u").select("grp", r6(F.col("fpr95")).alias("fpr95"))


CURVE = f"p AS ({POOL}), w AS (SELECT grp, {{value}} AS v, avg({{value}}) OVER (PARTITION BY grp ORDER BY {{by}}, id ROWS UNBOUNDED PRECEDING) AS r, row_number() OVER (PARTITION BY grp ORDER BY {{by}}, id) AS k, count(*) OVER (PARTITION BY grp) AS n FROM p)"


@query(
    "a17_aurc_eaurc",
    f"""WITH {CURVE.format(value="y", by="u")}, t AS (SELECT grp, (r + lag(r) OVER (PARTITION BY grp ORDER BY k)) / 2 / n AS a FROM w), m AS (SELECT grp, sum(a) AS aurc FROM t GROUP BY grp),
        o AS (SELECT grp, avg(y) OVER (PARTITION BY grp ORDER BY y, id ROWS UNBOUNDED PRECEDING) AS r, row_number() OVER (PARTITION BY grp ORDER BY y, id) AS k, count(*) OVER (PARTITION BY grp) AS n FROM p),
        q AS (SELECT grp, sum(a) AS best FROM (SELECT grp, (r + lag(r) OVER (PARTITION BY grp ORDER BY k)) / 2 / n AS a FROM o) GROUP BY grp)
        SELECT m.grp, round(aurc, 6) AS aurc, round(aurc - best, 6) AS eaurc FROM m JOIN q ON m.grp = q.grp""",
)
def a17_aurc_eaurc(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pool(spark, sf_dir)
    own = R.aurc_trapezoid(R.selective_risk(p, ["grp"], "y", "u", "id"), ["grp"])
    best = R.aurc_trapezoid(R.selective_risk(p, ["grp"], "y", "y", "id"), ["grp"]).withColumnRenamed("aurc", "best")
    return own.join(best, "grp").select("grp", r6(F.col("aurc")).alias("aurc"), r6(F.col("aurc") - F.col("best")).alias("eaurc"))


@query(
    "a18_selective_risk_means",
    f"""WITH {CURVE.format(value="risk", by="u")}, o AS (SELECT grp, avg(risk) OVER (PARTITION BY grp ORDER BY risk, id ROWS UNBOUNDED PRECEDING) AS r FROM p)
        SELECT a.grp, a.aurc, b.oracle, a.random_expected FROM (SELECT grp, round(avg(r), 6) AS aurc, round(avg(v), 6) AS random_expected FROM w GROUP BY grp) a
        JOIN (SELECT grp, round(avg(r), 6) AS oracle FROM o GROUP BY grp) b ON a.grp = b.grp""",
)
def a18_selective_risk_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pool(spark, sf_dir)
    own = R.aurc_mean(R.selective_risk(p, ["grp"], "risk", "u", "id"), ["grp"])
    best = R.aurc_mean(R.selective_risk(p, ["grp"], "risk", "risk", "id"), ["grp"]).withColumnRenamed("aurc", "oracle")
    random = p.groupBy("grp").agg(F.avg("risk").alias("random_expected"))
    return own.join(best, "grp").join(random, "grp").select("grp", *(r6(F.col(c)).alias(c) for c in ("aurc", "oracle", "random_expected")))


@query(
    "a19_selective_risk_at_coverage",
    f"""WITH {CURVE.format(value="risk", by="u")}, q(requested) AS (VALUES (0.5::DOUBLE), (0.8), (0.9), (1.0))
        SELECT grp, requested, round(r, 6) AS selective_risk FROM w, q WHERE k = greatest(1, CAST(ceil(round(requested * n, 9)) AS BIGINT))""",
)
def a19_selective_risk_at_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = R.risk_coverage(pool(spark, sf_dir), ["grp"], "risk", "u", "id")
    return R.risk_at(curve, ["grp"], [0.5, 0.8, 0.9, 1.0]).select("grp", "requested", r6(F.col("selective_risk")).alias("selective_risk"))


@query(
    "a22_spearman",
    f"""WITH p AS ({POOL}), a AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY u) AS ku, row_number() OVER (PARTITION BY grp ORDER BY risk) AS kr FROM p),
        b AS (SELECT grp, avg(ku) OVER (PARTITION BY grp, u) AS ru, avg(kr) OVER (PARTITION BY grp, risk) AS rr FROM a)
        SELECT grp, round(corr(ru, rr), 6) AS spearman FROM b GROUP BY grp""",
)
def a22_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.spearman(pool(spark, sf_dir), ["grp"], "u", "risk").select("grp", r6(F.col("spearman")).alias("spearman"))
