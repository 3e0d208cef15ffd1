"""Queries on matches, statistics, windows, top-k, bins, sets and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwise.functions import boxes as B
from boxwise.functions import scalars as S
from boxwise.operators import matching as M
from boxwise.operators import ordered as O
from boxwise.operators import ranking as R
from boxwise.operators import statistics as T
from boxwise.plans.boxes_queries import PAIRS, pairs, r6, sides, xyxy
from boxwise.plans.registry import query
from boxwise.plans.views import table, view

#: Greedy matching in DuckDB: one detection of every image and label at a time.
GREEDY = f"""{PAIRS}, wishes AS (SELECT image_id, label, det_id, score, list(gt_id ORDER BY i / (s - i) DESC, gt_id DESC) AS wants FROM pairs WHERE i / (s - i) >= 0.5 GROUP BY image_id, label, det_id, score),
    ranks AS (SELECT *, row_number() OVER (PARTITION BY image_id, label ORDER BY score DESC, det_id) AS k FROM wishes),
    fold(image_id, label, k, det_id, got, used) AS (
        SELECT image_id, label, k, det_id, wants[1], [wants[1]] FROM ranks WHERE k = 1
        UNION ALL SELECT r.image_id, r.label, r.k, r.det_id, list_filter(r.wants, lambda g: NOT list_contains(f.used, g))[1], list_append(f.used, list_filter(r.wants, lambda g: NOT list_contains(f.used, g))[1])
        FROM fold f JOIN ranks r ON r.image_id = f.image_id AND r.label = f.label AND r.k = f.k + 1)"""


@query(
    "j8_greedy_match",
    f"""WITH RECURSIVE {GREEDY} SELECT d.image_id, d.label, d.box_id AS det_id, d.score, coalesce(f.got, -1) AS gt_id, f.got IS NOT NULL AS matched
        FROM boxes d LEFT JOIN fold f ON f.image_id = d.image_id AND f.label = d.label AND f.det_id = d.box_id WHERE d.kind = 'DET'""",
)
def j8_greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, det = sides(view(spark, sf_dir, "boxes"))
    return M.greedy_match(det, gt).withColumn("gt_id", F.coalesce("gt_id", F.lit(-1)))


@query(
    "j8_greedy_match_auroc",
    f"""WITH RECURSIVE {GREEDY}, m AS (SELECT d.label, d.score, f.got IS NOT NULL AS ok FROM boxes d LEFT JOIN fold f ON f.image_id = d.image_id AND f.label = d.label AND f.det_id = d.box_id WHERE d.kind = 'DET'),
        r AS (SELECT label, ok, avg(k) OVER (PARTITION BY label, score) AS k FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score) AS k FROM m))
        SELECT label, round((sum(CASE WHEN ok THEN k ELSE 0 END) - count_if(ok) * (count_if(ok) + 1) / 2.0::DOUBLE) / (count_if(ok) * count_if(NOT ok)), 6) AS auroc FROM r GROUP BY label""",
)
def j8_greedy_match_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well scores separate matched from unmatched detections, by label."""
    gt, det = sides(view(spark, sf_dir, "boxes"))
    flags = M.greedy_match(det, gt).withColumn("y", F.col("matched").cast("int"))
    return R.auroc(flags, ["label"], "y", "score").select("label", r6(F.col("auroc")).alias("auroc"))


@query(
    "j1_images_with_annotations",
    """SELECT o_orderkey AS image_id, count(l_orderkey) AS n_boxes, round(coalesce(sum(l_quantity), 0), 6) AS total FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
)
def j1_images_with_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images stay without annotations too. Lines are summed by image before they meet."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("image_id")).agg(F.count(F.lit(1)).alias("n_boxes"), F.sum("l_quantity").alias("total"))
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"))
    return images.join(lines, "image_id", "left").select("image_id", F.coalesce("n_boxes", F.lit(0)).alias("n_boxes"), r6(F.coalesce("total", F.lit(0.0))).alias("total"))


@query(
    "j2_category_remap",
    """WITH c AS (SELECT p_brand, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INT) AS label FROM (SELECT DISTINCT p_brand FROM part))
       SELECT p_partkey, part.p_brand, label FROM part JOIN c ON part.p_brand = c.p_brand""",
)
def j2_category_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category names get contiguous labels in their order (P13); the dimension has one row a category."""
    from pyspark.sql import Window

    part = table(spark, sf_dir, "part")
    labels = part.select("p_brand").distinct().withColumn("label", (F.dense_rank().over(Window.orderBy("p_brand")) - 1).cast("int"))
    return part.join(labels, "p_brand").select("p_partkey", "p_brand", "label")


@query(
    "j12_nms",
    """WITH RECURSIVE d AS (SELECT image_id, label, box_id, score, x0, y0, x1, y1, row_number() OVER (PARTITION BY image_id, label ORDER BY score DESC, box_id) AS k FROM boxes WHERE kind = 'DET' AND score > 0.1),
        s AS (SELECT DISTINCT image_id, label, 0::BIGINT AS k, []::STRUCT(x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[] AS kept, false AS stays FROM d
            UNION ALL
            SELECT image_id, label, k, CASE WHEN stays THEN list_append(kept, own) ELSE kept END, stays
            FROM (SELECT s.image_id, s.label, d.k, kept, {'x0': d.x0, 'y0': d.y0, 'x1': d.x1, 'y1': d.y1} AS own,
                    len(list_filter(kept, lambda b: greatest(least(b.x1, d.x1) - greatest(b.x0, d.x0), 0) * greatest(least(b.y1, d.y1) - greatest(b.y0, d.y0), 0) > 0.5 * ((b.x1 - b.x0) * (b.y1 - b.y0) + (d.x1 - d.x0) * (d.y1 - d.y0) - greatest(least(b.x1, d.x1) - greatest(b.x0, d.x0), 0) * greatest(least(b.y1, d.y1) - greatest(b.y0, d.y0), 0)))) = 0 AS stays
                  FROM s JOIN d ON d.image_id = s.image_id AND d.label = s.label AND d.k = s.k + 1)),
        r AS (SELECT d.*, row_number() OVER (PARTITION BY d.image_id ORDER BY score DESC, box_id) AS place FROM s JOIN d ON d.image_id = s.image_id AND d.label = s.label AND d.k = s.k WHERE stays)
        SELECT image_id, label, box_id, score, x0, y0, x1, y1 FROM r WHERE place <= 100""",
)
def j12_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.nms(view(spark, sf_dir, "boxes").where("kind = 'DET'"), 0.5, 100, 0.1)


@query("j10_hungarian_match", None)
def j10_hungarian_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = [x / 200 for x in B.xyxy_to_cxcywh(xyxy())]
    # A logit for each of the three labels: the box's own and, lower, those of the others.
    logits = F.transform(F.array(*map(F.lit, range(3))), lambda c: F.when(c == F.col("label"), 6 * F.col("score") - 3).otherwise(-3 * F.col("score") - c))
    rows = view(spark, sf_dir, "boxes").select("image_id", "label", "box_id", "kind", logits.alias("logits"), *(x.alias(k) for x, k in zip(n, ("cx", "cy", "w", "h"), strict=True)))
    return M.hungarian_match(rows.where("kind = 'DET'").withColumnRenamed("box_id", "det_id"), rows.where("kind = 'GT'").withColumnRenamed("box_id", "gt_id"))


@query("j11_overlap_assignment", None)
def j11_overlap_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt, det = sides(view(spark, sf_dir, "boxes"))
    return M.overlap_assignment(det, gt)


@query("j11_false_and_missed", None)
def j11_false_and_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every detection and ground truth once: matched, false or missed."""
    gt, det = sides(view(spark, sf_dir, "boxes"))
    return M.overlap_outcomes(det, gt)


@query(
    "j14_match_label_scatter",
    """SELECT d.image_id, d.box_id, coalesce(g.label, -1) AS target FROM boxes d LEFT JOIN boxes g ON g.image_id = d.image_id AND g.box_id = d.box_id + 1 AND g.kind = 'GT' WHERE d.kind = 'DET'""",
)
def j14_match_label_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels go to the matched detections, -1 to the rest."""
    b = view(spark, sf_dir, "boxes")
    gt = b.where("kind = 'GT'").select("image_id", (F.col("box_id") - 1).alias("box_id"), F.col("label").alias("target"))
    return b.where("kind = 'DET'").select("image_id", "box_id").join(gt, ["image_id", "box_id"], "left").withColumn("target", F.coalesce("target", F.lit(-1)))


@query(
    "j17_denoising_indices",
    """SELECT image_id, g.box_id AS gt_id, CAST(grp AS INT) AS grp, grp * n + row_number() OVER (PARTITION BY image_id, grp ORDER BY g.box_id) - 1 AS query_idx
       FROM (SELECT *, count(*) OVER (PARTITION BY image_id) AS n FROM boxes WHERE kind = 'GT') g, range(5) t(grp)""",
)
def j17_denoising_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image's ground truth is tiled over groups of queries."""
    from pyspark.sql import Window

    gt = view(spark, sf_dir, "boxes").where("kind = 'GT'").select("image_id", F.col("box_id").alias("gt_id"))
    own = Window.partitionBy("image_id")
    numbered = gt.withColumn("n", F.count(F.lit(1)).over(own)).withColumn("k", F.row_number().over(own.orderBy("gt_id")) - 1)
    return numbered.select("image_id", "gt_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("grp"), "n", "k").select("image_id", "gt_id", "grp", (F.col("grp") * F.col("n") + F.col("k")).alias("query_idx"))


@query(
    "j19_state_match",
    """SELECT coalesce(s.s_suppkey, c.c_custkey) AS key, CASE WHEN c_custkey IS NULL THEN 'extra' WHEN s_suppkey IS NULL THEN 'missed' WHEN s_nationkey = c_nationkey THEN 'matched' ELSE 'unmatched' END AS outcome
       FROM supplier s FULL JOIN customer c ON s_suppkey = c_custkey""",
)
def j19_state_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS key", "s_nationkey AS shape")
    want = table(spark, sf_dir, "customer").selectExpr("c_custkey AS key", "c_nationkey AS shape")
    return M.state_match(have, want, "key", "shape")


EMB = "e AS (SELECT vec_id, label, CAST(vec_id % 3 AS INT) AS layer, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("vec_id") % 3).cast("int").alias("layer"), F.col("embedding").cast("array<double>").alias("x"))


@query(
    "a2_frechet_mean",
    f"""WITH {EMB}, u AS (SELECT label, layer, unnest(range(len(x))) AS i, unnest(x) AS v FROM e), m AS (SELECT label, layer, i, avg(v) AS m, count(*) AS n FROM u GROUP BY ALL)
        SELECT label, layer, CAST(i AS INT) AS i, n, round(m, 6) AS m FROM m""",
)
def a2_frechet_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.vector_mean(vectors(spark, sf_dir), ["label", "layer"], "x").select("label", "layer", F.posexplode("m").alias("i", "m"), "n").select("label", "layer", "i", "n", r6(F.col("m")).alias("m"))


@query(
    "a3_two_level_mean",
    f"""WITH {EMB}, u AS (SELECT label, vec_id // 7 AS image_id, unnest(range(len(x))) AS i, unnest(x) AS v FROM e), m AS (SELECT label, image_id, i, avg(v) AS m FROM u GROUP BY ALL)
        SELECT label, CAST(i AS INT) AS i, count(*) AS n, round(avg(m), 6) AS m FROM m GROUP BY label, i""",
)
def a3_two_level_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).withColumn("image_id", F.expr("vec_id div 7"))
    return T.two_level_mean(v, ["image_id"], ["label"], "x").select("label", F.posexplode("m").alias("i", "m"), "n").select("label", "i", "n", r6(F.col("m")).alias("m"))


@query(
    "a4_merge_partials",
    "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type",
)
def a4_merge_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial sums of each shard merge to the global mean."""
    parts = table(spark, sf_dir, "events").groupBy("event_type", (F.col("event_id") % 8).alias("shard")).agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))
    return T.merge_partials(parts, ["event_type"]).select("event_type", "n", r6(F.col("mean")).alias("mean"))


@query("a1_class_histogram", "SELECT label, kind, count(*) AS n FROM boxes GROUP BY label, kind")
def a1_class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "boxes").groupBy("label", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a24_class_heterogeneity",
    """WITH s AS (SELECT event_type, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std FROM events GROUP BY event_type),
       t AS (SELECT count(*) AS n_classes, stddev_pop(mean) AS b, sqrt(sum(n * std * std) / sum(n)) AS w FROM s WHERE n >= 20)
       SELECT n_classes, round(b, 6) AS between, round(w, 6) AS within, round(b / w, 6) AS ratio, CASE WHEN b / w >= 1 THEN 'high' WHEN b / w >= 0.5 THEN 'moderate' ELSE 'low' END AS verdict FROM t""",
)
def a24_class_heterogeneity(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return T.heterogeneity(stats).select("n_classes", *(r6(F.col(c)).alias(c) for c in ("between", "within", "ratio")), "verdict")


@query(
    "a38_layer_class_matrix",
    "SELECT user_id % 10 AS layer, round(avg(value) FILTER (event_type = 'click'), 6) AS click, round(avg(value) FILTER (event_type = 'view'), 6) AS \"view\" FROM events GROUP BY ALL",
)
def a38_layer_class_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("layer", F.col("user_id") % 10)
    return e.groupBy("layer").pivot("event_type", ["click", "view"]).agg(r6(F.avg("value")))


@query(
    "a9_a10_image_means",
    """WITH m AS (SELECT image_id, avg(score) FILTER (kind = 'DET') AS m, avg(score) FILTER (kind = 'DET' AND box_id % 2 = 0) AS c FROM boxes GROUP BY image_id)
       SELECT image_id, round(m, 6) AS mean_score, round(c, 6) AS mean_correct, m IS NULL AS empty FROM m""",
)
def a9_a10_image_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over detections and over correct ones; images without keep NULL and count as empty."""
    det = F.col("kind") == "DET"
    means = view(spark, sf_dir, "boxes").groupBy("image_id").agg(F.avg(F.when(det, F.col("score"))).alias("m"), F.avg(F.when(det & (F.col("box_id") % 2 == 0), F.col("score"))).alias("c"))
    return means.select("image_id", r6(F.col("m")).alias("mean_score"), r6(F.col("c")).alias("mean_correct"), F.col("m").isNull().alias("empty"))


@query(
    "a20_a21_interval_coverage",
    f"""WITH {PAIRS}, q AS (SELECT (dx0 - gx0) / 100 AS e0, (dy0 - gy0) / 100 AS e1, exp(score - 3) AS sd, 2 * (score - 3) AS lv FROM pairs), z(nominal, z) AS (VALUES ('50', 0.67448975::DOUBLE), ('80', 1.28155157), ('90', 1.64485363), ('95', 1.95996398))
        SELECT nominal, round(avg((CAST(abs(e0) <= z * sd AS INT) + CAST(abs(e1) <= z * sd AS INT)) / 2.0::DOUBLE), 6) AS coordinate, round(avg(CAST(abs(e0) <= z * sd AND abs(e1) <= z * sd AS INT)), 6) AS whole,
               round(avg(0.5 * (e0 * e0 / exp(lv) + lv + ln(2 * pi()))), 6) AS nll, round(sqrt(avg(e0 * e0)), 6) AS rmse, round(avg(sd), 6) AS mean_std FROM q, z GROUP BY nominal""",
)
def a20_a21_interval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of nominal intervals by coordinate and by box, likelihood and sharpness, in one pass, which keeps one row for all levels."""
    levels = {"50": 0.67448975, "80": 1.28155157, "90": 1.64485363, "95": 1.95996398}
    p = pairs(view(spark, sf_dir, "boxes"))
    q = p.select(((F.col("dx0") - F.col("gx0")) / 100).alias("e0"), ((F.col("dy0") - F.col("gy0")) / 100).alias("e1"), F.exp(F.col("score") - 3).alias("sd"), (2 * (F.col("score") - 3)).alias("lv"))
    within = lambda e, z: (F.abs(F.col(e)) <= z * F.col("sd")).cast("int")
    shares = {k: (F.avg((within("e0", z) + within("e1", z)) / 2), F.avg(within("e0", z) * within("e1", z))) for k, z in levels.items()}
    row = q.agg(F.count(F.lit(1)).alias("n"), F.avg(S.gaussian_nll(F.col("e0"), F.col("lv"))).alias("nll"), F.sqrt(F.avg(F.col("e0") * F.col("e0"))).alias("rmse"), F.avg("sd").alias("mean_std"), *(x.alias(f"{c}_{k}") for k, both in shares.items() for c, x in zip(("coordinate", "whole"), both, strict=True)))
    each = F.array(*(F.struct(F.lit(k).alias("nominal"), r6(F.col(f"coordinate_{k}")).alias("coordinate"), r6(F.col(f"whole_{k}")).alias("whole")) for k in levels))
    return row.where("n > 0").select(F.inline(each), *(r6(F.col(c)).alias(c) for c in ("nll", "rmse", "mean_std")))


@query(
    "a23_quantile_calibration",
    """WITH b AS (SELECT grp, u, toxic, ntile(10) OVER (PARTITION BY grp ORDER BY u, id) AS bin FROM scores)
       SELECT grp, bin, count(*) AS n, round(sqrt(avg(u * u)), 6) AS predicted, round(sqrt(avg(toxic * toxic)), 6) AS empirical FROM b GROUP BY grp, bin""",
)
def a23_quantile_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = T.ranked_bins(view(spark, sf_dir, "scores"), ["grp"], "u", "id", ["toxic"], 10).withColumnRenamed("score", "u")
    square = lambda c: r6(F.sqrt(F.avg(F.col(c) * F.col(c))))
    return b.groupBy("grp", F.col("bin").cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"), square("u").alias("predicted"), square("toxic").alias("empirical"))


@query(
    "a35_confidence_bands",
    """WITH b AS (SELECT image_id, score, y0 AS u, ntile(10) OVER (PARTITION BY image_id ORDER BY score, box_id) AS k FROM boxes WHERE kind = 'DET' AND image_id IN (SELECT image_id FROM boxes WHERE kind = 'DET' GROUP BY image_id HAVING count(*) >= 10)),
       v AS (SELECT image_id, k, avg(u) AS m FROM b GROUP BY image_id, k), p AS (SELECT image_id, list(m ORDER BY k) AS v FROM v GROUP BY image_id)
       SELECT image_id, round(list_avg(v), 6) AS mean, round(v[6] - v[10], 6) AS raw_gap, round(list_avg(v[1:3]) - list_avg(v[8:10]), 6) AS low_high, round(2 * (v[6] - v[1]) / (v[6] + v[1] + 1e-9), 6) AS rel_gap FROM p""",
)
def a35_confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decile means of an image's uncertainties in the order of confidence, and features of them; images with ten detections at least."""
    from pyspark.sql import Window

    det = view(spark, sf_dir, "boxes").where("kind = 'DET'").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("image_id"))).where("n >= 10")
    means = T.equal_bins(det, ["image_id"], [F.asc("score"), F.asc("box_id")], 10).groupBy("image_id", "bin").agg(F.avg("y0").alias("m"))
    v = means.groupBy("image_id").pivot("bin", list(range(1, 11))).agg(F.first("m"))
    c = lambda *ks: sum(F.col(f"`{k}`") for k in ks) / len(ks)
    return v.select("image_id", r6(c(*range(1, 11))).alias("mean"), r6(c(6) - c(10)).alias("raw_gap"), r6(c(1, 2, 3) - c(8, 9, 10)).alias("low_high"), r6(2 * (c(6) - c(1)) / (c(6) + c(1) + 1e-9)).alias("rel_gap"))


@query(
    "a36_a37_histograms",
    """WITH h AS (SELECT label, CAST(least(floor(score / (1.0::DOUBLE / 30)), 29) AS INT) AS bin, count(*) AS n FROM boxes WHERE score >= 0 AND score <= 1 GROUP BY ALL)
       SELECT label, bin, n, round(n / sum(n) OVER (PARTITION BY label), 6) AS share, round(n / (sum(n) OVER (PARTITION BY label) * (1.0::DOUBLE / 30)), 6) AS density FROM h""",
)
def a36_a37_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = view(spark, sf_dir, "boxes")
    share = T.histogram(b, ["label"], "score", 0.0, 1.0, 30, "share")
    return share.select("label", "bin", "n", r6(F.col("value")).alias("share"), r6(F.col("value") / F.lit(1.0 / 30)).alias("density"))


@query("a39_exact_quantiles", "SELECT label, round(quantile_cont(score, 0.05), 6) AS q05, round(quantile_cont(score, 0.95), 6) AS q95 FROM boxes GROUP BY label")
def a39_exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = R.quantiles(view(spark, sf_dir, "boxes"), ["label"], "score", {"q05": 0.05, "q95": 0.95})
    return q.select("label", r6(F.col("q05")).alias("q05"), r6(F.col("q95")).alias("q95"))


@query(
    "a44_error_summary",
    """WITH e AS (SELECT label, abs(x1 - x0 - 28) / 28 AS e FROM boxes) SELECT label, round(avg(e), 6) AS mean, round(quantile_cont(e, 0.95), 6) AS p95, round(max(e), 6) AS max FROM e GROUP BY label""",
)
def a44_error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "boxes").withColumn("e", F.abs(F.col("x1") - F.col("x0") - 28) / 28)
    means = e.groupBy("label").agg(r6(F.avg("e")).alias("mean"), r6(F.max("e")).alias("max"))
    return means.join(R.quantiles(e, ["label"], "e", {"p95": 0.95}), "label").select("label", "mean", r6(F.col("p95")).alias("p95"), "max")


@query(
    "a29_topk_accuracy",
    """WITH l AS (SELECT vec_id, label, unnest(range(10)) AS c, unnest(embedding[1:10]) AS s FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, c) AS k FROM l)
       SELECT label, round(avg(CASE WHEN k <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS top1, round(avg(CASE WHEN k <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS top5 FROM r WHERE c = label GROUP BY label""",
)
def a29_topk_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label's rank is counted inside of the row: no explode, no shuffle before the final means."""
    s = F.slice("embedding", 1, 10)
    own = F.get(s, F.col("label"))
    ahead = F.size(F.filter(s, lambda v: v > own)) + F.size(F.filter(F.slice(s, F.lit(1), F.col("label")), lambda v: v == own))
    return table(spark, sf_dir, "embeddings").withColumn("k", ahead + 1).groupBy("label").agg(r6(F.avg((F.col("k") <= 1).cast("double"))).alias("top1"), r6(F.avg((F.col("k") <= 5).cast("double"))).alias("top5"))


@query(
    "a30_a40_cardinality_and_counts",
    """WITH c AS (SELECT image_id, count(*) FILTER (kind = 'DET' AND score > 0.5) AS p, count(*) FILTER (kind = 'GT') AS g FROM boxes GROUP BY image_id)
       SELECT round(avg(abs(p - g)), 6) AS cardinality_error, CAST(sum(greatest(p - g, 0)) AS BIGINT) AS over, CAST(sum(greatest(g - p, 0)) AS BIGINT) AS missed FROM c""",
)
def a30_a40_cardinality_and_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "boxes").groupBy("image_id").agg(F.count_if((F.col("kind") == "DET") & (F.col("score") > 0.5)).alias("p"), F.count_if(F.col("kind") == "GT").alias("g"))
    gap = F.col("p") - F.col("g")
    return c.agg(r6(F.avg(F.abs(gap))).alias("cardinality_error"), F.sum(F.greatest(gap, F.lit(0))).alias("over"), F.sum(F.greatest(-gap, F.lit(0))).alias("missed"))


@query("a33_best_step", "SELECT user_id, arg_max(event_id, struct_pack(v := value, e := -event_id)) AS best_step, max(value) AS best FROM events GROUP BY user_id")
def a33_best_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best value of each series and the first step that reached it."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("best_step"), F.max("value").alias("best"))


@query(
    "a45_metric_matrix",
    """WITH p AS (SELECT event_type AS corruption, round(avg(value) FILTER (user_id % 3 = 0), 6) AS s0, round(avg(value) FILTER (user_id % 3 = 1), 6) AS s1, round(avg(value) FILTER (user_id % 3 = 2), 6) AS s2, avg(value) AS m FROM events WHERE event_type <> 'view' GROUP BY event_type)
       SELECT corruption, s0, s1, s2, CAST(row_number() OVER (ORDER BY m, corruption) AS INT) AS place FROM p""",
)
def a45_metric_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means by kind and severity, kinds in the order of their mean, one kind left out."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").where("event_type <> 'view'").withColumn("severity", F.col("user_id") % 3)
    wide = e.groupBy(F.col("event_type").alias("corruption")).agg(F.avg("value").alias("m"), *(r6(F.avg(F.when(F.col("severity") == k, F.col("value")))).alias(f"s{k}") for k in range(3)))
    return wide.withColumn("place", F.row_number().over(Window.orderBy("m", "corruption"))).drop("m")  # a row for each kind


METER_ROLL = "PARTITION BY user_id ORDER BY ts, event_id"


@query(
    "w1_w5_rolling_meter",
    f"""SELECT user_id, event_id, round(quantile_disc(value, 0.5) OVER w, 6) AS median, round(avg(value) OVER w, 9) AS avg, round(max(value) OVER w, 6) AS max, round(value, 6) AS value_now, round(avg(value) OVER ({METER_ROLL} ROWS UNBOUNDED PRECEDING), 9) AS global_avg
        FROM meter WINDOW w AS ({METER_ROLL} ROWS 19 PRECEDING)""",
)
def w1_w5_rolling_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = O.rolling(view(spark, sf_dir, "meter"), ["user_id"], [F.asc("ts"), F.asc("event_id")], "value")
    return m.select("user_id", "event_id", *(r6(F.col(c)).alias(c) for c in ("median", "max", "value_now")), *(F.round(c, 9).alias(c) for c in ("avg", "global_avg")))


@query(
    "w12_ema",
    f"""WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER ({METER_ROLL}) - 1 AS t FROM meter),
        f(user_id, t, v) AS (SELECT user_id, t, value FROM o WHERE t = 0 UNION ALL SELECT o.user_id, o.t, f.v * (0.99 * (1 - exp(-o.t / 10.0::DOUBLE))) + (1 - 0.99 * (1 - exp(-o.t / 10.0::DOUBLE))) * o.value FROM f JOIN o ON o.user_id = f.user_id AND o.t = f.t + 1)
        SELECT user_id, max(t) + 1 AS n, round(arg_max(v, t), 6) AS ema FROM f GROUP BY user_id""",
)
def w12_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.ema(view(spark, sf_dir, "meter"), ["user_id"], ["ts", "event_id"], "value", 0.99, 10.0).select("user_id", "n", r6(F.col("ema")).alias("ema"))


@query(
    "w12_ema_of_one_key",
    """WITH o AS (SELECT value, row_number() OVER (ORDER BY ts, event_id) AS t FROM meter), w AS (SELECT t, value, 0.999 * (1 - exp(-t / 50.0::DOUBLE)) AS d FROM o),
        p AS (SELECT *, coalesce(exp(sum(ln(d)) OVER (ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS later FROM w)
        SELECT 0 AS series, count(*) AS n, round(sum((1 - d) * value * later) + 10 * exp(sum(ln(d))), 6) AS ema FROM p""",
)
def w12_ema_of_one_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one series, which many tasks share, from a stated start (the second form of W12)."""
    m = view(spark, sf_dir, "meter").withColumn("series", F.lit(0))
    return O.ema(m, ["series"], ["ts", "event_id"], "value", 0.999, 50.0, 10.0).select("series", "n", r6(F.col("ema")).alias("ema"))


@query("w13_warmup", "SELECT event_id, round(least(1.0::DOUBLE, (event_id + 1) / 2000.0::DOUBLE), 6) AS factor FROM events")
def w13_warmup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", r6(T.warmup_factor(F.col("event_id"), 2000)).alias("factor"))


@query("w14_rank_by_confidence", "SELECT image_id, box_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY score DESC, box_id) AS INT) AS rank FROM boxes WHERE kind = 'DET'")
def w14_rank_by_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.top_per_group(view(spark, sf_dir, "boxes").where("kind = 'DET'"), ["image_id"], [F.desc("score"), F.asc("box_id")], 10**9).select("image_id", "box_id", "rank")


@query(
    "t1_flat_topk",
    """WITH l AS (SELECT vec_id // 5 AS image_id, vec_id % 5 AS q, unnest(range(64)) AS c, unnest(embedding) AS s FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY s DESC, q * 64 + c) AS k FROM l)
       SELECT image_id, CAST(q AS INT) AS query_idx, CAST(c AS INT) AS label, round(1 / (1 + exp(-CAST(s AS DOUBLE))), 6) AS score, CAST(k AS INT) AS rank FROM r WHERE k <= 30""",
)
def t1_flat_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best (query, class) cells of each image. A query keeps its own best k before cells of an image meet."""
    e = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 5").alias("image_id"), (F.col("vec_id") % 5).cast("int").alias("q"), F.col("embedding").cast("array<double>").alias("x"))
    own = F.slice(F.array_sort(F.transform("x", lambda v, i: F.struct((-v).alias("s"), i.cast("int").alias("c")))), 1, 30)
    cells = e.select("image_id", F.col("q").alias("query_idx"), F.inline(own)).withColumn("flat", F.col("query_idx") * 64 + F.col("c"))
    return M.top_per_group(cells, ["image_id"], [F.asc("s"), F.asc("flat")], 30).select("image_id", F.expr("CAST(flat div 64 AS INT)").alias("query_idx"), (F.col("flat") % 64).alias("label"), r6(S.sigmoid(-F.col("s"))).alias("score"), "rank")


@query(
    "t2_softmax_topk",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings), p AS (SELECT vec_id // 20 AS image_id, vec_id % 20 AS q, list_position(x[1:63], list_max(x[1:63])) - 1 AS c, exp(list_max(x[1:63])) / list_sum(list_transform(x, lambda v: exp(v))) AS s FROM e),
       r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY s DESC, q) AS k FROM p) SELECT image_id, CAST(q AS INT) AS query_idx, CAST(c AS INT) AS label, round(s, 6) AS score, CAST(k AS INT) AS rank FROM r WHERE k <= 10""",
)
def t2_softmax_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of highest softmax, the last class left out, of the best queries of each image."""
    e = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 20").alias("image_id"), (F.col("vec_id") % 20).cast("int").alias("query_idx"), S.softmax(F.col("embedding").cast("array<double>")).alias("p"))
    best = e.withColumn("p", F.slice("p", 1, 63)).select("image_id", "query_idx", S.argmax(F.col("p")).alias("label"), F.array_max("p").alias("s"))
    return M.top_per_group(best, ["image_id"], [F.desc("s"), F.asc("query_idx")], 10).select("image_id", "query_idx", "label", r6(F.col("s")).alias("score"), "rank")


@query(
    "t3_query_selection",
    """WITH s AS (SELECT vec_id // 20 AS image_id, vec_id % 20 AS q, list_max(embedding) AS top, embedding[1] AS agnostic FROM embeddings),
       r AS (SELECT image_id, q, row_number() OVER (PARTITION BY image_id ORDER BY top DESC, q) AS k1, row_number() OVER (PARTITION BY image_id ORDER BY agnostic DESC, q) AS k2 FROM s)
       SELECT image_id, CAST(q AS INT) AS query_idx, k1 <= 5 AS by_class, k2 <= 5 AS agnostic FROM r WHERE k1 <= 5 OR k2 <= 5""",
)
def t3_query_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries chosen by their best class and by a class-agnostic score."""
    e = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 20").alias("image_id"), (F.col("vec_id") % 20).cast("int").alias("query_idx"), F.array_max("embedding").alias("top"), F.col("embedding")[0].alias("own"))
    by_class = M.top_per_group(e, ["image_id"], [F.desc("top"), F.asc("query_idx")], 5).select("image_id", "query_idx", F.lit(True).alias("by_class"))
    agnostic = M.top_per_group(e, ["image_id"], [F.desc("own"), F.asc("query_idx")], 5).select("image_id", "query_idx", F.lit(True).alias("agnostic"))
    return by_class.join(agnostic, ["image_id", "query_idx"], "full").select("image_id", "query_idx", F.coalesce("by_class", F.lit(False)).alias("by_class"), F.coalesce("agnostic", F.lit(False)).alias("agnostic"))


@query("t8_sorted_arrays", "SELECT vec_id, round(CAST(list_reverse_sort(embedding)[1] AS DOUBLE), 6) AS largest, round(CAST(list_reverse_sort(embedding)[64] AS DOUBLE), 6) AS smallest FROM embeddings")
def t8_sorted_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.sort_array("embedding", asc=False)
    return table(spark, sf_dir, "embeddings").select("vec_id", r6(s[0].cast("double")).alias("largest"), r6(s[63].cast("double")).alias("smallest"))


@query("t10_first_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY (o_orderkey * 2654435761 + 7) % 4294967296, o_orderkey LIMIT 100")
def t10_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows in a seeded order (P14): each partition keeps its own first rows."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(T.mixed(F.col("o_orderkey"), 7), "o_orderkey").limit(100)


@query("o1_o2_labelled_union", "SELECT pool, count(*) AS n, round(sum(s), 6) AS total FROM (SELECT 0 AS pool, c_acctbal AS s FROM customer UNION ALL SELECT 1, s_acctbal FROM supplier) GROUP BY pool")
def o1_o2_labelled_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.lit(0).alias("pool"), F.col("c_acctbal").alias("s"))
    b = table(spark, sf_dir, "supplier").select(F.lit(1).alias("pool"), F.col("s_acctbal").alias("s"))
    return a.unionByName(b).groupBy("pool").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("s")).alias("total"))


@query(
    "o3_o5_key_sets",
    """SELECT 'both' AS outcome, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')
       UNION ALL SELECT 'first', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')""",
)
def o3_o5_key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in both sets and in the first alone (O3, O4, O5, J15), from one aggregate of flags."""
    flags = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("r"), F.bool_or(F.col("l_returnflag") == "A").alias("a"))
    counts = flags.agg(F.count_if(F.col("r") & F.col("a")).alias("both"), F.count_if(F.col("r") & ~F.col("a")).alias("first"))
    return counts.select(F.expr("stack(2, 'both', both, 'first', first) AS (outcome, n)"))


@query("o6_first_of_each", "SELECT l_orderkey, min(l_partkey * 100000 + l_suppkey) AS first FROM lineitem GROUP BY l_orderkey")
def o6_first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("first"))


@query(
    "a34_split_coverage",
    """SELECT p_brand, count(*) AS n, count(*) FILTER (p_partkey % 5 = 0) AS n_calibration, count(*) FILTER (p_partkey % 5 = 0) = 0 AS uncovered, count(*) FILTER (p_partkey % 5 = 0) < 20 AS sparse FROM part GROUP BY p_brand""",
)
def a34_split_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.count_if(F.col("p_partkey") % 5 == 0)
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), own.alias("n_calibration"), (own == 0).alias("uncovered"), (own < 20).alias("sparse"))


@query(
    "x1_deterministic_split",
    """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY (o_orderkey * 2654435761 + 42) % 4294967296, o_orderkey) AS k FROM orders), n AS (SELECT least(10000, count(*)) AS n FROM orders)
       SELECT o_orderkey, CASE WHEN k <= least(greatest(1, CAST(round_even(0.2 * n, 0) AS BIGINT)), n - 1) THEN 'calibration' ELSE 'frechet' END AS split FROM r, n WHERE k <= n""",
)
def x1_deterministic_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.split(table(spark, sf_dir, "orders"), "o_orderkey", 0.2, 42, 10_000)


@query("x2_bernoulli_split", "SELECT o_orderkey, (o_orderkey * 2654435761 + 3) % 4294967296 < 1288490188 AS chosen FROM orders")
def x2_bernoulli_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.bernoulli(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.3, 3)


@query("p4_valid_images", "SELECT image_id, count(*) AS n FROM boxes GROUP BY image_id HAVING NOT bool_and(x1 - x0 <= 22 OR y1 - y0 <= 22) AND count_if(label = 1) >= 10")
def p4_valid_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with boxes that are not all thin, and enough of one kind."""
    thin = (F.col("x1") - F.col("x0") <= 22) | (F.col("y1") - F.col("y0") <= 22)
    g = view(spark, sf_dir, "boxes").groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(thin).alias("thin"), F.count_if(F.col("label") == 1).alias("ones"))
    return g.where("not thin and ones >= 10").select("image_id", "n")


@query("p8_p9_allowed_classes", "SELECT image_id, box_id, label FROM boxes WHERE label IN (SELECT label FROM boxes WHERE kind = 'GT' AND label <> 2) AND kind = 'DET' AND score > 0.9")
def p8_p9_allowed_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only classes that have a reference (P8) and are allowed (P9); filters stand below the join."""
    b = view(spark, sf_dir, "boxes")
    known = b.where("kind = 'GT' and label <> 2").select("label").distinct()
    return b.where("kind = 'DET' and score > 0.9").join(known, "label", "left_semi").select("image_id", "box_id", "label")


@query(
    "p18_regex_groups",
    """SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^[a-f]') THEN 'low' WHEN regexp_matches(p_name, 'o.*o') THEN 'double' ELSE 'rest' END AS grp,
              CAST(regexp_matches(p_name, '^[a-f]') AS INT) + CAST(regexp_matches(p_name, 'o.*o') AS INT) > 1 AS overlap FROM part""",
)
def p18_regex_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.rlike("p_name", F.lit("^[a-f]")), F.rlike("p_name", F.lit("o.*o"))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(a, "low").when(b, "double").otherwise("rest").alias("grp"), (a & b).alias("overlap"))


@query("p20_category_agnostic", "SELECT image_id, -1 AS label, count(*) AS n FROM boxes GROUP BY image_id")
def p20_category_agnostic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "boxes").withColumn("label", F.lit(-1)).groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("n"))
