"""Which queries and images count, and the pipelines from activations to means, distances and uncertainties."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwise.functions import scalars as S
from boxwise.operators import matching as M
from boxwise.operators import statistics as T
from boxwise.operators import topology as U

#: The modules that a capture task stands for, in each decoder layer or in the encoder.
TASKS = {
    "score": ("linear1", "linear2", "score_head"),
    "bbox": ("bbox_head_0", "bbox_head_1", "bbox_head_2"),
    "deformable_sampling_offsets": ("sampling_offsets",),
    "attention_weights": ("attention_weights",),
    "value_proj": ("value_proj",),
    "output_proj": ("output_proj",),
}
ENCODER_TASKS = {
    "enc_output": ("enc_output_proj",),
    "enc_score_head": ("enc_score_head",),
    "enc_bbox_head": ("enc_bbox_head_0", "enc_bbox_head_1", "enc_bbox_head_2"),
}


def selected_layers(captures: DataFrame, tasks: list[str], layers: int | list[int] = -1) -> DataFrame:
    """The captures (layer, module, ...) that task names and decoder layers select; -1 stands for all layers (U5). The filter reaches the scan.

    Modules of the encoder are in no decoder layer, so `layers` leaves them.
    """
    if unknown := set(tasks) - {*TASKS, *ENCODER_TASKS}:
        raise ValueError(f"unknown tasks {sorted(unknown)}")
    decoder = F.col("module").isin([m for t in tasks for m in TASKS.get(t, ())])
    encoder = F.col("module").isin([m for t in tasks for m in ENCODER_TASKS.get(t, ())])
    if layers != -1:
        decoder &= F.col("layer").isin([layers] if isinstance(layers, int) else list(layers))
    return captures.where(decoder | encoder)


def population(rows: DataFrame, which: str, allowed: list[int] | None = None) -> DataFrame:
    """rows with class_id: 'correct' keeps queries whose matched label (target, -1 or NULL: none) is the predicted one (P10), 'predicted' all by their prediction (P11); only allowed classes."""
    if which == "correct":
        rows = rows.where("target >= 0 and predicted = target")
    elif which != "predicted":
        raise ValueError(f"unknown population {which!r}")
    rows = rows.withColumn("class_id", F.col("predicted"))
    return rows if allowed is None else rows.where(F.col("class_id").isin(list(allowed)))


def confident(rows: DataFrame, least: float) -> DataFrame:
    """rows (logits, label) whose softmax is highest at the label and at least `least` there."""
    p = S.softmax(F.col("logits"))
    return rows.withColumn("_p", p).where((S.argmax(F.col("_p")) == F.col("label")) & (F.get("_p", F.col("label")) >= least)).drop("_p")


def gathered(activations: DataFrame, queries: DataFrame) -> DataFrame:
    """The activations (image_id, query_idx, layer, x) of the chosen queries, with these queries' other columns."""
    return activations.join(queries, ["image_id", "query_idx"])


def best_queries(outputs: DataFrame, k: int) -> DataFrame:
    """image_id, query_idx, label, score of the k best (query, class) cells of each image, of outputs (image_id, query_idx, logits) (T1); a query keeps its own best k before those of an image meet."""
    own = F.slice(F.array_sort(F.transform("logits", lambda v, i: F.struct((-v).alias("s"), i.cast("int").alias("label")))), 1, k)
    cells = outputs.select("image_id", "query_idx", F.inline(own))
    top = M.top_per_group(cells, ["image_id"], [F.asc("s"), F.asc("query_idx"), F.asc("label")], k)
    return top.select("image_id", "query_idx", "label", S.sigmoid(-F.col("s")).alias("score"))


def scored_detections(outputs: DataFrame, activations: DataFrame, weights: dict[str, np.ndarray], prototypes: DataFrame, k: int, least: float = 0.0) -> DataFrame:
    """image_id, query_idx, label, score, tu: the uncertainty head (U4).

    The best k cells of each image, of these the ones whose score is more than `least`, of
    these the ones whose class has prototypes (class_id, layer, m) at all; their diagrams
    are compared with the prototypes of their class and layer, the farthest counting,
    and averaged over layers. Only the chosen queries' activations are turned into diagrams.
    """
    known = prototypes.select(F.col("class_id").alias("label")).distinct()
    queries = best_queries(outputs, k).where(F.col("score") > least).join(known, "label", "left_semi")
    rows = gathered(activations, queries.select("image_id", "query_idx", F.col("label").alias("class_id"), "score"))
    diagrams = U.diagrams(rows, weights, ["image_id", "query_idx", "class_id", "score"])
    far = U.prototype_distances(diagrams, prototypes, ["class_id", "layer"], "diagram")
    return U.uncertainty(far, ["image_id", "query_idx", "class_id", "score"]).withColumnRenamed("class_id", "label")


def class_means(outputs: DataFrame, activations: DataFrame, weights: dict[str, np.ndarray], k: int, least: float) -> DataFrame:
    """class_id, layer, n, m: mean diagrams by class of the best k cells of each image with a score of at least `least`."""
    queries = best_queries(outputs, k).where(F.col("score") >= least)
    d = U.diagrams(gathered(activations, queries.select("image_id", "query_idx", F.col("label").alias("class_id"))), weights, ["class_id"])
    return T.vector_mean(d, ["class_id", "layer"], "diagram")


def image_class_means(images: DataFrame, activations: DataFrame, weights: dict[str, np.ndarray], least: float) -> DataFrame:
    """label, layer, n, m: mean diagrams of the images (image_id, logits, label) that are classified correctly and confidently (U7); n counts images."""
    rows = activations.join(confident(images, least).select("image_id", "label"), "image_id")
    return T.vector_mean(U.diagrams(rows, weights, ["label"]), ["label", "layer"], "diagram")


def matched_means(outputs: DataFrame, gt: DataFrame, activations: DataFrame, weights: dict[str, np.ndarray], allowed: list[int] | None = None) -> DataFrame:
    """class_id, layer, n, m: mean diagrams of the queries whose prediction is the label of the ground truth that optimal matching gives them (U8).

    outputs: image_id, query_idx, logits, cx, cy, w, h; gt: image_id, gt_id, label, cx, cy, w, h.
    """
    queries = population(predictions(outputs, gt), "correct", allowed)
    d = U.diagrams(gathered(activations, queries.select("image_id", "query_idx", "class_id")), weights, ["class_id"])
    return T.vector_mean(d, ["class_id", "layer"], "diagram")


def predictions(outputs: DataFrame, gt: DataFrame) -> DataFrame:
    """image_id, query_idx, predicted, target: the class of each query, and the label of what it is matched with, or -1."""
    matches = M.hungarian_match(outputs.withColumnRenamed("query_idx", "det_id"), gt)
    labels = matches.join(gt.select("image_id", "gt_id", "label"), ["image_id", "gt_id"]).select("image_id", F.col("det_id").alias("query_idx"), F.col("label").alias("target"))
    return outputs.select("image_id", "query_idx", S.argmax(F.col("logits")).alias("predicted")).join(labels, ["image_id", "query_idx"], "left").withColumn("target", F.coalesce("target", F.lit(-1)))


def conformal_distances(queries: DataFrame, activations: DataFrame, weights: dict[str, np.ndarray], means: DataFrame, which: str = "correct", allowed: list[int] | None = None) -> DataFrame:
    """image_id, query_idx, class_id, layer, distance of the population's diagrams to the means of their class and layer (U9); those without a mean are left out.

    queries: image_id, query_idx, predicted, target.
    """
    keys = ["image_id", "query_idx", "class_id"]
    d = U.diagrams(gathered(activations, population(queries, which, allowed).select(*keys)), weights, keys)
    return U.prototype_distances(d, means, ["class_id", "layer"], "diagram")


def distance_cells(distances: DataFrame, cell: list[str], x: str = "distance") -> DataFrame:
    """cell..., place (from 1), distance: the sorted tables of a cell's distances, in rows, so that no cell is gathered."""
    from boxwise.operators import ranking as R

    counts = distances.groupBy(*cell, F.col(x).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    cum = R.running(counts, cell, "v", ["c"])
    return cum.select(*cell, F.explode(F.sequence(F.col("cum_c") - F.col("c") + 1, F.col("cum_c"))).alias("place"), F.col("v").alias(x))


def layer_mean(distances: Column, predicted: Column) -> tuple[Column, Column]:
    """The mean of the finite ones of an array of layer distances (NULL if none is), and the class of each, -1 where it is not finite."""
    good = F.filter(distances, S.finite)
    return F.when(F.size(good) > 0, S.total(good) / F.size(good)), F.transform(distances, lambda d: F.when(S.finite(d), predicted).otherwise(-1))


def noised(gt: DataFrame, groups: int, classes: int, label_noise: float, box_noise: float, seed: int) -> DataFrame:
    """image_id, gt_id, grp, negative, query_idx, label, x0, y0, x1, y1 (X5): ground truth tiled into positive and negative denoising queries.

    gt: image_id, gt_id, label, x0, y0, x1, y1 within [0, 1]. A label is replaced with
    probability label_noise / 2; each corner moves by up to box_noise half sides, those of
    negatives by one to two times as much, and stays in [0, 1]. The draws are mixed keys,
    the same in every run and on every worker.
    """
    from pyspark.sql import Window

    own = Window.partitionBy("image_id")
    n, k = F.count(F.lit(1)).over(own), F.row_number().over(own.orderBy("gt_id")) - 1
    tiles = gt.withColumns({"_n": n, "_k": k}).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(2 * groups - 1))))
    tiles = tiles.withColumns({"grp": F.expr("tile div 2"), "negative": F.col("tile") % 2 == 1, "query_idx": F.col("tile") * F.col("_n") + F.col("_k")})
    draw = lambda salt: T.mixed((F.col("image_id") % 100003) * 9973 + F.col("query_idx") * 31 + salt, seed) / 4294967296.0
    label = F.when(draw(1) < label_noise / 2, F.floor(draw(2) * classes).cast("int")).otherwise(F.col("label"))
    side = {"x": F.col("x1") - F.col("x0"), "y": F.col("y1") - F.col("y0")}
    moved = []
    for c, name in enumerate(("x0", "y0", "x1", "y1")):
        sign = F.when(draw(3 + 2 * c) < 0.5, -1.0).otherwise(1.0)
        part = draw(4 + 2 * c) + F.when(F.col("negative"), 1.0).otherwise(0.0)
        moved.append(S.clamp(F.col(name) + sign * part * side[name[0]] * 0.5 * box_noise, 0.0, 1.0).alias(name))
    return tiles.select("image_id", "gt_id", "grp", "negative", "query_idx", label.alias("label"), *moved)
