"""Topological uncertainty: spanning-tree diagrams of activations, prototypes, distances and percentile scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from boxwise.functions import scalars as S
from boxwise.operators import ranking as R


def spanning_tree(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sorted edge weights, largest first, of the maximum spanning tree between inputs and outputs.

    x: rows by inputs; w: outputs by inputs; an edge weighs |w| * |x|. All rows grow their
    tree at once, from input 0, by the heaviest edge that reaches a new vertex. The
    sorted weights do not depend on how ties are broken.
    """
    x, w = np.abs(x), np.abs(w)
    n, inputs, outputs = len(x), x.shape[1], len(w)
    rows = np.arange(n)
    reach = np.full((n, inputs + outputs), -np.inf)
    reach[:, inputs:] = w[:, 0] * x[:, :1]
    done = np.zeros_like(reach, dtype=bool)
    done[:, 0] = True
    out = np.empty((n, inputs + outputs - 1))
    for k in range(inputs + outputs - 1):
        best = np.where(done, -np.inf, reach).argmax(axis=1)
        out[:, k] = reach[rows, best]
        done[rows, best] = True
        is_input = best < inputs
        i, o = rows[is_input], rows[~is_input]
        reach[i, inputs:] = np.maximum(reach[i, inputs:], w[:, best[i]].T * x[i, best[i]][:, None])
        reach[o, :inputs] = np.maximum(reach[o, :inputs], w[best[o] - inputs] * x[o])
    return -np.sort(-out, axis=1)


def diagrams(activations: DataFrame, weights: dict[str, np.ndarray], keys: list[str]) -> DataFrame:
    """keys..., layer and diagram of activations (keys..., layer, x). Filters belong before this call, as they do not pass below it.

    weights: one matrix a layer, a model's own size. Layers without one, and null vectors, give no row.
    """
    schema = T_.StructType([*activations.select(*keys).schema, T_.StructField("layer", T_.StringType()), T_.StructField("diagram", T_.ArrayType(T_.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for layer, w in weights.items():
                own = batch.filter(pa.array([v == layer for v in batch["layer"].to_pylist()], pa.bool_()))
                if len(own):
                    tree = spanning_tree(own["x"].flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1), w)
                    size = tree.shape[1]
                    column = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * size, pa.int32()), pa.array(tree.ravel()))
                    yield pa.record_batch([*(own[k] for k in keys), own["layer"], column], [*keys, "layer", "diagram"])

    rows = activations.where("x is not null and layer is not null").select(*keys, "layer", F.col("x").cast("array<double>").alias("x"))
    return rows.mapInArrow(run, schema)


def prototype_distances(vectors: DataFrame, prototypes: DataFrame, on: list[str], x: str, reduce: str = "max") -> DataFrame:
    """vectors with distance: to the farthest ('max') or nearest ('min') prototype m of the same keys; rows without one are left out."""
    far = {"max": F.max, "min": F.min}[reduce]
    ids = [c for c in vectors.columns if c != x]
    joined = vectors.join(prototypes.select(*on, "m"), on)
    return joined.withColumn("_d", S.rms_distance(F.col(x), F.col("m"))).groupBy(*ids).agg(far("_d").alias("distance"))


def uncertainty(distances: DataFrame, keys: list[str], layers: int | None = None) -> DataFrame:
    """keys..., tu: the mean distance over the layers that have one, or over a stated number of layers."""
    total = F.sum("distance")
    return distances.groupBy(*keys).agg((total / (F.count(F.lit(1)) if layers is None else F.lit(layers))).alias("tu"))


def named_uncertainty(distances: DataFrame, keys: list[str], captured: int, name: str = "linear1") -> DataFrame:
    """keys..., tu: the distances of the layers whose names contain `name`, added up and divided by the number of all captured layers."""
    own = F.coalesce(F.sum(F.when(F.contains(F.col("layer"), F.lit(name)), F.col("distance"))), F.lit(0.0))
    return distances.groupBy(*keys).agg((own / F.lit(captured)).alias("tu"))


def percentiles(rows: DataFrame, reference: DataFrame, cell: list[str], x: str, least: int = 10) -> DataFrame:
    """rows with percentile: the share of their cell's references that are at most x (F13); rows whose cell has fewer than `least` are left out.

    References and rows are counted by value and share one running total, so no cell is gathered.
    """
    sizes = reference.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    both = reference.select(*cell, F.col(x).alias("v"), F.lit(1).alias("w")).unionByName(rows.select(*cell, F.col(x).alias("v"), F.lit(0).alias("w")))
    counts = both.join(sizes.select(*cell), cell, "left_semi").groupBy(*cell, "v").agg(F.sum("w").alias("w"))
    below = R.running(counts, cell, "v", ["w"]).select(*cell, F.col("v").alias(x), "cum_w")
    return rows.join(below, [*cell, x]).join(sizes, cell).withColumn("percentile", F.col("cum_w") / F.col("_n")).drop("cum_w", "_n")
