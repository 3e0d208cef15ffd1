"""Prototypes of groups: settled means, D²-weighted starts, and no worse than a plain loop over ten starts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import SparkSession

from boxwise.operators import prototypes
from boxwise.operators.prototypes import clusters, uniform
from boxwise.plans import all_queries
from boxwise.plans.model_queries import tree_diagrams


def plain_best(x: np.ndarray, k: int, starts: int = 10) -> float:
    """The least inertia of plain k-means++ runs."""
    best = np.inf
    for s in range(starts):
        rng = np.random.default_rng(s)
        centres = x[[rng.integers(len(x))]]
        while len(centres) < k:
            far = ((x[:, None] - centres[None]) ** 2).sum(2).min(1)
            if not far.sum():
                break
            centres = np.vstack([centres, x[rng.choice(len(x), p=far / far.sum())]])
        for _ in range(300):
            at = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            new = np.array([x[at == c].mean(0) for c in range(len(centres)) if (at == c).any()])
            if new.shape == centres.shape and np.allclose(new, centres, atol=1e-12):
                break
            centres = new
        best = min(best, float(((x[:, None] - centres[None]) ** 2).sum(2).min(1).sum()))
    return best


def test_prototypes_are_the_best_of_ten_settled_starts(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    rng = np.random.default_rng(5)
    spots = rng.random((4, 3)) * 10
    points = {
        "even": rng.random((400, 2)),
        "copies": np.concatenate([np.zeros((300, 2)), [[9.0, 0.0], [0.0, 9.0], [9.0, 9.0]]]),
        "apart": spots[rng.integers(4, size=500)] + rng.normal(size=(500, 3)) / 5,
        "two": np.array([[1.0, 2.0], [3.0, 4.0]]),
        "same": np.ones((9, 2)),
        "one": np.array([[5.0]]),
    }
    rows = [(g, k, x.tolist()) for g, own in points.items() for k, x in enumerate(own)] + [("one", 7, None), ("none", 1, None)]
    df = spark.createDataFrame(rows, "g string, id long, x array<double>").repartition(5)
    monkeypatch.setattr(prototypes, "CENTRES_BYTES", 8 * 10 * 4 * 2 * 2)  # two groups a wave
    found = clusters(df, ["g"], "id", "x").collect()
    assert {r["g"] for r in found} == set(points)
    for g, own in points.items():
        parts = sorted((r for r in found if r["g"] == g), key=lambda r: r["cluster_id"])
        centres = np.array([r["m"] for r in parts])
        assert [r["cluster_id"] for r in parts] == list(range(min(4, len(np.unique(own, axis=0)))))
        far = ((own[:, None] - centres[None]) ** 2).sum(2)
        at = far.argmin(1)
        assert np.allclose(centres, [own[at == k].mean(axis=0) for k in range(len(centres))], atol=1e-9)
        assert [r["n"] for r in parts] == np.bincount(at, minlength=len(centres)).tolist()
        assert far.min(1).sum() <= plain_best(own, 4) * 1.01 + 1e-9, g


def test_seeds_are_drawn_by_squared_distance(spark: SparkSession) -> None:
    """The race draws a row as often as its share of the squared distances says."""
    step = prototypes._seeds(1, 1)
    x = np.array([[0.0], [1.0], [2.0], [3.0]])
    wins = np.zeros(4)
    for trial in range(4000):
        best: dict = {}
        step(best, 0, np.arange(4) + 1000 * trial, x, [np.array([[0.0]])])
        wins[int(best[0, 0, 0][2][0])] += 1
    assert wins[0] == 0 and np.allclose(wins / 4000, np.array([0, 1, 4, 9]) / 14, atol=0.03)
    u = uniform(np.arange(100_000), 1, 2)
    assert abs(u.mean() - 0.5) < 0.01 and 0 < u.min() and u.max() < 1


def test_no_vectors(spark: SparkSession) -> None:
    assert clusters(spark.createDataFrame([], "g string, id long, x array<double>"), ["g"], "id", "x").collect() == []


def test_clustered_uncertainty_equals_a_loop_over_its_prototypes(spark: SparkSession, sf_dir: str) -> None:
    """u3 by hand: of a class's prototypes the farthest, by layer, and the mean over layers."""
    diagrams = tree_diagrams(spark, sf_dir)
    means = clusters(diagrams.where("vec_id % 5 <> 0"), ["label", "layer"], "vec_id", "diagram").collect()
    own: dict = {}
    for r in means:
        own.setdefault((r["label"], r["layer"]), []).append(np.array(r["m"]))
    fitted: dict = {}
    scores: dict = {}
    for r in diagrams.collect():
        x = np.array(r["diagram"])
        if r["vec_id"] % 5:
            fitted.setdefault((r["label"], r["layer"]), []).append(x)
        elif (r["label"], r["layer"]) in own:
            far = max(float(np.sqrt(((x - m) ** 2).mean())) for m in own[r["label"], r["layer"]])
            scores.setdefault((r["vec_id"], r["label"]), []).append(far)
    # Ten starts of the one and ten others of the other: neither has the least inertia in every cell.
    ratios = []
    for cell, xs in fitted.items():
        x = np.array(xs)
        ratios.append(((x[:, None] - np.array(own[cell])[None]) ** 2).sum(2).min(1).sum() / plain_best(x, 4))
    assert np.mean(ratios) <= 1.005 and max(ratios) <= 1.06
    found = {(r["vec_id"], r["label"]): r["tu"] for r in all_queries.QUERIES["u3_clustered_uncertainty"](spark, sf_dir).collect()}
    assert found.keys() == scores.keys()
    assert all(abs(found[k] - sum(v) / len(v)) < 2e-6 for k, v in scores.items())


def test_settled_starts_are_not_looked_at_again(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """Starts of one group settle in different rounds; only those that still move go on to the next pass."""
    df = spark.createDataFrame([("g", k, x.tolist()) for k, x in enumerate(np.random.default_rng(5).random((400, 2)))], "g string, id long, x array<double>")
    moving, plain = [], prototypes._pass

    def watched(rows, starts, step):  # noqa: ANN001, ANN202
        if step is prototypes._sums:
            moving.append(sum(len(c) > 0 for own in starts.values() for c in own))
        return plain(rows, starts, step)

    monkeypatch.setattr(prototypes, "_pass", watched)
    assert clusters(df, ["g"], "id", "x").count() == 4
    assert moving == sorted(moving, reverse=True) and moving[0] == 10 and moving[-1] < 10
