"""Running totals and maxima over partitions against plain loops."""

from __future__ import annotations

import random
from math import exp

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from boxwise.operators import ordered as O
from boxwise.operators import ranking as R


def test_totals_and_maxima_cross_partitions(spark: SparkSession) -> None:
    """A group over all partitions, small ones between, a null one, and a value that half of all rows share."""
    rng = random.Random(1)
    rows = [(g, rng.choice([0.5, rng.random()]), k, rng.randrange(-5, 6), None if k % 7 == 0 else rng.random()) for k, g in enumerate([*["big"] * 400, *["a"] * 30, None, None, "b", *["c"] * 3])]
    df = spark.createDataFrame(rows, "g string, s double, k long, n int, x double").repartition(5)
    placed = O.in_order(df, ["g"], [F.desc("s"), F.asc("k")])
    out = O.highest_after(O.running_totals(placed, ["g"], ["n", "x"]), ["g"], ["x"]).collect()
    assert placed.rdd.getNumPartitions() == 8 and len(out) == len(rows)
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        found = {r["k"]: r for r in out if r["g"] == g}
        n, x = 0, 0.0
        for i, (_, _, k, dn, dx) in enumerate(own):
            n, x = n + dn, x + (dx or 0.0)
            later = [r[4] for r in own[i:] if r[4] is not None]
            assert found[k]["cum_n"] == n and abs(found[k]["cum_x"] - x) < 1e-9
            assert found[k]["max_x"] == (max(later) if later else None)


def test_no_rows_and_no_group(spark: SparkSession) -> None:
    df = spark.createDataFrame([], "g long, s double, n long")
    assert O.running_totals(O.in_order(df, ["g"], [F.asc("s")]), ["g"], ["n"]).collect() == []
    df = spark.range(100).withColumn("n", F.lit(2))
    out = O.running_totals(O.in_order(df, [], [F.asc("id")]), [], ["n"]).collect()
    assert sorted((r["id"], r["cum_n"]) for r in out) == [(k, 2 * k + 2) for k in range(100)]


def test_one_score_for_all_rows_is_many_tasks(spark: SparkSession) -> None:
    df = spark.range(10_000).select(F.lit(0).alias("g"), F.lit(1.0).alias("u"), "id", (F.col("id") % 2).alias("risk"))
    placed = R.ranked(df, ["g"], "u", "id", ["risk"])
    assert placed.select(F.spark_partition_id().alias("p")).groupBy("p").count().count() == 8
    curve = R.selective_risk(df, ["g"], "risk", "u", "id")
    expected = [((k + 1) // 2) / (k + 1) for k in range(10_000)]
    area = sum((a + b) / 2 for a, b in zip(expected, expected[1:], strict=False)) / 10_000
    assert abs(R.aurc_trapezoid(curve, ["g"]).first()["aurc"] - area) < 1e-9


def test_meters_of_one_key_over_all_tasks(spark: SparkSession) -> None:
    """Windows and averages that cross partitions, also of fewer rows than a window."""
    rng = random.Random(2)
    for n, size in ((400, 20), (30, 20), (50, 1), (5, 7)):
        rows = [(g, k, rng.random()) for g, many in ((1, n), (2, 3), (None, 9)) for k in range(many)] + [(1, 999, None)]
        df = spark.createDataFrame(rows, "g int, k long, x double").repartition(3)
        found = {(r["g"], r["k"]): r for r in O.rolling(df, ["g"], [F.asc("k")], "x", size).collect()}
        averages = [{r["g"]: r for r in O.ema(df, ["g"], ["k"], "x", 0.9, 5.0, start).collect()} for start in (None, 2.0)]
        assert len(found) == n + 12
        for g in (1, 2, None):
            own = [r[2] for r in rows if r[0] == g and r[2] is not None]
            for k, v in enumerate(own):
                last = sorted(own[max(0, k - size + 1) : k + 1])
                r = found[g, k]
                expected = (last[(len(last) - 1) // 2], sum(last) / len(last), last[-1], v, sum(own[: k + 1]) / (k + 1))
                assert all(abs(a - b) < 1e-9 for a, b in zip((r["median"], r["avg"], r["max"], r["value_now"], r["global_avg"]), expected, strict=True))
            for start, got in zip((None, 2.0), averages, strict=True):
                mean = start or 0.0
                for t, v in enumerate(own, start=0 if start is None else 1):
                    d = 0.9 * (1 - exp(-t / 5.0))
                    mean = d * mean + (1 - d) * v
                assert got[g]["n"] == len(own) and abs(got[g]["ema"] - mean) < 1e-9
