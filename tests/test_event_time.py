"""Streams in event order: shuffled files give the batch result, and late rows are counted."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from boxwise.operators import statistics as T
from boxwise.streaming import event_time as E

SCHEMA = "user long, ts timestamp, id long, value double"


def write(spark: SparkSession, folder: Path, rows: list[tuple]) -> None:
    """Rows (user, seconds, id, value) as one more file."""
    df = spark.createDataFrame(rows, "user long, s double, id long, value double").select("user", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"), "id", "value")
    df.coalesce(1).write.mode("append").parquet(str(folder / "in"))


def source(spark: SparkSession, folder: Path):  # noqa: ANN201
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))


def test_shuffled_files_give_the_batch_result_and_go_on_after_a_restart(spark: SparkSession, tmp_path: Path) -> None:
    rng = random.Random(8)
    rows = [(rng.randrange(3), 1000 + k // 2 * 0.0004, k, rng.random()) for k in range(120)] + [(1, None, 900, 1.0), (2, 1000.0, 901, None)]
    mixed = rng.sample(rows, len(rows))
    for part in (mixed[:40], mixed[40:90]):
        write(spark, tmp_path, part)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    E.drain(E.rolling(source(spark, tmp_path), "user", "ts", "id", "value", "1 hour", 5), out, state)
    assert spark.read.parquet(out).count() == 0, "nothing is taken before the watermark"
    write(spark, tmp_path, mixed[90:])
    write(spark, tmp_path, [(None, 10_000.0, -1, 0.0)])
    E.drain(E.rolling(source(spark, tmp_path), "user", "ts", "id", "value", "1 hour", 5), out, state)
    names = ["median", "avg", "max", "value_now", "global_avg"]
    batch = spark.createDataFrame([r for r in rows if r[1] is not None and r[3] is not None], "user long, s double, id long, value double")
    expected = {(r["user"], r["id"]): [pytest.approx(r[c]) for c in names] for r in T.rolling(batch, ["user"], [F.asc("s"), F.asc("id")], "value", 5).collect()}
    assert {(r["key"], r["event"]): [r[c] for c in names] for r in spark.read.parquet(out).where("key is not null").collect()} == expected


def test_late_rows_are_counted(spark: SparkSession, tmp_path: Path) -> None:
    write(spark, tmp_path, [(1, 1000.0, 0, 1.0), (1, 5000.0, 1, 2.0)])
    write(spark, tmp_path, [(1, 5001.0, 2, 3.0)])
    write(spark, tmp_path, [(1, 1100.0, 3, 9.0), (1, 4990.0, 4, 4.0)])
    write(spark, tmp_path, [(None, 90_000.0, -1, 0.0)])
    query = E.drain(E.ema(source(spark, tmp_path), "user", "ts", "id", "value", "1 minute", 0.5, 1.0), str(tmp_path / "out"), str(tmp_path / "state"))
    assert E.late_rows(query) == 1
    assert sorted(r["event"] for r in spark.read.parquet(str(tmp_path / "out")).where("key = 1").collect()) == [0, 1, 2, 4]
    counts = E.windows(source(spark, tmp_path), "ts", "1 minute", "100 seconds", ["user"], "value")
    query = E.drain(counts, str(tmp_path / "w"), str(tmp_path / "ws"))
    assert E.late_rows(query) >= 1
    assert sorted((r["start"].timestamp() % 86400, r["n"]) for r in spark.read.parquet(str(tmp_path / "w")).where("user = 1").collect()) == [(1000.0, 1), (4900.0, 1), (5000.0, 2)]


def test_calls_to_the_state_store_do_not_grow_with_the_keys(spark: SparkSession, tmp_path: Path) -> None:
    """5,000 keys, one of them past 2^53, and rows without a key: state and timers are those of the buckets."""
    big = 2**53 + 1
    rows = [(k, 1000.0 + k % 7, k, float(k)) for k in range(5000)] + [(big, 1001.0, 9000, 1.0), (None, 1002.0, 9001, 2.0)]
    write(spark, tmp_path, rows)
    write(spark, tmp_path, [(None, 10_000.0, -1, 0.0)])
    query = E.drain(E.ema(source(spark, tmp_path), "user", "ts", "id", "value", "1 minute", 0.5, 1.0), str(tmp_path / "out"), str(tmp_path / "state"))
    assert max(s["customMetrics"].get("numRegisteredTimers", 0) for p in query.recentProgress for s in p["stateOperators"]) <= 512
    found = {(r["key"], r["event"]): r["ema"] for r in spark.read.parquet(str(tmp_path / "out")).where("event >= 0").collect()}
    assert found == {(k, e): v for k, _, e, v in rows}
