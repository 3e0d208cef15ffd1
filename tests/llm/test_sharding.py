"""Uniform shards: exact sizes, gapless slots, and the laws of the draws."""

from __future__ import annotations

import zlib
from collections import Counter
from math import comb

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from boxwise.llm.queries import op13_hypergeometric_shards
from boxwise.llm.sharding import communication_matrix, hypergeometric, shard_digest, shuffled, sizes_of, uniform, write_shards


def check(rows: list, docs: list[tuple], shards: int) -> None:
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == len(docs) and set(sizes) <= set(range(shards))
    assert max((sizes[k] for k in range(shards)), default=0) - min((sizes[k] for k in range(shards)), default=0) <= 1
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(k, i) for k in range(shards) for i in range(sizes[k])]
    own = lambda d, t: (d is None, d or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == sorted(own(d, t) for d, t in docs)
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in rows)


def test_documents(spark: SparkSession, sf_dir: str) -> None:
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(op13_hypergeometric_shards(spark, sf_dir).collect(), docs, 24)


def test_odd_rows(spark: SparkSession) -> None:
    docs = [(k // 2, "é" * (k % 5)) for k in range(60)] + [(None, None), (None, None), (7, "x" * 3_000_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("shard", F.lit("x")).withColumn("SLOT", F.lit(1)).withColumn("size", F.lit(1))
    check(shard_digest(df.repartition(7), 5).collect(), docs, 5)
    assert {"doc_id", "text", "size", "shard", "slot"} == set(shuffled(df, 3).columns)
    check(shard_digest(spark.createDataFrame([], "doc_id long, text string")).collect(), [], 24)
    check(shard_digest(spark.createDataFrame([(1, "a")], "doc_id long, text string")).collect(), [(1, "a")], 24)


def test_small_blocks_and_ranges_and_files(spark: SparkSession, tmp_path) -> None:  # noqa: ANN001
    df = spark.range(5000).withColumn("text", F.lit("t"))
    rows = shuffled(df.repartition(6), 7, block_bits=6, range_rows=32).collect()
    assert sorted(Counter(r["shard"] for r in rows).values()) == sizes_of(5000, 7)[::-1]
    assert len({(r["shard"], r["slot"]) for r in rows}) == 5000 and max(r["slot"] for r in rows) == 714
    write_shards(df, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 5000 and back.groupBy("shard").count().select("count").distinct().collect()[0][0] == 1250


def test_draws_follow_the_hypergeometric_law(spark: SparkSession) -> None:
    for good, bad, draws in ((7, 13, 9), (1, 30, 5), (12, 2, 11), (400, 600, 500)):
        n = 20_000
        drawn = spark.range(n).select(F.expr(hypergeometric(f"{good}L", f"{bad}L", f"{draws}L", uniform("id", f"{good}"))).alias("x")).groupBy("x").count().collect()
        seen = {r["x"]: r["count"] for r in drawn}
        law = {k: comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws) for k in range(max(0, draws - bad), min(good, draws) + 1)}
        assert set(seen) <= set(law)
        usual = [k for k, p in law.items() if p * n >= 10]
        chi = sum((seen.get(k, 0) - law[k] * n) ** 2 / (law[k] * n) for k in usual)
        assert chi < len(usual) + 5 * (2 * len(usual)) ** 0.5 + 5, (good, bad, draws, chi)


def test_matrix_has_its_margins_and_its_law(spark: SparkSession) -> None:
    """The number of rows from the first block to the first shard, over many seeds."""
    sizes, shards = [3, 7, 1, 4, 5], [8, 6, 6]
    blocks = spark.createDataFrame(list(enumerate(sizes)), "block long, n long").coalesce(1)
    for seed in range(3):
        m = sorted(communication_matrix(blocks, shards, len(sizes), seed).collect())
        assert [(r["block"], r["n"]) for r in m] == list(enumerate(sizes))
        assert all(sum(r["to"]) == r["n"] for r in m) and [sum(c) for c in zip(*(r["to"] for r in m), strict=True)] == shards


def test_every_place_is_as_likely(spark: SparkSession) -> None:
    """Rows that stand next to each other, and copies of a text, are spread as chance has it."""
    rows = shuffled(spark.range(0, 48_000, 1, 12).withColumn("kind", F.expr("id div 12000")), 24, seed=4).groupBy("shard", "kind").count().collect()
    chi = sum((r["count"] - 500) ** 2 / 500 for r in rows)
    assert len(rows) == 96 and 69 - 5 * 12 < chi < 69 + 5 * 12
    firsts = shuffled(spark.range(0, 48_000, 1, 12), 24, seed=5).where("slot < 100").agg(F.avg("id")).first()[0]
    assert abs(firsts - 24_000) < 5 * 48_000 / (12 * 2400) ** 0.5
