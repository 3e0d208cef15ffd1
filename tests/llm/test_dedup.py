"""Exact and near dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import SparkSession
from tokenizers import Tokenizer

import corpus_pipeline
from boxwise.llm import near_dedup
from boxwise.llm.exact_dedup import SLACK, build_index, directory, drop_exact_duplicates, exact_duplicates
from boxwise.llm.near_dedup import drop_near_duplicates, near_duplicates, parity
from boxwise.llm.queries import ORACLE_SQL, op3_license_dice, op6_minhash_near_dedup, op10_exact_dedup
from boxwise.llm.pii import personal_data
from boxwise.llm.toxicity import toxicity
from tests.comparing import rows_of, sql_rows
from tests.llm.test_patterns import personal
from tests.llm.test_tokens import check_packing

SCHEMA = "doc_id long, text string"


def shingles(text: str | None) -> frozenset:
    words = re.findall(r"[^ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def near(texts: dict[int, str | None]) -> list[tuple]:
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs that share a shingle."""
    sets = {d: shingles(t) for d, t in texts.items()}
    holders = defaultdict(list)
    for d, own in sets.items():
        for s in own:
            holders[s].append(d)
    top = {d: d for d in texts}

    def find(d: int) -> int:
        while top[d] != d:
            d = top[d]
        return d

    for a, own in sets.items():
        for b in {b for s in own for b in holders[s] if b > a}:
            both = len(own & sets[b])
            if 100 * both >= 75 * (len(own) + len(sets[b]) - both):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in texts)


def compare(df, texts: dict[int, str | None]) -> None:
    rows = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())
    assert rows == near(texts)


def test_near_duplicates_of_documents(spark: SparkSession, sf_dir: str) -> None:
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    compare(op6_minhash_near_dedup(spark, sf_dir), texts)


def test_near_duplicates_of_a_large_group(spark: SparkSession) -> None:
    """Variants of one text, most pairs of which are close to the threshold, in chains and apart."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(150)]
    texts: dict[int, str | None] = {}
    for d in range(240):
        words = list(base)
        for k in rng.sample(range(150), rng.choice([0, 1, 2, 3, 4])):
            words[k] = f"x{rng.randrange(10**6)}"
        texts[d] = " ".join(words)
    texts |= {900: None, 901: "", 902: " \t\n", 903: "One two", 904: "ONE\ttwo ", 905: "one two three four five", 906: "é One", 907: "É One", 908: "x " * 3000}
    compare(near_duplicates(spark.createDataFrame(list(texts.items()), SCHEMA)), texts)


def test_parity_never_exceeds_the_difference() -> None:
    """Planes of any width differ in no more bits than the sets do in shingles; a wide plane folds to a narrow one."""
    rng = np.random.default_rng(4)
    for n in (1, 7, 500, 6000):
        both, a, b = (np.unique(rng.integers(0, 1 << 63, k, dtype=np.uint64)) for k in (n, n // 3, n // 2))
        x, y = np.union1d(both, a), np.union1d(both, b)
        for bits in (64, 2048, 16384):
            p, q = (parity(h, np.zeros(len(h), np.int64), 1, bits)[0] for h in (x, y))
            assert int(np.bitwise_count(p ^ q).sum()) <= len(np.setxor1d(x, y))
            half = parity(x, np.zeros(len(x), np.int64), 1, bits // 2)[0]
            assert (half == p[: len(half)] ^ p[len(half) :]).all()


def test_near_duplicates_of_long_texts_that_share_passages(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """Texts around the threshold, long and short, with one passage in common, in many blocks and turns."""
    monkeypatch.setattr(near_dedup, "BLOCK", 40)
    monkeypatch.setattr(near_dedup, "TURN", 3)
    rng = random.Random(11)
    texts = {}
    for size, ids in ((1400, range(24)), (300, range(24, 90))):
        passage = [f"p{size}x{k}" for k in range(size)]
        for d in ids:
            own = int(size * rng.choice([0.02, 0.25, 0.3, 0.33, 0.36, 0.5, 0.8]))
            texts[d] = " ".join(passage + [f"d{rng.randrange(8)}w{k}" if d % 2 else f"d{d}w{k}" for k in range(own)])
    compare(near_duplicates(spark.createDataFrame(list(texts.items()), SCHEMA)), texts)


def test_near_duplicates_keep_odd_rows(spark: SparkSession) -> None:
    docs = spark.createDataFrame([(None, "a b c d e f", "p"), (1, "a b c d e f", "q"), (2, "A b  c d e f", "r"), (3, None, "s"), (4, "", "t")], "doc_id long, text string, node string")
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["node"] for r in kept.collect()) == ["p", "q", "s", "t"]
    assert near_duplicates(docs.where("false")).count() == 0


def test_exact_duplicates(spark: SparkSession, sf_dir: str) -> None:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    norm = {r["doc_id"]: re.sub(r"[ \t-\r]+", " ", r["text"] or "") for r in rows}
    groups = defaultdict(list)
    for d, t in norm.items():
        groups[t].append(d)
    expected = sorted((d, min(groups[t]), len(groups[t]), d == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in norm.items())
    found = op10_exact_dedup(spark, sf_dir).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, found.collect())) == expected


def test_oracles(spark: SparkSession, sf_dir: str) -> None:
    for name, query in (("op10_exact_dedup", op10_exact_dedup), ("op3_license_dice", op3_license_dice)):
        names, expected = sql_rows(sf_dir, ORACLE_SQL[name])
        df = query(spark, sf_dir)
        assert sorted(df.columns) == names and rows_of(df) == expected


def test_exact_duplicates_of_odd_rows(spark: SparkSession) -> None:
    docs = spark.createDataFrame([(3, "a  b", 1), (2, "a\tb", 2), (2, "a b", 3), (None, "a b", 4), (7, None, 5), (5, "", 6), (6, " ", 7), (None, "z", 8)], "doc_id long, text string, bucket int")
    found = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_duplicates(docs).collect()}
    assert found == {(3, 2, 4, False), (2, 2, 4, True), (None, 2, 4, False), (7, 5, 2, False), (5, 5, 2, True), (6, 6, 1, True), (None, None, 1, True)}
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())[:2] == [(0, "a b"), (0, "z")]
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [2, 5, 6]
    assert exact_duplicates(docs.where("false")).count() == drop_exact_duplicates(docs.where("false")).count() == 0


def test_buckets_split_until_they_hold(spark: SparkSession, sf_dir: str) -> None:
    rng = random.Random(1)
    uneven = [rng.getrandbits(60) - (1 << 59) for _ in range(300)] + [rng.getrandbits(40) for _ in range(100)] * 2 + [5] * 50
    for hashes, capacity in ((uneven, 10), (uneven, 1000), ([7], 1), ([], 4)):
        slots, bits = directory(spark.createDataFrame([(h,) for h in hashes], "h long"), capacity)
        owner = {r["slot"]: (r["bucket"], r["depth"]) for r in slots.collect()}
        held = defaultdict(set)
        for h in hashes:
            bucket, depth = owner[(h % (1 << 64)) >> (64 - bits)]
            assert bucket == (1 << depth) | (h % (1 << 64)) >> (64 - depth)
            held[bucket, depth].add(h)
        assert all(len(own) <= capacity or depth == bits for (_, depth), own in held.items())
        for (bucket, depth), _ in held.items():  # no bucket lies below a prefix that would have held its keys
            parent = {h for h in hashes if depth and (h % (1 << 64)) >> (64 - depth + 1) == (bucket ^ (1 << depth)) >> 1}
            assert not depth or len(parent) > capacity
    few, many = (directory(spark.range(n).selectExpr("xxhash64(id) AS h"), 10)[1] for n in (10, 5000))
    assert (few, many) == (SLACK, 9 + SLACK)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert rows_of(exact_duplicates(docs, capacity=3)) == rows_of(exact_duplicates(docs))
    index, _, _ = build_index(docs, 3)
    assert index.groupBy("bucket").count().where("count > 3").isEmpty() and index.select("bucket").distinct().count() > 20


def test_pipeline_stages_equal_plain_versions(spark: SparkSession, sf_dir: str) -> None:
    """Each stage on what the one before it kept; all but the scores by brute force."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    held = texts(docs)

    kept = stages["toxicity"](spark, docs, sf_dir)
    clean = {r["doc_id"] for r in toxicity(docs, labels).where("predicted = 0").collect()}
    assert texts(kept) == {d: held[d] for d in clean}
    first: dict[str, int] = {}
    for d in sorted(clean):
        first.setdefault(re.sub("[ \\t-\\r]+", " ", held[d] or ""), d)
    kept = spark.createDataFrame(kept.collect(), docs.schema)
    kept = stages["exact_dedup"](spark, kept, sf_dir)
    assert texts(kept) == {d: held[d] for d in first.values()}
    expected = {d for d, _, _, stays in near(texts(kept)) if stays}
    kept = spark.createDataFrame(kept.collect(), docs.schema)
    kept = spark.createDataFrame(stages["near_dedup"](spark, kept, sf_dir).collect(), docs.schema)
    assert texts(kept) == {d: held[d] for d in expected}
    spans = {r["doc_id"]: r["spans"] for r in personal_data(kept).collect()}
    kept = spark.createDataFrame(stages["personal_data"](spark, kept, sf_dir).collect(), docs.schema)
    changed = 0
    for d, text in texts(kept).items():
        base = sorted((a, b, k) for k, a, b in personal(held[d] or ""))
        if not spans[d]:
            assert text == held[d]
        elif "crf_" not in spans[d] and all(x[1] <= y[0] for x, y in zip(base, base[1:], strict=False)):
            own, at = "", 0
            for a, b, k in base:
                own, at = own + held[d][at:a] + f"[{k.upper()}]", b
            assert text == own + held[d][at:]
            changed += 1
    assert changed
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids_of = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for d, t in texts(kept).items()}
    check_packing(stages["packing"](spark, kept, sf_dir).collect(), ids_of, 2048)


def test_pipeline_of_odd_tables(spark: SparkSession, tmp_path: Path) -> None:
    """Null ids and texts, repeated rows, added columns with names of the stages' own, no labels, no rows."""
    rows = [(1, None, 0, "x", 1.0, 7), (2, "", 0, "x", 1.0, 7), (2, "", 0, "x", 1.0, 7), (None, "a b c", 5, "y", 2.0, 8), (None, "a b c", 5, "y", 2.0, 8), (3, "write to ann@mail.example.org " + "w " * 3000, 6030, None, None, None), (4, "one two three", 13, "z", 0.0, 9), (5, "one two  three", 14, "z", 0.0, 9)]
    schema = "doc_id long, text string, n_chars long, piece string, score double, bucket long"
    for k, (docs, labels) in enumerate([(rows, [(1, 0), (4, None), (None, 1)]), (rows, []), ([], [])]):
        spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/{k}/labels.parquet")
        packed = corpus_pipeline.run(spark, f"{tmp_path}/{k}").collect()
        assert sorted((r["doc_id"] or 0, r["piece"]) for r in packed if r["doc_id"] != 3) == ([(0, 0), (0, 0), (1, 0), (4, 0)] if docs else [])
        assert sum(r["length"] for r in packed if r["doc_id"] == 3) > 3000 or not docs


def test_pipeline(spark: SparkSession, sf_dir: str) -> None:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = corpus_pipeline.run(spark, sf_dir)
    kept = {r["doc_id"] for r in packed.select("doc_id").collect()}
    exact = {r["keep_id"] for r in exact_duplicates(docs).select("keep_id").collect()}
    assert kept and kept <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert len(kept) <= len(exact)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).dtypes == docs.dtypes, name
