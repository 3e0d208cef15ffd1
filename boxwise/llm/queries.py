"""The corpus operators as registered queries, and the SQL that checks those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from boxwise.llm.ann import nearest
from boxwise.llm.bpe import round_trip
from boxwise.llm.conversations import oracle_sql as conversation_sql
from boxwise.llm.conversations import repair
from boxwise.llm.exact_dedup import exact_duplicates
from boxwise.llm.licenses import license_matches, license_notices
from boxwise.llm.licenses import oracle_sql as license_sql
from boxwise.llm.lm_score import pseudo_likelihood
from boxwise.llm.near_dedup import near_duplicates
from boxwise.llm.packing import pack
from boxwise.llm.pii import personal_data
from boxwise.llm.secrets import digests, scan
from boxwise.llm.sharding import shard_digest
from boxwise.llm.spelling import oracle_sql as spelling_sql
from boxwise.llm.spelling import spelling_variants
from boxwise.llm.toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file, in the folder that BOXWISE_TOKENIZERS names or else in the installed package."""
    if folder := os.environ.get("BOXWISE_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), token_pattern())


def op2_skip_chain_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_table(spark, sf_dir, "documents"))


def op3_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(_table(spark, sf_dir, "documents"))


def op3_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_notices(_table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op5_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(scan(_table(spark, sf_dir, "documents")))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op7_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(_table(spark, sf_dir, "documents"))


def op8_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op9_fm_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op11_even_partition_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


def op12_earley_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(_table(spark, sf_dir, "conversations"))


def op13_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digest(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_skip_chain_crf": op2_skip_chain_crf,
    "op3_license_dice": op3_license_dice,
    "op3_license_notices": op3_license_notices,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_linked_secrets": op5_linked_secrets,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_pseudo_likelihood": op7_pseudo_likelihood,
    "op8_multi_index_hashing": op8_multi_index_hashing,
    "op9_fm_toxicity": op9_fm_toxicity,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_even_partition_join": op11_even_partition_join,
    "op12_earley_repair": op12_earley_repair,
    "op13_hypergeometric_shards": op13_hypergeometric_shards,
}

ORACLE_SQL: dict[str, str] = {
    "op3_license_dice": license_sql(),
    "op10_exact_dedup": """
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)""",
    "op11_even_partition_join": spelling_sql(),
    "op12_earley_repair": conversation_sql(),
}
