"""A corpus pipeline: each stage applies one corpus operator to what the one before it kept.

In order: documents that the toxicity machine rejects go; of equal texts the one with the
smallest doc_id stays; of each group of near duplicates one stays; personal data is
replaced in the text; and the rest is packed into sequences. Each stage's result is
written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from boxwise.llm.common import shared_folder
from boxwise.llm.exact_dedup import drop_exact_duplicates
from boxwise.llm.near_dedup import drop_near_duplicates
from boxwise.llm.packing import pack
from boxwise.llm.pii import redact
from boxwise.llm.queries import token_pattern, tokenizer_file
from boxwise.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_file("byte_bpe_50k.tiktoken"), token_pattern())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: SQL expresses neither the learnt stages nor the packing; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the rows of the last.

    Null and empty texts go through every stage as empty ones: they are copies of each
    other, near no other text, hold no personal data, and are a piece of one id. Rows
    with a null doc_id are never dropped as duplicates and keep it. Rows that repeat a
    doc_id with the same text are left once by the exact stage. Columns other than
    doc_id and text are carried to the last stage, whatever their names, but for n_chars, which
    follows the text. Without labels nothing is rejected; an empty
    table gives no rows. Each run writes to a new folder, which stays for a restart.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
