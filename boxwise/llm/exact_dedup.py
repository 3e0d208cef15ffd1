"""Exact dedup by an extendible-hash index on shared files.

A directory maps the leading bits of a text's 64-bit hash to a bucket. Its depth grows
with the table: from one bucket, every bucket with more distinct keys than its capacity
is split in two, and the directory doubles where a bucket's depth reaches its own. The
keys' counts, not the texts, decide that, so the directory is there before a text moves.

Every row then finds its bucket in the directory. Within a bucket, texts of one hash
are a chain, and texts of a chain are compared byte by byte: that is Spark's hash
aggregation on (bucket, hash, text), whose map side leaves one row a text and task, so a
group of copies of any size costs a row a task. Entries go to Parquet files in the
shared folder, where each owner task has written a range of buckets, and rows look
their entry up by bucket and hash; of a chain they take the one of the same length and
SHA-256, so that texts are moved once only. Nothing here runs in Python.
"""

from __future__ import annotations

import uuid
from math import ceil, log2

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxwise.llm.common import shared_folder, text_table

#: Distinct keys to a bucket at most.
CAPACITY = 20_000
#: Buckets that the directory is made for at most, and slots to a bucket: they bound what is broadcast, at
#: 2^20 slots of 16 bytes. Where that many buckets of CAPACITY would not do, the capacity doubles instead.
BUCKETS, SLACK = 1 << 17, 3


def normalised(text: F.Column) -> F.Column:
    """The text with each run of space and 0x09-0x0D replaced by one space."""
    return F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, norm and h, the hash of norm."""
    return text_table(docs).select("doc_id", normalised(F.col("text")).alias("norm")).withColumn("h", F.xxhash64("norm"))


def slot(h: F.Column, depth: int) -> F.Column:
    """The leading `depth` bits of a 64-bit hash."""
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(slot, bucket, depth) for each slot that a hash h of keys falls in, and the number of leading bits that make a slot.

    A bucket is the shallowest prefix with at most `capacity` distinct hashes; its number
    is the prefix with a 1 before it, so that numbers of all depths differ. A slot that
    is still overfull alone, as when all hashes agree, is a bucket with a longer chain.
    """
    distinct = keys.select("h").distinct()
    total = distinct.count()
    capacity = max(capacity, ceil(total / BUCKETS))
    bits = ceil(log2(max(1, ceil(total / capacity)))) + SLACK
    counts = distinct.groupBy(slot(F.col("h"), bits).alias("slot")).count()
    every = F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth")
    prefix = F.expr(f"shiftrightunsigned(slot, int({bits} - depth))")
    sizes = counts.select("slot", "count", every).groupBy("depth", prefix.alias("prefix")).agg(F.sum("count").alias("n"), F.collect_list("slot").alias("slots"))
    fitting = sizes.where((F.col("n") <= capacity) | (F.col("depth") == bits)).select(F.explode("slots").alias("slot"), "depth", "prefix")
    first = fitting.groupBy("slot").agg(F.min(F.struct("depth", "prefix")).alias("b"))
    return first.select("slot", F.expr("shiftleft(1L, int(b.depth)) | b.prefix").alias("bucket"), F.col("b.depth").alias("depth")), bits


def in_buckets(rows: DataFrame, slots: DataFrame, bits: int) -> DataFrame:
    """rows, which have h, with the bucket that the directory gives."""
    return rows.withColumn("slot", slot(F.col("h"), bits)).join(F.broadcast(slots.select("slot", "bucket")), "slot").drop("slot")


def build_index(docs: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame, int]:
    """The index, one row (bucket, h, text_sha256, n_bytes, keep_id, group_size) for each distinct text, and its directory.

    Both are read back from the shared folder.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/exact-index-{uuid.uuid4().hex}"
    rows = hashed(docs)
    slots, bits = directory(rows, capacity)
    slots.write.parquet(f"{folder}/directory")
    slots = spark.read.schema("slot long, bucket long, depth int").parquet(f"{folder}/directory")
    chains = in_buckets(rows, slots, bits).groupBy("bucket", "h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    entries = chains.select("bucket", "h", F.sha2("norm", 256).alias("text_sha256"), F.octet_length("norm").alias("n_bytes"), "keep_id", "group_size")
    entries.write.parquet(f"{folder}/entries")
    spark.read.schema(entries.schema).parquet(f"{folder}/entries").repartitionByRange("bucket", "h").sortWithinPartitions("bucket", "h").write.parquet(f"{folder}/buckets")
    return spark.read.schema(entries.schema).parquet(f"{folder}/buckets"), slots, bits


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same bytes after normalised(); a null text is
    an empty one, and all empty texts are copies of each other. The smallest doc_id
    of a group stays. Rows that repeat a doc_id with the same text count each and
    share `kept`; drop_exact_duplicates() leaves one of them. A null doc_id is never
    the smallest, unless all ids of the group are null: then keep_id is null and
    kept is true. An empty table gives an empty result. Columns other than doc_id and
    text are not read, so their names do not matter.
    """
    index, slots, bits = build_index(docs, capacity)
    keyed = hashed(docs).select("doc_id", "h", F.sha2("norm", 256).alias("text_sha256"), F.octet_length("norm").alias("n_bytes"))
    found = in_buckets(keyed, slots, bits).join(index, ["bucket", "h", "text_sha256", "n_bytes"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of docs without later copies; of rows that repeat the doc_id too, one stays.

    Rows with a null doc_id stay, as nothing tells them apart by id.
    """
    index, slots, bits = build_index(docs, capacity)
    kept = index.where("keep_id is not null").select(F.col("keep_id").alias("doc_id"), F.col("bucket").alias("__bx_bucket"), F.col("text_sha256").alias("__bx_sha"))
    norm = normalised(F.coalesce(F.col("text"), F.lit("")))
    keyed = docs.withColumn("__bx_sha", F.sha2(norm, 256)).withColumn("__bx_slot", slot(F.xxhash64(norm), bits))
    placed = keyed.where("doc_id is not null").join(F.broadcast(slots.select(F.col("slot").alias("__bx_slot"), F.col("bucket").alias("__bx_bucket"))), "__bx_slot")
    # The window needs the rows as the join has dealt and sorted them: no further shuffle.
    keys = ["doc_id", "__bx_bucket", "__bx_sha"]
    again = Window.partitionBy(*keys).orderBy("doc_id")
    named = placed.join(kept, keys).withColumn("__bx_n", F.row_number().over(again)).where("__bx_n = 1")
    return named.select(docs.columns).unionByName(keyed.where("doc_id is null").select(docs.columns))
