"""Near-duplicate documents by circulant MinHash.

Two permutations make a whole signature: the first scatters a text's shingles over
DOMAIN slots, the second, turned by k slots, gives coordinate k. Turning is reading
a window of the permutation's table, so a shingle costs one copy of COORDINATES
numbers. ROWS coordinates make a band; texts that share a band are candidates, and
a candidate is a link only after the whole shingle sets have been compared.

Texts with the same words are one class from the start, and its smallest doc_id
stands for it. In each bucket of a band, classes are first compared with the
bucket's smallest member, then, where a bucket still holds several components, with
a few members of its largest one. Buckets that are still mixed compare the members
outside their largest component with every member, in blocks. So no link between
components is lost, and a large group of near copies costs its size, not its square.
Before texts are compared, pairs past the first are held to a bound that no link fails:
a bit of a parity plane says whether an odd number of a set's shingles falls on it, so that
two planes differ in no more bits than the sets do in shingles, which for a link is a
seventh of both sizes at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxwise.llm.common import checkpointed, mix64, shingle_hashes, shingle_sets, text_table, utf8_steps, word_hashes

SHINGLE = 5
#: A link at similarity 0.75 is missed with probability (1 - 0.75^ROWS)^(BANDED / ROWS), 5e-6.
BANDED, ROWS = 128, 4
#: Bits of a parity plane. Sets of more than half as many shingles have a wide plane too, of twice to four times their size.
PLANE = 2048
#: Members of a bucket's largest component that the others are compared with first.
HUBS = 4
DOMAIN = 1 << 20
#: Numbers in memory at once while signatures are made.
CHUNK = 1 << 22
#: Pairs of one bucket that one block compares, about, and pairs that share one copy of a text while they are verified.
BLOCK, TURN = 1 << 22, 64
WORDS = [f"s{k}" for k in range(PLANE // 64)]

_tables: list[np.ndarray] = []


def permutations() -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and the turning one followed by its own start."""
    if not _tables:
        slots = np.arange(DOMAIN, dtype=np.uint64)
        scatter = np.argsort(mix64(slots), kind="stable").astype(np.int32)
        turn = np.argsort(mix64(slots + np.uint64(DOMAIN)), kind="stable").astype(np.uint32)
        _tables[:] = [scatter, np.concatenate([turn, turn[:BANDED]])]
    return _tables[0], _tables[1]


def signatures(hashes: np.ndarray, text: np.ndarray, n_texts: int, coordinates: int) -> np.ndarray:
    """The circulant MinHash of each text, given its shingles (text ascending); all ones for a text without."""
    scatter, turn = permutations()
    windows = np.lib.stride_tricks.sliding_window_view(turn, coordinates)
    out = np.full((n_texts, coordinates), np.iinfo(np.uint32).max, dtype=np.uint32)
    slots = scatter[(hashes % np.uint64(DOMAIN)).astype(np.int64)]
    size = CHUNK // coordinates
    for at in range(0, len(slots), size):
        own = text[at : at + size]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        least = np.minimum.reduceat(windows[slots[at : at + size]], first, axis=0)
        out[own[first]] = np.minimum(out[own[first]], least)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """One 64-bit bucket number for each band of each signature; bands have no bucket in common."""
    parts = signature.reshape(len(signature), -1, ROWS).astype(np.uint64)
    total = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2])
    for k in range(ROWS):
        total = mix64(total ^ mix64(parts[:, :, k]))
    return total.astype(np.int64)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, offsets in utf8_steps(batch["text"]):
            words, bounds = word_hashes(data, offsets)
            hashes, text = shingle_hashes(words, bounds, SHINGLE)
            _, before = shingle_sets(words, bounds, SHINGLE)
            n = len(offsets) - 1
            raw = data.tobytes()
            keys = [hashlib.blake2b(b" ".join(raw[a:b].lower().split()), digest_size=16).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            numbers = bands(signatures(hashes, text, n, BANDED))
            yield pa.record_batch(
                [
                    batch["doc_id"].slice(first, n),
                    pa.array(np.diff(before), pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * numbers.shape[1], pa.int32()), pa.array(numbers.ravel())),
                ],
                ["doc_id", "n_shingles", "key", "bands"],
            )


def parity(hashes: np.ndarray, text: np.ndarray, n_texts: int, bits: int) -> np.ndarray:
    """For each text, packed: which of `bits` places an odd number of its shingles falls on. Halving bits folds the upper half onto the lower by xor."""
    places, counts = np.unique(text * bits + (hashes % np.uint64(bits)).astype(np.int64), return_counts=True)
    odd = np.zeros(n_texts * bits, dtype=bool)
    odd[places[counts % 2 == 1]] = True
    return np.packbits(odd).reshape(n_texts, bits // 8)


def _planes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, offsets in utf8_steps(batch["text"]):
            hashes, before = shingle_sets(*word_hashes(data, offsets), SHINGLE)
            sizes = np.diff(before)
            n = len(sizes)
            plane = parity(hashes, np.repeat(np.arange(n), sizes), n, PLANE).view(np.int64)
            wide = [parity(hashes[a:b], np.zeros(b - a, np.int64), 1, 2 << int(b - a).bit_length()).tobytes() if b - a > PLANE // 2 else None for a, b in zip(before[:-1], before[1:], strict=True)]
            yield pa.record_batch([batch["doc_id"].slice(first, n), pa.array(sizes, pa.int64()), pa.array(wide, pa.binary()), *(pa.array(np.ascontiguousarray(x)) for x in plane.T)], ["node", "n", "wide", *WORDS])


def _narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose wide planes, where both have one, allow a link."""
    for batch in batches:
        left = np.ones(len(batch), dtype=bool)
        for row in np.flatnonzero(pc.and_(batch["wide_a"].is_valid(), batch["wide_b"].is_valid()).to_numpy(zero_copy_only=False)).tolist():
            x, y = (np.frombuffer(batch[c][row].as_py(), dtype=np.uint8) for c in ("wide_a", "wide_b"))
            while len(x) > len(y):
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            while len(y) > len(x):
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
            left[row] = 7 * int(np.bitwise_count(x ^ y).sum()) <= batch["n_a"][row].as_py() + batch["n_b"][row].as_py()
        left = pa.array(left)
        yield pa.record_batch([batch["a"].filter(left), batch["b"].filter(left)], ["a", "b"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs with 100 * intersection >= 75 * union of the two texts' shingle sets."""

    def sets(column: pa.Array) -> Iterator[np.ndarray]:
        for _, data, offsets in utf8_steps(column):
            hashes, before = shingle_sets(*word_hashes(data, offsets), SHINGLE)
            yield from np.split(hashes, before[1:-1])

    for batch in batches:
        passed = []
        for a, b in zip(sets(batch["text_a"]), sets(batch["text_b"]), strict=True):
            both = len(np.intersect1d(a, b, assume_unique=True))
            passed.append(100 * both >= 75 * (len(a) + len(b) - both) and both > 0)
        passed = pa.array(passed, pa.bool_())
        yield pa.record_batch([batch["a"].filter(passed), batch["b"].filter(passed)], ["a", "b"])


def links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough.

    Each pair fetches the text of b, and goes with TURN others of its a, about, to one copy of
    the text of a: one that is in many pairs is many keys.
    """
    pairs = checkpointed(pairs)
    turns = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TURN).alias("turns"))
    dealt = pairs.join(turns, "a").select("a", "b", F.pmod(F.xxhash64("b"), "turns").alias("turn"))
    left = turns.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "text_a")
    right = dealt.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return right.join(left, ["a", "turn"]).select("a", "b", "text_a", "text_b").mapInArrow(_linked, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of (a, b) edges: the smallest node reachable.

    Each round hangs every node, and its neighbours, on the smallest neighbour it
    knows, and then each on its smallest neighbour's own; the number of rounds grows
    with the logarithm of the longest path. Rounds are cut by checkpoints.
    """

    def stars(edges: DataFrame, whole: bool) -> DataFrame:
        pairs = edges.select("a", "b")
        if whole:  # both directions; neighbours larger than the node hang on its smallest
            pairs = pairs.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        moved = pairs.join(least, "a")
        if whole:
            return moved.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        return moved.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b"))).where("a > b").distinct()

    def settled(edges: DataFrame) -> bool:
        """Whether every node that hangs on another has nothing on it, and hangs on one only."""
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select("b", F.lit(0), F.lit(1)).toDF("node", "up", "down"))
        return ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or up = 1 and down > 0").isEmpty()

    edges = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    while not settled(edges):
        edges = checkpointed(stars(stars(edges, True), False))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _edges(names: DataFrame) -> DataFrame:
    return names.select(F.col("node").alias("a"), F.col("component").alias("b"))


def _mixed(buckets: DataFrame, names: DataFrame) -> DataFrame:
    """The rows (bucket, node) of buckets with several components, with component, the bucket's largest one, major, and its numbers of members, size, and of those outside of major, outside."""
    placed = buckets.join(names, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    sizes = placed.groupBy("bucket", "component").count().groupBy("bucket").agg(F.max_by("component", F.struct("count", "component")).alias("major"), F.sum("count").alias("size"), F.max("count").alias("most"))
    return placed.join(sizes.where("size > most"), "bucket").select("bucket", "node", "component", "major", "size", (F.col("size") - F.col("most")).alias("outside"))


def _pairs(mixed: DataFrame, planes: DataFrame, hubs: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of one bucket and different components, one of them outside of the largest, that size and parity allow.

    b is any member, or one of hubs, a few rows of each bucket. A pair comes from the
    first of its common buckets alone, however many there are, and once where both are
    outside. Blocks hold a share of the members and all outside, or, with hubs, a share
    of those outside and all hubs.
    """
    others = mixed if hubs is None else hubs
    blocks = F.ceil(F.col("outside") * (F.col("size") if hubs is None else F.lit(HUBS)) / BLOCK)
    shared = F.pmod(F.xxhash64("node"), blocks)
    copied = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))

    def side(rows: DataFrame, known: DataFrame, end: str, block: Column) -> DataFrame:
        own = known.groupBy("node").agg(F.collect_set("bucket").alias("own"))
        held = rows.select("bucket", "node", "component", "major", block.alias("block")).join(own, "node").join(planes, "node")
        return held.select("bucket", "block", *(F.col(c).alias(f"{c}_{end}") for c in ("node", "component", "major", "own", "n", "wide", *WORDS)))

    differ = " + ".join(f"bit_count({x}_a ^ {x}_b)" for x in WORDS)
    once = "(component_b = major_b or node_a < node_b) and array_min(array_intersect(own_a, own_b)) = bucket"
    near = F.expr(f"component_a <> component_b and 100 * least(n_a, n_b) >= 75 * greatest(n_a, n_b) and 7 * ({differ}) <= n_a + n_b and {once}")
    left = side(mixed.where("component <> major"), mixed, "a", copied if hubs is None else shared)
    found = left.join(side(others, others, "b", shared if hubs is None else copied), ["bucket", "block"]).where(near)
    ends = F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")
    return found.select(*ends, "n_a", "n_b", "wide_a", "wide_b").mapInArrow(_narrowed, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept.

    Words are lower-cased (A-Z) runs of bytes other than white space; a set holds the
    distinct runs of SHINGLE words, or the whole text where it is shorter. Documents
    are linked at a Jaccard similarity of 0.75 or more, confirmed on the whole sets.
    component_id is the smallest doc_id reachable over links. Texts that are null,
    empty or blank have n_shingles 0 and are linked with nothing; so is a row with a
    null doc_id, whose component_id is null and which is kept. Rows of one doc_id are
    one document. An empty table gives an empty result. Columns other than doc_id and text
    are not read, whatever their names.
    """
    rows = text_table(docs)
    slim = checkpointed(rows.mapInArrow(_describe, "doc_id long, n_shingles long, key binary, bands array<long>"))
    real = slim.where("n_shingles > 0 and doc_id is not null")
    classes = real.groupBy("key").agg(F.min("doc_id").alias("node"))
    least = classes.select(F.col("node").alias("doc_id"), "key")
    dealt = real.join(least, ["doc_id", "key"]).dropDuplicates(["key"]).select(F.col("doc_id").alias("node"), F.explode("bands").alias("bucket"))
    full = dealt.groupBy("bucket").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = checkpointed(dealt.join(full, "bucket").select("bucket", "first", "node"))
    texts = checkpointed(rows.join(shared.select(F.col("node").alias("doc_id")).distinct(), "doc_id"))

    stars = shared.where("first <> node").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    names = components(links(stars, texts))
    mixed = checkpointed(_mixed(shared.select("bucket", "node"), names))
    planes = texts.join(mixed.select(F.col("node").alias("doc_id")).distinct(), "doc_id").mapInArrow(_planes, f"node long, n long, wide binary, {', '.join(f'{s} long' for s in WORDS)}")
    planes = checkpointed(planes)  # several rows of one doc_id have a plane each
    one = Window.partitionBy("bucket").orderBy(F.xxhash64("node"), "node")
    hubs = mixed.where("component = major").withColumn("k", F.row_number().over(one)).where(F.col("k") <= HUBS).drop("k")
    names = components(_edges(names).unionByName(links(_pairs(mixed, planes, hubs), texts)))
    mixed = checkpointed(_mixed(mixed.select("bucket", "node"), names))
    final = components(_edges(names).unionByName(links(_pairs(mixed, planes), texts)))

    named = classes.join(final, "node", "left").select("key", F.coalesce("component", "node").alias("component"))
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    alone = slim.where(~linked).select("doc_id", "n_shingles", F.col("doc_id").alias("component"))  # no key for them all
    joined = slim.where(linked).select("doc_id", "n_shingles", "key").join(named, "key").drop("key").unionByName(alone)
    return joined.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs whose document stays: the smallest doc_id of each component, and rows without an id."""
    kept = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
