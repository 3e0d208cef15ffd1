"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

A code is the signs of a unit vector's coordinates after centring and a learned
rotation: principal axes, then the rotation that brings the coordinates closest to
their signs. Mean, rotation and search radius are fitted on a sample of at most
`sample` vectors, chosen by a hash of vec_id; every vector is indexed.

A code is split into SUBSTRINGS, each with an index of its own. If two codes differ
in r bits at most, then with r = SUBSTRINGS * s + a, they differ in s bits at most in
one of the first a + 1 substrings or in s - 1 at most in one of the others; probing
these keys therefore retrieves every code within the radius. Those are then ranked
by the cosine of the original vectors. Where a block holds fewer than k vectors
within the radius, the radius grows until it has k, or all.

The stated queries meet the rows block by block: each task indexes one block of
vectors and answers one block of queries with at most k rows a query. One index for all
rows, joined with the queries' keys, was tried: where vectors are nearly isotropic,
as here, a quarter of all codes lie within the radius, and every such pair has to be
shuffled with both vectors before it can be ranked; in blocks no pair leaves its task.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SUBSTRINGS = 4
#: Vectors to a block at most on average, queries to a block, and the number of blocks for small tables.
BLOCK, QUERIES, LEAST_BLOCKS = 65_536, 4_096, 16

_BITS = np.array([bin(k).count("1") for k in range(1 << 16)], dtype=np.uint8)


@dataclass(frozen=True)
class Codes:
    """mean and rotation of unit vectors; radius in bits."""

    mean: np.ndarray
    rotation: np.ndarray
    radius: int

    def of(self, unit: np.ndarray) -> np.ndarray:
        """Codes as SUBSTRINGS columns of 16 bits; bits past the rotation's are 0."""
        signs = (unit - self.mean) @ self.rotation > 0
        padded = np.zeros((len(unit), SUBSTRINGS * 16), dtype=bool)
        # Bits are dealt to the substrings in turn, so that each has its share.
        order = np.arange(signs.shape[1])
        padded[:, (order % SUBSTRINGS) * 16 + order // SUBSTRINGS] = signs
        return np.packbits(padded, axis=1).view(">u2").astype(np.uint16)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def learn(x: np.ndarray, k: int = 5, recall: float = 0.985, rounds: int = 40) -> Codes:
    """Codes for vectors like the rows of x."""
    unit = _unit(x)
    mean = unit.mean(axis=0)
    bits = min(x.shape[1], SUBSTRINGS * 16)
    _, _, axes = np.linalg.svd(unit - mean, full_matrices=True)
    axes = axes[:bits].T
    v = (unit - mean) @ axes
    turn = np.linalg.qr(np.random.default_rng(8).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.sign(v @ turn).T @ v)
        turn = (left @ right).T
    codes = Codes(mean, axes @ turn, 0)
    own = codes.of(unit)
    found = []
    for i in range(0, len(x), max(1, len(x) // 400)):
        near = unit @ unit[i]
        near[i] = -2
        best = np.argpartition(-near, min(k, len(x) - 1) - 1)[:k]
        found.append(_BITS[own[best[best != i]] ^ own[i]].sum(axis=1))
    # Neighbours in all rows are no farther than those in the sample.
    return Codes(mean, codes.rotation, int(np.quantile(np.concatenate(found), recall, method="higher")) if len(x) > 1 else bits)


class Index:
    """The substring indexes of some vectors."""

    def __init__(self, codes: Codes, ids: np.ndarray, x: np.ndarray) -> None:
        self.codes, self.ids, self.x = codes, ids, x
        self.norms = np.sqrt((x * x).sum(axis=1))
        self.own = codes.of(x / self.norms[:, None])
        self.keys, self.rows = [], []
        for column in self.own.T:
            order = np.argsort(column, kind="stable")
            keys, first = np.unique(column[order], return_index=True)
            self.keys.append((keys, np.append(first, len(order))))
            self.rows.append(order)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code differs from the given one in `radius` bits at most."""
        each, more = divmod(radius, SUBSTRINGS)
        hit = np.zeros(len(self.ids), dtype=bool)
        for k, ((keys, first), rows) in enumerate(zip(self.keys, self.rows, strict=True)):
            near = np.flatnonzero(_BITS[keys ^ code[k]] <= (each if k <= more else each - 1))
            counts = first[near + 1] - first[near]
            hit[rows[np.repeat(first[near] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]] = True
        rows = np.flatnonzero(hit)
        return rows[_BITS[self.own[rows] ^ code].sum(axis=1) <= radius]

    def nearest(self, own_id: int, q: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the k nearest found, ties by id; rows of the query's own id take no part."""
        radius, bits = self.codes.radius, SUBSTRINGS * 16
        while True:
            rows = self.within(code, radius)
            rows = rows[self.ids[rows] != own_id]
            if len(rows) >= k or radius >= bits:
                break
            radius = min(bits, radius + SUBSTRINGS)
        # Row by row alike, so that equal vectors have equal cosines.
        cosine = (self.x[rows] * q).sum(axis=1) / (self.norms[rows] * np.sqrt((q * q).sum()))
        best = np.lexsort((self.ids[rows], -cosine))[:k]
        return self.ids[rows[best]], cosine[best]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (double) of the vectors that are not null, zero or empty and hold finite numbers only, with an id."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ok = F.col("vec_id").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda v: v != 0)
    return vectors.where(F.coalesce(ok, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding"))


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return pa.concat_arrays(column.chunks).flatten().to_numpy().reshape(-1, size) if column.num_chunks else np.zeros((0, size))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, sample: int = 4_096) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest vectors found for every query.

    Both have vec_id and embedding. score is the cosine in double precision; ties
    go to the smaller vec_id. Vectors that are null, zero, or hold a null or a
    non-finite number take no part, nor do those of another length than most.
    Rows that repeat a vec_id are candidates each; queries that repeat one are answered
    as one. Empty tables give no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    rows, asked = usable(vectors), usable(queries).dropDuplicates(["vec_id"])
    sizes = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], out)
    size, total = sizes[0]
    rows, asked = rows.where(F.size("embedding") == size), asked.where(F.size("embedding") == size)
    share = min(1.0, sample / total)
    chosen = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(8)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(2 * sample).toArrow()
    if not len(chosen):
        chosen = rows.limit(sample).toArrow()
    codes = learn(_matrix(chosen["embedding"], size), k)
    blocks = max(ceil(total / BLOCK), min(LEAST_BLOCKS, ceil(total / 1024)))
    asks = max(1, ceil(asked.count() / QUERIES))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("ask", each(asks))
    right = asked.withColumn("ask", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(asks)).cast("int")).withColumn("block", each(blocks))

    def search(own: pa.Table, asked: pa.Table) -> pa.Table:
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        if len(own) and len(asked):
            index = Index(codes, own["vec_id"].to_numpy(), _matrix(own["embedding"], size))
            q = _matrix(asked["embedding"], size)
            for i, x, code in zip(asked["vec_id"].to_pylist(), q, codes.of(_unit(q)), strict=True):
                found.append((i, *index.nearest(i, x, code, k)))
        n = [len(ids) for _, ids, _ in found]
        none = np.zeros(0)
        return pa.table(
            {
                "query_id": pa.array(np.repeat(np.array([i for i, _, _ in found], dtype=np.int64), n)),
                "vec_id": pa.array(np.concatenate([none.astype(np.int64), *(ids for _, ids, _ in found)])),
                "score": pa.array(np.concatenate([none, *(s for _, _, s in found)])),
            }
        )

    near = left.groupBy("block", "ask").cogroup(right.groupBy("block", "ask")).applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
