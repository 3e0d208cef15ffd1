"""Toxicity scores by a factorization machine over hashed terms.

A document is the set of its terms, hashed to BUCKETS numbers: its words (lower-cased
runs of letters and digits), and the stems of STEM bytes that two, and that three, of
its different words share. Its logit is b + sum of w_i + sum over pairs of <v_i, v_j>: the
pair part, found from the sums of v and v^2 in one pass, catches terms that mean
harm together only.

Fitting reads a sample of at most `max_rows` labelled rows, chosen by a hash of
doc_id. Rows with the same four MinHash coordinates of their terms, which is to say
copies, share the weight of one, so that one odd label in a large group of copies
teaches nothing. Spark sums the weights of either label for each bucket; the at most
`max_terms` buckets that exceed their expected share of a label by `least_z`
standard errors or more enter the machine. It is then fitted by numpy on the
driver, which sees max_rows by max_terms numbers at most and no text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwise.llm.common import PUNCTUATED, checkpointed, mix64, text_table, utf8_steps, word_hashes

BUCKETS = 1 << 18
FACTORS = 4
STEM = 6


@dataclass(frozen=True)
class Machine:
    """terms: ascending buckets; weight and factors by term."""

    bias: float
    terms: np.ndarray
    weight: np.ndarray
    factors: np.ndarray

    def scores(self, term: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        """Probability for each of n texts, given (term index, text) without repeats."""
        logit = self.bias + np.bincount(text, self.weight[term], n)
        for v in self.factors.T:
            logit += (np.bincount(text, v[term], n) ** 2 - np.bincount(text, v[term] ** 2, n)) / 2
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def buckets_by_text(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of each text and the text's index, by text and bucket."""
    hashes, bounds, stems = word_hashes(data, offsets, PUNCTUATED, STEM)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    order = np.lexsort((hashes, stems, text))
    hashes, stems, text = hashes[order], stems[order], text[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, stems, text = hashes[new], stems[new], text[new]
    found = [(hashes, text)]
    for k in (1, 2):  # the words of a stem stand side by side
        again = (stems[k:] == stems[:-k]) & (text[k:] == text[:-k])
        found.append((mix64(stems[k:][again] + np.uint64(k)), text[k:][again]))
    both = np.unique(np.concatenate([t * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64) for h, t in found]))
    return both % BUCKETS, both // BUCKETS


def _copies_key(bucket: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """A number for each of n texts, the same for most texts of nearly the same buckets."""
    key = np.zeros(n, dtype=np.uint64)
    if len(bucket):
        first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        for k in range(4):
            least = np.minimum.reduceat(mix64(bucket.astype(np.uint64) + np.uint64(BUCKETS * k)), first)
            key[text[first]] = mix64(key[text[first]] ^ least)
    return key.astype(np.int64)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, offsets in utf8_steps(batch["text"]):
            bucket, text = buckets_by_text(data, offsets)
            n = len(offsets) - 1
            bounds = np.searchsorted(text, np.arange(n + 1))
            terms = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(bucket, pa.int32()))
            yield pa.record_batch([batch["toxic"].slice(first, n), pa.array(_copies_key(bucket, text, n)), terms], ["toxic", "key", "terms"])


def held_out(doc_id: F.Column) -> F.Column:
    """Whether a document is outside of the training folds: crc32 of its id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_terms: int = 256, least_z: float = 6.0, rounds: int = 300, decay: float = 2e-5) -> Machine:
    """The machine learnt from labels (doc_id, toxic) outside of the held-out fold.

    Rows with a null id or label teach nothing. Without both labels the machine is
    the constant rate of label 1, or a quarter where nothing is labelled, so that then
    nothing is rejected.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    share = max_rows / max(max_rows, known.count())
    # The broadcast side is bounded by max_rows, give or take a few standard errors of the hash.
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = checkpointed(text_table(docs).join(F.broadcast(chosen), "doc_id").select("toxic", "text").mapInArrow(_terms, "toxic int, key long, terms array<int>"))
    shares = rows.groupBy("key").agg((1 / F.count(F.lit(1))).alias("weight"))
    rows = rows.join(shares, "key").select("toxic", "terms", "weight")
    n, positive = (x or 0 for x in rows.agg(F.sum("weight"), F.sum(F.col("weight") * F.col("toxic"))).first())
    rate = (positive + 0.5) / (n + 1) if n else 0.25
    bias = float(np.log(rate / (1 - rate)))
    if not 0 < positive < n:
        return Machine(bias, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)))
    counts = rows.select("toxic", "weight", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("toxic")).alias("p"))
    z = F.abs(F.col("p") - rate * F.col("n")) / F.sqrt(F.col("n") * (rate * (1 - rate)) + 1)
    best = counts.select("term", z.alias("z")).where(F.col("z") >= least_z).orderBy(F.desc("z"), "term").limit(max_terms)
    terms = np.sort(np.array([r[0] for r in best.collect()], dtype=np.int64))
    wanted = F.array(*(F.lit(int(t)) for t in terms)) if len(terms) else F.array().cast("array<int>")
    table = rows.select("toxic", "weight", F.array_intersect("terms", wanted).alias("terms")).groupBy("toxic", F.array_sort("terms").alias("terms")).agg(F.sum("weight").alias("n")).toArrow()
    x = np.zeros((len(table), len(terms)))
    for row, own in enumerate(table["terms"].to_pylist()):
        x[row, np.searchsorted(terms, own)] = 1
    return _descend(x, table["toxic"].to_numpy().astype(float), table["n"].to_numpy() / n, bias, terms, rounds, decay)


def _descend(x: np.ndarray, y: np.ndarray, share: np.ndarray, bias: float, terms: np.ndarray, rounds: int, decay: float) -> Machine:
    """Adam on the logistic loss of distinct rows x, each with its share of all rows."""
    rng = np.random.default_rng(9)
    parts = [np.array([bias]), np.zeros(x.shape[1]), rng.normal(0, 0.05, (x.shape[1], FACTORS))]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for t in range(1, rounds + 1):
        b, w, v = parts
        sums = x @ v
        logit = b + x @ w + ((sums**2).sum(1) - x @ (v**2).sum(1)) / 2
        error = (1 / (1 + np.exp(-np.clip(logit, -500, 500))) - y) * share
        pull = x.T @ error
        slopes = [np.array([error.sum()]), pull + decay * w, x.T @ (error[:, None] * sums) - v * pull[:, None] + 10 * decay * v]
        for k, g in enumerate(slopes):
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            parts[k] = parts[k] - 0.1 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-9)
    return Machine(float(parts[0][0]), terms, parts[1], parts[2])


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every document: the probability of label 1 for the whole text; an empty or null text has the bias alone."""
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[machine.terms] = np.arange(len(machine.terms))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in utf8_steps(batch["text"]):
                bucket, text = buckets_by_text(data, offsets)
                term = place[bucket]
                n = len(offsets) - 1
                yield pa.record_batch([batch["doc_id"].slice(first, n), pa.array(machine.scores(term[term >= 0], text[term >= 0], n))], ["doc_id", "score"])

    return text_table(docs).mapInArrow(scored, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, **how: float) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted (1 at a score of 0.5 or more).

    Rows that repeat are scored alike. A null doc_id is never held out, nor taught from.
    A null or empty text has the score of the bias. An empty table gives no rows. Columns
    other than doc_id and text, and of labels other than doc_id and toxic, are not read.
    """
    scored = score(docs, fit(docs, labels, **how))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **how: float) -> DataFrame:
    """The rows of docs that the machine scores below 0.5; columns and other values as they were."""
    machine = fit(docs, labels, **how)
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[machine.terms] = np.arange(len(machine.terms))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in utf8_steps(batch["text"]):
                bucket, text = buckets_by_text(data, offsets)
                term = place[bucket]
                n = len(offsets) - 1
                yield batch.slice(first, n).filter(pa.array(machine.scores(term[term >= 0], text[term >= 0], n) < 0.5))

    return docs.mapInArrow(clean, docs.schema)
