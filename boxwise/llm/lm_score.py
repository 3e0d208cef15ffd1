"""Language-model scores by masked pseudo-likelihood.

A small network predicts every token from the WINDOW tokens on both sides: position-wise
embeddings of the neighbours are summed, passed through tanh, and a softmax over classes
times a softmax within the class gives the token's probability. A document's score is the
sum of the log probabilities of all its tokens.

Tokens are words: the most frequent of the whole corpus have a number of their own,
others share hashed numbers, and have the probability of their number times their part
of its occurrences. Spark counts all words of all documents; the counts of the COUNTED
most frequent go with the tasks, and rarer words meet theirs in a join. The
network is trained by averaging: in each round every task takes steps over its own
documents, from the weights of the round before, and Spark averages the tasks' weights,
in chunks. The rounds share the tokens out, so that each is trained on once. The counts
grow with the corpus; the network itself has a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwise.llm.common import checkpointed, text_table, utf8_steps, word_hashes

WINDOW, WIDTH, CLASSES = 2, 32, 32
VOCABULARY = CLASSES * CLASSES
#: Numbers shared by rarer words (a power of two), and the one of places outside of the text.
SHARED, OUTSIDE = 256, VOCABULARY - 1
FREQUENT = VOCABULARY - SHARED - 1
#: Words, the most frequent, whose counts every task has at hand (16 bytes each); those of the others are joined.
COUNTED = 1 << 17
#: Tokens to a step of training and to one of scoring; weights to a chunk.
STEP, SCORED, CHUNK = 2048, 16_384, 4096
#: Logits that differ by less have exponentials that a 32-bit number holds without loss.
RANGE = 60.0


@dataclass
class Network:
    """embed: place, token, width; outer: width, class; inner: class, width, member; biases of both."""

    embed: np.ndarray
    outer: np.ndarray
    inner: np.ndarray
    outer_bias: np.ndarray
    inner_bias: np.ndarray

    SHAPES = ((2 * WINDOW, VOCABULARY, WIDTH), (WIDTH, CLASSES), (CLASSES, WIDTH, CLASSES), (CLASSES,), (CLASSES, CLASSES))

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        ends = np.cumsum([int(np.prod(s)) for s in cls.SHAPES])
        return cls(*(part.reshape(s) for part, s in zip(np.split(flat, ends[:-1]), cls.SHAPES, strict=True)))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.embed, self.outer, self.inner, self.outer_bias, self.inner_bias)])

    @classmethod
    def start(cls, counts: np.ndarray) -> Network:
        """Small random weights; the biases give the tokens' frequencies."""
        rng = np.random.default_rng(7)
        table = (counts + 1.0).reshape(CLASSES, CLASSES)
        by_class = table.sum(axis=1)
        parts = [rng.normal(0, 0.1, s) for s in cls.SHAPES[:3]]
        return cls(*(x.astype(np.float32) for x in (*parts, np.log(by_class / by_class.sum()), np.log(table / by_class[:, None]))))

    def hidden(self, around: np.ndarray) -> np.ndarray:
        total = self.embed[0].take(around[:, 0], axis=0)
        for k in range(1, 2 * WINDOW):
            total += self.embed[k].take(around[:, k], axis=0)
        return np.tanh(total, out=total)

    def _members(self, h: np.ndarray, kind: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The inner layer's values for rows in the order of their class: a product a class, and all else at once."""
        x = np.empty((len(h), CLASSES), h.dtype)
        for c in np.flatnonzero(np.diff(bounds)).tolist():
            own = slice(bounds[c], bounds[c + 1])
            np.matmul(h[own], self.inner[c], out=x[own])
        x += self.inner_bias.take(kind, axis=0)
        return x

    @staticmethod
    def _shifted(x: np.ndarray) -> np.ndarray:
        """x less a number for each row, so that its exponentials neither overflow nor all vanish: one number does where x has no wide range."""
        top = x.max(initial=-np.inf)
        return x - (top if top - x.min(initial=np.inf) < RANGE else x.max(axis=1, keepdims=True))

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        e = Network._shifted(x)
        np.exp(e, out=e)
        e /= (e @ np.ones(e.shape[1], e.dtype))[:, None]
        return e

    @staticmethod
    def _log_softmax_at(x: np.ndarray, column: np.ndarray) -> np.ndarray:
        x = Network._shifted(x)
        return x[np.arange(len(x)), column] - np.log(np.exp(x) @ np.ones(x.shape[1], x.dtype))

    @staticmethod
    def _order(tokens: np.ndarray) -> np.ndarray:
        """The places of small numbers in ascending order; 16 bits are sorted by counting."""
        return np.argsort(tokens.astype(np.int16), kind="stable")

    def log_probability(self, around: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Of each token, given those around it."""
        order = self._order(token // CLASSES)
        token = token[order]
        h, kind, member = self.hidden(around.take(order, axis=0)), token // CLASSES, token % CLASSES
        own = self._log_softmax_at(h @ self.outer + self.outer_bias, kind)
        own += self._log_softmax_at(self._members(h, kind, np.searchsorted(kind, np.arange(CLASSES + 1))), member)
        out = np.empty_like(own)
        out[order] = own
        return out

    def learn(self, around: np.ndarray, token: np.ndarray, rate: float) -> None:
        """One step of gradient descent on the mean log probability."""
        n = len(token)
        order = self._order(token)  # so that a class is a slice
        around, token = around.take(order, axis=0), token[order]
        h, kind, member = self.hidden(around), token // CLASSES, token % CLASSES
        slope = self._softmax(h @ self.outer + self.outer_bias)
        slope[np.arange(n), kind] -= 1
        back = slope @ self.outer.T
        self.outer -= rate * (h.T @ slope) / n
        self.outer_bias -= rate * (np.ones(n, slope.dtype) @ slope) / n
        bounds = np.searchsorted(kind, np.arange(CLASSES + 1))
        slope = self._softmax(self._members(h, kind, bounds))
        slope[np.arange(n), member] -= 1
        met = np.flatnonzero(np.diff(bounds))
        moves, inner_back = np.empty((len(met), *self.SHAPES[2][1:]), h.dtype), np.empty_like(back)
        for k, c in enumerate(met.tolist()):
            own = slice(bounds[c], bounds[c + 1])
            np.matmul(slope[own], self.inner[c].T, out=inner_back[own])
            np.matmul(h[own].T, slope[own], out=moves[k])
        back += inner_back
        self.inner[met] -= rate * moves / n
        self.inner_bias[met] -= rate * np.add.reduceat(slope, bounds[met]) / n
        back *= (1 - h * h) * (rate / n)
        # Sums for each token met, without sorting rows by it.
        place = np.arange(WIDTH)
        for k in range(2 * WINDOW):
            at = (around[:, k, None] * WIDTH + place).ravel()
            self.embed[k] -= np.bincount(at, back.ravel(), VOCABULARY * WIDTH).reshape(VOCABULARY, WIDTH).astype(back.dtype)


@dataclass(frozen=True)
class Vocabulary:
    """hashes of the frequent words, ascending, and the number of each; hashes of the COUNTED most frequent, ascending, and the log of each one's count."""

    hashes: np.ndarray
    numbers: np.ndarray
    counted: np.ndarray
    logs: np.ndarray

    def log_counts(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log of each word's count, 0 where it is not at hand; and where it is not."""
        if not len(self.counted):
            return np.zeros(len(words)), np.ones(len(words), dtype=bool)
        at = np.minimum(np.searchsorted(self.counted, words), len(self.counted) - 1)
        missing = self.counted[at] != words
        return np.where(missing, 0.0, self.logs[at]), missing

    def tokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers and hashes of all words of some texts, and the number of words before each text."""
        words, bounds = word_hashes(data, offsets)
        out = (FREQUENT + words % np.uint64(SHARED)).astype(np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
            known = self.hashes[at] == words
            out[known] = self.numbers[at[known]]
        return out, words, bounds


def targets(bounds: np.ndarray, number: int, rounds: int) -> np.ndarray:
    """The tokens of some texts that a round trains on; the rounds together take each token once."""
    place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], np.diff(bounds))
    return np.flatnonzero(place % rounds == number)


def windows(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The tokens around each token; OUTSIDE beyond its text."""
    n, text = len(tokens), np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.arange(n)
    out = np.full((n, 2 * WINDOW), OUTSIDE, dtype=np.int64)
    for column, k in enumerate([*range(-WINDOW, 0), *range(1, WINDOW + 1)]):
        inside = (at + k >= bounds[:-1][text]) & (at + k < bounds[1:][text])
        out[inside, column] = tokens[at[inside] + k]
    return out


def vocabulary(docs: DataFrame) -> tuple[Vocabulary, np.ndarray, DataFrame]:
    """The vocabulary of all words of docs, how often each number occurs, and how often each word (word, n)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [word_hashes(data, offsets)[0] for _, data, offsets in utf8_steps(batch["text"])]
            hashes, n = np.unique(np.concatenate(words), return_counts=True) if words else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.record_batch([pa.array(hashes.view(np.int64)), pa.array(n)], ["word", "n"])

    counts = checkpointed(text_table(docs).select("text").mapInArrow(counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    top = counts.orderBy(F.desc("n"), "word").limit(COUNTED).toArrow()
    words, times = top["word"].to_numpy(), top["n"].to_numpy()
    best = words[:FREQUENT]
    n = np.zeros(VOCABULARY)
    n[: len(best)] = times[:FREQUENT]
    for r in counts.groupBy(F.col("word").bitwiseAND(F.lit(SHARED - 1)).alias("part")).agg(F.sum("n").alias("n")).collect():
        n[FREQUENT + r["part"]] = r["n"]
    np.subtract.at(n, FREQUENT + (best & SHARED - 1), times[:FREQUENT])
    order, every = np.argsort(best.view(np.uint64)), np.argsort(words.view(np.uint64))
    return Vocabulary(best.view(np.uint64)[order], order, words.view(np.uint64)[every], np.log(times[every])), n, counts


def train(docs: DataFrame, known: Vocabulary, counts: np.ndarray, rounds: int = 2, rate: float = 4.0) -> Network:
    """The network after `rounds` rounds, each the average of all tasks' weights, by the tokens that each saw."""
    flat = Network.start(counts).flat()
    chunks = -(-len(flat) // CHUNK)
    for number in range(rounds):

        def local(batches: Iterator[pa.RecordBatch], flat: np.ndarray = flat, number: int = number) -> Iterator[pa.RecordBatch]:
            own, seen = Network.of(flat.copy()), 0
            for batch in batches:
                for _, data, offsets in utf8_steps(batch["text"]):
                    tokens, _, bounds = known.tokens(data, offsets)
                    chosen = targets(bounds, number, rounds)
                    around = windows(tokens, bounds)[chosen]
                    for at in range(0, len(chosen), STEP):
                        own.learn(around[at : at + STEP], tokens[chosen[at : at + STEP]], rate)
                    seen += len(chosen)
            if seen:
                padded = np.zeros(chunks * CHUNK, dtype=np.float32)
                padded[: len(flat)] = own.flat()
                yield pa.record_batch([pa.array(np.arange(chunks, dtype=np.int32)), pa.array(np.full(chunks, seen, dtype=np.int64)), pa.array(list(padded.reshape(chunks, CHUNK)), pa.list_(pa.float32()))], ["chunk", "seen", "weights"])

        def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            seen: dict[int, int] = {}
            for batch in batches:
                weights = batch["weights"].flatten().to_numpy().reshape(len(batch), CHUNK)
                for k, n, w in zip(batch["chunk"].to_pylist(), batch["seen"].to_pylist(), weights, strict=True):
                    sums[k] = sums.get(k, 0.0) + n * w.astype(np.float64)
                    seen[k] = seen.get(k, 0) + n
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([sums[k] / seen[k] for k in sums], pa.list_(pa.float64()))], ["chunk", "weights"])

        parts = text_table(docs).select("text").mapInArrow(local, "chunk int, seen long, weights array<float>")
        mean = parts.repartition("chunk").mapInArrow(averaged, "chunk int, weights array<double>").orderBy("chunk").toArrow()  # as many rows as chunks
        if len(mean):
            flat = pa.concat_arrays(mean["weights"].chunks).flatten().to_numpy()[: len(flat)].astype(np.float32)
    return Network.of(flat)


def pseudo_likelihood(docs: DataFrame, rounds: int = 2) -> DataFrame:
    """One row a document: doc_id, n_tokens, log_likelihood (the sum over all tokens) and mean_log_likelihood (null without tokens).

    Null, empty and blank texts have no tokens and a sum of 0. Rows that repeat are
    scored alike; a null doc_id stays null; an empty table gives an empty result.
    """
    known, counts, words = vocabulary(docs)
    network = train(docs, known, counts, rounds)
    shared = np.zeros(VOCABULARY)
    shared[FREQUENT:OUTSIDE] = np.log(np.maximum(counts[FREQUENT:OUTSIDE], 1))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in utf8_steps(batch["text"]):
                tokens, hashes, bounds = known.tokens(data, offsets)
                around = windows(tokens, bounds)
                each = [network.log_probability(around[at : at + SCORED], tokens[at : at + SCORED]) for at in range(0, len(tokens), SCORED)]
                n = np.diff(bounds)
                rare_at = np.flatnonzero(tokens >= FREQUENT)
                logs, missing = known.log_counts(hashes[rare_at])
                own = np.concatenate(each) - shared[tokens] if each else np.zeros(0)
                own[rare_at] += logs
                sums = np.concatenate([[0.0], np.cumsum(own)])
                is_rare = np.zeros(len(tokens), dtype=bool)
                is_rare[rare_at[missing]] = True
                rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(is_rare)])[bounds], pa.int32()), pa.array(hashes[is_rare].view(np.int64)))
                yield pa.record_batch([batch["doc_id"].slice(first, len(n)), pa.array(n.astype(np.int64)), pa.array(sums[bounds[1:]] - sums[bounds[:-1]]), rare], ["doc_id", "n_tokens", "by_number", "rare"])

    rows = checkpointed(text_table(docs).mapInArrow(scored, "doc_id long, n_tokens long, by_number double, rare array<long>")).withColumn("row", F.monotonically_increasing_id())
    own = rows.select("row", F.explode("rare").alias("word")).join(words, "word").groupBy("row").agg(F.sum(F.log("n")).alias("own"))
    out = rows.join(own, "row", "left").select("doc_id", "n_tokens", (F.col("by_number") + F.coalesce("own", F.lit(0.0))).alias("log_likelihood"))
    return out.withColumn("mean_log_likelihood", F.try_divide("log_likelihood", "n_tokens"))
