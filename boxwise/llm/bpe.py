"""Byte-level BPE: encoding and decoding with vectorised pre-tokenisation.

Boundaries are found without a regular expression. Every code point becomes one of
eight symbols, from its class and those of its neighbours; a symbol is a function
from state to state of a small automaton. Composition of functions is associative,
so the states before all code points of many texts come from one blocked scan over
numbers of functions, with a table of compositions. The slices between boundaries
are merged pair by pair, lowest rank first, and remembered in a bounded cache.

The automaton accepts what the pattern
's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
matches, one match after the other.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from boxwise.llm.common import text_table, utf8_steps

#: Classes of code points.
LETTER, NUMBER, OTHER, SPACE = range(4)
#: Code points with the White_Space property.
WHITE_SPACE = [9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Symbols: the first three as the classes; an apostrophe that starts 's 't 'm 'd, one that
#: starts 're 've 'll; white space before white space or the end; a blank, or other white
#: space, before something else.
SHORT, LONG, INNER, BLANK, LAST = range(3, 8)
#: States, by what the code point just read is part of: white space, a word of each class, a
#: blank that begins a word, a contraction with one or two letters to come, or a match that has ended.
IN_SPACE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_BLANK, ONE_LEFT, TWO_LEFT, ENDED = range(8)
#: Slices remembered by a worker.
CACHE = 300_000
BLOCK = 64


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """The next state, and whether the code point begins a match, by state and symbol."""
    after = np.tile(np.array([IN_LETTERS, IN_NUMBERS, IN_OTHERS, ONE_LEFT, TWO_LEFT, IN_SPACE, AFTER_BLANK, ENDED]), (8, 1))
    after[ONE_LEFT, LETTER], after[TWO_LEFT, LETTER] = ENDED, ONE_LEFT
    begins = np.ones((8, 8), dtype=bool)
    begins[[IN_LETTERS, AFTER_BLANK, ONE_LEFT, TWO_LEFT], LETTER] = False
    begins[[IN_NUMBERS, AFTER_BLANK], NUMBER] = False
    begins[IN_SPACE, INNER] = False
    for state in (IN_OTHERS, AFTER_BLANK):
        after[state, [SHORT, LONG]] = IN_OTHERS
        begins[state, [OTHER, SHORT, LONG]] = False
    return after, begins


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class by code point; functions (state by state), compositions of them, the function of each symbol and of each at a text's start; begins."""
    kinds = {"L": LETTER, "N": NUMBER}
    classes = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    classes[WHITE_SPACE] = SPACE
    after, begins = _automaton()
    plain = [tuple(after[:, s]) for s in range(8)]
    starting = [(f[ENDED],) * 8 for f in plain]
    known = list(dict.fromkeys(plain + starting))
    for f in known:  # grows until it is closed under composition
        for g in plain + starting:
            if (both := tuple(g[s] for s in f)) not in known:
                known.append(both)
    number = {f: k for k, f in enumerate(known)}
    compose = np.array([[number[tuple(g[s] for s in f)] for g in known] for f in known], dtype=np.uint8)
    return classes, np.array(known, dtype=np.uint8), compose, np.array([number[f] for f in plain], dtype=np.uint8), np.array([number[f] for f in starting], dtype=np.uint8), begins


def _scan(functions: np.ndarray, compose: np.ndarray) -> np.ndarray:
    """Composition of all functions up to each, that one included."""
    n = len(functions)
    if n <= BLOCK:
        out = functions.copy()
        for k in range(1, n):
            out[k] = compose[out[k - 1], out[k]]
        return out
    rows = -(-n // BLOCK)
    table = np.zeros(rows * BLOCK, dtype=functions.dtype)
    table[:n] = functions
    table = np.ascontiguousarray(table.reshape(rows, BLOCK).T)
    for k in range(1, BLOCK):
        table[k] = compose[table[k - 1], table[k]]
    before = _scan(table[-1, :-1].copy(), compose)
    table[:, 1:] = compose[before, table[:, 1:]]
    return table.T.ravel()[:n]


def _codes(text: str) -> list[int]:
    return [ord(c) for c in text]


def boundaries(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indexes at which a match begins in code points of texts that begin at `starts` (the empty ones left out)."""
    classes, functions, compose, plain, starting, begins = _tables()
    n = len(points)
    kind = classes[points]
    first = np.zeros(n + 1, dtype=bool)
    first[starts] = first[n] = True
    symbol = kind.copy()
    space = kind == SPACE
    ends = first[1:].copy()  # the next code point belongs to another text
    inner = space.copy()
    inner[:-1] &= space[1:] | ends[:-1]
    symbol[space] = np.where(points[space] == 32, BLANK, LAST)
    symbol[inner] = INNER
    marks = np.flatnonzero((points == 39) & ~ends)
    one = points[marks + 1] if len(marks) else marks
    symbol[marks[np.isin(one, _codes("stmd"))]] = SHORT
    marks, one = (x[(marks + 2 < n) & ~first[np.minimum(marks + 2, n)]] for x in (marks, one))
    two = points[marks + 2] if len(marks) else marks
    for pair in ("re", "ve", "ll"):
        symbol[marks[(one == ord(pair[0])) & (two == ord(pair[1]))]] = LONG
    own = plain[symbol]
    own[starts] = starting[symbol[starts]]
    state = functions[_scan(own, compose), ENDED]
    before = np.empty(n, dtype=np.uint8)
    before[1:] = state[:-1]
    before[starts] = ENDED
    return np.flatnonzero(begins[before, symbol])


class Encoder:
    """Ids of texts, and bytes of ids, by a rank file."""

    def __init__(self, ranks_path: str) -> None:
        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pieces = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece
        self.numbers = [str(k) for k in range(len(self.pieces))]
        outer = self

        class Cache(dict):
            def __missing__(self, piece: bytes) -> tuple[int, ...]:
                if len(self) >= CACHE:
                    self.clear()
                self[piece] = ids = outer.merge(piece)
                return ids

        self.cache = Cache()

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one match: of the adjacent pairs that are in the vocabulary, the one of lowest rank, leftmost, is merged first."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return (whole,)
        if len(piece) > 100:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        none = len(self.pieces)
        pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same in time n log n, for very long matches."""
        ranks, n = self.ranks, len(piece)
        stop, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at i
        heap = []

        def offer(i: int) -> None:
            j = stop[i]
            if j < n and (rank := ranks.get(piece[i : stop[j]])) is not None:
                heapq.heappush(heap, (rank, i, j, stop[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, j, end = heapq.heappop(heap)
            if stop[i] != j or j >= n or stop[j] != end:
                continue  # one of the two has changed since
            stop[i], stop[j] = end, -1
            if end < n:
                before[end] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : stop[i]]])
            i = stop[i]
        return tuple(out)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[list[int]]:
        """The ids of each text of a UTF-8 buffer."""
        raw = data.tobytes()
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        at = np.zeros(len(points) + 1, dtype=np.int64)
        np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), out=at[1:])
        starts = np.searchsorted(at, offsets)
        marks = boundaries(points, np.unique(starts[:-1][np.diff(offsets) > 0])) if len(points) else np.zeros(0, np.int64)
        cuts = at[marks].tolist()
        slices = [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)] if cuts else []
        bounds = np.searchsorted(marks, starts).tolist()
        get = self.cache.__getitem__
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield list(chain.from_iterable(map(get, slices[a:b])))

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.pieces.__getitem__, ids))

    def lengths(self, ids: list[int]) -> np.ndarray:
        """Bytes of each id; their running sum has the offsets of the tokens in the text."""
        return np.fromiter((len(self.pieces[k]) for k in ids), dtype=np.int32, count=len(ids))


@lru_cache(maxsize=1)
def encoder(ranks_path: str) -> Encoder:
    return Encoder(ranks_path)


def encode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, ids and offsets (of each token's first byte in the UTF-8 text) of every document.

    A null or empty text has no tokens. Rows that repeat are encoded each; a null
    doc_id stays null.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks_path)
        for batch in batches:
            for first, data, offsets in utf8_steps(batch["text"]):
                ids = list(own.encode(data, offsets))
                places = [np.cumsum(n) - n for n in map(own.lengths, ids)]
                yield pa.record_batch([batch["doc_id"].slice(first, len(ids)), pa.array(ids, pa.list_(pa.int32())), pa.array(places, pa.list_(pa.int32()))], ["doc_id", "ids", "offsets"])

    return text_table(docs).mapInArrow(encoded, "doc_id long, ids array<int>, offsets array<int>")


def decode(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and text (binary) of rows with doc_id and ids; null ids give null."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks_path)
        for batch in batches:
            texts = [None if ids is None else own.decode(ids) for ids in batch["ids"].to_pylist()]
            yield pa.record_batch([batch["doc_id"], pa.array(texts, pa.binary())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(decoded, "doc_id long, text binary")


def round_trip(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document: encoded, and its ids decoded, in one task, so that no ids move.

    Odd rows are as in encode(). Columns other than doc_id and text are not read; an empty
    table gives no rows.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks_path)
        for batch in batches:
            for first, data, offsets in utf8_steps(batch["text"]):
                rows = [(len(ids), hashlib.sha256(" ".join(map(own.numbers.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()) for ids in own.encode(data, offsets)]
                n, ids_sha, text_sha = zip(*rows, strict=True)
                yield pa.record_batch([batch["doc_id"].slice(first, len(rows)), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return text_table(docs).mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
