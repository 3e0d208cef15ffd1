"""What the corpus operators share: the shared folder, Arrow batching and vectorised hashing of words.

Words are the maximal runs of bytes other than space and 0x09-0x0D, after A-Z
are lower-cased. All hashes here are 64 bits wide and the same on every worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwise.session import checkpointed, shared_folder

__all__ = ["checkpointed", "mix64", "shared_folder", "shingle_hashes", "shingle_sets", "text_table", "utf8_steps", "word_hashes"]

#: Bytes of text that one vectorised step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20

WHITESPACE = b" \t\n\x0b\x0c\r"

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def text_table(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) and the named columns alone."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits look random."""
    with np.errstate(over="ignore"):
        x = x + _M1
        x = (x ^ (x >> np.uint64(30))) * _M2
        x = (x ^ (x >> np.uint64(27))) * _M3
        return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix64(np.arange(256, dtype=np.uint64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(WHITESPACE)] = True
#: For terms: whatever is ASCII but no letter or digit parts words too.
PUNCTUATED = np.ones(256, dtype=bool)
PUNCTUATED[128:] = False
PUNCTUATED[48:58] = PUNCTUATED[97:123] = False
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, STEP_BYTES + 1)
        _powers[:] = []
        for base in (_BASE, _BASE_INVERSE):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            with np.errstate(over="ignore"):
                _powers.append(np.cumprod(table, dtype=np.uint64))
    return _powers[0], _powers[1]


def utf8_steps(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about STEP_BYTES; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first, n = 0, len(column)
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + STEP_BYTES, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray, parting: np.ndarray = _IS_SPACE, stem: int = 0) -> tuple[np.ndarray, ...]:
    """Hash of each word of some texts, and the number of words before each text (one entry more than texts).

    parting: for each byte, A-Z lowered, whether it parts words. With a stem, also the
    hash of each word's first `stem` bytes.
    """
    n = len(data)
    if not n:
        return (np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64))[: 3 if stem else 2]
    lowered = _LOWER[data]
    space = parting[lowered]
    edges = np.zeros(n + 1, dtype=bool)
    edges[offsets] = True
    starts = ~space
    starts[1:] &= space[:-1] | edges[1:n]
    ends = ~space
    ends[:-1] &= space[1:] | edges[1:n]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    power, inverse = _power_tables(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUE[lowered] * power[:n], out=sums[1:])
        hashes = mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _M2)
        if stem:
            stems = mix64((sums[np.minimum(starts + stem, ends)] - sums[starts]) * inverse[starts])
            return hashes, np.searchsorted(starts, offsets), stems
    return hashes, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of `size` words of each text, with repeats, and the index of its text.

    A text of fewer words, but one at least, has a single shingle, all its words.
    """
    n = len(words)
    counts = np.diff(bounds)
    text = np.repeat(np.arange(len(counts)), counts)
    left = bounds[1:][text] - np.arange(n)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    with np.errstate(over="ignore"):
        total = np.minimum(counts[text], size).astype(np.uint64) * _M3
        factor = np.uint64(1)
        for k in range(size):
            factor = factor * np.uint64(_BASE)
            total += np.where(left > k, padded[k : k + n] * factor, np.uint64(0))
    whole = (left >= size) | ((left == counts[text]) & (counts[text] < size))
    return mix64(total[whole]), text[whole]


def shingle_sets(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted by text and hash, and the number of them before each text."""
    hashes, text = shingle_hashes(words, bounds, size)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[new], text[new]
    return hashes, np.searchsorted(text, np.arange(len(bounds)))
