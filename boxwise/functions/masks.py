"""Run-length masks as columns.

A mask of h rows and w columns is an array of run lengths, column after column, that begins
with the unset pixels (0 if the first is set). Everything is worked out from runs, in Arrow
batches; only encode() and decode() see pixels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T_

#: Types are objects, as a worker that imports this module cannot parse their text.
RUNS = T_.ArrayType(T_.IntegerType())


def _parts(counts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All run lengths of a batch, and the index of each mask's first (one entry more)."""
    lengths = pc.fill_null(pc.list_value_length(counts), 0).to_numpy(zero_copy_only=False)
    return counts.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(lengths)])


def set_runs(counts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mask, first pixel and end of each run of set pixels."""
    flat, first = _parts(counts)
    mask = np.repeat(np.arange(len(counts)), np.diff(first))
    ends = np.cumsum(flat)
    ends -= np.concatenate([[0], ends])[first[:-1]][mask] if len(flat) else 0
    own = ((np.arange(len(flat)) - first[:-1][mask]) % 2 == 1) & (flat > 0)
    return mask[own], (ends - flat)[own], ends[own]


def _lists(values: np.ndarray, lengths: np.ndarray, null: np.ndarray) -> pa.Array:
    """Lists of 32-bit numbers, one after the other in values."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)), mask=pa.array(null))


def _lengths(x: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)


#: Pixels of masks that are looked at together.
PIXELS = 1 << 20


@F.arrow_udf(RUNS)
def _encode(pixels: pa.Array, threshold: pa.Array) -> pa.Array:
    heights, null = _lengths(pixels), pc.is_null(pixels).to_numpy(zero_copy_only=False)
    rows = pixels.flatten()
    ends = np.concatenate([[0], np.cumsum(_lengths(rows))])  # of rows, in values
    values = pc.fill_null(rows.flatten().cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    last = np.concatenate([[0], np.cumsum(heights)])
    first, size = ends[last[:-1]], ends[last[1:]] - ends[last[:-1]]
    least = threshold.to_numpy(zero_copy_only=False)
    parts, lengths = [], np.zeros(len(pixels), np.int64)
    a = 0
    while a < len(pixels):
        b = max(a + 1, int(np.searchsorted(first + size, first[a] + PIXELS, side="right")))
        n, h = size[a:b], heights[a:b]
        if (n % np.maximum(h, 1)).any() or (np.diff(ends)[last[a] : last[b]] != np.repeat(n // np.maximum(h, 1), h)).any():
            raise ValueError("the rows of a mask have one length")
        mask, start = np.repeat(np.arange(b - a), n), np.cumsum(n) - n
        place = np.arange(len(mask)) - start[mask]
        column, row = np.divmod(place, np.maximum(h, 1)[mask])
        at = start[mask] + row * (n // np.maximum(h, 1))[mask] + column
        flat = (values[first[a] : first[a] + len(mask)] > np.repeat(least[a:b], n))[at]
        # A run begins at a mask's first pixel and where a pixel is not as the one before; a set first pixel has an empty run before it.
        begins = np.flatnonzero((place == 0) | (flat != np.roll(flat, 1)))
        runs = np.diff(np.append(begins, len(flat)))
        empty = (place[begins] == 0) & flat[begins]
        lengths[a:b] = np.bincount(mask[begins], minlength=b - a) + np.bincount(mask[begins[empty]], minlength=b - a)
        parts.append(np.insert(runs, np.flatnonzero(empty), 0))
        a = b
    out, bare = np.concatenate(parts) if parts else np.zeros(0), (size == 0) & ~null  # a mask without pixels is one empty run
    out = np.insert(out, (np.cumsum(lengths) - lengths)[bare], 0)
    lengths[bare] = 1
    return _lists(out, lengths, null)


def encode(pixels: Column, threshold: float = 0.5) -> Column:
    """Runs of an array of rows of numbers; a pixel is set if it is more than the threshold. Null stays null."""
    return _encode(pixels, F.lit(float(threshold)))


@F.arrow_udf(T_.ArrayType(RUNS))
def _decode(counts: pa.Array, height: pa.Array) -> pa.Array:
    out = []
    for runs, h in zip(counts.to_pylist(), height.to_pylist(), strict=True):
        if runs is None or not h:
            out.append(None)
            continue
        flat = np.repeat(np.arange(len(runs)) % 2, runs)
        out.append(flat.reshape(-1, h).T.tolist())
    return pa.array(out, pa.list_(pa.list_(pa.int32())))


def decode(counts: Column, height: Column) -> Column:
    """The rows of pixels, 0 or 1, of a mask of some height; null for a null mask or height."""
    return _decode(counts, height)


@F.arrow_udf(T_.LongType())
def _area(counts: pa.Array) -> pa.Array:
    mask, first, end = set_runs(counts)
    return pa.array(np.bincount(mask, weights=end - first, minlength=len(counts)).astype(np.int64))


def area(counts: Column) -> Column:
    """Set pixels; none of a null mask."""
    return _area(counts)


@F.arrow_udf(T_.StructType([T_.StructField(c, T_.IntegerType()) for c in ("x0", "y0", "x1", "y1")]))
def _box(counts: pa.Array, height: pa.Array) -> pa.Array:
    mask, first, end = set_runs(counts)
    h = np.maximum(pc.fill_null(height, 1).to_numpy(zero_copy_only=False).astype(np.int64), 1)[mask]
    n, far = len(counts), np.iinfo(np.int64).max
    last = end - 1
    wraps = first // h != last // h  # a run over two columns holds the last pixel of one and the first of the next
    low, high = np.full((2, n), far), np.full((2, n), -1)
    for axis, (a, b) in enumerate(((first // h, last // h), (np.where(wraps, 0, first % h), np.where(wraps, h - 1, last % h)))):
        np.minimum.at(low[axis], mask, a)
        np.maximum.at(high[axis], mask, b)
    none = high[0] < 0
    columns = [pa.array(np.where(none, 0, x), pa.int32()) for x in (low[0], low[1], high[0], high[1])]
    return pa.StructArray.from_arrays(columns, ["x0", "y0", "x1", "y1"], mask=pa.array(none))


def box(counts: Column, height: Column) -> Column:
    """(x0, y0, x1, y1): the first and last column and row with a set pixel; null without one."""
    return _box(counts, height)


@F.arrow_udf(T_.LongType())
def _shared(a: pa.Array, b: pa.Array) -> pa.Array:
    mask, first, end = set_runs(a)
    other, start, stop = set_runs(b)
    if not len(mask) or not len(other):
        return pa.array(np.zeros(len(a), np.int64))
    # All masks of the batch on one line: the set pixels of b before a place are a line that rises along its runs.
    width = int(max(end.max(), stop.max())) + 1
    places = np.stack([start + other * width, stop + other * width], axis=1).ravel()
    before = np.concatenate([[0], np.cumsum(stop - start)])
    rises = np.stack([before[:-1], before[1:]], axis=1).ravel()
    inside = np.interp(end + mask * width, places, rises) - np.interp(first + mask * width, places, rises)
    return pa.array(np.bincount(mask, weights=inside, minlength=len(a)).round().astype(np.int64))


def shared(a: Column, b: Column) -> Column:
    """Pixels that are set in both masks of one size."""
    return _shared(a, b)


def iou(a: Column, b: Column, crowd: Column | None = None) -> Column:
    """Shared pixels over those of either mask, or, where the second is a crowd, over the first's own; 0 without any."""
    both = shared(a, b)
    whole = area(a) + area(b) - both
    return F.coalesce(F.try_divide(both, whole if crowd is None else F.when(crowd, area(a)).otherwise(whole)), F.lit(0.0))


@F.arrow_udf(T_.StringType())
def _text(counts: pa.Array) -> pa.Array:
    runs, first = _parts(counts)
    mask = np.repeat(np.arange(len(counts)), np.diff(first))
    rest = runs.copy()
    differs = np.flatnonzero(np.arange(len(runs)) - first[:-1][mask] > 2)
    rest[differs] -= runs[differs - 2]
    # The codes of all runs, a column for each of their groups of five bits.
    codes, going = [], np.ones(len(rest), bool)
    while going.any():
        low, rest = rest & 31, rest >> 5
        more = rest != np.where(low & 16, -1, 0)
        codes.append(np.where(going, 48 + (low | np.where(more, 32, 0)), 0).astype(np.uint8))
        going = going & more
    wide = np.stack(codes, axis=1) if codes else np.zeros((0, 1), np.uint8)
    used = wide > 0
    offsets = np.concatenate([[0], np.cumsum(used.sum(axis=1))])[first].astype(np.int32)
    null = pc.is_null(counts)
    return pc.if_else(null, pa.scalar(None, pa.string()), pa.StringArray.from_buffers(len(counts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(wide[used].tobytes())))


def to_text(counts: Column) -> Column:
    """The compressed text of runs that annotation files hold: groups of five bits, lowest first, from the fourth run on of differences to the run two before."""
    return _text(counts)


@F.arrow_udf(RUNS)
def _from_text(texts: pa.Array) -> pa.Array:
    null = pc.is_null(texts).to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = np.frombuffer("".join(pc.fill_null(texts, "").to_pylist()).encode(), np.uint8).astype(np.int64) - 48
    ends = np.flatnonzero(~codes & 32 > 0)  # the last group of each run
    begins = np.append(0, ends[:-1] + 1) if len(ends) else ends
    run = np.repeat(np.arange(len(ends)), ends - begins + 1)
    codes = codes[: len(run)]
    shift = 5 * (np.arange(len(run)) - begins[run])
    values = np.bincount(run, weights=(codes & 31) * 2.0**shift, minlength=len(ends)).astype(np.int64)
    values -= np.where(codes[ends] & 16, np.int64(1) << (shift[ends] + 5), 0)
    first = np.searchsorted(ends, np.concatenate([[0], np.cumsum(sizes)]))
    lengths = np.diff(first)
    # From the fourth run on a run is a difference to the one two before: sums over every second one.
    place = np.arange(len(values)) - np.repeat(first[:-1], lengths)
    order = np.lexsort((place, place % 2, np.repeat(np.arange(len(texts)), lengths)))
    anchor = place <= 2
    sums = np.cumsum(values[order])
    heads = np.flatnonzero(anchor[order])
    before = np.concatenate([[0], sums])[heads]
    out = np.empty_like(values)
    out[order] = sums - np.repeat(before, np.diff(np.append(heads, len(values))))
    return _lists(out, lengths, null)


def from_text(text: Column) -> Column:
    """The runs of a compressed text."""
    return _from_text(text)
