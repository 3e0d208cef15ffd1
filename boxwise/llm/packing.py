"""Packing of token sequences: best fit, then a swap-based local search.

Documents are encoded where they are read; what moves is one small row for each
piece, never ids or text. Pieces are dealt evenly into pools of about POOL
documents, and every pool is packed for itself. Pieces of the full length are
sequences of their own, so a pool holds one shorter piece for each document at most.

In a pool, pieces first go, largest first, where the least room remains. Then the
emptiest bins, one after the other, give pieces away: a piece moves, or is exchanged
for a smaller one, or two pieces for one that is smaller than both together, always to
a fuller bin, so that the sum of squared fills grows with each step. This ends when
no bin can be saved by the total of the lengths, or no such step is left.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from boxwise.llm import bpe
from boxwise.llm.common import text_table

#: Documents to a pool.
POOL = 8_000
#: Characters past which a text is encoded by the scan of boxwise.llm.bpe, which gives the same ids: the
#: regular expression of the faster encoder runs out of stack on about a million adjacent blanks.
LONG = 100_000


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str):  # noqa: ANN201
    """The byte-level BPE of a rank file. It gives the ids that the same vocabulary's `tokenizers` file gives, about four times as fast.

    That file's added tokens, of the same name with the ending .json, have ids of their
    own wherever they stand in a text, and what lies between them is encoded for itself.
    """
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(os.path.splitext(ranks_path)[0] + ".json", encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t[flag] for t in added for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that look at what stands around them are not supported")
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in added})


def scanned(text: str, ranks_path: str, added: dict[str, int]) -> list[int]:
    """The ids of a text of any length and kind, without a regular expression over it but for the added tokens, the longest first."""
    own = bpe.encoder(ranks_path)
    parts = re.split("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")", text) if added else [text]
    ids: list[int] = []
    for part in parts:
        if part in added:
            ids.append(added[part])
        elif part:
            data = np.frombuffer(part.encode(), np.uint8)
            ids += next(own.encode(data, np.array([0, len(data)])))
    return ids


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: largest items first, each where the least room remains."""
    rooms: dict[int, list[int]] = {}
    open_, bins = 0, []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = open_ >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            k = rooms[room].pop()
            if not rooms[room]:
                open_ ^= 1 << room
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        room -= size
        if not rooms.setdefault(room, []):
            open_ |= 1 << room
        rooms[room].append(k)
    return bins


def local_search(sizes: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Steps that increase the squared fill until bins empty; the bins left. Items and capacity stay as they are.

    It ends when the bins are as few as the total length allows, or no step is left in any bin.
    """
    place = np.empty(len(sizes), dtype=np.int64)
    for k, own in enumerate(bins):
        place[own] = k
    bins = [set(own) for own in bins]
    fill = np.array([sizes[list(own)].sum() for own in bins], dtype=np.int64)
    least, left, far = -(-int(sizes.sum()) // capacity), len(bins), 4 * capacity

    def put(i: int, k: int) -> None:
        bins[place[i]].remove(i)
        fill[place[i]] -= sizes[i]
        bins[k].add(i)
        fill[k] += sizes[i]
        place[i] = k

    def step(d: int) -> bool:
        """One step that takes from bin d."""
        room = capacity - fill
        room[d] = -1
        room[fill == 0] = -1
        own = sorted(bins[d], key=lambda i: -sizes[i])
        for i in own:
            rest = np.where((room >= sizes[i]) & (fill + sizes[i] > fill[d]), room - sizes[i], far)
            if rest[k := int(rest.argmin())] < far:
                put(i, k)
                return True
        # An exchange of `given` tokens for an item of y leaves its bin room + y - given.
        open_ = room[place] > 0
        reach, fuller = room[place] + sizes, fill[place] >= fill[d]
        pairs = [(int(sizes[i] + sizes[j]), (i, j)) for a, i in enumerate(own) for j in own[a + 1 :]]
        for given, items in [*((int(sizes[i]), (i,)) for i in own), *pairs]:
            rest = np.where(open_ & fuller & (sizes < given) & (reach >= given), reach - given, far)
            if rest[y := int(rest.argmin())] < far:
                k = int(place[y])
                put(y, d)
                for i in items:
                    put(i, k)
                return True
        return False

    moved = True
    while moved and left > least:
        moved = False
        order = np.argsort(fill, kind="stable")
        for d in order[(fill[order] > 0) & (fill[order] < capacity)].tolist():
            while left > least and bins[d] and step(d):
                moved = True
                left -= not bins[d]
    return [sorted(own) for own in bins if own]


def pieces(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's ids, `end` after them, cut to capacity; only a first piece may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks_path, pattern)
        added = {t: own.encode_single_token(t) for t in own.special_tokens_set}

        def encode(text: str) -> list[int]:
            return own.encode(text, allowed_special="all") if len(text) <= LONG else scanned(text, ranks_path, added)

        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = np.array([*encode(text.as_py()), end], dtype="<u4")
                stops = range(len(ids) - (ceil(len(ids) / capacity) - 1) * capacity, len(ids) + 1, capacity)
                start = 0
                for piece, stop in enumerate(stops):
                    rows.append((doc, piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
                    start = stop
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return text_table(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, ranks_path: str, pattern: str, capacity: int = 2048, pool: int = POOL) -> DataFrame:
    """The pieces of docs with sequence_id and offset, the place of each in its sequence.

    A null text is empty and a piece of one id; rows that repeat are packed each; a
    null doc_id stays null. An empty table gives no sequences. sequence_id is unique
    and has no order.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def placed(rows: pa.Table) -> pa.RecordBatch:
            nonlocal number
            sizes = rows["length"].to_numpy()
            sequence, offset = np.empty(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            full = np.flatnonzero(sizes == capacity)
            sequence[full] = number + np.arange(len(full))
            number += len(full)
            short = np.flatnonzero(sizes < capacity)
            for own in local_search(sizes[short], best_fit(sizes[short], capacity), capacity):
                items = short[own]
                sequence[items] = number
                offset[items] = np.cumsum(sizes[items]) - sizes[items]
                number += 1
            return rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).combine_chunks().to_batches()

        waiting, short = [], 0
        for batch in batches:
            waiting.append(batch)
            short += pc.sum(pc.less(batch["length"], capacity)).as_py() or 0
            if short >= 2 * pool:
                yield from placed(pa.Table.from_batches(waiting))
                waiting, short = [], 0
        if waiting and sum(map(len, waiting)):
            yield from placed(pa.Table.from_batches(waiting))

    cut = pieces(docs, ranks_path, pattern, capacity)
    pools = max(1, ceil(docs.count() / pool))
    return cut.repartition(pools).mapInArrow(packed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
