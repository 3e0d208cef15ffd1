"""Repair of conversations by error-correcting Earley parsing.

The roles of a conversation are parsed by a weighted grammar whose terminals have error
productions: a row may be kept, given another role or deleted, and a row may be
inserted. Chart items hold the least cost of the edits so far and, as ties need it, where
their audit stands among the audits of the column. The grammar is left-recursive, so
every item begins at the conversation's start and a column has a fixed number of items
at most, however long the conversation is. What a column becomes depends on the column,
with costs counted from its least, and on the kind of the row alone; so each such step is
parsed once by a worker, and looked up after that.

Rows are sorted by conversation and turn over all tasks. A task finishes the conversations
that lie within it. Of one that goes on in the next task, or is long, it makes
pieces of a bounded number of rows and bytes. Columns are passed from piece to piece over one byte a
row, and then texts are repaired piece by piece; only the checksum, which is one
running value, reads the pieces of a conversation one after the other.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from functools import partial
from typing import ClassVar, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwise.llm.common import shared_folder
from boxwise.llm.spelling import crc32_sql

#: Role grammar over initials: (s?(ua)+)? with every production beginning at the conversation's start.
GRAMMAR = {"C": ((), ("B",)), "B": (("H", "u", "a"), ("B", "u", "a")), "H": ((), ("s",))}
#: Fixed values of the contract: costs of edits, their initials, and roles that a row may be given.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
GIVEN = {"u": "user", "a": "assistant"}
WHITE = " \t\n\x0b\x0c\r"
#: Rows and characters of a piece at most, but for one row.
PIECE_ROWS, PIECE_CHARS = 20_000, 4 << 20


class Item(NamedTuple):
    """A production of the grammar with a dot in it. Its origin is the conversation's start."""

    head: str
    body: tuple[str, ...]
    dot: int

    @property
    def next(self) -> str | None:
        return self.body[self.dot] if self.dot < len(self.body) else None

    def moved(self) -> Item:
        return Item(self.head, self.body, self.dot + 1)


#: What an item of a column holds: cost, the rank of the audit that it was made from, and the edits since then.
Value = tuple[int, int, str]
Steps = list[dict[Item, tuple[Item, str]]]
WAITING = {head: [Item(h, body, 0) for h, bodies in GRAMMAR.items() for body in bodies if body[:1] == (head,)] for head in GRAMMAR}
#: From any item, two insertions and a deletion lead on as any other item does, so one that is dearer by more is in no cheapest parse.
FAR = 2 * INSERT + DELETE


def closed(items: dict[Item, tuple[Value, Item]], inserting: bool) -> dict[Item, tuple[Value, Item]]:
    """items, each with its value and the item it came from, with what completing, and inserting, gives: the least value of each."""
    found = dict(items)
    open_ = list(items)
    while open_:
        item = open_.pop()
        (cost, rank, edits), came = found[item]
        if item.next is None:
            new = [(w.moved(), (cost, rank, edits)) for w in WAITING[item.head]]
        elif inserting and item.next in GIVEN:
            new = [(item.moved(), (cost + INSERT, rank, edits + "I"))]
        else:
            new = []
        for other, value in new:
            if other not in found or value < found[other][0]:
                found[other] = (value, came)
                open_.append(other)
    return found


class Column:
    """Items of the chart after some row, each with its cost from the column's least and the rank of its audit; made once for equal ones, see of()."""

    known: ClassVar[dict[tuple, Column]] = {}

    def __init__(self, items: tuple[tuple[Item, int, int], ...]) -> None:
        self.items = items
        self.next: list[tuple[Column, int, dict[Item, tuple[Item, str]]] | None] = [None] * 12

    @classmethod
    def of(cls, items: dict[Item, tuple[Value, Item]]) -> tuple[Column, int, dict[Item, tuple[Item, str]]]:
        """The column, the least cost, and where each item came from by which edits."""
        least = min(cost for (cost, _, _), _ in items.values())
        items = {item: x for item, x in items.items() if x[0][0] <= least + FAR}
        ranks = {x: k for k, x in enumerate(sorted({(rank, edits) for (_, rank, edits), _ in items.values()}))}
        own = tuple(sorted((item, cost - least, ranks[rank, edits]) for item, ((cost, rank, edits), _) in items.items()))
        if own not in cls.known:
            cls.known[own] = cls(own)
        return cls.known[own], least, {item: (came, edits) for item, ((_, _, edits), came) in items.items()}

    @classmethod
    def opening(cls) -> Column:
        """The column before the first row: everything predicted, and what is complete without a row."""
        first = {item: ((0, 0, ""), item) for item in (Item(h, body, 0) for h, bodies in GRAMMAR.items() for body in bodies)}
        return cls.of(closed(first, False))[0]

    def _inserted(self) -> dict[Item, tuple[Value, Item]]:
        return closed({item: ((cost, rank, ""), item) for item, cost, rank in self.items}, True)

    def after(self, kind: int) -> tuple[Column, int, dict[Item, tuple[Item, str]]]:
        """The column after a row of a kind, see kind_of. Insertions come just before a row, so audits of a column are never each other's beginnings."""
        if self.next[kind] is None:
            initial, fault = "sua?"[kind % 4], kind // 4
            new: dict[Item, tuple[Value, Item]] = {}

            def offer(item: Item, value: Value, came: Item) -> None:
                if item not in new or value < new[item][0]:
                    new[item] = (value, came)

            for item, ((cost, rank, edits), came) in self._inserted().items():
                offer(item, (cost + DELETE, rank, edits + "D"), came)
                if fault < 2 and item.next is not None and item.next not in GRAMMAR:
                    more = cost + fault * TRUNCATED
                    if item.next == initial:
                        offer(item.moved(), (more + KEEP, rank, edits + "K"), came)
                    if item.next in GIVEN:
                        offer(item.moved(), (more + REROLE, rank, edits + "R"), came)
            self.next[kind] = Column.of(closed(new, False))
        return self.next[kind]

    def completed(self) -> tuple[int, Item, str]:
        """Cost from the column's least, item and last insertions of the cheapest parse that ends here."""
        ends = self._inserted()
        (cost, _, edits), came = min(ends[end] for body in GRAMMAR["C"] if (end := Item("C", body, len(body))) in ends)
        return cost, came, edits


def forward(column: Column, kinds: bytes) -> tuple[Column, int, Steps]:
    """The column after rows of these kinds, the cost that its items have in common, and each step's origins."""
    cost, steps = 0, []
    for kind in kinds:
        column, more, came = column.after(kind)
        cost += more
        steps.append(came)
    return column, cost, steps


def traced(item: Item, steps: Steps) -> tuple[Item, list[str]]:
    """The item before these steps, and the edits of each of them, that lead to item."""
    edits = []
    for came in reversed(steps):
        item, own = came[item]
        edits.append(own)
    return item, edits[::-1]


def kind_of(role: str, text: str, duplicate: bool) -> tuple[int, str]:
    """Number of the role's initial, and 4 for a truncated row or 8 for one that must be deleted; the row's fault."""
    words = text.rstrip(WHITE)
    fault = "blank" if not words else "duplicate" if duplicate else "" if words[-1] in ".!?" else "truncated"
    return max("sua".find(role[:1] or "?"), -1) % 4 + {"": 0, "truncated": 4}.get(fault, 8), fault


def edited(rows: Iterable[tuple[str, str]], edits: list[str], last: str) -> Iterator[tuple[str, str, str]]:
    """Role, text and initial of the rows after their edits; last: the initial before them."""

    def given() -> tuple[str, str]:
        initial = "a" if last == "u" else "u"
        return GIVEN[initial], initial

    for (role, text), own in zip(rows, edits, strict=True):
        for edit in own:
            if edit == "D":
                continue
            role_, last = (role, role[:1]) if edit == "K" else given()
            yield role_, "" if edit == "I" else text, last


def joined(rows: Iterable[tuple[str, str, str]]) -> bytes:
    """The rows as `role:text`, a newline before each."""
    return "".join(f"\n{role}:{text}" for role, text, _ in rows).encode()


class Tally:
    """Running counts of a conversation's rows in order."""

    NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal")

    def __init__(self) -> None:
        self.first = self.last = self.low = self.high = None
        self.turns = 0
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)

    def add(self, turn: int | None, role: str, fault: str) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += self.high != turn
            self.high = turn
        if fault:
            self.counts[fault] += 1
        if self.last is None:
            self.first = role[:1]
        else:
            self.counts["illegal"] += self.last + role[:1] not in ("su", "ua", "au")
        self.last = role[:1]

    def merge(self, first: str, last: str, low: int | None, high: int | None, turns: int, counts: list[int]) -> None:
        """Takes the counts of rows that come next."""
        if self.last is not None:
            self.counts["illegal"] += self.last + first not in ("su", "ua", "au")
        if low is not None:
            self.turns += turns - (low == self.high)
            self.low = low if self.low is None else self.low
            self.high = high
        for name, n in zip(self.counts, counts, strict=True):
            self.counts[name] += n
        self.first, self.last = first if self.first is None else self.first, last

    def values(self) -> list[int]:
        return [0 if self.low is None else self.high - self.low + 1 - self.turns, *self.counts.values()]


RESULT = "null_id boolean, id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
PIECE = "piece long, kinds binary, roles array<string>, texts array<string>, initials array<string>, turns array<long>, counts array<long>"


def read_rows(turns: DataFrame, damage: bool = True) -> DataFrame:
    """Rows (null_id, id, has_turn, turn, role, text, copies) of conversations; nulls are read as one space.

    With damage, crc32(`conv_id:turn`) % 20 decides: 0 drops the row, 1 empties its text,
    2 removes its `.!?`, 3 repeats it, 4 sets its role to user.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    chance = F.lit(-1) if not damage else F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(F.col("chance") == 1, "").when(F.col("chance") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), chance.alias("chance")).where("chance <> 0")
    ids = [F.isnull("conv_id").alias("null_id"), F.coalesce("conv_id", F.lit(0)).alias("id"), F.isnotnull("turn").alias("has_turn"), F.coalesce("turn", F.lit(0)).alias("turn")]
    return rows.select(*ids, F.when(F.col("chance") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("chance") == 3, 2).otherwise(1).alias("copies"))


def ordered(rows: DataFrame) -> DataFrame:
    """Equal rows as one, with `copies` and whether it is the `first` of its role and text in the conversation; sorted by conversation, turn (nulls first), role and text over all tasks."""
    same = ["null_id", "id", "has_turn", "turn", "role", "sha"]
    own = rows.withColumn("sha", F.unhex(F.sha2("text", 256)))
    one = own.groupBy(*same).agg(F.max("text").alias("text"), F.sum("copies").alias("copies"))
    # The place of the first is joined by turn too: a text that a long conversation repeats is not one key.
    first = own.groupBy("null_id", "id", "role", "sha").agg(F.min(F.struct("has_turn", "turn")).alias("at"))
    placed = first.select("null_id", "id", "at.has_turn", "at.turn", "role", "sha", F.lit(True).alias("first"))
    marked = one.join(placed, same, "left").select("null_id", "id", "has_turn", "turn", "role", "text", "copies", F.coalesce("first", F.lit(False)).alias("first"))
    order = ["null_id", "id", "has_turn", "turn", "role", "text"]
    return marked.repartitionByRange(*order[:5]).sortWithinPartitions(*order)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


_RESULT = pa.schema([("null_id", pa.bool_()), ("id", pa.int64()), *((n, pa.int64()) for n in (*Tally.NAMES, "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_PIECE = pa.schema([("piece", pa.int64()), ("kinds", pa.binary()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("initials", pa.list_(pa.string())), ("turns", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
_BOTH = pa.schema([*_RESULT, *_PIECE])


class _Part:
    """Rows of one conversation in a task."""

    def __init__(self, key: tuple) -> None:
        self.key, self.rows, self.kinds, self.chars, self.tally = key, [], bytearray(), 0, Tally()

    def add(self, turn: int | None, role: str, text: str, duplicate: bool) -> None:
        kind, fault = kind_of(role, text, duplicate)
        self.kinds.append(kind)
        self.rows.append((role, text))
        self.chars += len(text)
        self.tally.add(turn, role, fault)

    def whole(self) -> tuple:
        column, cost, steps = forward(Column.opening(), bytes(self.kinds))
        more, item, last = column.completed()
        edits = traced(item, steps)[1]
        out = joined(edited([*self.rows, ("", "")], [*edits, last], ""))
        return (*self.key, *self.tally.values(), cost + more, "".join(edits) + last, hashlib.sha256(out[1:]).hexdigest(), *[None] * len(_PIECE))

    def piece(self, number: int) -> tuple:
        t = self.tally
        return (*self.key, *[None] * 8, number, bytes(self.kinds), [r for r, _ in self.rows], [x for _, x in self.rows], [t.first, t.last], [t.low, t.high], [t.turns, *t.counts.values()])


def _parsed(batches: Iterator[pa.RecordBatch], piece_rows: int) -> Iterator[pa.RecordBatch]:
    """Results of the conversations that lie within the task, and pieces of the first and the last and of long ones."""
    number = TaskContext.get().partitionId() << 32
    part, inside, out = None, False, []  # inside: whether the conversation began in this task and has not been cut

    def cut() -> None:
        nonlocal number
        out.append(part.piece(number))
        number += 1

    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("null_id", "id", "has_turn", "turn", "role", "text", "copies", "first")]
        for null_id, id_, has_turn, turn, role, text, copies, first in zip(*columns, strict=True):
            if part is None or part.key != (null_id, id_):
                if part is not None:
                    out.append(part.whole()) if inside else cut()
                inside = part is not None
                part = _Part((null_id, id_))
            for k in range(copies):
                if len(part.rows) >= piece_rows or part.rows and part.chars + len(text) > PIECE_CHARS:
                    cut()
                    part, inside = _Part(part.key), False
                part.add(turn if has_turn else None, role, text, k > 0 or not first)
        if out:
            yield _batch(out, _BOTH)
            out.clear()
    if part is not None:
        cut()
        yield _batch(out, _BOTH)


def _passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of the rows of pieces, that come by conversation and in order: the column at each piece's start is kept, and its steps are made once more on the way back."""
    schema = pa.schema([("piece", pa.int64()), ("edits", pa.list_(pa.string())), ("before", pa.string()), ("cost", pa.int64()), ("last", pa.string())])
    own: list[tuple[int, bytes, Column]] = []
    key, column, cost = None, Column.opening(), 0

    def finished() -> pa.RecordBatch:
        more, item, last = column.completed()
        back = []
        for _, kinds, start in reversed(own):
            item, edits = traced(item, forward(start, kinds)[2])
            back.append(edits)
        before, rows = "", []
        for (number, kinds, _), edits in zip(own, reversed(back), strict=True):
            rows.append((number, edits, before, None, None))
            for kind, edit in zip(kinds, edits, strict=True):
                for e in edit:
                    before = before if e == "D" else "sua?"[kind % 4] if e == "K" else "a" if before == "u" else "u"
        rows[-1] = (*rows[-1][:3], cost + more, last)
        return _batch(rows, schema)

    for batch in batches:
        for null_id, id_, number, kinds in zip(*(batch[c].to_pylist() for c in ("null_id", "id", "piece", "kinds")), strict=True):
            if own and key != (null_id, id_):
                yield finished()
                own, column, cost = [], Column.opening(), 0
            key = null_id, id_
            own.append((number, kinds, column))
            column, more, _ = forward(column, kinds)
            cost += more
    if own:
        yield finished()


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text and the audit of each piece after its edits; the last one's also have the insertions at the end."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            pairs, edits = list(zip(r["roles"], r["texts"], strict=True)), r["edits"]
            if r["last"] is not None:
                pairs, edits = [*pairs, ("", "")], [*edits, r["last"]]
            rows.append((joined(edited(pairs, edits, r["before"])), "".join(edits)))
        names = [c for c in batch.schema.names if c not in ("roles", "texts", "edits")]
        yield pa.record_batch([*(batch[c] for c in names), pa.array([x for x, _ in rows], pa.large_binary()).cast(pa.binary()), pa.array([x for _, x in rows], pa.string())], [*names, "repaired", "audit"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A result for each conversation of pieces that come in order, one piece in memory at a time."""
    key = None

    def result() -> pa.RecordBatch:
        return _batch([(*key, *tally.values(), cost, "".join(audit), sha.hexdigest())], _RESULT)

    for batch in batches:
        for r in batch.to_pylist():
            if key != (r["null_id"], r["id"]):
                if key is not None:
                    yield result()
                key, tally, sha, audit, begun, cost = (r["null_id"], r["id"]), Tally(), hashlib.sha256(), [], False, 0
            turns, *counts = r["counts"]
            tally.merge(*r["initials"], *r["turns"], turns, counts)
            sha.update(r["repaired"] if begun else r["repaired"][1:])
            begun = begun or bool(r["repaired"])
            audit.append(r["audit"])
            cost = r["cost"] if r["cost"] is not None else cost
    if key is not None:
        yield result()


def repair(turns: DataFrame, damage: bool = True, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row for each conv_id of turns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    turns has conv_id, turn, role and text; other columns are not read. A null role or
    text is one space, a null turn comes first and is no turn for gaps, and rows with a
    null conv_id are a conversation of their own. Rows of one turn go by role and
    text; rows that repeat are duplicates. A conversation without rows after the
    damage has zeros, an empty audit and the checksum of nothing; an empty table gives no rows.
    damage: whether rows are damaged first; without it all are taken as they are.
    piece_rows: how many rows of a conversation a task holds before it makes a piece.
    """
    spark = turns.sparkSession
    folder = f"{shared_folder(spark)}/conversations-{uuid.uuid4().hex}"
    ordered(read_rows(turns, damage)).mapInArrow(partial(_parsed, piece_rows=piece_rows), f"{RESULT}, {PIECE}").write.parquet(f"{folder}/parsed")
    parsed = spark.read.parquet(f"{folder}/parsed")
    pieces = parsed.where("piece is not null")

    def in_order(df: DataFrame) -> DataFrame:
        return df.repartition("null_id", "id").sortWithinPartitions("null_id", "id", "piece")

    in_order(pieces.select("null_id", "id", "piece", "kinds")).mapInArrow(_passed, "piece long, edits array<string>, before string, cost long, last string").write.parquet(f"{folder}/edits")
    passed = spark.read.parquet(f"{folder}/edits")
    texts = pieces.select("null_id", "id", "piece", "roles", "texts", "initials", "turns", "counts").join(passed, "piece")
    mended = texts.mapInArrow(_repaired, "piece long, null_id boolean, id long, initials array<string>, turns array<long>, counts array<long>, before string, cost long, last string, repaired binary, audit string")
    long_ = in_order(mended.select("null_id", "id", "piece", "initials", "turns", "counts", "cost", "repaired", "audit")).mapInArrow(_summed, RESULT)
    found = parsed.where("piece is null").select(long_.columns).unionByName(long_)
    every = turns.select(F.isnull("conv_id").alias("null_id"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("id")).distinct()
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in (*Tally.NAMES, "cost")]
    named = every.join(found, ["null_id", "id"], "left")
    return named.select(F.when(~F.col("null_id"), F.col("id")).alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def oracle_sql() -> str:
    """DuckDB SQL of repair over conversations: the cheapest edits by states (0: nothing yet, 1: s, 2: u, 3: a), row after row for all conversations."""
    white = "[ \\t\\n\\x0B\\f\\r]"
    return f"""
        WITH RECURSIVE hashed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations),
        damaged AS (
            SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
            FROM hashed WHERE k <> 0),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, regexp_replace(text, '{white}+$', '') AS words FROM damaged),
        faulty AS (
            SELECT *, left(role, 1) AS x, CASE WHEN words = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(words, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
                lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS x0
            FROM placed),
        counts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                count(*) FILTER (x0 IS NOT NULL AND x0 || x NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
            FROM faulty GROUP BY conv_id),
        inserts(q, p, edits, price) AS (VALUES (0, 0, '', 0), (1, 1, '', 0), (2, 2, '', 0), (3, 3, '', 0), (0, 2, 'I', 2), (1, 2, 'I', 2), (2, 3, 'I', 2), (3, 2, 'I', 2), (0, 3, 'II', 4), (1, 3, 'II', 4)),
        uses(p, r, edit, needs, cost) AS (VALUES
            (0, 0, 'D', '', 3), (1, 1, 'D', '', 3), (2, 2, 'D', '', 3), (3, 3, 'D', '', 3), (0, 1, 'K', 's', 0), (0, 2, 'K', 'u', 0), (1, 2, 'K', 'u', 0), (2, 3, 'K', 'a', 0), (3, 2, 'K', 'u', 0),
            (0, 2, 'R', '', 2), (1, 2, 'R', '', 2), (2, 3, 'R', '', 2), (3, 2, 'R', '', 2)),
        chart AS (
            SELECT conv_id, 0::BIGINT AS i, 0 AS q, {{'cost': 0, 'audit': ''}} AS best FROM counts
            UNION ALL
            SELECT f.conv_id, f.i, u.r, min({{'cost': (c.best.cost + m.price + u.cost + (CASE WHEN fault = 'truncated' AND u.edit <> 'D' THEN 1 ELSE 0 END))::INT, 'audit': c.best.audit || m.edits || u.edit}})
            FROM chart c JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.i = c.i + 1 JOIN inserts m ON m.q = c.q JOIN uses u ON u.p = m.p
            WHERE u.needs IN ('', f.x) AND (u.edit = 'D' OR fault IS NULL OR fault = 'truncated') GROUP BY f.conv_id, f.i, u.r),
        ends AS (
            SELECT c.conv_id, min({{'cost': c.best.cost + m.price, 'audit': c.best.audit || m.edits}}) AS best
            FROM chart c JOIN counts n ON n.conv_id IS NOT DISTINCT FROM c.conv_id AND n.n = c.i JOIN inserts m ON m.q = c.q WHERE m.p IN (0, 3) GROUP BY c.conv_id),
        letters AS (SELECT conv_id, j, best.audit[j] AS edit FROM (SELECT *, unnest(range(1, length(best.audit) + 1)) AS j FROM ends)),
        used AS (
            SELECT l.*, sum((edit <> 'I')::INT) OVER w AS i, count(*) FILTER (edit IN ('I', 'R') OR edit = 'K') OVER w AS given FROM letters l WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
        kept AS (
            SELECT u.conv_id, j, edit, given, CASE WHEN edit <> 'I' THEN f.role END AS role, CASE WHEN edit = 'I' THEN '' ELSE f.text END AS text, CASE WHEN edit = 'K' AND f.x = 's' THEN 1 ELSE 0 END AS opens
            FROM used u JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM u.conv_id AND f.i = greatest(u.i, 1) WHERE edit <> 'D'),
        roles AS (
            SELECT conv_id, j, text, CASE WHEN edit = 'K' THEN role WHEN (given - max(opens) OVER (PARTITION BY conv_id)) % 2 = 1 THEN 'user' ELSE 'assistant' END AS role FROM kept),
        joined AS (SELECT conv_id, string_agg(role || ':' || text, chr(10) ORDER BY j) AS repaired FROM roles GROUP BY conv_id),
        every AS (SELECT DISTINCT conv_id FROM conversations)
        SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
        FROM every e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN ends d ON d.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN joined j ON j.conv_id IS NOT DISTINCT FROM e.conv_id"""
