"""Spelling variants against a comparison of all pairs, and conversations against all edits."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from boxwise.llm.conversations import repair
from boxwise.llm.queries import ORACLE_SQL, op11_even_partition_join, op12_earley_repair
from boxwise.llm.spelling import spelling_variants
from tests.comparing import rows_of, sql_rows


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(docs: list[tuple]) -> list[tuple]:
    """(form, form_n, n, n_near, root, word) by comparing every word with every other."""
    n: Counter[str] = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 6:
                n[word] += 1
    n = {w: c for w, c in n.items() if c >= 5}
    near = {w: [v for v in n if one_edit(v, w)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w: str) -> str:
        return w if form[w] is None else root(form[w])

    return sorted(((form[w], n[form[w]] if form[w] else None, c, len(near[w]), root(w), w) for w, c in n.items()), key=repr)


def test_variants_equal_all_pairs(spark: SparkSession) -> None:
    rng = random.Random(11)
    words = ["abcdefgh", "ébcdefgh", "straße", "aaaaaa", "aaaaaaa", "aaaaaaaaaaaa", "ABCDEF", "naïvete", "x" * 300]
    for _ in range(60):
        w = list(rng.choice(words).lower())
        k = rng.randrange(len(w))
        w[k : k + rng.randrange(2)] = rng.choice(["", "a", "b", "é", "÷"])
        words.append("".join(w))
    docs = [(d, " ".join(rng.choices(words[: rng.choice([3, 9, 60])], k=80))) for d in range(60)]
    docs += [(None, "abcdefgh abcdefgh, naïvete"), (7, docs[7][1]), (90, None), (91, ""), (92, "1 2 3 ... \t"), (93, "abcdefgx " * 200_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(1))
    found = rows_of(spelling_variants(df))
    assert found == plain_variants(docs)
    assert any(r[0] and r[4] != r[0] for r in found), "no chain of forms among the words"


def test_no_words(spark: SparkSession) -> None:
    for rows in ([], [(1, None)], [(1, "one two three")]):
        assert spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("query", [op11_even_partition_join, op12_earley_repair])
def test_queries_equal_sql(spark: SparkSession, sf_dir: str, query) -> None:  # noqa: ANN001
    df = query(spark, sf_dir)
    names, expected = sql_rows(sf_dir, ORACLE_SQL[query.__name__])
    assert sorted(df.columns) == names
    assert rows_of(df) == expected


FULL = {"u": "user", "a": "assistant"}


def cheapest(rows: list[tuple[str, str]], faults: list[str]) -> tuple[int, str, str]:
    """Cost, audit and repaired text of the best edits, trying them in order of (cost, audit)."""
    heap = [(0, "", 0, "", ())]
    while heap:
        cost, audit, i, initials, out = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, "\n".join(out)
        for x, role in FULL.items():
            if re.fullmatch("s?(ua)*u?", initials + x):
                heapq.heappush(heap, (cost + 2, audit + "I", i, initials + x, (*out, f"{role}:")))
        if i == len(rows):
            continue
        role, text = rows[i]
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, initials, out))
        if faults[i] in ("blank", "duplicate"):
            continue
        more = cost + (faults[i] == "truncated")
        if re.fullmatch("s?(ua)*u?", initials + role[:1]) and role[:1]:
            heapq.heappush(heap, (more, audit + "K", i + 1, initials + role[:1], (*out, f"{role}:{text}")))
        for x, new in FULL.items():
            if re.fullmatch("s?(ua)*u?", initials + x):
                heapq.heappush(heap, (more + 2, audit + "R", i + 1, initials + x, (*out, f"{new}:{text}")))
    raise AssertionError


def plain_repair(turns: list[tuple], damage: bool) -> list[tuple]:
    own: dict[int | None, list] = defaultdict(list)
    for conv, turn, role, text in turns:
        own[conv]  # noqa: B018
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        own[conv] += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    out = []
    for conv, rows in own.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in rows:
            words = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not words else "duplicate" if (role, text) in seen else "" if words[-1] in ".!?" else "truncated")
            seen.add((role, text))
        numbers = [t for t, _, _ in rows if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, repaired = cheapest([r[1:] for r in rows], faults)
        out.append((audit, faults.count("blank"), conv, cost, faults.count("duplicate"), gaps, illegal, hashlib.sha256(repaired.encode()).hexdigest(), faults.count("truncated")))
    return sorted(out, key=repr)


def conversations(rng: random.Random) -> list[tuple]:
    """Conversations with odd roles, gaps, nulls, ties and repeated rows."""
    turns = []
    for conv in [*range(40), None]:
        for k in range(rng.randrange(1, 7)):
            turn = rng.choice([k, k, k, k + 1, k * 3, None])
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.8 else rng.choice(["system", "tool", "", None, "ünd", "sudo"])
            text = rng.choice(["Yes.", "No!", "and then", " \t", "", None, "why?\n", "é", "a ", "Ok. "])
            turns.append((conv, turn, role, text))
    return turns + turns[:5]


@pytest.mark.parametrize("damage", [True, False])
def test_repair_is_the_cheapest(spark: SparkSession, damage: bool) -> None:
    turns = conversations(random.Random(12))
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("id", F.lit(1)).withColumn("audit", F.lit("x"))
    expected = plain_repair(turns, damage)
    assert rows_of(repair(df, damage)) == expected
    assert rows_of(repair(df, damage, piece_rows=2)) == expected


def test_one_conversation_over_all_tasks(spark: SparkSession) -> None:
    """A conversation of many rows, in pieces, with the same results as in one; the chart's columns come from a small set."""
    rng = random.Random(3)
    turns = [(1, k, rng.choice(["user", "assistant", "system"]), f"{rng.randrange(300)} {rng.choice(['.', ''])}") for k in range(3000)] + [(2, 0, "user", "Hi."), (3, None, None, None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(8)
    whole = rows_of(repair(df, False))
    assert whole == rows_of(repair(df, False, piece_rows=7)) == rows_of(repair(df.coalesce(1), False, piece_rows=10_000))
    long_ = next(r for r in whole if r[2] == 1)
    assert long_[5] == 0 and long_[4] > 0 and sum(c != "I" for c in long_[0]) == 3000


def test_no_conversations(spark: SparkSession) -> None:
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair(empty).collect() == []
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    row = repair(spark.createDataFrame([(gone, 0, "user", "Hi.")], empty.schema)).collect()
    assert [tuple(r) for r in row] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
