"""Personal data: fixed patterns, and a skip-chain conditional random field that adds to them.

The field's nodes are the words of a text that hold a digit or an @; all other words
can have no label but OTHER, and a message through them says nothing, so they are
left out. Each node's potential comes from its shape; neighbours a few code points
apart share a chain potential; and words of one document that are repeated or similar
(the same letters and digits, the same last seven digits, or the same name before
an @) share a skip potential, from each occurrence to the next, wherever they stand.
Loopy sum-product messages over these edges make labels agree: a number that follows no
pattern where it stands is found if its like elsewhere does.

The potentials are fitted piece by piece on a sample of at most `sample` documents,
chosen by a hash of doc_id, in which what the patterns find is the label: a softmax
over shapes for the nodes, and log ratios of observed to expected label pairs for
either kind of edge. Spark counts shapes and pairs; only the counts reach the driver.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwise.llm.common import text_table

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
LABELS = OTHER + 1
#: Code points between words that share a chain potential, at most.
CHAIN_GAP = 3
ROUNDS = 100
#: Change of a log message from which another round is worth it.
SETTLED = 1e-3
#: Probability from which a label counts.
SURE = 0.8

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is tried from its start alone: a later start within it cannot do better.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*")
_ANY = re.compile(r"[0-9@]")
_EDGE = "\"'`.,;:!?()[]{}<>*#$%&|"

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    """Whether a digit string has a valid check digit."""
    total = sum(map(int, digits[-1::-2])) + sum((2 * d) % 9 if d != 9 else 9 for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of all pattern matches that hold, by kind and start."""
    found = [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split(".")):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((3, m.start(), m.end()))
    return found


@dataclass
class Graph:
    """Nodes of one text: places, shapes and labels of the patterns (OTHER where none), and its edges."""

    places: list[tuple[int, int]]
    shapes: list[int]
    labels: list[int]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def _shape(word: str) -> int:
    """Bits that describe a word."""
    digits = "".join(c for c in word if c in "0123456789")
    n, letters = len(digits), any(c.isalpha() for c in word)
    local, _, domain = word.partition("@")
    parts = word.split(".")
    bits = (
        "@" in word, bool(local) and "@" in word, "." in domain.strip("."), letters, word[:1] == "+", "(" in word or ")" in word,
        len(parts) == 4, len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts), word.count("-") == 1, word.count("-") > 1, "." in word,
        n == 1, 2 <= n <= 3, 4 <= n <= 6, 7 <= n <= 9, 10 <= n <= 15, 16 <= n <= 19, n > 19, 16 <= n <= 19 and luhn(digits), len(word) == n, any(c in "=\"'/_:" for c in word),
    )
    return sum(1 << k for k, b in enumerate(bits) if b)


SHAPE_BITS = 21


def graph(text: str, base: list[Span]) -> Graph:
    """The field of one text. It grows in proportion to the words with a digit or an @."""
    places, shapes, labels, chain, skip = [], [], [], [], []
    last: dict[str, int] = {}
    spans = sorted((a, b, k) for k, a, b in base)
    at = 0
    for m in _WORD.finditer(text):
        word = m.group().strip(_EDGE)
        if not word:
            continue
        start = m.start() + m.group().index(word)
        end, i = start + len(word), len(places)
        while at < len(spans) and spans[at][1] <= start:
            at += 1
        own = [k for a, b, k in spans[at : at + 8] if a < end and b > start]
        places.append((start, end))
        shapes.append(_shape(word))
        labels.append(own[0] if own else OTHER)
        if i and start - places[i - 1][1] <= CHAIN_GAP:
            chain.append((i - 1, i))
        plain = "".join(c for c in word.lower() if c.isalnum())
        digits = "".join(c for c in plain if c in "0123456789")
        keys = {f"={plain}"} if len(plain) >= 6 else set()
        if len(digits) >= 7:
            keys.add(f"#{digits[-7:]}")
        if "@" in word and len(local := word.lower().partition("@")[0]) >= 4:
            keys.add(f"@{local}")
        for key in keys:
            if key in last and (last[key], i) not in skip[-3:]:
                skip.append((last[key], i))
            last[key] = i
    return Graph(places, shapes, labels, chain, skip)


@dataclass(frozen=True)
class Field:
    """node: weights by shape bit (the last row: bias) and label; chain and skip: by pair of labels."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def beliefs(self, g: Graph) -> np.ndarray:
        """Probability of each label at each node, by loopy sum-product messages until they settle; what a pattern labelled stays certain.

        Without a cycle these are the exact marginals. Each round passes every message
        on by one edge, so it takes as many rounds as the longest way at most, and
        where a cycle keeps them moving, ROUNDS more.
        """
        n = len(g.places)
        bits = (np.array(g.shapes)[:, None] >> np.arange(SHAPE_BITS)) & 1
        own = bits @ self.node[:-1] + self.node[-1]
        known = np.array(g.labels)
        sure = known != OTHER
        own[sure] = -20.0
        own[sure, known[sure]] = 0.0
        own -= own.max(axis=1, keepdims=True)
        edges = np.array(g.chain + g.skip, dtype=np.int64).reshape(-1, 2)
        if len(edges):
            tables = np.concatenate([np.repeat(self.chain[None], len(g.chain), 0), np.repeat(self.skip[None], len(g.skip), 0)])
            source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
            tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
            back = np.roll(np.arange(len(source)), len(edges))
            message = np.zeros((len(source), LABELS))
            for _ in range(n + ROUNDS):
                total = own.copy()
                np.add.at(total, target, message)
                whole = (total[source] - message[back])[:, :, None] + tables
                top = whole.max(axis=1)
                new = top + np.log(np.exp(whole - top[:, None]).sum(axis=1))
                new -= new.max(axis=1, keepdims=True)
                if np.abs(new - message).max() < SETTLED:
                    break
                message = (message + new) / 2
            np.add.at(own, target, message)
        odds = np.exp(own - own.max(axis=1, keepdims=True))
        assert len(odds) == n
        return odds / odds.sum(axis=1, keepdims=True)

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Spans that the field labels beyond the patterns' own, which they do not overlap; adjoining ones of one label are joined."""
        if not _ANY.search(text):
            return []
        g = graph(text, base)
        if all(k != OTHER for k in g.labels) or not g.places:
            return []
        beliefs = self.beliefs(g)
        out: list[Span] = []
        for i in np.flatnonzero((beliefs[:, OTHER] <= 1 - SURE) & (np.array(g.labels) == OTHER)).tolist():
            kind, (start, end) = int(beliefs[i, :OTHER].argmax()), g.places[i]
            if out and out[-1][0] == kind and text[out[-1][2] : start].strip(" ()-") == "" and start - out[-1][2] <= CHAIN_GAP:
                out[-1] = (kind, out[-1][1], end)
            else:
                out.append((kind, start, end))
        return sorted(out)


def fit(docs: DataFrame, sample: int = 20_000, rounds: int = 300) -> Field:
    """The field learnt from a bounded sample of docs. Without any word with a digit or an @, it labels nothing."""
    total = docs.count()
    share = min(1.0, sample / max(total, 1))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[tuple[str, int, int]] = Counter()
            for text in batch["text"].to_pylist():
                if text and _ANY.search(text):
                    g = graph(text, base_spans(text))
                    found.update(("node", s, k) for s, k in zip(g.shapes, g.labels, strict=True))
                    found.update(("chain", g.labels[a], g.labels[b]) for a, b in g.chain)
                    found.update(("skip", g.labels[a], g.labels[b]) for a, b in g.skip)
            columns = list(zip(*((*k, n) for k, n in found.items()), strict=True)) or [[]] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["piece", "a", "b", "n"])

    chosen = text_table(docs).where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    counts = chosen.select("text").mapInArrow(counted, "piece string, a long, b long, n long").groupBy("piece", "a", "b").agg(F.sum("n").alias("n")).collect()
    nodes = sorted((r["a"], r["b"], r["n"]) for r in counts if r["piece"] == "node")
    weights = np.zeros((SHAPE_BITS + 1, LABELS))
    if nodes:
        shapes, labels, n = (np.array(c) for c in zip(*nodes, strict=True))
        x = np.column_stack([(shapes[:, None] >> np.arange(SHAPE_BITS)) & 1, np.ones(len(shapes), int)]).astype(float)
        goal = np.eye(LABELS)[labels]
        share_of = n / n.sum()
        speed = np.zeros_like(weights)
        for _ in range(rounds):
            p = np.exp(x @ weights - (x @ weights).max(axis=1, keepdims=True))
            slope = x.T @ ((p / p.sum(axis=1, keepdims=True) - goal) * share_of[:, None]) + 1e-5 * weights
            speed = 0.9 * speed + slope
            weights = weights - 0.5 * speed
    else:
        weights[-1, OTHER] = 10.0

    def pairs(piece: str, ties: bool) -> np.ndarray:
        """Log ratios of observed pairs to independent ones; for skip edges, half the log odds that a pair with a kind in it agrees, and its opposite."""
        seen = np.full((LABELS, LABELS), 0.5)
        for r in counts:
            if r["piece"] == piece:
                seen[r["a"], r["b"]] += r["n"] / 2
                seen[r["b"], r["a"]] += r["n"] / 2
        if ties:
            same = np.trace(seen[:OTHER, :OTHER])
            half = np.log((same + 1) / (seen.sum() - seen[OTHER, OTHER] - same + 1)).clip(1, 8) / 2
            return np.where(np.eye(LABELS, dtype=bool), half, -half)
        alone = seen.sum(axis=1) / seen.sum()
        return np.clip(np.log(seen / seen.sum() / np.outer(alone, alone)), -2, 2)

    return Field(weights, pairs("chain", False), pairs("skip", True))


def _line(spans: list[Span], prefix: str = "") -> list[str]:
    return [f"{prefix}{KINDS[k]}:{a}:{b}" for k, a, b in spans]


def find(docs: DataFrame, field: Field) -> DataFrame:
    """One row a document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans.

    The numbers and the digest are of the patterns' own spans; in spans, those that the
    field adds come after them, their kinds with "crf_" before. A null or empty text has no
    spans; rows that repeat are read each; a null doc_id stays null. Columns other than doc_id
    and text are not read; an empty table gives no rows.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                text = text.as_py()
                base = base_spans(text) if _ANY.search(text) else []
                line = _line(base)
                kinds = Counter(k for k, _, _ in base)
                rows.append((*(kinds[k] for k in range(OTHER)), hashlib.sha256(",".join(line).encode()).hexdigest(), ",".join(line + _line(field.added(text, base), "crf_"))))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.record_batch([batch["doc_id"], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return text_table(docs).mapInArrow(found, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def personal_data(docs: DataFrame, sample: int = 20_000) -> DataFrame:
    """find() with a field fitted on docs."""
    return find(docs, fit(docs, sample))


def redacted(text: str, field: Field) -> str:
    """The text with a placeholder for each span; of overlapping spans, one for their union, named by the first."""
    base = base_spans(text) if _ANY.search(text) else []
    spans = sorted((a, b, k) for k, a, b in base + field.added(text, base))
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, sample: int = 20_000) -> DataFrame:
    """docs with personal data replaced in text, and n_chars, where there is such a column, as long as the new text. Null texts stay null."""
    field = fit(docs, sample)

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else redacted(t, field) for t in batch["text"].to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"), pa.array(texts, batch.schema.field("text").type))

    out = docs.mapInArrow(replaced, docs.schema)
    kind = dict(docs.dtypes).get("n_chars")
    return out.withColumn("n_chars", F.length("text").cast(kind)) if kind else out
