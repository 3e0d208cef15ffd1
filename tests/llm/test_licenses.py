"""Licence notices within longer texts, wherever their lines break."""

from __future__ import annotations

import re
import textwrap
from collections import defaultdict

import numpy as np
from pyspark.sql import SparkSession

from boxwise.llm.licenses import NOTICES, TEMPLATES, THRESHOLD, license_matches, license_notices, template_bigrams
from boxwise.llm.queries import op3_license_notices


def test_notices_wrapped_in_longer_texts(spark: SparkSession) -> None:
    rng = np.random.default_rng(3)
    filler = lambda: " ".join(f"w{k}" for k in rng.integers(0, 5000, 400))
    names = list(NOTICES)
    docs = [(d, f"{filler()}\n{textwrap.fill(NOTICES[name], 80, initial_indent=' * ', subsequent_indent=' * ')}\n{filler()}") for d, name in enumerate(names)]
    docs += [(1000, filler()), (1001, None), (1002, ""), (1003, "license"), (1004, f"{TEMPLATES['mit']} {filler()} {TEMPLATES['mit']}")]
    found = defaultdict(list)
    for r in license_notices(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        found[r["doc_id"], r["template"]].append((r["first_word"], r["dice"]))
    for d, name in enumerate(names):
        assert [(at, x) for at, x in found[d, name] if x == 1] == [(400, 1.0)], name
    assert len(found[1004, "mit"]) == 2 and not any(d in (1000, 1001, 1002, 1003) for d, _ in found)


def plain_matches(texts: list[tuple[int | None, str | None]]) -> list[tuple]:
    """Every unit against every template, by sets."""
    out = []
    for d, text in texts:
        lines = (text or "").split("\n")
        for line, unit in [*([(-1, text)] if len(lines) > 1 else []), *enumerate(lines)]:
            words = re.sub("[^a-z0-9]+", " ", unit.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))).split()
            own = set(zip(words, words[1:], strict=False))
            for name, bigrams in template_bigrams().items():
                dice = 2 * len(own & {tuple(b.split()) for b in bigrams}) / (len(own) + len(bigrams))
                if dice >= 0.75:
                    out.append((d, line, name, len(own), round(dice, 9)))
    return sorted(out, key=repr)


def test_matches_equal_plain_sets_on_odd_rows(spark: SparkSession) -> None:
    """No match is lost to the filters before the bigrams; nulls, empty, blank, long and repeated texts, clashing columns."""
    rng = np.random.default_rng(4)
    docs: list[tuple[int | None, str | None]] = [(1, None), (2, ""), (3, " \n \n"), (None, TEMPLATES["isc"]), (4, "license"), (5, "MIT"), (6, "x" * 300_000 + "\n" + TEMPLATES["mit"].upper()), (7, "l\u0130cense\u212a")]
    docs += [(8, f"{TEMPLATES['mit_line']}\n" * 3)] * 2
    for name, text in TEMPLATES.items():  # words taken away, one after the other, from both sides of the threshold
        words = text.split()
        for k in range(0, len(words) // 2 + 1, max(1, len(words) // 8)):
            gone = set(rng.choice(len(words), k, replace=False).tolist())
            docs.append((len(docs) + 100, f"head\n{' '.join(w for i, w in enumerate(words) if i not in gone)}, {name}\ntail"))
    rows = [(d, t, "x", 1, "y") for d, t in docs]
    got = license_matches(spark.createDataFrame(rows, "doc_id long, text string, line string, dice int, words string"))
    assert sorted(((r["doc_id"], r["line"], r["template"], r["n_bigrams"], round(r["dice"], 9)) for r in got.collect()), key=repr) == plain_matches(docs)
    assert license_matches(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert license_notices(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_notices(text: str) -> list[tuple]:
    """(template, first_word, n_words, n_bigrams, dice): every run is compared, and the best of those that overlap stays."""
    words = re.sub("[^a-z0-9]+", " ", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))).split()
    pairs = [" ".join(p) for p in zip(words, words[1:], strict=False)]
    out = []
    for name, bigrams in template_bigrams(NOTICES).items():
        own, runs = set(bigrams), []
        for a in (i for i, p in enumerate(pairs) if p in own):
            for b in (j for j in range(a, len(pairs)) if pairs[j] in own and j - a < len(own) * (2 - THRESHOLD) / THRESHOLD):
                run = set(pairs[a : b + 1])
                dice = 2 * len(run & own) / (len(run) + len(own))
                if dice >= THRESHOLD:
                    runs.append((-dice, a, b, len(run)))
        kept: list[tuple] = []
        for r in sorted(runs):
            if not any(r[1] <= k[2] + 1 and k[1] <= r[2] + 1 for k in kept):
                kept.append(r)
        out += [(name, a, b - a + 2, n, round(-x, 9)) for x, a, b, n in kept]
    return sorted(out)


def test_notices_equal_all_runs(spark: SparkSession) -> None:
    """Damaged, repeated and adjoining notices; nulls, repeated rows and clashing names."""
    rng = np.random.default_rng(6)
    texts: list[str | None] = [None, "", " \n", "mit"]
    for _ in range(25):
        words: list[str] = []
        for name in rng.choice(list(NOTICES), int(rng.integers(1, 4))):
            own = NOTICES[name].split()
            gone = set(rng.choice(len(own), int(len(own) * rng.choice([0, 0.1, 0.3])), replace=False).tolist())
            words += [w for i, w in enumerate(own) if i not in gone] + [f"w{k}" for k in rng.integers(0, 9, int(rng.integers(0, 6)))]
        texts.append("\n".join(words))
    docs = [*enumerate(texts), (7, texts[7]), (None, texts[8])]
    rows = [(d, t, "x", 1, [1], True) for d, t in docs]
    got = license_notices(spark.createDataFrame(rows, "doc_id long, text string, template string, pairs int, runs array<int>, own boolean")).collect()
    expected = [(d, *r) for d, t in docs for r in plain_notices(t or "")]
    assert sorted(((r["doc_id"], r["template"], r["first_word"], r["n_words"], r["n_bigrams"], round(r["dice"], 9)) for r in got), key=repr) == sorted(expected, key=repr) and expected


def test_a_very_long_text_of_notices(spark: SparkSession) -> None:
    text = ("alpha beta gamma " * 30 + NOTICES["isc"] + " ") * 60
    found = license_notices(spark.createDataFrame([(1, text), (2, "word " * 1_000_000)], "doc_id long, text string")).where("template = 'isc'").collect()
    assert len(found) == 60 and all(r["doc_id"] == 1 and r["dice"] == 1 for r in found)


def test_every_licence_line_is_found(spark: SparkSession) -> None:
    sf_dir = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = {r["doc_id"] for r in op3_license_notices(spark, sf_dir).where("template = 'cc_by_nc_line'").collect()}
    assert {d for d, t in texts.items() if "Licensed under CC BY-NC 4.0." in t} <= found and found
