"""Encoding, packing, toxicity, language-model scores and neighbour search against brute force or held-out figures."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import defaultdict
from dataclasses import replace

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import SparkSession
from tokenizers import Tokenizer

from boxwise.llm.ann import nearest
from boxwise.llm.bpe import decode, encode, round_trip
from boxwise.llm import ann, lm_score
from boxwise.llm.lm_score import pseudo_likelihood, targets
from boxwise.llm.packing import best_fit, encoder, local_search, pack, pieces
from boxwise.llm.queries import op1_best_fit_packing, op4_byte_bpe, op7_pseudo_likelihood, op8_multi_index_hashing, op9_fm_toxicity, token_pattern, tokenizer_file
from boxwise.llm.toxicity import Machine, _descend, buckets_by_text, drop_toxic, toxicity

RANKS = "byte_bpe_50k.tiktoken"
SCHEMA = "doc_id long, text string"
ODD = [None, "", " ", "  a", "a  ", "it's we'll 'LL ''s 're've x'd", "x\n\n y\r\n", "1234 ٣٤ Ⅷ x2", "é😀  z", "a" * 3000, " " * 3000, "!?" * 2000, "\u0085\x1c\x1d q", "ab" * 400, "日本語 текст", "'", "s'", "a'\ns"]


@pytest.fixture(scope="module")
def texts(spark: SparkSession, sf_dir: str) -> dict[int, str]:
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def reference():  # noqa: ANN201
    return encoder(tokenizer_file(RANKS), token_pattern())


def check_ids(rows: list, texts: dict[int, str]) -> None:
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        ids = reference().encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), text[:50]
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_ids(spark: SparkSession, sf_dir: str, texts: dict[int, str]) -> None:
    check_ids(op4_byte_bpe(spark, sf_dir).collect(), texts)


def test_ids_of_odd_texts(spark: SparkSession) -> None:
    docs = spark.createDataFrame(list(enumerate(ODD)), SCHEMA)
    check_ids(round_trip(docs, tokenizer_file(RANKS)).collect(), {k: t or "" for k, t in enumerate(ODD)})
    tokens = encode(docs, tokenizer_file(RANKS))
    assert {r["doc_id"]: bytes(r["text"]).decode() for r in decode(tokens, tokenizer_file(RANKS)).collect()} == {k: t or "" for k, t in enumerate(ODD)}
    for r in tokens.collect():
        assert r["offsets"] == sorted(r["offsets"]) and len(r["offsets"]) == len(r["ids"])
    assert round_trip(docs.where("false"), tokenizer_file(RANKS)).count() == 0


def check_packing(rows: list, ids_of: dict[int, list[int]], capacity: int) -> int:
    """Every rule of the pieces; the number of sequences."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(ids_of)
    for doc, own in pieces.items():
        own.sort(key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(own):
            ids = ids_of[doc][at : at + r["length"]]
            assert (r["piece"], r["start"]) == (k, at)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
            assert r["length"] == capacity or k == 0
            at += r["length"]
        assert at == len(ids_of[doc])
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(sequences)


def test_packing(spark: SparkSession, sf_dir: str, texts: dict[int, str]) -> None:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids_of = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for d, t in texts.items()}
    n = check_packing(op1_best_fit_packing(spark, sf_dir).collect(), ids_of, 2048)
    least = math.ceil(sum(map(len, ids_of.values())) / 2048)
    assert n <= max(least + 2, 1.02 * least)


def test_packing_of_odd_texts(spark: SparkSession) -> None:
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(ODD)], f"{SCHEMA}, length int")
    ids_of = {k: [*reference().encode_ordinary(t or ""), 0] for k, t in enumerate(ODD)}
    check_packing(pack(docs, tokenizer_file(RANKS), token_pattern(), capacity=64).collect(), ids_of, 64)
    assert pack(docs.where("false"), tokenizer_file(RANKS), token_pattern()).count() == 0


def test_local_search_empties_bins_that_best_fit_leaves() -> None:
    sizes = np.array([44, 24, 24, 22, 21, 17, 8, 8, 6, 6])
    before = best_fit(sizes, 60)
    assert len(before) == 4 and len(local_search(sizes, before, 60)) == 3
    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes = rng.integers(15, 60, 40)
        before = best_fit(sizes, 100)
        after = local_search(sizes, before, 100)
        assert sorted(i for own in after for i in own) == list(range(40)) and all(sizes[own].sum() <= 100 for own in after)
        assert len(after) <= len(before)


def test_toxicity_on_the_held_out_fold(spark: SparkSession) -> None:
    sf_dir = "/root/testdata/sf0.1"  # smaller tables hold out six toxic documents or fewer
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = op9_fm_toxicity(spark, sf_dir).collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    tested = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    pos, neg = [s for s, y in tested if y == 1], [s for s, y in tested if y == 0]
    auroc = np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])
    assert auroc > 0.9


def test_toxicity_learns_a_pair_of_terms(spark: SparkSession) -> None:
    """Either word alone is harmless; both together are not."""
    rng = np.random.default_rng(9)
    docs, labels = [], []
    for d in range(800):
        a, b = d % 2, d // 2 % 2
        words = [f"f{k}" for k in rng.integers(0, 3000, 12)] + ["insultword"] * a + ["groupword"] * b
        docs.append((d, " ".join(words)))
        labels.append((d, int(a and b)))
    docs, labels = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    found = [r["predicted"] == truth[r["doc_id"]] for r in toxicity(docs, labels, least_z=4.0).collect() if r["held_out"]]
    assert np.mean(found) > 0.95


def plain_logit(machine: Machine, own: list[int]) -> float:
    """The machine's logit of a set of terms, pair by pair."""
    pairs = sum(float(machine.factors[a] @ machine.factors[b]) for k, a in enumerate(own) for b in own[k + 1 :])
    return machine.bias + sum(machine.weight[own]) + pairs


def test_machine_scores_equal_a_sum_over_pairs() -> None:
    rng = np.random.default_rng(5)
    machine = Machine(-0.7, np.arange(30), rng.normal(0, 0.5, 30), rng.normal(0, 0.5, (30, 4)))
    sets = [sorted(rng.choice(30, size, replace=False).tolist()) for size in (0, 1, 2, 9, 30, 0)]
    term, text = np.array([t for own in sets for t in own]), np.repeat(np.arange(len(sets)), [len(own) for own in sets])
    assert machine.scores(term, text, len(sets)) == pytest.approx([1 / (1 + np.exp(-plain_logit(machine, own))) for own in sets])


def test_machine_steps_against_the_slope_of_its_loss() -> None:
    """The first step moves each number against the slope that small differences of a plain loss give."""
    rng = np.random.default_rng(6)
    x = (rng.random((40, 12)) < 0.4).astype(float)
    y, share, decay = (rng.random(40) < 0.3).astype(float), np.full(40, 1 / 40), 1e-3
    fitted = lambda rounds: _descend(x, y, share, -0.5, np.arange(12), rounds, decay)

    def loss(m: Machine) -> float:
        logits = np.array([plain_logit(m, np.flatnonzero(row).tolist()) for row in x])
        return float((share * (np.logaddexp(0, logits) - y * logits)).sum() + decay / 2 * (m.weight**2).sum() + 5 * decay * (m.factors**2).sum())

    start, after = fitted(0), fitted(1)
    for part in ("weight", "factors"):
        moved = getattr(after, part) - getattr(start, part)
        for at in np.ndindex(moved.shape):
            ends = []
            for step in (1e-5, -1e-5):
                changed = getattr(start, part).copy()
                changed[at] += step
                ends.append(loss(replace(start, **{part: changed})))
            slope = (ends[0] - ends[1]) / 2e-5
            assert abs(slope) < 1e-6 or moved[at] * slope < 0
    assert loss(fitted(300)) < loss(start)


@pytest.mark.parametrize("text", ["insultword " * 300_000, "x" * 2_000_000, " " * 2_000_000, "\u00e9" * 700_000])
def test_a_very_long_text_scores_as_its_set_of_terms(text: str) -> None:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    term, own = buckets_by_text(raw, np.array([0, len(raw)]))
    short = np.frombuffer(" ".join(dict.fromkeys(text.split())).encode(), dtype=np.uint8)
    assert term.tolist() == buckets_by_text(short, np.array([0, len(short)]))[0].tolist() and not own.any()


def test_toxicity_of_odd_tables(spark: SparkSession) -> None:
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "x y", "c"), (2, "", "d")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity(docs, labels).count() == 4
    assert drop_toxic(docs, labels).columns == docs.columns
    assert toxicity(docs, labels.where("false")).count() == 4 and toxicity(docs.where("false"), labels).count() == 0


def test_pseudo_likelihood(spark: SparkSession, sf_dir: str, texts: dict[int, str]) -> None:
    rows = {r["doc_id"]: r for r in op7_pseudo_likelihood(spark, sf_dir).collect()}
    assert sorted(rows) == sorted(texts)
    for d, r in rows.items():
        assert r["log_likelihood"] <= 0 and (r["n_tokens"] > 0 or r["log_likelihood"] == 0)
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "b a"), (None, "a"), (3, "b a")], SCHEMA)
    found = pseudo_likelihood(docs).collect()
    assert sorted(r["n_tokens"] for r in found) == [0, 0, 1, 2, 2] and pseudo_likelihood(docs.where("false")).count() == 0


def test_pseudo_likelihood_prefers_usual_order(spark: SparkSession) -> None:
    """Texts in the order of the corpus score better than the same words shuffled."""
    rng = np.random.default_rng(7)
    cycle = [f"w{k}" for k in range(30)]
    docs = [(d, " ".join(cycle[(d + k) % 30] for k in range(120))) for d in range(600)]
    mixed = [(1000 + d, " ".join(rng.permutation(docs[d][1].split()))) for d in range(20)]
    scores = {r["doc_id"]: r["mean_log_likelihood"] for r in pseudo_likelihood(spark.createDataFrame(docs + mixed, SCHEMA), rounds=6).collect()}
    assert np.mean([scores[d] for d in range(20)]) > np.mean([scores[1000 + d] for d in range(20)]) + 0.1


def test_pseudo_likelihood_trains_on_every_token_once() -> None:
    bounds = np.array([0, 5, 5, 40, 41])
    for rounds in (1, 2, 7):
        assert sorted(np.concatenate([targets(bounds, k, rounds) for k in range(rounds)])) == list(range(41))


@pytest.mark.parametrize("counted", [1 << 17, 1000])
def test_pseudo_likelihood_tells_rare_words_apart(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, counted: int) -> None:
    """In one context, the probabilities of all words, rare ones too, add up to no more than 1, whether their counts are at hand or joined."""
    monkeypatch.setattr(lm_score, "COUNTED", counted)
    docs = spark.createDataFrame([(d, f"w{d % 3000}") for d in range(3500)], SCHEMA)
    rows = {r["doc_id"]: np.exp(r["log_likelihood"]) for r in pseudo_likelihood(docs).collect()}
    assert 0.9 < sum(rows[d] for d in range(3000)) <= 1 + 1e-6


def test_network_gradients_are_those_of_the_log_probability() -> None:
    """A step moves each weight against the slope that small differences give."""
    rng = np.random.default_rng(3)
    net = lm_score.Network.of(rng.normal(0, 0.3, len(lm_score.Network.start(np.ones(lm_score.VOCABULARY)).flat())))
    around, token = rng.integers(0, lm_score.VOCABULARY, (50, 2 * lm_score.WINDOW)), rng.integers(0, lm_score.VOCABULARY, 50)
    before = net.flat()
    net.learn(around, token, 1.0)
    moved = net.flat() - before
    chosen = rng.choice(np.flatnonzero(moved), 40, replace=False)
    for i in chosen:
        ends = []
        for step in (1e-5, -1e-5):
            flat = before.copy()
            flat[i] += step
            ends.append(lm_score.Network.of(flat).log_probability(around, token).mean())
        assert moved[i] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-3, abs=1e-7)
    logs = np.array([lm_score.Network.of(before).log_probability(np.repeat(around[:1], lm_score.VOCABULARY, 0), np.arange(lm_score.VOCABULARY))])
    assert np.exp(logs).sum() == pytest.approx(1)


def brute(ids: np.ndarray, x: np.ndarray, asked: list[int], k: int) -> dict[int, list[int]]:
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    out = {}
    for q in asked:
        score = unit @ unit[np.flatnonzero(ids == q)[0]]
        keep = ids != q
        out[q] = ids[keep][np.lexsort((ids[keep], -score[keep]))[:k]].tolist()
    return out


def test_neighbours_recall(spark: SparkSession) -> None:
    sf_dir = "/root/testdata/sf0.01"
    rows = [r for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect() if r["embedding"] is not None]
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=float)
    found = defaultdict(list)
    for r in sorted(op8_multi_index_hashing(spark, sf_dir).collect(), key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append(r["vec_id"])
    expected = brute(ids, x, [int(i) for i in ids if i % 50 == 0], 5)
    assert set(found) == set(expected)
    assert np.mean([len(set(found[q]) & set(own)) / len(own) for q, own in expected.items()]) >= 0.9


def test_neighbours_of_odd_vectors(spark: SparkSession) -> None:
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 2.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (50, [0.0, 1.0]), (None, [1.0, 0.0])]
    vectors = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, block int")
    found = nearest(vectors, vectors.where("vec_id % 50 = 0"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in found.collect())
    half = round(2**-0.5, 6)
    assert got == [(0, 1, 1, half), (0, 2, 2, half), (0, 3, 50, 0.0), (50, 1, 1, half), (50, 2, 2, half), (50, 3, 0, 0.0)]
    assert nearest(vectors.where("false"), vectors).count() == 0
    assert nearest(vectors, vectors.where("false")).count() == 0


def test_probing_finds_every_code_within_the_radius() -> None:
    """Against all pairs of codes, at radii below and above those that every substring is probed at."""
    rng = np.random.default_rng(11)
    x = np.repeat(rng.normal(size=(40, 64)), 5, axis=0) + rng.normal(0, 0.6, (200, 64))
    index = ann.Index(ann.learn(x), np.arange(200), x)
    for radius in (0, 3, 7, 10, 29, 64):
        for q in range(0, 200, 20):
            apart = ann._BITS[index.own ^ index.own[q]].sum(axis=1)
            assert index.within(index.own[q], radius).tolist() == np.flatnonzero(apart <= radius).tolist()


def test_neighbours_among_many_copies(spark: SparkSession) -> None:
    """Of a large group of equal vectors the smallest ids are the neighbours, and rows of the query's own id never are."""
    rng = np.random.default_rng(12)
    other = rng.normal(size=(40, 8))
    rows = [(i, [1.0] * 8) for i in range(300)] + [(50, [1.0] * 8)] * 3 + [(1000 + i, v.tolist()) for i, v in enumerate(other)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for r in sorted(nearest(vectors, vectors.where("vec_id in (0, 50, 1000)")).collect(), key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append(r["vec_id"])
    assert found[0] == [1, 2, 3, 4, 5] and found[50] == [0, 1, 2, 3, 4] and len(found[1000]) == 5


def test_long_white_space_is_packed_and_encoded(spark: SparkSession) -> None:
    """Texts on which the regular expression of the faster encoder runs out of stack, and what it does on both sides of the switch."""
    from boxwise.llm.packing import LONG

    token = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [c * 2_000_000 for c in (" ", "\n", "\t")] + ["a <|endoftext|>b\n" * (LONG // 10), " " * LONG, " " * (LONG + 1), "é" * LONG + "x"]
    docs = spark.createDataFrame([(None if k == 1 else k % 3, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, piece int").repartition(7)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = pieces(docs, ranks, public_tokenizers.PATTERN).collect()
    expected = sorted(zlib.crc32(np.array([*token.encode(t, add_special_tokens=False).ids, 0], "<u4")[-2048:].tobytes()) for t in texts[3:])
    last: dict = {}
    for r in rows:
        last.setdefault(r["doc_id"], []).append(r)
    assert set(last) == {None, 0, 1, 2}
    assert set(expected) <= {r["ids_crc32"] for r in rows}
    trip = round_trip(docs, ranks).collect()
    assert sorted(r["decoded_sha256"] for r in trip) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in texts)
    assert pack(docs, ranks, public_tokenizers.PATTERN).agg({"length": "sum"}).first()[0] == sum(r["length"] for r in rows)


def test_a_step_of_training_takes_all_classes_at_once(monkeypatch: pytest.MonkeyPatch) -> None:
    """One softmax for the classes and one for all members; sums by token and logits of a wide range are those of a plain loop."""
    rng = np.random.default_rng(3)
    around, token = rng.integers(0, lm_score.VOCABULARY, (500, 2 * lm_score.WINDOW)), rng.integers(0, lm_score.VOCABULARY, 500)
    network = lm_score.Network.start(np.ones(lm_score.VOCABULARY))
    calls, plain = [], lm_score.Network._softmax
    monkeypatch.setattr(lm_score.Network, "_softmax", staticmethod(lambda x: calls.append(len(x)) or plain(x)))
    network.learn(around, token, 0.5)
    assert calls == [500, 500]
    for wide in (1.0, 300.0):
        x = (rng.normal(0, wide, (50, lm_score.CLASSES))).astype(np.float32)
        e = np.exp(x.astype(float) - x.max(axis=1, keepdims=True))
        assert plain(x) == pytest.approx(e / e.sum(axis=1, keepdims=True), abs=1e-6)
        column = rng.integers(0, lm_score.CLASSES, 50)
        exact = np.log((e / e.sum(axis=1, keepdims=True))[np.arange(50), column].clip(1e-300))
        assert np.where(exact > -600, lm_score.Network._log_softmax_at(x, column) - exact, 0) == pytest.approx(0, abs=1e-3)
