"""The lattice model against all segmentations written out, and the query against plain counts."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from fieldbook.llm import lattice as L

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return L.Pieces(PATH)


def segmentations(pieces, text):
    """Every way to spell a text: lists of lists of piece ids, one list for each edge."""
    if not text:
        yield []
        return
    for j in range(1, len(text) + 1):
        heads = [[pieces.prefixes[text[:j]]]] if pieces.prefixes.get(text[:j], -1) >= 0 else []
        if j == 1:
            heads.append([int(pieces.bytes[b]) for b in text[0].encode()])
        for head in heads:
            for rest in segmentations(pieces, text[j:]):
                yield [head, *rest]


WORDS = ["the", "natio", "été", "漢x", "zq7!", "a", "▁", "\x00b", "ing's"]


def test_sums_and_expectations_equal_all_segmentations(pieces):
    logs = pieces.first()
    times = np.arange(1.0, len(WORDS) + 1)
    got = L.word_logs(pieces, WORDS, logs)
    expected = np.zeros(pieces.size)
    for k, w in enumerate(WORDS):
        ways = [[p for edge in way for p in edge] for way in segmentations(pieces, L.START + w)]
        weights = np.array([math.exp(sum(logs[p] for p in way)) for way in ways])
        assert got[k] == pytest.approx(math.log(weights.sum()), rel=1e-9)
        for way, share in zip(ways, weights / weights.sum(), strict=True):
            for p in way:
                expected[p] += share * times[k]
    assert np.allclose(L.Lattices(pieces, WORDS).expected(logs, times), expected)


def test_probabilities_add_up(pieces):
    for logs in (pieces.first(), pieces.logs(np.arange(pieces.size, dtype=float))):
        assert np.exp(logs).sum() == pytest.approx(1) and np.isneginf(logs[~pieces.usable]).all() and np.isfinite(logs[pieces.usable]).all()


def test_fitting_raises_the_likelihood(spark, pieces):
    rows = [("retition", 40), ("thoun", 25), ("elle", 30), ("mentre", 9), ("où", 3), ("x" * 50, 1)]
    frame = spark.createDataFrame(rows, "word string, c bigint").repartition(2)
    before = -math.inf
    for rounds in range(4):
        logs = L.fit(frame, PATH, 10, rounds)
        now = float(sum(c * s for (_, c), s in zip(rows, L.word_logs(pieces, [w for w, _ in rows], logs), strict=True)) + 10 * logs[pieces.end])
        assert now > before - 0.5  # smoothing may cost a little
        before = now
    assert before > float(sum(c * s for (_, c), s in zip(rows, L.word_logs(pieces, [w for w, _ in rows], pieces.first()), strict=True)))


def test_query_against_plain_counts(spark, docs, texts, pieces):
    rows = [*texts, (3000, "É É é A a"), (3000, "again"), (None, "null id"), (3001, "long " * 20_000 + "y" * 200_000)]
    frame = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id bigint, text string, score string, word bigint").repartition(3)
    got = Counter()
    for r in L.lm_scores(frame, PATH, rounds=1).collect():
        got[(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4))] += 1
    tokens = lambda t: [w.lower() for w in (t or "").encode().split()] + [None]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    assert got == Counter((i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 4)) for i, t in rows)


def test_scores_of_texts_are_sums_of_words(spark, pieces):
    rows = [(i, t) for i, t in enumerate(["The été", None, "", "the  THE\tx", "unseen-words only"])]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in L.lm_scores(frame, PATH).collect()}
    train = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    times = Counter(w.decode() for _, t in train for w in (t or "").encode().lower().split())
    logs = L.fit(spark.createDataFrame(list(times.items()), "word string, c bigint"), PATH, len(train), 2)
    for i, t in rows:
        words = [w.decode() for w in (t or "").encode().lower().split()]
        expected = (float(L.word_logs(pieces, words, logs).sum()) + logs[pieces.end]) / math.log(10)
        assert got[i]["score"] == pytest.approx(expected, rel=1e-9) and got[i]["score"] < 0


def test_without_training_texts_and_without_rows(spark, none):
    assert L.lm_scores(none, PATH).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = L.lm_scores(spark.createDataFrame([(held, "a b")], "doc_id bigint, text string"), PATH).first()
    assert (got["train_tokens"], got["n_known"], got["n_tokens"], got["base_score"]) == (0, 0, 3, 0.0) and got["score"] < 0
