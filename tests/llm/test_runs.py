"""Periodic runs against a brute-force version."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from fieldbook.llm import runs as R


def brute(words):
    """(start, length, period) of every run, by looking at every period and place."""
    n, found = len(words), set()
    for q in range(1, n // 4 + 1):
        same = [words[i] == words[i + q] for i in range(n - q)]
        i = 0
        while i < n - q:
            j = i
            while j < n - q and same[j]:
                j += 1
            length = j - i + q
            own = words[i : i + length]
            if j > i and length >= max(6, 4 * q) and not any(all(own[k] == own[k + p] for k in range(length - p)) for p in range(1, q)):
                found.add((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    """The contract's row, written from its words."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    h = zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs)]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *tail, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(kept)))


def repeats(rng, n, kinds):
    words = []
    while len(words) < n:
        words += [f"w{rng.randrange(kinds)}" for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 7)
    return words[:n]


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(150):
        docs = [repeats(rng, rng.randrange(0, 90), rng.choice([1, 2, 3, 5, 30])) for _ in range(rng.randrange(1, 6))]
        numbers = {w: i for i, w in enumerate(sorted({w for d in docs for w in d}))}
        lengths = np.array([len(d) for d in docs])
        if not lengths.sum():
            continue
        text, *run = R.find_runs(np.array([numbers[w] for d in docs for w in d]), np.cumsum(lengths) - lengths, lengths)
        got = list(zip(text.tolist(), *(c.tolist() for c in run), strict=True))
        assert got == [(k, *r) for k, d in enumerate(docs) for r in brute(d)]


def test_ranges_of_a_wavelet_tree():
    rng = np.random.default_rng(5)
    values = rng.permutation(300).astype(np.int32)
    tree = R.WaveletTree(values)
    low = rng.integers(0, 300, 200)
    high = np.array([rng.integers(a + 1, 301) for a in low])
    x = rng.integers(0, 512, 200)
    assert tree.smaller(low, high, np.minimum(x, 299)).tolist() == [int((values[a:b] < min(c, 299)).sum()) for a, b, c in zip(low, high, x, strict=True)]
    k = np.array([rng.integers(0, b - a) for a, b in zip(low, high, strict=True)])
    assert tree.smallest(low, high, k).tolist() == [int(np.sort(values[a:b])[c]) for a, b, c in zip(low, high, k, strict=True)]


def test_query_against_brute_force(spark, docs, texts):
    rng = random.Random(9)
    more = [(1000 + i, " ".join(repeats(rng, rng.randrange(0, 120), rng.choice([2, 4, 20])))) for i in range(120)]
    more += [(2000, " ".join(["x"] * 400)), (2001, " ".join(["a", "b"] * 3)), (2002, "a a a a a"), (2003, "a\ta\na\x0ba\x0ca\ra")]
    frame = docs.select("doc_id", "text", "score").unionByName(spark.createDataFrame(more, "doc_id bigint, text string").selectExpr("doc_id", "text", "'s' as score"))
    got = {r[0]: tuple(r)[1:] for r in R.run_digests(frame).collect()}
    for i, t in [*texts, *more]:
        if len((t or "").split()) < 1000:
            assert got[i] == expected(i, t), i


def test_a_long_text_and_an_empty_table(spark, none):
    assert R.run_digests(none).count() == 0
    long = "lead " + "a b c " * 100_000 + "x" * 1_000_000
    frame = spark.createDataFrame([(None, long), (None, None), (None, long)], "doc_id bigint, text string")
    got = R.periodic_runs(frame, rewrite=R.planted).collect()
    full = [r for r in got if r["runs"]]
    assert len(got) == 3 and len(full) == 2 and full[0] == full[1]
    assert [tuple(r) for r in full[0]["runs"]] == [(1, 300_000, 3)] and full[0]["collapsed"].startswith("lead a b c xxx")


def test_shorter_runs_are_refused():
    with pytest.raises(ValueError):
        R.find_runs(np.zeros(8, np.int64), np.zeros(1, np.int64), np.array([8]), exponent=3)
