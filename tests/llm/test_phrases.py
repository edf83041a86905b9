"""Collocations against SQL and a brute-force count."""

import random
import re
from collections import Counter
from itertools import pairwise

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from fieldbook.llm import phrases as P
from fieldbook.llm.queries import OP12_SQL

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def counts(texts):
    found = Counter()
    for t in texts:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(str.maketrans(UPPER, LOWER))):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            found.update(tuple(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    return found


def brute(rows, least=10, share=50, top=2000):
    out = []
    for lang in {r[0] or "und" for r in rows}:
        f = counts([t for x, t in rows if (x or "und") == lang])
        n = sum(a for p, a in f.items() if len(p) == 1)
        ranked = []
        for p, a in f.items():
            if len(p) == 1 or a < least:
                continue
            if any(len(q) > len(p) and b >= least and 100 * b >= share * a and p in {q[i : i + len(p)] for i in range(len(q))} for q, b in f.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, i, p.decode(), -a, left, right, n, -s))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = ["the", "The", "of", "new", "york", "city", "été", "x", "ABC", "z\x1cz", "a\x00b"]
    say = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", " ; ", "\x0b"]) for _ in range(n))
    got = [(rng.choice(["en", "fr", None]), say(rng.randrange(0, 60))) for _ in range(160)]
    return got + [("en", None), (None, ""), ("de", " ., "), ("en", "new york city " * 40), ("en", "solo " * 3000)]


def test_query_equals_brute_force(spark, rows):
    frame = spark.createDataFrame(rows, "lang string, text string").selectExpr("lang", "text", "'q' as a", "'q' as word", "1 as h").repartition(3)
    for least, top in ((10, 2000), (3, 7)):
        got = P.collocations(frame, least=least, top=top, parts=5)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == brute(rows, least, top=top)


def test_nothing_in_gives_nothing(spark, rows):
    empty = spark.createDataFrame([], "lang string, text string")
    assert P.collocations(empty).count() == 0
    with pytest.raises(ValueError):
        P.collocations(empty, least=1)


def test_products_beyond_64_bits(spark):
    got = spark.createDataFrame([(3_000_000_000, 4_000_000_000, 5_000_000_001), (7, 7, 7)], "a bigint, l bigint, r bigint").select(P._score("a", "l", "r").alias("s")).collect()
    assert [r["s"] for r in got] == [1_000_000 * 3_000_000_000**2 // (4_000_000_000 * 5_000_000_001), 1_000_000]


def test_bursts_and_spills_lose_nothing(monkeypatch):
    monkeypatch.setattr(P, "CONTAINER", 12)
    rng = random.Random(8)
    words = [b"w%d" % int(rng.paretovariate(0.7)) for _ in range(6000)]
    stream = [P._END if rng.random() < 0.1 else w for w in words]
    trie, spilled = P.PhraseTrie(), []
    for a in range(0, len(stream), 500):
        trie.add(stream[a : a + 500], stream[a + 500 : a + 502])
        if a % 1500 == 0:
            before = trie.size
            spilled += trie.spill(3, 0.4)
            assert trie.size <= 0.4 * before + 1
    assert any(trie.deep) and len(trie.containers) > 3 * P.FIRST
    spilled += trie.spill(3, 0)
    names = dict(zip(trie.words.hashes, trie.words, strict=True))
    table = pa.table({"known": [k for _, k, _ in spilled], "run": [r for _, _, r in spilled]})
    found = Counter()
    for part in range(3):
        own = table.filter(pa.array([p == part for p, _, _ in spilled]))
        for _, *h, a in P._merge(2)((pa.scalar("en"), pa.scalar(part)), own).to_pandas().itertuples(index=False):
            found[tuple(names[int(np.int64(x).view(np.uint64))] for x in h if x)] += a
    text = b" ".join(stream).split(P._END)
    expected = Counter()
    for piece in text:
        w = piece.split()
        expected.update(zip(w, w[1:], strict=False))
        expected.update(zip(w, w[1:], w[2:], strict=False))
    assert found == {p: a for p, a in expected.items() if a >= 2}
    for p, _, r in spilled:  # runs are sorted
        first, second, third, _ = P._unpacked(r, np.uint32, np.uint32, np.uint32, np.int64)
        at = np.stack([np.cumsum(first, dtype=np.uint32), second, third], 1).tolist()
        assert p in range(3) and all(x < y for x, y in pairwise(at))


def test_query_equals_sql(spark, data):
    from fieldbook.llm.queries import QUERIES

    got = QUERIES["op12_phrase_collocations"](spark, data).toPandas()
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{data}/documents.parquet'")
    theirs = con.sql(OP12_SQL).df()
    assert len(got) and sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, theirs[list(got.columns)].values.tolist()))
