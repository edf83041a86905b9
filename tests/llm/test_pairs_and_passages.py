import random
import re

from fieldbook.llm.jaccard import jaccard_join
from fieldbook.llm.substring import substring_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def components(texts, percent=75):
    sets = []
    for i, t in texts:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            both = len(x & y)
            if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return sorted((i, len(x), find(i)) for i, x in sets)


def test_jaccard_equals_brute_force(docs, texts):
    want = components(texts)
    assert sum(c != i for i, _, c in want) > 20
    for block_rows in (256, 4):
        assert sorted(map(tuple, jaccard_join(docs, block_rows=block_rows).collect())) == want


def chained(n, seed):
    """Near copies of near copies, and texts that share a passage and nothing else: groups that no single hub holds together."""
    rng = random.Random(seed)
    say = lambda k: [f"v{rng.randrange(3000)}" for _ in range(k)]
    passage, last, out = say(12), say(60), []
    for i in range(n):
        if i % 3 == 0:
            out.append(say(rng.randrange(4, 9)) + passage)
        else:
            last = list(last) if i % 40 else say(60)
            last[rng.randrange(60)] = f"z{i}"
            out.append(last)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def test_open_shingles_are_settled_by_pairs_and_blocks(spark, monkeypatch):
    from fieldbook.llm import jaccard

    texts = chained(240, 5)
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    for percent, turns, rare, block_rows in ((75, 2, 4, 256), (75, 1, 0, 4), (50, 0, 0, 8), (50, 0, 10**6, 4)):
        want = components(texts, percent)
        assert 20 < len({c for _, _, c in want}) < 200
        monkeypatch.setattr(jaccard, "HUB_TURNS", turns)
        monkeypatch.setattr(jaccard, "RARE", rare)
        got = sorted(map(tuple, jaccard_join(df, percent=percent, block_rows=block_rows).collect()))
        assert got == want, (percent, turns, rare, block_rows)


def test_frequent_shingles_in_small_flushes(texts, monkeypatch):
    """Column and row blocks by hand, with flushes so small that some call a shingle frequent and others don't."""
    import numpy as np
    import pyarrow as pa

    from fieldbook.llm import jaccard

    for flush, least in ((2000, 3), (500, 2), (10**9, 4)):
        monkeypatch.setattr(jaccard, "FLUSH", flush)
        monkeypatch.setattr(jaccard, "FREQUENT_SETS", least)
        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in texts]), pa.array([t for _, t in texts], pa.string())], ["id", "text"])
        blocks = pa.Table.from_batches(list(jaccard._blocks([5], 5)(iter([batch]))))
        counted = jaccard._count([5])(blocks)
        freqs = np.concatenate([np.frombuffer(x, np.uint32) for x in counted.column("freqs").to_pylist() if x is not None])
        assert (freqs == jaccard._FREQUENT).any()
        sets = [x for x in jaccard._sets(75)(counted).to_pylist() if x["ids"] is None]
        assert len({x["sig"] for x in sets}) == len(sets)
        assert all(len(x["grams"]) == 8 * len(np.unique(np.frombuffer(x["grams"], np.uint64))) for x in sets)
        grams = {x["sig"]: np.frombuffer(x["grams"], np.uint64) for x in sets}
        heads = {x["sig"]: set(np.frombuffer(x["grams"], np.uint64)[: x["n_prefix"]].tolist()) for x in sets}
        size = {x["sig"]: x["size"] for x in sets}
        own = {}
        hashes = jaccard.WordHashes()
        for _, t in texts:
            g = jaccard.shingles(t.encode() if t else None, hashes, 5)
            if len(g):
                own[int(jaccard.mixed(g ^ np.uint64(jaccard.BASE)).sum().astype(np.int64))] = set(g.tolist())
        for a in own:
            for b in own:
                both = len(own[a] & own[b])
                if a < b and 100 * both >= 75 * (len(own[a]) + len(own[b]) - both):
                    assert heads[a] & heads[b] and len(np.intersect1d(grams[a], grams[b])) == both and size[a] == len(own[a])


def test_entries_stay_small_in_many_blocks():
    """Most of what is shuffled: bytes for each shingle of a set, however many blocks there are."""
    import pyarrow as pa

    from fieldbook.llm import jaccard

    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(2000)}" for _ in range(500)) for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(texts)], ["id", "text"])
    for partitions, most in ((8, 7), (3000, 12)):
        rows = [x for b in jaccard._blocks(list(range(partitions)), 5)(iter([batch])) for x in b.to_pylist()]
        entries = sum(len(x["hi"]) // 2 for x in rows if x["hi"])
        assert entries == 40 * 496
        assert sum(len(v) for x in rows for v in x.values() if isinstance(v, bytes)) < most * entries


def test_one_posting_for_equal_lists(spark, monkeypatch):
    from fieldbook.llm import jaccard

    lists = {10: [1, 2], 11: [1, 2], 12: [1, 2, 3], 13: [2, 3], 14: [3], 15: [1, 2, 3], 16: [1, 4, 5, 9], 17: [1, 4, 6, 9]}
    postings = spark.createDataFrame([(g, s) for g, own in lists.items() for s in own], "gram bigint, sig bigint")
    want = sorted((g, s) for g in (10, 12, 13, 16, 17) for s in lists[g])
    for least in (1000, 1):  # with 1, the shingles of several sets count as frequent
        monkeypatch.setattr(jaccard, "LEAST_HOT", least)
        assert sorted(map(tuple, jaccard._telling(postings).collect())) == want


def test_jaccard_edges(spark, none):
    assert jaccard_join(none).collect() == []
    df = spark.createDataFrame([(None, "a b"), (7, "A  B"), (7, "A  B"), (9, None)], "doc_id bigint, text string")
    got = sorted(map(tuple, jaccard_join(df).collect()), key=str)
    assert got == sorted([(None, 1, 7), (7, 1, 7), (7, 1, 7), (9, 0, 9)], key=str)


def kept(texts, width):
    first = {}
    split = [(i, WORDS.findall(t or "")) for i, t in texts]
    for i, w in split:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def test_substring_dedup_equals_brute_force(docs, texts, monkeypatch):
    want = kept(texts, 50)
    assert sum(x[2] > 0 for x in want) > 20
    assert sorted(map(tuple, substring_dedup(docs).collect())) == want
    assert sorted(map(tuple, substring_dedup(docs, width=7).collect())) == kept(texts, 7)


def test_substring_dedup_in_small_flushes(texts):
    import pyarrow as pa

    from fieldbook.llm import substring

    held, substring.FLUSH = substring.FLUSH, 300
    try:
        batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in texts]), pa.array([i for i, _ in texts]), pa.array([t for _, t in texts], pa.string())], ["id", "mark", "text"])
        blocks = pa.Table.from_batches(list(substring._blocks([5], 50)(iter([batch]))))
        spans = substring._merged(50)(substring._judge([5])(blocks)).to_pylist()
    finally:
        substring.FLUSH = held
    import numpy as np

    removed = {x["id"]: int(np.diff(np.frombuffer(x["spans"], np.int64).reshape(-1, 2), axis=1).sum()) for x in spans}
    assert removed == {i: n for i, _, n, _ in kept(texts, 50) if n}


def test_substring_edges(spark, docs, none):
    assert substring_dedup(none).collect() == []
    long = " ".join(f"x{i}" for i in range(60))
    df = spark.createDataFrame([(None, long), (3, long), (3, long), (4, long)], "doc_id bigint, text string")
    got = sorted((tuple(r)[:3] for r in substring_dedup(df).collect()), key=str)
    assert got == sorted([(None, 60, 0), (3, 60, 0), (3, 60, 0), (4, 60, 60)], key=str)
    names = substring_dedup(docs, keep=["doc_id", "kept", "_text", "_spans"], whole=True).columns
    assert names == ["doc_id", "kept", "_text", "_spans", "n_words", "n_removed", "kept"]
