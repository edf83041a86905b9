"""Collocations: phrases of two and three words that stand together more often than their parts lead one to expect.

Counting is done by a burstable trie of word numbers. Every word starts one path, the word and the two after it in its piece (0 beyond its end);
a path lies in a hash container, and a container that grows too large bursts: words with many paths get a container of their own, others are
dealt to two, and a container of one word bursts into children by the second word, no deeper. A task that holds too many paths spills
its largest subtrees as sorted runs, one for each prefix partition (a hash of the first word and a few bits of the second, so that a very frequent
word is dealt out). Runs carry hashes of words with a dictionary of their own, compressed. Spark brings the runs of a prefix partition
together, where they are merged: a path's count is the trigram's, and a bigram's is the sum below it. Hashes have 64 bits and are checked: the
vocabulary is counted by its words first, and where two words of a language would share a hash, another seed is taken.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.llm.common import mixed, parts_for, runs, utf8
from fieldbook.operators.skew import hot_keys, spread_join
from fieldbook.session import ship, written

#: Bits of a word's number in a path; a task's vocabulary starts anew long before they are used up.
BITS = 21
#: Paths of a container before it bursts, paths of a task before it spills, words of a task's vocabulary before it starts anew.
CONTAINER, PATHS, VOCABULARY = 8_192, 1_500_000, 700_000
#: Containers that a trie starts with, children of a word whose container bursts, parts that the second word deals a first word to.
FIRST, CHILDREN, FINE = 16, 16, 64
#: Words that are counted at a time.
WORDS_AT_ONCE = 200_000
#: Bytes of input for each prefix partition.
PART_BYTES = 6_000_000

_MARKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"\n" * 10)
_END = b"\xff"  # no byte of UTF-8 text; ends a piece
_LOW = (1 << BITS) - 1
_RUNS = "lang string, part int, known binary, run binary"
_FOUND = "lang string, h1 bigint, h2 bigint, h3 bigint, a bigint"


def pieces(text: bytes) -> list[bytes]:
    """The lower-cased words of a text, with a mark at the end of every piece."""
    return text.lower().translate(_MARKS).replace(b"\n", b" \xff ").split()


class _Words(dict):
    """Numbers words from 1 on, and keeps their hashes."""

    def __init__(self, seed: int) -> None:
        super().__init__({_END: 0})
        self.seed = seed
        self.hashes = [0]

    def __missing__(self, word: bytes) -> int:
        got = self[word] = len(self)
        self.hashes.append(xxhash.xxh3_64_intdigest(word, self.seed) or 1)
        return got


class PhraseTrie:
    """Counts of the paths of one language, in containers that burst."""

    def __init__(self, seed: int = 0) -> None:
        self.seed = seed
        self.start()

    def start(self) -> None:
        self.words = _Words(self.seed)
        self.containers: list[Counter] = [Counter() for _ in range(FIRST)]
        self.single: list[bool] = [False] * FIRST  # containers of one first word, which burst by the second
        self.route = np.zeros(1, np.int32)  # container of each first word, or the first of its CHILDREN
        self.deep = np.zeros(1, bool)
        self.size = 0

    def add(self, stream: list[bytes], after: list[bytes]) -> None:
        """Counts the paths that start in a stream of words and marks; after: the two words behind it, if there are any."""
        ids = np.zeros(len(stream) + 2, np.int64)
        ids[: len(stream) + len(after)] = np.fromiter(map(self.words.__getitem__, [*stream, *after]), np.int64, len(stream) + len(after))
        n = len(self.words)
        if n > len(self.route):
            fresh = np.arange(len(self.route), n)
            self.route = np.concatenate([self.route, (fresh % FIRST).astype(np.int32)])
            self.deep = np.concatenate([self.deep, np.zeros(len(fresh), bool)])
        first, second, third = ids[:-2], ids[1:-1], np.where(ids[1:-1] == 0, 0, ids[2:])
        own = first > 0
        first, second, third = first[own], second[own], third[own]
        box = self.route[first] + np.where(self.deep[first], second % CHILDREN, 0)
        order = np.argsort(box, kind="stable")
        box, paths = box[order], (first << 2 * BITS | second << BITS | third)[order]
        cuts = np.append(runs(box), len(box)).tolist()
        for a, b in zip(cuts, cuts[1:], strict=False):
            k = int(box[a])
            held = self.containers[k]
            before = len(held)
            held.update(paths[a:b].tolist())
            self.size += len(held) - before
            if len(held) > CONTAINER:
                self._burst(k)

    def _burst(self, k: int) -> None:
        """Deals a container out: by first words into two, the largest one alone if it holds half; a word's own by its second words, once."""
        if self.single[k]:
            return
        paths, times = _entries(self.containers[k])
        first = paths >> 2 * BITS
        names, inverse, sizes = np.unique(first, return_inverse=True, return_counts=True)
        if len(names) == 1:
            child = (paths >> BITS & _LOW) % CHILDREN
            base = len(self.containers)
            self.containers += [Counter(dict(zip(paths[child == c].tolist(), times[child == c].tolist(), strict=True))) for c in range(CHILDREN)]
            self.single += [True] * CHILDREN
            self.route[names], self.deep[names] = base, True
            self.containers[k] = Counter()
            return
        by_size = np.argsort(-sizes, kind="stable")
        leaves = np.zeros(len(names), bool)
        leaves[by_size[:1] if 2 * sizes[by_size[0]] >= len(paths) else by_size[::2]] = True
        moved = leaves[inverse]
        self.containers.append(Counter(dict(zip(paths[moved].tolist(), times[moved].tolist(), strict=True))))
        self.single.append(False)
        self.containers[k] = Counter(dict(zip(paths[~moved].tolist(), times[~moved].tolist(), strict=True)))
        self.route[names[leaves]] = len(self.containers) - 1

    def spill(self, parts: int, keep: float = 0.5) -> Iterator[tuple[int, bytes, bytes]]:
        """(part, dictionary, sorted run) of the largest subtrees, until no more than a share `keep` of the paths is left."""
        paths, times, left = [], [], self.size
        for k in sorted(range(len(self.containers)), key=lambda k: -len(self.containers[k])):
            if left <= keep * self.size or not self.containers[k]:
                break
            x, n = _entries(self.containers[k])
            paths.append(x)
            times.append(n)
            left -= len(x)
            self.containers[k] = Counter()
        self.size = left
        if paths:
            yield from _sorted_runs(np.concatenate(paths), np.concatenate(times), np.array(self.words.hashes, np.uint64), parts)


def _entries(held: Counter) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(held.keys(), np.int64, len(held)), np.fromiter(held.values(), np.int64, len(held))


def _packed(*columns: np.ndarray) -> bytes:
    """Columns by planes of bytes (all first bytes, all second ones, ...), which compress better."""
    data = b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(held: bytes, *kinds: type) -> list[np.ndarray]:
    """The columns again, which are equally long."""
    data = np.frombuffer(pa.decompress(held[8:], int.from_bytes(held[:8], "little"), codec="zstd", asbytes=True), np.uint8)
    widths = [np.dtype(k).itemsize for k in kinds]
    n = len(data) // sum(widths)
    ends = np.cumsum([0, *widths]) * n
    return [np.ascontiguousarray(data[a:b].reshape(w, n).T).view(k)[:, 0] for a, b, w, k in zip(ends.tolist(), ends[1:].tolist(), widths, kinds, strict=False)]


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def _sorted_runs(paths: np.ndarray, times: np.ndarray, hashes: np.ndarray, parts: int) -> Iterator[tuple[int, bytes, bytes]]:
    by_hash = np.argsort(hashes)
    place = np.empty(len(hashes), np.int64)
    place[by_hash] = np.arange(len(hashes))
    hashes = hashes[by_hash]
    first, second, third = (place[paths >> s & _LOW] for s in (2 * BITS, BITS, 0))  # 0 keeps its place: no hash is smaller
    order = np.argsort(first << 2 * BITS | second << BITS | third)
    first, second, third, times = first[order], second[order], third[order], times[order]
    part = (mixed(hashes[first] + (hashes[second] % np.uint64(FINE))) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part = part[order]
    for a, b in zip((cuts := np.append(runs(part), len(part)).tolist()), cuts[1:], strict=False):
        own = order[a:b]
        known, x = np.unique(np.concatenate([[0], first[own], second[own], third[own]]), return_inverse=True)
        n, x = b - a, x[1:].astype(np.uint32)
        yield int(part[a]), _packed(_steps(hashes[known])), _packed(_steps(x[:n]), x[n : 2 * n], x[2 * n :], times[own])


def _by_lang(batch: pa.RecordBatch) -> dict[str, list[bytes]]:
    found: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
        found.setdefault(lang, []).append(text or b"")
    return found


def _count_words(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of a task, a vocabulary at a time."""
    held: dict[str, Counter] = {}

    def told(lang: str) -> pa.RecordBatch:
        own = held.pop(lang)
        own.pop(_END, None)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own.keys(), pa.binary()).cast(pa.string()), pa.array(own.values(), pa.int64())], ["lang", "word", "n"])

    for batch in source:
        for lang, texts in _by_lang(batch).items():
            for text in texts:
                held.setdefault(lang, Counter()).update(pieces(text))
            if len(held[lang]) > VOCABULARY:
                yield told(lang)
    for lang in list(held):
        yield told(lang)


def _hashed(seed: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            h = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) or 1 for w in utf8(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(h.view(np.int64))], ["lang", "word", "n", "h"])

    return run


def _count(seed: int, parts: int):
    schema = pa.schema([("lang", pa.string()), ("part", pa.int32()), ("known", pa.binary()), ("run", pa.binary())])

    def told(lang: str, spilled: Iterator[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        held = list(spilled)
        if held:
            columns = [pa.array([lang] * len(held)), *(pa.array(c) for c in zip(*held, strict=True))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, PhraseTrie] = {}
        for batch in source:
            for lang, texts in _by_lang(batch).items():
                trie = tries.setdefault(lang, PhraseTrie(seed))
                for stream, after in _streams(texts):
                    trie.add(stream, after)
                    if len(trie.words) > VOCABULARY:
                        yield from told(lang, trie.spill(parts, 0))
                        trie.start()
                    while (total := sum(t.size for t in tries.values())) > PATHS:
                        large = max(tries, key=lambda x: tries[x].size)
                        yield from told(large, tries[large].spill(parts, max(0.0, 1 - total / 2 / tries[large].size)))
        for lang, trie in tries.items():
            yield from told(lang, trie.spill(parts, 0))

    return run


def _streams(texts: list[bytes]) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """Slices of WORDS_AT_ONCE words and marks at most, each with the two words behind it."""
    held: list[bytes] = []
    for i, text in enumerate(texts):
        held += pieces(text)
        held.append(_END)
        if len(held) > WORDS_AT_ONCE or i == len(texts) - 1:
            for a in range(0, len(held), WORDS_AT_ONCE):
                b = a + WORDS_AT_ONCE
                yield held[a:b], held[b : b + 2]
            held = []


def _merge(least: int):
    schema = pa.schema([("lang", pa.string()), ("h1", pa.int64()), ("h2", pa.int64()), ("h3", pa.int64()), ("a", pa.int64())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        known = [np.cumsum(_unpacked(x, np.uint64)[0]) for x in table["known"].to_pylist()]
        every = np.unique(np.concatenate([*known, np.zeros(1, np.uint64)]))
        prefix, third, times = [], [], []
        for own, x in zip(known, table["run"].to_pylist(), strict=True):
            place = np.searchsorted(every, own)
            first, second, last, n = _unpacked(x, np.uint32, np.uint32, np.uint32, np.int64)
            prefix.append(place[np.cumsum(first, dtype=np.uint32)] * len(every) + place[second])
            third.append(place[last])
            times.append(n)
        prefix, third, times = (np.concatenate(x) for x in (prefix, third, times))
        del known, table
        order = np.argsort(prefix, kind="stable")
        prefix, third, times = prefix[order], third[order], times[order]
        cuts = runs(prefix)
        pair = np.add.reduceat(times, cuts)
        # Paths below a pair that is too rare are too rare themselves.
        often = np.flatnonzero((pair >= least) & (prefix[cuts] % len(every) > 0))
        inside = np.repeat(pair >= least, np.diff(np.append(cuts, len(prefix))))
        number = np.repeat(np.arange(len(cuts)), np.diff(np.append(cuts, len(prefix))))[inside]
        path, below = number * len(every) + third[inside], times[inside]
        order = np.argsort(path, kind="stable")
        path, below = path[order], below[order]
        ends = runs(path)
        total = np.add.reduceat(below, ends) if len(ends) else below
        path = path[ends]
        full = (total >= least) & (path % len(every) > 0)
        path, total = path[full], total[full]
        signed = every.view(np.int64)
        head = np.concatenate([prefix[cuts][often], prefix[cuts][path // len(every)]])
        h3 = np.concatenate([np.zeros(len(often), np.int64), signed[path % len(every)]])
        n = len(head)
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * n, pa.string()), pa.array(signed[head // len(every)]), pa.array(signed[head % len(every)]), pa.array(h3), pa.array(np.concatenate([pair[often], total]))], schema=schema)

    return run


def counted(docs: DataFrame, lang_col: str, text_col: str, least: int, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((lang, word, h, n) of every word, (lang, h1, h2, h3, a) of every phrase of two (h3 = 0) or three words with a >= least), both written."""
    spark = docs.sparkSession
    ship(spark)
    parts = parts or parts_for(docs, PART_BYTES)
    own = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    words = own.mapInArrow(_count_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    for seed in range(8):
        words = written(words.select("lang", "word", "n").mapInArrow(_hashed(seed), "lang string, word string, n bigint, h bigint"))
        if words.groupBy("lang", "h").agg(F.count("*").alias("k")).where("k > 1").isEmpty():
            break
    else:
        raise RuntimeError("words share hashes under every seed")
    merged = own.mapInArrow(_count(seed, parts), _RUNS).groupBy("lang", "part").applyInArrow(_merge(least), _FOUND)
    return words, written(merged)


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 10, share: int = 50, top: int = 2000, parts: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases of greatest a * a / (l * r), in millionths, at most `top`.

    Phrases of two or three words of one piece that occur `least` times (2 at least); a, l, r: occurrences of the phrase and of the two parts of its
    lowest-scoring cut (ties: the first); n: all words of the language. A pair that lies within a phrase of three with `share` per cent
    of its occurrences or more is left out. Equal scores go by a, then by the phrase's bytes. A null language counts as "und"; null and empty texts
    hold no words; repeated rows count again; an empty table gives an empty result; texts are counted whole, however long; other columns
    don't matter. parts: prefix partitions (default: one for each PART_BYTES of input).
    """
    if least < 2:
        raise ValueError("phrases that occur once are not told apart from chance")
    words, phrases = counted(docs, lang_col, text_col, least, parts)
    often = words.where(F.col("n") >= least)
    pairs = phrases.where("h3 = 0").select("lang", "h1", "h2", "a")
    triples = phrases.where("h3 <> 0")
    two = _met(pairs, often, {"lang": "lang", "h1": "h"}, {"l": "n"})
    two = written(_met(two, often, {"lang": "lang", "h2": "h"}, {"r": "n"}))
    three = _met(triples, two, {"lang": "lang", "h1": "h1", "h2": "h2"}, {"l1": "l", "l2": "a"})
    three = _met(three, two, {"lang": "lang", "h2": "h1", "h3": "h2"}, {"r1": "a", "r2": "r"})
    three = three.withColumns({"s1": _score("a", "l1", "r1"), "s2": _score("a", "l2", "r2")})
    one = F.col("s1") <= F.col("s2")
    three = three.select("lang", "h1", "h2", "h3", "a", F.when(one, F.col("l1")).otherwise(F.col("l2")).alias("l"), F.when(one, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    within = triples.select("lang", "a", F.explode(F.array(F.struct("h1", "h2"), F.struct(F.col("h2").alias("h1"), F.col("h3").alias("h2")))).alias("p")).groupBy("lang", "p.h1", "p.h2").agg(F.max("a").alias("inside"))
    two = two.join(within, ["lang", "h1", "h2"], "left").where(F.coalesce(100 * F.col("inside") < share * F.col("a"), F.lit(True)))
    two = two.select("lang", "h1", "h2", F.lit(0).cast("bigint").alias("h3"), "a", "l", "r", _score("a", "l", "r").alias("score"))
    # All that tie with the last place stay until words are known; a window with a limit sends no more than that from each task.
    first = two.unionByName(three).withColumn("_r", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("_r") <= top).drop("_r")
    named = written(first)
    for k in (1, 2, 3):
        names = words.select("lang", F.col("h").alias(f"h{k}"), F.col("word").alias(f"w{k}"))
        named = named.join(names, ["lang", f"h{k}"], "left" if k == 3 else "inner")
    named = named.withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    ranked = named.withColumn("rank", place.cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select(F.col("lang").alias(lang_col), "rank", "phrase", "a", "l", "r", "n", "score")


def _met(df: DataFrame, facts: DataFrame, on: dict[str, str], values: dict[str, str]) -> DataFrame:
    """df with values of the facts (new name: theirs) whose columns equal its own (own name: theirs); keys of very many rows meet their facts by a broadcast."""
    keyed = df.withColumn("_k", F.xxhash64(*on))
    known = facts.select(F.xxhash64(*on.values()).alias("_k"), *(F.col(v).alias(f"_{k}") for k, v in on.items()), *(F.col(v).alias(k) for k, v in values.items()))
    got = spread_join(keyed, known, "_k", hot_keys(keyed, "_k"))
    for k in on:
        got = got.where(F.col(k) == F.col(f"_{k}"))
    return got.select(*df.columns, *values)


def _score(a: str, left: str, right: str):
    """floor(1000000 a a / (l r)), in decimals, since the products may pass 64 bits."""
    wide = lambda c: f"cast({c} as decimal(15, 0))"
    return F.expr(f"(cast(1000000 as decimal(7, 0)) * ({wide(a)} * {wide(a)})) div ({wide(left)} * {wide(right)})")
