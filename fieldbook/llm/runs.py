"""Periodic runs: stretches of words that repeat themselves, found by internal pattern matching.

Words of a batch of texts are numbered, and prefix doubling sorts the suffixes of each text (its classes by the first 2, 4, 8, ... words are
the rows of a dictionary of basic factors). For every level B = 2, 4, 8, ... each aligned block of B words asks for its nearest occurrences
in the windows before and behind it: its class is a range of the suffix array, and a wavelet tree over that array answers the range
predecessor and successor. Occurrences of a block that overlap itself form a progression, whose difference d, B/2 <= d < B, is the
candidate period: a run of period q and length 4 q at least holds, for the B with B/2 <= q < B, an aligned block whose nearest
occurrence on one side lies exactly q away, since B > q. Longest common extensions, read off the dictionary, then
give the run's ends. All of it is exact: words are numbered by value, and nothing is told by hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.common import utf8
from fieldbook.session import ship

#: Words that are sorted together; a longer text is a batch of its own.
WORDS_AT_ONCE = 150_000
_RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class _Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        got = self[word] = len(self)
        return got


class WaveletTree:
    """Ranks and order statistics of ranges of an integer array, for many ranges at a time (bits by levels, zeros to the left)."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for b in range(int(values.max()).bit_length() - 1 if len(values) else -1, -1, -1):
            ones = (values >> b) & 1
            zeros = np.zeros(len(values) + 1, np.int32)
            np.cumsum(1 - ones, out=zeros[1:])
            mask = ones.astype(bool)
            values = np.concatenate([values[~mask], values[mask]])
            self.levels.append((b, zeros, int(zeros[-1])))

    def smaller(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many entries of [low, high) are below x."""
        found = np.zeros(len(x), np.int32)
        for b, zeros, n in self.levels:
            a, z = zeros[low], zeros[high]
            one = ((x >> b) & 1).astype(bool)
            found += np.where(one, z - a, 0)
            low, high = np.where(one, low - a + n, a), np.where(one, high - z + n, z)
        return found

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The entry of [low, high) that has k entries below it; k must lie in the range."""
        found = np.zeros(len(k), np.int32)
        for b, zeros, n in self.levels:
            a, z = zeros[low], zeros[high]
            one = k >= z - a
            k = np.where(one, k - (z - a), k)
            found += np.where(one, np.int32(1 << b), np.int32(0))
            low, high = np.where(one, low - a + n, a), np.where(one, high - z + n, z)
        return found


class _Factors:
    """Ranks of the factors of 1, 2, 4, ... words of each text, the suffix array, and the blocks that recur."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        n = len(words)
        self.n = n
        self.text = np.repeat(np.arange(len(starts), dtype=np.int32), lengths)
        self.first = np.repeat(starts, lengths).astype(np.int32)
        self.stop = np.repeat(starts + lengths, lengths).astype(np.int32)
        self.top = np.zeros(len(starts), np.int32)
        local = np.arange(n, dtype=np.int32) - self.first
        key = self.text.astype(np.int64) * (int(words.max()) + 1 if n else 1) + words
        order = np.argsort(key, kind="stable").astype(np.int32)
        rank = np.empty(n, np.int32)
        slots = np.arange(n, dtype=np.int32)
        at, size = _classes(key[order])
        rank[order] = slots[at]
        self.ranks, self.order = [rank], order
        self.blocks: list[tuple[np.ndarray, ...]] = []  # (position, first slot, slots, B)
        self.recurring = np.zeros(0, np.int32)
        open_ = (size > 1) & (lengths[self.text[order]] >= 4)
        slots, block = slots[open_], 1
        while len(slots):
            at_ = order[slots]
            behind = at_ + block
            second = np.where(behind < self.stop[at_], rank[np.minimum(behind, n - 1)] + 1, 0)
            key = rank[at_].astype(np.int64) * (n + 1) + second
            turn = np.argsort(key, kind="stable")
            at_ = at_[turn]
            order[slots] = at_
            at, size = _classes(key[turn])
            rank = rank.copy()
            rank[at_] = slots[at]
            block *= 2
            self.ranks.append(rank)
            self.top[self.text[at_]] = len(self.ranks) - 1
            many = size > 1
            if block == 2:
                self.recurring = slots[many]
            asks = many & (local[at_] % block == 0)
            self.blocks.append((at_[asks], rank[at_[asks]], size[asks], np.full(int(asks.sum()), block, np.int32)))
            slots = slots[many & (lengths[self.text[at_]] >= 4 * block)]

    def common(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words from i and from j > i on are equal, pair by pair; with back, how many before them."""
        found = np.zeros(len(i), np.int32)
        text = self.text[np.minimum(i, self.n - 1)]
        top, first, stop = self.top[text], self.first[np.minimum(i, self.n - 1)], self.stop[np.minimum(i, self.n - 1)]
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, step = self.ranks[k], 1 << k
            left = np.flatnonzero(top >= k)
            while len(left):
                a, b = (i[left] - found[left] - step, j[left] - found[left] - step) if back else (i[left] + found[left], j[left] + found[left])
                fits = a >= first[left] if back else b + step <= stop[left]
                left, a, b = left[fits], a[fits], b[fits]
                left = left[rank[a] == rank[b]]
                found[left] += step
        return found


def _classes(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of a sorted array the index of the first equal one, and how many are equal."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(begins, len(key)))
    return np.repeat(begins, sizes), np.repeat(sizes, sizes)


def find_runs(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, exponent: int = 4, least: int = 6) -> tuple[np.ndarray, ...]:
    """(text, start in the text, length, period) of every run, ordered by them in that order with the period before the length.

    words: numbers of the words of all texts, one after the other; a run is as long as `exponent` periods (4 at least) and `least` words (6 at least).
    """
    if exponent < 4 or least < 6:
        raise ValueError("runs of fewer than 4 periods or 6 words aren't looked for")
    f = _Factors(words, starts, lengths)
    if not f.blocks:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    x, low, size, block = (np.concatenate(c) for c in zip(*f.blocks, strict=True))
    # The tree holds the suffixes whose first two words recur, at their places in their texts.
    place = np.zeros(f.n + 1, np.int32)
    place[f.recurring + 1] = 1
    np.cumsum(place, out=place)
    at = f.order[f.recurring]
    tree = WaveletTree(at - f.first[at])
    high, low = place[low + size], place[low]
    own = x - f.first[x]
    below = tree.smaller(low, high, own)
    found = []
    for step, usable in ((1, below + 1 < high - low), (-1, below > 0)):
        q = np.flatnonzero(usable)
        other = tree.smallest(low[q], high[q], below[q] + step)
        d = step * (other - own[q])
        near = (d < block[q]) & (2 * d >= block[q])
        q, d = q[near], d[near]
        found.append((np.minimum(x[q], x[q] + step * d), d))
    i, d = (np.concatenate(c) for c in zip(*found, strict=True))
    j = i + d
    begin = i - f.common(i, j, back=True)
    length = j + f.common(i, j) - begin
    long = (length >= least) & (length >= exponent * d)
    begin, length, d = begin[long], length[long], d[long]
    order = np.lexsort((d, begin))
    begin, length, d = begin[order], length[order], d[order]
    new = np.ones(len(begin), bool)
    new[1:] = (begin[1:] != begin[:-1]) | (d[1:] != d[:-1])
    begin, length, d = begin[new], length[new], d[new]
    return f.text[begin], begin - f.first[begin], length, d


def planted(key: str | None, words: list[bytes]) -> list[bytes]:
    """The words of a text as the query takes them: a tenth of the ids, told by crc32, repeat a stretch to the end of the text. A null id changes nothing."""
    if key is None or not words:
        return words
    h = zlib.crc32(key.encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def _described(texts: list[list[bytes]], exponent: int, least: int) -> tuple[list[list[dict]], list[bytes]]:
    numbers = _Numbers()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    words = np.concatenate([np.fromiter(map(numbers.__getitem__, t), np.int64, len(t)) for t in texts])
    starts = np.cumsum(lengths) - lengths
    text, start, length, period = find_runs(words, starts, lengths, exponent, least)
    edge = np.zeros(len(words) + 1, np.int32)
    np.add.at(edge, starts[text] + start + period, 1)
    np.add.at(edge, starts[text] + start + length, -1)
    kept = np.cumsum(edge)[:-1] == 0
    runs: list[list[dict]] = [[] for _ in texts]
    for t, s, n, p in zip(text.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
        runs[t].append({"start": s, "length": n, "period": p})
    out = [b" ".join(compress(t, kept[a : a + len(t)]) if own else t) for t, own, a in zip(texts, runs, starts.tolist(), strict=True)]
    return runs, out


def _best(runs: list[dict]) -> dict | None:
    best = None
    for r in runs:  # ordered by start and period, so that the first of equals stays
        if best is None or r["length"] * best["period"] > best["length"] * r["period"]:
            best = r
    return best


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = 4, least: int = 6, rewrite: Callable[[str | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(id, runs, best, collapsed) for every row.

    A run is a stretch of words [^\\x20\\x09-\\x0D]+ with a smallest period q and at least max(least, exponent q) words that no neighbour
    extends. runs: (start, length, period), by start and period; best: the one of greatest length / period (ties: smallest start, then period; null
    without runs); collapsed: the text's words without those that a run holds beyond its first period, parted by a blank.
    rewrite(id as text, words) may change the words first. Null and empty texts, and those of blanks alone, have no runs and an empty
    collapsed text; repeated rows get equal results if their ids are equal; an empty table gives an empty result; other columns don't matter. Texts are
    taken whole; one of n words takes n log n time, and 4 bytes a word for each power of two up to its longest repeat.
    """
    ship(docs.sparkSession)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            ids = batch.column(0)
            texts = [(t or b"").split() for t in utf8(batch.column(1))]
            if rewrite is not None:
                texts = [rewrite(key, t) for key, t in zip(batch.column(2).to_pylist(), texts, strict=True)]
            # Texts of like length are sorted together: the tree has as many levels as the longest needs.
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
            runs: list[list[dict]] = [[] for _ in texts]
            out = [b""] * len(texts)
            a = 0
            while a < len(order):
                b, n = a, 0
                while b < len(order) and (b == a or n + len(texts[order[b]]) <= WORDS_AT_ONCE):
                    n += len(texts[order[b]])
                    b += 1
                if n:
                    own = order[a:b]
                    for i, r, t in zip(own, *_described([texts[i] for i in own], exponent, least), strict=True):
                        runs[i], out[i] = r, t
                a = b
            yield pa.RecordBatch.from_arrays([ids, pa.array(runs, pa.list_(_RUN)), pa.array(map(_best, runs), _RUN), pa.array(out, pa.binary()).cast(pa.string())], ["id", "runs", "best", "collapsed"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(id_col).cast("string").alias("key"))
    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(run, f"id {kind}, runs {_RUNS}, best {_RUNS[6:-1]}, collapsed string").withColumnRenamed("id", id_col)


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The query's columns: how many runs the planted texts have, the best one, and digests of all runs and of the collapsed text."""
    found = periodic_runs(docs, id_col, text_col, rewrite=planted)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return found.select(
        id_col, F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        digest(lines).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"),
    )
