"""Byte-level BPE with a segment tree over byte positions.

A leaf stands for the pair that starts at its byte and holds the pair's rank and place, or nothing; every inner node holds
the smaller of its two, so the root is the leftmost pair of the lowest rank. A merge changes three leaves (the
merged pair's, its left neighbour's and the one that is gone) and the paths above them. Short pieces are merged many at a
time, a row of the tree arrays for each; long ones one at a time, in n log n steps.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.session import ship

#: Pieces that a worker remembers; beyond that it starts anew.
REMEMBERED = 500_000
#: Longest piece in bytes that is merged among others.
SHORT = 64
_NONE = np.int64(1) << np.int64(60)


class Ranks:
    """A rank file: bytes of every id, and the rank of every pair of ids that some token joins."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {i: t for t, i in self.ranks.items()}
        pairs = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)

    def of_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << np.int64(32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)


def merge_one(piece: bytes, ranks: Ranks) -> list[int]:
    """Ids of one piece by the segment tree."""
    n = len(piece)
    token = ranks.bytes[np.frombuffer(piece, np.uint8)].tolist()
    leaves = 1 << max(1, (n - 1).bit_length())
    none = 1 << 60
    tree = [none] * (2 * leaves)
    pairs = ranks.pairs
    for i in range(n - 1):
        if (rank := pairs.get(token[i] << 32 | token[i + 1])) is not None:
            tree[leaves + i] = rank << 32 | i
    for i in range(leaves - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def point(i: int, value: int) -> None:
        i += leaves
        tree[i] = value
        while i > 1:
            i >>= 1
            low = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == low:
                break
            tree[i] = low

    def leaf(i: int) -> int:
        j = after[i]
        rank = pairs.get(token[i] << 32 | token[j]) if j < n else None
        return none if rank is None else rank << 32 | i

    while tree[1] < none:
        rank, i = tree[1] >> 32, tree[1] & 0xFFFFFFFF
        j = after[i]
        token[i], token[j] = rank, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        point(j, none)
        point(i, leaf(i))
        if before[i] >= 0:
            point(before[i], leaf(before[i]))
    return [t for t in token if t >= 0]


def merge_many(pieces: list[bytes], ranks: Ranks) -> list[bytes]:
    """Packed ids of many pieces of 2 to SHORT bytes, merged side by side: a row of the tree arrays for each piece."""
    lengths = np.array([len(p) for p in pieces])
    leaves = 1 << max(1, int(lengths.max() - 1).bit_length())
    k = len(pieces)
    grid = np.zeros((k, leaves), np.uint8)
    inside = np.arange(leaves) < lengths[:, None]
    grid[inside] = np.frombuffer(b"".join(pieces), np.uint8)
    token = np.where(inside, ranks.bytes[grid], -1)
    after = np.tile(np.arange(1, leaves + 1), (k, 1))
    before = np.tile(np.arange(-1, leaves - 1), (k, 1))
    tree = np.full((k, 2 * leaves), _NONE)
    first = np.where(inside[:, 1:], ranks.of_pairs(np.maximum(token[:, :-1], 0), np.maximum(token[:, 1:], 0)), -1)
    tree[:, leaves : 2 * leaves - 1] = np.where(first >= 0, first << np.int64(8) | np.arange(leaves - 1), _NONE)
    for i in range(leaves - 1, 0, -1):
        tree[:, i] = np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1])
    rows = np.flatnonzero(tree[:, 1] < _NONE)
    while len(rows):
        root = tree[rows, 1]
        i = root & 255
        j = after[rows, i]
        token[rows, i], token[rows, j] = root >> np.int64(8), -1
        next_ = after[rows, j]
        after[rows, i] = next_
        has_next, prev = next_ < lengths[rows], before[rows, i]
        before[rows[has_next], next_[has_next]] = i[has_next]
        tree[rows, leaves + j] = _NONE
        right = np.where(has_next, ranks.of_pairs(token[rows, i], np.maximum(token[rows, np.minimum(next_, leaves - 1)], 0)), -1)
        tree[rows, leaves + i] = np.where(right >= 0, right << np.int64(8) | i, _NONE)
        has_prev = prev >= 0
        own, at = rows[has_prev], prev[has_prev]
        left = ranks.of_pairs(token[own, at], token[own, i[has_prev]])
        tree[own, leaves + at] = np.where(left >= 0, left << np.int64(8) | at, _NONE)
        nodes = [leaves + j, leaves + i, leaves + np.maximum(prev, 0)]
        while nodes[0][0] > 1:
            nodes = [x >> 1 for x in nodes]
            for x in nodes:
                tree[rows, x] = np.minimum(tree[rows, 2 * x], tree[rows, 2 * x + 1])
        rows = rows[tree[rows, 1] < _NONE]
    live = token >= 0
    flat, ends = token[live].astype("<u4").tobytes(), (4 * np.cumsum(live.sum(1))).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Encoder:
    """Ids of texts by a rank file and a pattern; remembers the ids of pieces as packed 32-bit integers."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks, self.pattern, self.known = Ranks(path), regex.compile(pattern), {}

    def learn(self, pieces: set[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        short: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces.difference(self.known):
            raw = piece.encode()
            whole = self.ranks.ranks.get(raw)
            if whole is not None:
                self.known[piece] = struct.pack("<I", whole)
            elif len(raw) > SHORT:
                self.known[piece] = np.array(merge_one(raw, self.ranks), "<u4").tobytes()
            else:
                short.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for own in short.values():
            for a in range(0, len(own), 4096):
                part = own[a : a + 4096]
                self.known.update(zip((p for p, _ in part), merge_many([r for _, r in part], self.ranks), strict=True))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's begin and the last one's end)."""
        pieces = [self.pattern.findall(t) if t else () for t in texts]
        self.learn(set().union(*pieces))
        packed = [b"".join(map(self.known.__getitem__, own)) for own in pieces]
        return np.frombuffer(b"".join(packed), "<u4").astype(np.int32), np.cumsum([0, *(len(x) // 4 for x in packed)])


class Decoder:
    """Bytes of ids, for many texts at once."""

    def __init__(self, path: str) -> None:
        tokens = Ranks(path).tokens
        own = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.size = np.array([len(t) for t in own])
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.bytes = np.frombuffer(b"".join(own), np.uint8)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        size = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.start[ids] - ends[:-1], size) + np.arange(ends[-1])
        out, cuts = self.bytes[at].tobytes(), ends[bounds].tolist()
        return [out[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


@cache
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


@cache
def decoder(path: str) -> Decoder:
    return Decoder(path)


def _runs(sizes: list[int], at_once: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about at_once units each."""
    start = held = 0
    for i, n in enumerate(sizes):
        held += n
        if held > at_once or i + 1 == len(sizes):
            yield start, i + 1
            start, held = i + 1, 0


def _encoded(path: str, pattern: str, text: str, decode: bool, at_once: int = 1_000_000):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in source:
            rest = [x for x in batch.schema.names if x != text]
            column = batch.column(text)
            for a, b in _runs([n or 0 for n in pc.utf8_length(column).to_pylist()], at_once):
                ids, bounds = own.encode(column.slice(a, b - a).to_pylist())
                made = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))]
                if decode:
                    made.append(pa.array(decoder(path).decode(ids, bounds), pa.binary()))
                yield pa.RecordBatch.from_arrays([*(batch.column(x).slice(a, b - a) for x in rest), *made], [*rest, "ids", "decoded"][: len(rest) + len(made)])

    return run


def _schema(df: DataFrame, without: str, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != without), more])


def bpe_encode(df: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Replaces the text column by `ids` (array<int>); null and empty texts have no ids. Other columns stay, but for one named ids, which is replaced."""
    ship(df.sparkSession)
    df = df if text_col == "ids" else df.drop("ids")
    return df.mapInArrow(_encoded(path, pattern, text_col, False), _schema(df, text_col, "ids array<int>"))


def bpe_decode(df: DataFrame, path: str) -> DataFrame:
    """Replaces `ids` by `decoded` (binary); null ids decode to nothing. A column named decoded is replaced."""
    ship(df.sparkSession)
    df = df.drop("decoded")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rest = [x for x in batch.schema.names if x != "ids"]
            for a, b in _runs([n or 0 for n in pc.list_value_length(batch.column("ids")).to_pylist()], 500_000):
                part = batch.slice(a, b - a)
                lengths = pc.fill_null(pc.list_value_length(part.column("ids")), 0)
                decoded = decoder(path).decode(np.asarray(part.column("ids").flatten()), np.cumsum([0, *lengths.to_pylist()]))
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in rest), pa.array(decoded, pa.binary())], [*rest, "decoded"])

    return df.mapInArrow(run, _schema(df, "ids", "decoded binary"))


def bpe_round_trip(df: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """bpe_encode and bpe_decode in one pass: the text column gives way to `ids` and to `decoded`, which is made from the ids."""
    ship(df.sparkSession)
    df = df.drop(*({"ids", "decoded"} - {text_col}))
    return df.mapInArrow(_encoded(path, pattern, text_col, True), _schema(df, text_col, "ids array<int>, decoded binary"))


def bpe_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encoded, and decoded again from the ids.

    Null and empty texts have no tokens; repeated rows and null ids stay; very long texts are encoded whole; an empty table gives an
    empty result; other columns don't matter.
    """
    made = bpe_round_trip(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), path, pattern)
    written = F.sha2(F.encode(F.concat_ws(",", F.col("ids").cast("array<string>")), "UTF-8"), 256)
    return made.select(F.col("id").alias(id_col), F.size("ids").cast("bigint").alias("n_tokens"), written.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
