"""Likelihood of texts under a subword unigram model: every segmentation of every word counts.

The pieces are those of an existing vocabulary, and its scores, which are ranks, give the first probabilities (falling with the rank); rounds of
expectation and maximisation over the words of the training texts then fit the probabilities, by forward and backward
sums over each word's lattice in log space. No piece crosses white space, so a text's marginal probability is the product of those
of its words (with the mark of a word's start) and of the end, and each distinct word's lattice is summed once, not once for each occurrence.
A character may always be spelled in its bytes, so every word has a probability.

Tasks number the words of blocks of texts. Words are counted by Spark across blocks, scored, and their scores go back to
the blocks that hold them, where texts are summed; texts themselves are not shuffled, only their packed word numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.common import utf8
from fieldbook.session import ship, written

#: Words of a block of texts, and distinct ones; a longer text is a block of its own.
BLOCK_WORDS, BLOCK_DISTINCT = 3_000_000, 500_000
#: Cells (words times characters) of the lattices that are summed together.
CELLS = 1_000_000
#: Added to the expected count of each piece, so that none is impossible.
SMOOTHING = 0.1
START = "▁"  # marks the start of a word in the vocabulary


class Pieces:
    """The vocabulary: ids of pieces by text, of every prefix of a piece (-1 where that is none itself), of bytes and of the end."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.size, self.end = n, model.eos_id()
        self.bytes = np.zeros(256, np.int64)
        self.usable = np.zeros(n, bool)
        self.usable[self.end] = True
        self.prefixes: dict[str, int] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.usable[i] = True
            elif not (model.is_control(i) or model.is_unknown(i) or START in piece[1:]):
                self.usable[i] = True
                self.prefixes[piece] = i
                for k in range(1, len(piece)):
                    self.prefixes.setdefault(piece[:k], -1)
        self.scores = np.array([model.get_score(i) for i in range(n)])

    def first(self) -> np.ndarray:
        """Natural logs of the probabilities that the vocabulary's own ranks give; bytes and the end count as its last pieces."""
        ranks = np.where(self.scores < 0, -self.scores, len(self.scores))
        return self.logs(1e6 / (ranks + 10.0))

    def logs(self, counts: np.ndarray) -> np.ndarray:
        counts = np.where(self.usable, counts + SMOOTHING, 0.0)
        with np.errstate(divide="ignore"):
            return np.log(counts) - math.log(counts.sum())


class Lattices:
    """The lattices of some words: edges (word, from, to, piece), sorted by their ends; spelled characters are edges of several bytes."""

    def __init__(self, pieces: Pieces, words: list[str]) -> None:
        self.pieces, self.n = pieces, len(words)
        self.lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        word, low, high, piece = [], [], [], []
        prefixes = pieces.prefixes
        for k, text in enumerate(words):
            text = START + text
            m = len(text)
            for i in range(m):
                for j in range(i + 1, m + 1):
                    p = prefixes.get(text[i:j])
                    if p is None:
                        break
                    if p >= 0:
                        word.append(k)
                        low.append(i)
                        high.append(j)
                        piece.append(p)
        self.word, self.low, self.high, self.piece = (np.array(x, np.int64) for x in (word, low, high, piece))
        # Spelled characters: one edge each; its bytes lie in `spelled` from its first to its last.
        data = "".join(START + w for w in words).encode()
        raw = np.frombuffer(data, np.uint8)
        self.spelled = pieces.bytes[raw]
        self.begins = np.flatnonzero((raw & 0xC0) != 0x80)
        self.place = np.arange(len(self.begins)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.owner = np.repeat(np.arange(self.n), self.lengths)

    def _weights(self, logs: np.ndarray) -> tuple[np.ndarray, ...]:
        spell = np.add.reduceat(logs[self.spelled], self.begins) if len(self.begins) else np.zeros(0)
        return np.concatenate([self.word, self.owner]), np.concatenate([self.low, self.place]), np.concatenate([self.high, self.place + 1]), np.concatenate([logs[self.piece], spell])

    def sums(self, logs: np.ndarray) -> np.ndarray:
        """The natural log of each word's probability."""
        return self._forward(*self._weights(logs))[np.arange(self.n), self.lengths]

    def _forward(self, word: np.ndarray, low: np.ndarray, high: np.ndarray, weight: np.ndarray, swap: bool = False) -> np.ndarray:
        table = np.full((self.n, int(self.lengths.max(initial=0)) + 1), -np.inf)
        table[:, 0] = 0.0
        order = np.lexsort((word, high))
        word, low, high, weight = word[order], low[order], high[order], weight[order]
        ends = np.searchsorted(high, np.arange(1, table.shape[1] + 1))
        for a, b, j in zip(ends.tolist(), ends[1:].tolist(), range(1, table.shape[1]), strict=False):
            own = word[a:b]
            cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if b > a else np.zeros(0, np.int64)
            if len(cuts):
                table[own[cuts], j] = np.logaddexp.reduceat(table[own, low[a:b]] + weight[a:b], cuts)
        return table

    def expected(self, logs: np.ndarray, times: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the words, each of which counts `times`."""
        word, low, high, weight = self._weights(logs)
        forward = self._forward(word, low, high, weight)
        m = self.lengths[word]
        backward = self._forward(word, m - high, m - low, weight)  # from the end, places counted from there
        total = forward[np.arange(self.n), self.lengths]
        share = np.exp(forward[word, low] + weight + backward[word, m - high] - total[word]) * times[word]
        n = len(self.piece)
        found = np.bincount(self.piece, share[:n], self.pieces.size)
        sizes = np.diff(np.append(self.begins, len(self.spelled)))
        return found + np.bincount(self.spelled, np.repeat(share[n:], sizes), self.pieces.size)


def _groups(words: list[str]) -> Iterator[list[int]]:
    """Places of the words, those of like length together, such that tables stay within CELLS."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and (b - a + 1) * (len(words[order[b]]) + 2) <= CELLS:
            b += 1
        yield order[a:b]
        a = b


def word_logs(pieces: Pieces, words: list[str], logs: np.ndarray) -> np.ndarray:
    found = np.zeros(len(words))
    for own in _groups(words):
        found[own] = Lattices(pieces, [words[i] for i in own]).sums(logs)
    return found


def _expect(path: str, logs: np.ndarray) -> Callable:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        found = np.zeros(pieces.size)
        for batch in source:
            words, times = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            for own in _groups(words):
                found += Lattices(pieces, [words[i] for i in own]).expected(logs, times[own])
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(found[some])], ["piece", "x"])

    return run


def fit(words: DataFrame, path: str, texts: int, rounds: int) -> np.ndarray:
    """Natural logs of the pieces' probabilities after some rounds over (word, c), with `texts` ends. What comes back is as long as the vocabulary."""
    pieces = Pieces(path)
    logs = pieces.first()
    for _ in range(rounds):
        got = words.select("word", "c").mapInArrow(_expect(path, logs), "piece int, x double").groupBy("piece").agg(F.sum("x").alias("x")).collect()
        counts = np.zeros(pieces.size)
        for r in got:
            counts[r["piece"]] = r["x"]
        counts[pieces.end] += texts
        logs = pieces.logs(counts)
    return logs


def _score_words(path: str, logs: np.ndarray) -> Callable:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for batch in source:
            found = word_logs(pieces, batch.column(0).to_pylist(), logs) / math.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, "score"])

    return run


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        got = self[word] = len(self)
        return got


def _blocks(id_type: pa.DataType) -> Callable:
    """Batches of (id, text, train) as a row for each block of texts and a row for each distinct word of a block."""
    schema = pa.schema([("block", pa.int64()), ("word", pa.string()), ("local", pa.int32()), ("n", pa.int64()), ("ids", pa.list_(id_type)), ("lengths", pa.binary()), ("numbers", pa.binary())])

    def rows(**columns: pa.Array) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        numbers, ids, lengths, held, times, size = _Numbers(), [], [], [], np.zeros(0, np.int64), 0

        def done() -> Iterator[pa.RecordBatch]:
            words = list(numbers)
            for a in range(0, len(words), 100_000):
                own = words[a : a + 100_000]
                yield rows(block=pa.array([block] * len(own)), word=pa.array(own, pa.binary()), local=pa.array(range(a, a + len(own))), n=pa.array(times[a : a + len(own)]))
            packed = pa.compress(np.concatenate([*held, np.zeros(0, np.uint32)]).astype(np.uint32).tobytes(), codec="zstd", asbytes=True)
            yield rows(block=pa.array([block]), ids=pa.array([ids], pa.list_(id_type)), lengths=pa.array([np.array(lengths, np.int64).tobytes()]), numbers=pa.array([packed]))

        for batch in source:
            for key, text, train in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = (text or b"").lower().split()
                own = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
                if len(numbers) > len(times):
                    times = np.concatenate([times, np.zeros(max(len(times), len(numbers)), np.int64)])
                if train:
                    np.add.at(times, own, 1)
                ids.append(key)
                lengths.append(len(words))
                held.append(own.astype(np.uint32))
                size += len(words)
                if size >= BLOCK_WORDS or len(numbers) >= BLOCK_DISTINCT:
                    yield from done()
                    block += 1
                    numbers, ids, lengths, held, times, size = _Numbers(), [], [], [], np.zeros(0, np.int64), 0
        if ids:
            yield from done()

    return run


def _summed(n: int, v: int, ends: int, end_score: float) -> Callable:
    """Sums a block's texts from its words' counts and scores. n, v: training tokens and distinct ones; ends: training texts."""
    base = lambda c: np.log10((c + 1.0) / (n + v + 1.0))

    def run(key: tuple, blocks: pa.Table, words: pa.Table) -> pa.Table:
        local = words["local"].to_numpy()
        count, score = np.zeros(len(local), np.int64), np.zeros(len(local))
        count[local], score[local] = words["c"].to_numpy(), words["score"].to_numpy()
        by_word = base(count)
        out = []
        for ids, lengths, numbers in zip(blocks["ids"].combine_chunks(), blocks["lengths"].to_pylist(), blocks["numbers"].to_pylist(), strict=True):
            size = np.frombuffer(lengths, np.int64)
            own = np.frombuffer(pa.decompress(numbers, int(size.sum()) * 4, "zstd", asbytes=True), np.uint32)
            text = np.repeat(np.arange(len(size)), size)
            total = lambda x: np.bincount(text, x, len(size))  # noqa: B023, E731
            known = total((count > 0)[own].astype(float)).astype(np.int64) + (ends > 0)
            out.append(pa.Table.from_arrays([ids.values if isinstance(ids, pa.Scalar) else ids, pa.array(size + 1), pa.array(known), pa.array(total(by_word[own]) + base(ends)), pa.array(total(score[own]) + end_score)], ["id", "n_tokens", "n_known", "base_score", "score"]))
        return pa.concat_tables(out)

    return run


def lm_scores(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Tokens are the words [^\\x20\\x09-\\x0D]+ with A-Z in lower case, and one end. Rows whose crc32(id as text) mod 7 is not 2 are the
    training texts. score: log10 of the text's marginal probability under the fitted pieces; base_score: that of words with one added to each count.
    vocabulary: a SentencePiece model with byte pieces. Null and empty texts are the end alone; a null id counts as an empty one for
    held_out; repeated rows are kept and count again; without training texts counts are 0 and the vocabulary's own probabilities hold; an empty
    table gives an empty result; other columns don't matter; long texts and long words are taken whole.
    """
    ship(docs.sparkSession)
    held = held_out(id_col)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (~held).alias("train"))
    kind = own.schema["id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    rows = written(own.mapInArrow(_blocks(to_arrow_type(own.schema["id"].dataType)), f"block bigint, word string, local int, n bigint, ids array<{kind}>, lengths binary, numbers binary"))
    places = rows.where("word is not null").select("block", "word", "local", "n")
    words = written(places.groupBy("word").agg(F.sum("n").alias("c")))
    seen = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    ends = own.where("train").count()
    n, v = seen["n"] + ends, seen["v"] + (ends > 0)
    logs = fit(words.where("c > 0"), vocabulary, ends, rounds if ends else 0)
    scored = words.mapInArrow(_score_words(vocabulary, logs), "word string, c bigint, score double")
    back = places.drop("n").join(scored, "word").select(F.col("block").alias("at"), "local", "c", "score")
    blocks = rows.where("ids is not null").select("block", "ids", "lengths", "numbers")
    function = _summed(n, v, ends, float(logs[Pieces(vocabulary).end] / math.log(10)))
    got = blocks.groupBy("block").cogroup(back.groupBy("at")).applyInArrow(function, f"id {kind}, n_tokens bigint, n_known bigint, base_score double, score double")
    return got.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")


def held_out(id_col: str):
    """True for the seventh of the rows that learning never sees."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")), F.lit(7)) == 2
