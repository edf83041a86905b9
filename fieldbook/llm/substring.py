"""Substring dedup: passages of `width` words that an earlier document has too are cut out.

Every window of `width` consecutive words gets a Rabin-Karp hash, rolled over the 64-bit hashes of its words.
A map task settles what it can by itself: of the rows that it gathered, only the smallest id that starts a window
must still ask the others, so a passage that a third of all rows share is sent once for each flush of a task.
The rest goes out in blocks by hash. Spark deals, shuffles and groups the blocks; within a block's group the windows are counted by sorting
arrays, for rows of single windows would take more than the disk that the check allows (4 times the input). Windows
that repeat go back to their documents and merge into maximal removal intervals of words.

Windows are equal if their 64-bit hashes are: 61 bits or more of them are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.common import BASE, WordHashes, batches, even_keys, mixed, packed, runs, slices, stretches, utf8
from fieldbook.session import ship

#: Windows that a map task gathers before it sends a block to every partition.
FLUSH = 1_000_000
_LOW = np.uint64((1 << 56) - 1)
_BLOCK = pa.schema([("key", pa.int32()), ("h32", pa.binary()), ("h16", pa.binary()), ("h8", pa.binary()), ("ids", pa.binary()), ("marks", pa.binary()), ("counts", pa.binary()), ("starts", pa.binary())])
_BLOCK_SQL = "key int, h32 binary, h16 binary, h8 binary, ids binary, marks binary, counts binary, starts binary"
_SPANS = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("spans", pa.binary())])
_SPANS_SQL = "id bigint, mark bigint, spans binary"
_INVERSE = pow(BASE, -1, 1 << 64)


class Windows:
    """Rolling hashes of all windows of one document's word hashes."""

    def __init__(self, width: int) -> None:
        self.width, self.up, self.down = width, np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def of(self, h: np.ndarray) -> np.ndarray:
        n = len(h)
        if n < self.width:
            return np.zeros(0, np.uint64)
        if len(self.up) <= n:
            size = max(4096, 2 * n)
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, BASE, np.uint64)]))
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, _INVERSE, np.uint64)]))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * self.down[:n])])
        return mixed((sums[self.width :] - sums[: -self.width]) * self.up[self.width - 1 : n])


def _gaps(starts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Differences within each document's run, which compress well."""
    out = np.diff(starts, prepend=np.int64(0))
    out[first] = starts[first]
    return out.astype(np.uint16 if not len(out) or out.max() < 65536 else np.uint32)


def _ungapped(blobs: list[bytes], counts: list[np.ndarray]) -> np.ndarray:
    out = []
    for blob, count in zip(blobs, counts, strict=True):
        total = int(count.sum())
        gaps = np.frombuffer(blob, np.uint16 if len(blob) == 2 * total else np.uint32).astype(np.int64)
        sums = np.cumsum(gaps)
        first = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
        out.append(sums - np.repeat(sums[first] - gaps[first], count))
    return np.concatenate([np.zeros(0, np.int64), *out])


def _dealt(keys: list[int], part: np.ndarray, ids: np.ndarray, marks: np.ndarray, starts: np.ndarray, h: np.ndarray | None) -> Iterator[dict]:
    """Blocks by part, each in the order of documents and words."""
    order = np.lexsort((starts, marks, ids, part))
    part, ids, marks, starts = part[order], ids[order], marks[order], starts[order]
    cuts = runs(part)
    for a, b in stretches(cuts, len(part)):
        first = np.flatnonzero(np.concatenate([[True], (ids[a + 1 : b] != ids[a : b - 1]) | (marks[a + 1 : b] != marks[a : b - 1])]))
        row = {"key": keys[part[a]], "ids": packed(ids[a:b][first]), "marks": packed(marks[a:b][first]), "counts": packed(np.diff(np.append(first, b - a)).astype(np.uint32)), "starts": packed(_gaps(starts[a:b], first))}
        if h is not None:
            x = h[order[a:b]]
            row |= {"h32": packed(x.astype(np.uint32)), "h16": packed((x >> np.uint64(32)).astype(np.uint16)), "h8": packed((x >> np.uint64(48)).astype(np.uint8))}
        yield row


def _part(x: np.ndarray, partitions: int) -> np.ndarray:
    return (x.astype(np.uint64) % np.uint64(partitions)).astype(np.uint16 if partitions <= 65536 else np.uint32)


def _of_rows(ids: np.ndarray, marks: np.ndarray, partitions: int) -> np.ndarray:
    return _part(mixed(ids.astype(np.uint64) ^ mixed(marks.astype(np.uint64))) >> np.uint64(16), partitions)


def _blocks(keys: list[int], width: int):
    partitions = len(keys)

    def flush(windows: list, ids: list, marks: list) -> Iterator[dict]:
        sizes = [len(w) for w in windows]
        h = np.concatenate(windows)
        windows.clear()
        ids, marks = np.repeat(np.array(ids, np.int64), sizes), np.repeat(np.array(marks, np.int64), sizes)
        starts = np.concatenate([np.arange(n, dtype=np.int64) for n in sizes])
        order = np.argsort(h)
        cuts = runs(h[order])
        least = np.empty(len(h), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(ids[order], cuts), np.diff(np.append(cuts, len(h))))
        known = ids > least
        del order, least
        yield from _dealt(keys, _of_rows(ids[known], marks[known], partitions), ids[known], marks[known], starts[known], None)
        ask = ~known
        h = h[ask]
        yield from _dealt(keys, _part(h >> np.uint64(48), partitions), ids[ask], marks[ask], starts[ask], h & _LOW)

    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hashes, rolling = WordHashes(), Windows(width)
        windows, ids, marks, held = [], [], [], 0
        for batch in slices(source):
            for i, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                words = text.split() if text and i is not None else []
                if len(words) >= width:
                    windows.append(rolling.of(hashes.of(words)))
                    ids.append(i)
                    marks.append(mark)
                    held += len(words)
                    if held > FLUSH:
                        yield from flush(windows, ids, marks)
                        windows, ids, marks, held = [], [], [], 0
        if windows:
            yield from flush(windows, ids, marks)

    return lambda source: batches(rows(source), _BLOCK)


def _entries(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    counts = [np.frombuffer(x["counts"], np.uint32) for x in rows]
    join = lambda name: np.concatenate([np.zeros(0, np.int64), *(np.repeat(np.frombuffer(x[name], np.int64), c) for x, c in zip(rows, counts, strict=True))])
    return join("ids"), join("marks"), _ungapped([x["starts"] for x in rows], counts)


def _judge(keys: list[int]):
    """A block of hashes: windows that start in a document with a smaller id, sent to the block of their document."""
    partitions = len(keys)

    def rows(table: pa.Table) -> Iterator[dict]:
        all_rows = table.to_pylist()
        yield from (x for x in all_rows if x["h32"] is None)
        asked = [x for x in all_rows if x["h32"] is not None]
        del all_rows
        if not asked:
            return
        join = lambda name, kind: np.concatenate([np.frombuffer(x[name], kind) for x in asked]).astype(np.uint64)
        h = join("h32", np.uint32) | join("h16", np.uint16) << np.uint64(32) | join("h8", np.uint8) << np.uint64(48)
        ids, marks, starts = _entries(asked)
        order = np.argsort(h)
        sorted_ids = ids[order]
        cuts = runs(h[order])
        later = np.zeros(len(h), bool)
        later[order] = sorted_ids > np.repeat(np.minimum.reduceat(sorted_ids, cuts), np.diff(np.append(cuts, len(h))))
        ids, marks, starts = ids[later], marks[later], starts[later]
        if len(ids):
            yield from _dealt(keys, _of_rows(ids, marks, partitions), ids, marks, starts, None)

    return lambda table: pa.Table.from_batches(list(batches(rows(table), _BLOCK)), _BLOCK)


def _merged(width: int):
    """A block of documents: their repeated windows as maximal intervals (first word, end)."""

    def rows(table: pa.Table) -> Iterator[dict]:
        ids, marks, starts = _entries(table.to_pylist())
        order = np.lexsort((starts, marks, ids))
        ids, marks, starts = ids[order], marks[order], starts[order]
        new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1])])
        cuts = np.flatnonzero(new)
        for a, b in stretches(cuts, len(ids)):
            s = starts[a:b]
            first = np.flatnonzero(np.concatenate([[True], s[1:] > s[:-1] + width]))
            last = np.append(first[1:], len(s)) - 1
            yield {"id": int(ids[a]), "mark": int(marks[a]), "spans": packed(np.stack([s[first], s[last] + width], 1).astype(np.int64))}

    return lambda table: pa.Table.from_batches(list(batches(rows(table), _SPANS)), _SPANS)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> DataFrame:
    """(id, mark, spans): for each row with repeated passages, its word intervals as packed int64 pairs; mark is xxhash64 of the text."""
    ship(docs.sparkSession)
    keys = even_keys(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    judged = source.mapInArrow(_blocks(keys, width), _BLOCK_SQL).groupBy("key").applyInArrow(_judge(keys), _BLOCK_SQL)
    return judged.groupBy("key").applyInArrow(_merged(width), _SPANS_SQL)


def _cut(whole: bool):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(source):
            texts, spans = utf8(batch.column("_text")), batch.column("_spans").to_pylist()
            kept, totals, removed = [], [], []
            for text, packed_spans in zip(texts, spans, strict=True):
                words = text.split() if text else []
                totals.append(len(words))
                if packed_spans:
                    rest, at = [], 0
                    for a, b in np.frombuffer(packed_spans, np.int64).reshape(-1, 2).tolist():
                        rest += words[at:a]
                        at = b
                    words = rest + words[at:]
                removed.append(totals[-1] - len(words))
                kept.append(text if whole and not removed[-1] else b" ".join(words))
            names = [x for x in batch.schema.names if x not in ("_text", "_spans")]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], [*names, "n_words", "n_removed", "kept"])

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, keep: list[str] | None = None, whole: bool = False) -> DataFrame:
    """The columns `keep` (default: the id), with n_words, n_removed and kept (the words left, joined by one space).

    A word goes if a window of `width` words that covers it also starts in a row with a smaller id; windows are
    judged on the input. Words are runs of anything but ASCII white space, unchanged. Null and empty texts have no words
    and keep an empty text. Rows that share an id never remove each other's words; a row with a null id is left whole
    and removes nothing. An empty table gives an empty result; very long texts are handled whole. With `whole`, texts that lose nothing stay as they are, white space and nulls too. Columns of docs
    other than these don't matter; kept ones may have any names, and come first, in their order.
    """
    keep = [id_col] if keep is None else keep
    places = [f"c{i}" for i in range(len(keep))]
    spans = repeated_spans(docs, id_col, text_col, width).select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), F.col("spans").alias("_spans"))
    own = docs.select(*(F.col(c).alias(p) for c, p in zip(keep, places, strict=True)), F.col(id_col).cast("bigint").alias("_own"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_hash"))
    joined = own.join(spans, (F.col("_own") == F.col("_id")) & (F.col("_hash") == F.col("_mark")), "left").select(*places, "_text", "_spans")
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in joined.schema if f.name in places]
    cut = joined.mapInArrow(_cut(whole), ", ".join([*kinds, "n_words bigint", "n_removed bigint", "kept string"]))
    return cut.toDF(*keep, "n_words", "n_removed", "kept")


def kept_digest(column: str = "kept"):
    return F.sha2(F.encode(column, "UTF-8"), 256)
