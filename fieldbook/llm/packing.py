"""Best-two-fit packing of tokenised documents into sequences.

Documents become ids, are closed by id 1 and cut only if longer than a sequence. Pieces are dealt by hash to groups of about
`group_rows` rows, and every group is packed by itself, so no task sees the whole corpus and each group costs at most about
one sequence that isn't full. Within a group a sequence is filled greedily, largest fitting piece first; then its smallest
piece gives way to two unpacked pieces if those fill the expanded gap more tightly.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.llm import wordpieces
from fieldbook.llm.common import slices, utf8
from fieldbook.session import settled, ship

_PIECES = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("twin", pa.int64())])
_PIECES_SQL = "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, twin bigint"


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length from 1 to capacity; sequences are numbered from 0."""
    order = np.argsort(lengths, kind="stable")
    waiting: dict[int, list[int]] = {}
    for i in order.tolist():
        waiting.setdefault(int(lengths[i]), []).append(i)
    free = 0  # bit n: a piece of length n waits
    count = np.zeros(capacity + 1, np.int64)
    for n, own in waiting.items():
        free |= 1 << n
        count[n] = len(own)
    below = [(1 << (n + 1)) - 1 for n in range(capacity + 1)]
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    number = 0

    def take(n: int) -> int:
        nonlocal free
        count[n] -= 1
        if not count[n]:
            free &= ~(1 << n)
        return waiting[n].pop()

    def put_back(n: int, i: int) -> None:
        nonlocal free
        count[n] += 1
        free |= 1 << n
        waiting[n].append(i)

    while free:
        own, gap = [], capacity
        while (n := (free & below[gap]).bit_length() - 1) > 0:
            own.append((n, take(n)))
            gap -= n
        if gap and free:
            least, piece = own[-1]
            if pair := _tighter(count, gap + least, least):
                own.pop()
                put_back(least, piece)
                own += [(n, take(n)) for n in pair]
        at = 0
        for n, i in own:
            sequence[i], offset[i] = number, at
            at += n
        number += 1
    return sequence, offset


def _tighter(count: np.ndarray, room: int, least: int) -> tuple[int, int] | None:
    """Two waiting lengths with the largest sum over `least` and up to `room`."""
    have = np.flatnonzero(count[: room + 1])
    if not len(have):
        return None
    at = np.searchsorted(have, room - have, "right") - 1
    second = np.where(at >= 0, have[at], -1)
    same = (second == have) & (count[have] < 2)
    second = np.where(same, np.where(at > 0, have[np.maximum(at - 1, 0)], -1), second)
    total = np.where(second > 0, have + second, 0)
    best = int(total.argmax())
    return (int(have[best]), int(second[best])) if total[best] > least else None


def _pieces(path: str, capacity: int, end: int):
    close = np.array([end], "<u4").tobytes()

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = wordpieces.packed_ids(path)
        for batch in slices(source):
            out: list[list] = [[] for _ in _PIECES]
            for i, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                ids = ids_of(text) + close
                twin = zlib.crc32(ids)
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[a : a + 4 * capacity]
                    for column, value in zip(out, (i, k, a // 4, len(own) // 4, zlib.crc32(own), twin), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _PIECES, strict=True)], schema=_PIECES)

    return run


def pack_pieces(pieces: DataFrame, capacity: int = 4096, group_rows: int = 20_000) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` of 1 to capacity; columns of these names are replaced, others may have any name.

    pieces must be settled: it is counted first, and rows are dealt to groups by their content and their place in it, so that equal rows
    don't share a group. An empty table gives an empty result; a null length, or one out of bounds, raises.
    """
    groups = max(1, -(-pieces.count() // group_rows))
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    places = [f"c{i}" for i in range(len(kept))]
    length = places[kept.index("length")]

    def pack(table: pa.Table) -> pa.Table:
        lengths = table.column(length)
        if lengths.null_count or not 1 <= pc.min(lengths).as_py() <= pc.max(lengths).as_py() <= capacity:
            raise ValueError(f"lengths must lie between 1 and {capacity}")
        sequence, offset = best_two_fit(np.asarray(lengths), capacity)
        base = table.column("dealt")[0].as_py() << 32
        return table.select(places).append_column("sequence", pa.array(sequence + base)).append_column("place", pa.array(offset))

    own = pieces.select(*(F.col(f"`{c}`").alias(p) for c, p in zip(kept, places, strict=True)))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema)
    dealt = own.withColumn("dealt", F.pmod(F.xxhash64(F.monotonically_increasing_id(), *(c for c in places)), F.lit(groups)))
    return dealt.groupBy("dealt").applyInArrow(pack, kinds + ", sequence bigint, place bigint").toDF(*kept, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end: int = 1, group_rows: int = 20_000) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row.

    Null and empty texts are the closing id alone. Repeated rows are packed once each. Null ids are kept; an empty table gives
    an empty result; other columns don't matter; very long texts become as many pieces as it takes. tokenizer: a .json file of the
    tokenizers library, or a .model file of SentencePiece.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    pieces = settled(source.mapInArrow(_pieces(tokenizer, capacity, end), _PIECES_SQL))
    packed = pack_pieces(pieces, capacity, group_rows)
    return packed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
