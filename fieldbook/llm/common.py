"""What several operators share: word hashes, keys that deal evenly, packed blocks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words whose hashes a worker remembers; beyond that it starts anew.
REMEMBERED_WORDS = 300_000
#: Odd multiplier of the polynomial hashes (2**64 over the golden ratio).
BASE = 0x9E3779B97F4A7C15

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """64-bit hash of each word (bytes), remembered."""

    def __missing__(self, word: bytes) -> int:
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > REMEMBERED_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def over_rows(function: Callable, df: DataFrame, schema: str) -> DataFrame:
    """mapInArrow with a function from a batch iterator to a batch iterator."""
    return df.mapInArrow(function, schema)


def even_keys(spark: SparkSession) -> list[int]:
    """One integer for each shuffle partition, such that hash partitioning deals exactly one of them to each.

    Blocks that are numbered so fill all partitions alike. The count follows spark.sql.shuffle.partitions,
    which a user sets to fit the data.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found: dict[int, int] = {}
    step = 8 * n + 64
    start = 0
    while len(found) < n:
        rows = spark.range(start, start + step, 1, 1).select(F.col("id").cast("int").alias("k")).groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).agg(F.min("k").alias("k")).collect()
        for row in rows:
            found.setdefault(row["p"], row["k"])
        start += step
    return [found[p] for p in range(n)]


def parts_for(df: DataFrame, bytes_each: int, least: int = 32) -> int:
    """How many parts of bytes_each the planner's estimate of df makes, `least` at least; where it has none, the session's shuffle partitions count."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 2**62:
        return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, -(-size // bytes_each))


def packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def runs(x: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours."""
    if not len(x):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))


def stretches(starts: np.ndarray, n: int) -> Iterable[tuple[int, int]]:
    """(start, end) of the runs that begin at starts in n entries; none of none."""
    return zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True) if len(starts) else ()


def give_back() -> None:
    """Freed memory goes back to the system: a worker lives on between stages, and what its allocators keep counts beside its executor's memory."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


def slices(source: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows at most, so that few texts at a time are Python objects; what was freed is given back at the end."""
    for batch in source:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def batches(rows: Iterable[dict], schema: pa.Schema, bytes_at_once: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Record batches of rows that hold packed blocks, a few MB each; what was freed is given back at the end."""
    held: list[dict] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row.values() if isinstance(v, (bytes, list)))
        if size > bytes_at_once:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)
        held = []
    give_back()
