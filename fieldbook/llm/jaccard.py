"""N-gram Jaccard join: which documents share most of their word shingles.

The incidence matrix (distinct shingle sets by shingles) is cut into column blocks, one for each shuffle
partition; a block task sees every set that holds a shingle of its columns and so knows how many do. A shingle that is
frequent among the sets of one map task's flush, such as those of a passage that a third of all documents share, never gathers in a
block: the block learns only that it is frequent, which puts it last in everyone's order.
Shingles of one set alone cannot count towards any overlap and stop there. The rest goes back to the sets,
in blocks again. A set of n shingles links with none unless at least 75 % of n are shared ones (the first
size-derived bound); of those that are left, the rarest shingles beyond that bound must meet a partner's
rarest ones, so sets that share one of these are candidates. Of shingles that the same sets have there, one is kept.

Candidates of a shingle are first compared with one of its sets, its hub, and linked sets become components; this is repeated
with other hubs for frequent shingles whose sets are still in several components. That takes rows in proportion to the
sets, however many near copies a group has. What is left open then: for a shingle of at most `RARE` sets, its pairs from
different components; for more frequent ones, blocks of at most `block_rows` sets, made of one component where that is large, that are multiplied
with each other (sparse columns made dense a few thousand at a time), but never within a component. Overlap
counts accumulate, and pairs that can no longer reach 75 * (n + m) / 175 are discarded. A block task reports a spanning forest of the links it
found, not all pairs. So only sets that share a frequent shingle among their rarest and yet aren't alike cost more than in proportion:
m of them m / 256 rows each.

A set's hash goes with its entries once for each block it lies in, and its size once to its row block.
Equal sets are one row of the matrix, so exact copies cost nothing after the first shuffle.
Shingles are equal if 48 bits of their hashes and their block are, sets if the 64-bit sums of their shingles' hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.common import BASE, WordHashes, batches, even_keys, mixed, packed, runs, slices, stretches, utf8
from fieldbook.operators.components import connected_components
from fieldbook.operators.skew import HOT_SHARE, LEAST_HOT, hot_keys, spread_join
from fieldbook.session import ship, written

#: Shingles that a map task gathers before it sends a block to every partition.
FLUSH = 1_000_000
#: A shingle in this share of the sets of a flush, and in so many at least, is frequent there.
FREQUENT_SHARE, FREQUENT_SETS = 0.01, 32
#: Words of a shingle that choose its column block: fewer would put more shingles of a set together, but fill blocks less evenly.
STRETCH = 3
#: Turns of comparing sets with hubs, and the most sets of a shingle whose open pairs are compared one by one.
HUB_TURNS, RARE = 2, 32
#: Rows that meet one copy of a hub.
_HUB_ROWS = 100
#: Stands for the count of sets of a shingle that is frequent in some flush.
_FREQUENT = np.uint32(0xFFFFFFFF)
_PAYLOAD = np.uint64((1 << 48) - 1)
_TO_BLOCK = pa.schema([("key", pa.int32()), ("lo", pa.binary()), ("hi", pa.binary()), ("sigs", pa.binary()), ("counts", pa.binary()), ("freqs", pa.binary()), ("sizes", pa.binary()), ("ids", pa.list_(pa.int64())), ("doc_sizes", pa.list_(pa.int64())), ("doc_sigs", pa.list_(pa.int64()))])
_BLOCK_SQL = "key int, lo binary, hi binary, sigs binary, counts binary, freqs binary, sizes binary, ids array<bigint>, doc_sizes array<bigint>, doc_sigs array<bigint>"
_TO_SET = pa.schema([("key", pa.int32()), ("grams", pa.binary()), ("sigs", pa.binary()), ("counts", pa.binary()), ("freqs", pa.binary()), ("sizes", pa.binary()), ("ids", pa.list_(pa.int64())), ("doc_sizes", pa.list_(pa.int64())), ("doc_sigs", pa.list_(pa.int64()))])
_SET_SQL = "key int, grams binary, sigs binary, counts binary, freqs binary, sizes binary, ids array<bigint>, doc_sizes array<bigint>, doc_sigs array<bigint>"
_SETS = pa.schema([("sig", pa.int64()), ("size", pa.int64()), ("n_prefix", pa.int64()), ("grams", pa.binary()), ("ids", pa.list_(pa.int64())), ("doc_sizes", pa.list_(pa.int64())), ("doc_sigs", pa.list_(pa.int64()))])
_SETS_SQL = "sig bigint, size bigint, n_prefix bigint, grams binary, ids array<bigint>, doc_sizes array<bigint>, doc_sigs array<bigint>"
_EDGES = pa.schema([("src", pa.int64()), ("dst", pa.int64())])


def shingles(text: bytes | None, hashes: WordHashes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles: ASCII lower case, words between ASCII white space.

    Fewer words than `width`: the whole sequence as one; no word: none. The upper 16 bits, which name the column block, follow from the stretch
    of `STRETCH` words in the shingle that has the smallest hash. Neighbours often share it, so a set lies in half as many blocks.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.of(words)
    k = min(width, len(words))
    g = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        g = g * np.uint64(BASE) + h[i : len(h) - k + 1 + i]
    m = min(STRETCH, k)
    t = np.zeros(len(words) - m + 1, np.uint64)
    for i in range(m):
        t = t * np.uint64(BASE) + h[i : len(h) - m + 1 + i]
    t = mixed(t)
    least = t[: len(g)]
    for i in range(1, k - m + 1):
        least = np.minimum(least, t[i : i + len(g)])
    return np.unique((mixed(g) & _PAYLOAD) | (mixed(least ^ np.uint64(BASE)) & ~_PAYLOAD))


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal neighbours; a length is one byte, so long runs are split."""
    starts = runs(x)
    place = np.arange(len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x))))
    starts = np.flatnonzero(place % 255 == 0)
    return starts, np.diff(np.append(starts, len(x))).astype(np.uint8)


def _home(sig: np.ndarray, partitions: int) -> np.ndarray:
    """The row block of each set."""
    return ((sig >> np.uint64(48)) % np.uint64(partitions)).astype(np.uint32)


def _to_sets(gram: np.ndarray, sig: np.ndarray, freq: np.ndarray, keys: list[int], gram_name: str) -> Iterator[dict]:
    """Entries packed for the row blocks of their sets."""
    part = _home(sig, len(keys))
    order = np.lexsort((sig, part))
    part, gram, sig, freq = part[order], gram[order], sig[order], freq[order]
    for a, b in stretches(runs(part), len(part)):
        first, counts = _counted(sig[a:b])
        yield {"key": keys[part[a]], gram_name: packed(gram[a:b]), "sigs": packed(sig[a:b][first]), "counts": packed(counts), "freqs": packed(freq[a:b])}


def _blocks(keys: list[int], width: int):
    partitions = len(keys)

    def flush(grams: list, sigs: list, sizes: list) -> Iterator[dict]:
        all_grams = np.concatenate(grams)
        grams.clear()
        part = ((all_grams >> np.uint64(48)) % np.uint64(partitions)).astype(np.uint16 if partitions <= 65536 else np.uint32)
        order = np.argsort(part, kind="stable")
        part, all_grams = part[order], all_grams[order] & _PAYLOAD
        row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        del order
        sig, size = np.array(sigs, np.uint64), np.array(sizes, np.uint32)
        # A set's size goes to its row block once, not with its entries in every column block.
        home = _home(sig, partitions)
        by_home = np.argsort(home, kind="stable")
        for a, b in stretches(runs(home[by_home]), len(home)):
            yield {"key": keys[home[by_home[a]]], "sigs": packed(sig[by_home[a:b]]), "sizes": packed(size[by_home[a:b]])}
        # What is frequent here goes to its sets at once; the column block only hears that it is, by an entry of set 0.
        number = part.astype(np.uint64)
        number <<= np.uint64(48)
        number |= all_grams
        by_number = np.argsort(number)
        cuts = runs(number[by_number])
        times = np.diff(np.append(cuts, len(number)))
        often = np.zeros(len(number), bool)
        often[by_number] = np.repeat(times >= max(FREQUENT_SETS, FREQUENT_SHARE * len(sizes)), times)
        del by_number
        if often.any():
            yield from _to_sets(number[often], sig[row[often]], np.full(often.sum(), _FREQUENT), keys, "lo")
            told = np.unique(number[often])
            sig = np.append(sig, np.uint64(0))
            part = np.concatenate([part[~often], (told >> np.uint64(48)).astype(part.dtype)])
            all_grams, row = np.concatenate([all_grams[~often], told & _PAYLOAD]), np.concatenate([row[~often], np.full(len(told), len(sizes), np.int32)])
            order = np.argsort(part, kind="stable")
            part, all_grams, row = part[order], all_grams[order], row[order]
            del order
        del number, often
        starts = runs(part)
        for a, b in stretches(starts, len(part)):
            first, counts = _counted(row[a:b])
            g = all_grams[a:b]
            yield {"key": keys[part[a]], "lo": packed(g.astype(np.uint32)), "hi": packed((g >> np.uint64(32)).astype(np.uint16)), "sigs": packed(sig[row[a:b][first]]), "counts": packed(counts)}

    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        hashes = WordHashes()
        grams, sigs, sizes, seen, held = [], [], [], set(), 0
        for batch in slices(source):
            ids, doc_sizes, doc_sigs = batch.column(0).to_pylist(), [], []
            for text in utf8(batch.column(1)):
                g = shingles(text, hashes, width)
                sig = int(mixed(g ^ np.uint64(BASE)).sum()) if len(g) else 0
                doc_sizes.append(len(g))
                doc_sigs.append(sig - (1 << 64) if sig >= 1 << 63 else sig)
                if len(g) and sig not in seen:
                    seen.add(sig)
                    grams.append(g)
                    sigs.append(sig)
                    sizes.append(len(g))
                    held += len(g)
                    if held > FLUSH:
                        yield from flush(grams, sigs, sizes)
                        grams, sigs, sizes, seen, held = [], [], [], set(), 0
            yield {"key": keys[hash((ids[0], doc_sigs[0])) % partitions], "ids": ids, "doc_sizes": doc_sizes, "doc_sigs": doc_sigs}
        if grams:
            yield from flush(grams, sigs, sizes)

    return lambda source: batches(rows(source), _TO_BLOCK)


def _joined(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in table.column(name).to_pylist() if x is not None)])


def _set_sizes(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sets in order and their sizes, each set once."""
    table = table.filter(table.column("sizes").is_valid())
    sig, first = np.unique(_joined(table, "sigs", np.uint64), return_index=True)
    return sig, _joined(table, "sizes", np.uint32)[first]


def _documents(table: pa.Table) -> list[dict]:
    return [x for x in table.select(["ids", "doc_sizes", "doc_sigs"]).to_pylist() if x["ids"] is not None]


def _count(keys: list[int]):
    """A column block: how many sets hold each shingle; shared shingles go on to their sets."""
    number = {k: i for i, k in enumerate(keys)}

    def rows(table: pa.Table) -> Iterator[dict]:
        key = table.column("key")[0].as_py()
        for x in table.filter(pc.and_(table.column("hi").is_null(), table.column("lo").is_valid())).to_pylist():
            # Sent on with the key of the sets, as they came.
            yield {"key": x["key"], "grams": x["lo"], "sigs": x["sigs"], "counts": x["counts"], "freqs": x["freqs"]}
        own, size = _set_sizes(table)
        if len(own):
            yield {"key": key, "sigs": packed(own), "sizes": packed(size)}
        for x in _documents(table):
            yield {"key": key} | x
        table = table.filter(table.column("hi").is_valid())
        gram = _joined(table, "lo", np.uint32).astype(np.uint64) | (_joined(table, "hi", np.uint16).astype(np.uint64) << np.uint64(32))
        sig = np.repeat(_joined(table, "sigs", np.uint64), _joined(table, "counts", np.uint8))
        order = np.argsort(gram)
        gram = gram[order]
        same = np.concatenate([[False], gram[1:] == gram[:-1], [False]]) if len(gram) else np.zeros(1, bool)
        kept = same[1:] | same[:-1]
        order, gram = order[kept], gram[kept]
        sig = sig[order]
        order = np.lexsort((sig, gram))
        gram, sig = gram[order], sig[order]
        if len(gram):
            new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (sig[1:] != sig[:-1])])
            gram, sig = gram[new], sig[new]
        starts = runs(gram)
        times = np.diff(np.append(starts, len(gram)))
        told = sig[starts] == 0  # set 0 sorts first
        freq = np.repeat(np.where(told, _FREQUENT, times.astype(np.uint32)), times).astype(np.uint32)
        shared = (freq > 1) & (sig != 0)
        yield from _to_sets(gram[shared] | np.uint64(number[key] << 48), sig[shared], freq[shared], keys, "grams")

    return lambda table: pa.Table.from_batches(list(batches(rows(table), _TO_SET)), _TO_SET)


def _sets(percent: int):
    """A row block: sets with enough shared shingles, rarest first, and how many of those a partner must meet."""

    def rows(table: pa.Table) -> Iterator[dict]:
        own_sig, own_size = _set_sizes(table)
        entries = table.filter(table.column("grams").is_valid())
        gram, freq = _joined(entries, "grams", np.uint64), _joined(entries, "freqs", np.uint32)
        sig = np.repeat(_joined(entries, "sigs", np.uint64), _joined(entries, "counts", np.uint8))
        order = np.lexsort((gram, sig))
        if len(order):  # copies in several flushes send a frequent shingle each
            g, x = gram[order], sig[order]
            order = order[np.concatenate([[True], (g[1:] != g[:-1]) | (x[1:] != x[:-1])])]
        starts = runs(sig[order])
        shared = np.diff(np.append(starts, len(order)))
        size = own_size[np.searchsorted(own_sig, sig[order][starts])].astype(np.int64)
        needed = -(-percent * size // 100)
        kept = shared >= needed
        for a, n, m, need in zip(starts[kept], shared[kept], size[kept], needed[kept], strict=True):
            own = order[a : a + n]
            own = own[np.lexsort((gram[own], freq[own]))]
            yield {"sig": int(sig[own[0]].astype(np.int64)), "size": int(m), "n_prefix": int(n - need + 1), "grams": packed(gram[own])}
        yield from _documents(table)

    return lambda table: pa.Table.from_batches(list(batches(rows(table), _SETS)), _SETS)


def _postings(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        for sig, n, grams in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            own = np.frombuffer(grams, np.int64)[:n]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(n, sig, np.int64))], ["gram", "sig"])


def _telling(postings: DataFrame) -> DataFrame:
    """The postings of one shingle for each list of sets that occurs, of lists of several sets; near copies share dozens of shingles that tell the same.

    Lists are equal if their lengths, ends and the combined 64-bit hashes of their sets are.
    """
    lists = postings.groupBy("gram").agg(F.count("*").alias("n"), F.min("sig").alias("low"), F.max("sig").alias("high"), F.bit_xor(F.xxhash64("sig")).alias("mark"))
    lists = written(lists.where("n > 1"))
    often = [r[0] for r in lists.where(F.col("n") > max(LEAST_HOT, int(postings.count() * HOT_SHARE))).select("gram").collect()]
    chosen = lists.groupBy("n", "low", "high", "mark").agg(F.min("gram").alias("gram")).select("gram")
    return written(spread_join(postings, chosen, "gram", often).select("gram", "sig"))


def _links(left: list[np.ndarray], right: list[np.ndarray] | None, n: np.ndarray, m: np.ndarray, percent: int, columns: int = 2048) -> np.ndarray:
    """Boolean matrix of the linked pairs: overlaps accumulate over blocks of columns, hopeless rows leave early."""
    needed = -(-percent * (n[:, None] + m[None, :]) // (100 + percent))
    alive = np.minimum(n[:, None], m[None, :]) >= needed
    both = left if right is None else left + right
    gram = np.concatenate(both)
    row = np.repeat(np.arange(len(both)), [len(x) for x in both])
    distinct, column, times = np.unique(gram, return_inverse=True, return_counts=True)
    kept = times[column] > 1
    row, column = row[kept], np.unique(column[kept], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = int(column[-1]) + 1 if len(column) else 0
    found = np.zeros((len(n), len(m)), np.float32)
    rest = np.bincount(row, minlength=len(both)).astype(np.float32)
    for start in range(0, width, columns):
        a, b = np.searchsorted(column, [start, start + columns])
        block = np.zeros((len(both), min(columns, width - start)), np.float32)
        block[row[a:b], column[a:b] - start] = 1
        x, y = (block, block) if right is None else (block[: len(left)], block[len(left) :])
        open_x, open_y = alive.any(1), alive.any(0)
        if not open_x.any():
            break
        found[np.ix_(open_x, open_y)] += x[open_x] @ y[open_y].T
        rest -= block.sum(1)
        rx, ry = (rest, rest) if right is None else (rest[: len(left)], rest[len(left) :])
        alive &= found + np.minimum(rx[:, None], ry[None, :]) >= needed
    return alive & (found >= needed)


def _forest(linked: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """A spanning star of each component of a symmetric boolean matrix."""
    label = np.arange(len(ids))
    while True:
        lower = np.minimum(label, np.where(linked, label[None, :], len(ids)).min(1))
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    return [(int(ids[i]), int(ids[j])) for i, j in enumerate(label) if i != j]


def _product(percent: int):
    def edges(table: pa.Table) -> Iterator[tuple[int, int]]:
        group = np.array(table.column("group").to_pylist(), np.int64)
        right = np.array(table.column("right").to_pylist(), bool)
        sig, size = np.array(table.column("sig").to_pylist(), np.int64), np.array(table.column("size").to_pylist(), np.int64)
        grams = [np.frombuffer(x, np.uint64) for x in table.column("grams").to_pylist()]
        order = np.lexsort((sig, right, group))
        starts = runs(group[order])
        for a, b in stretches(starts, len(order)):
            x, y = order[a:b][~right[order[a:b]]], order[a:b][right[order[a:b]]]
            if not len(x) or (len(x) < 2 and not len(y)):
                continue
            if len(y):
                linked = _links([grams[i] for i in x], [grams[i] for i in y], size[x], size[y], percent)
                square = np.zeros((b - a, b - a), bool)
                square[: len(x), len(x) :] = linked
                square[len(x) :, : len(x)] = linked.T
                yield from _forest(square, sig[np.concatenate([x, y])])
            else:
                yield from _forest(_links([grams[i] for i in x], None, size[x], size[x], percent), sig[x])

    def run(table: pa.Table) -> pa.Table:
        found = list(edges(table))
        return pa.table([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], schema=_EDGES)

    return run


def _with_hub(percent: int):
    """Rows in the order of (hub, part), each hub's own set first: the sets that link with their hub."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, n = np.zeros(0, np.uint64), 0
        for batch in source:
            hubs, others = [], []
            for hub, member, sig, size, grams in zip(*(batch.column(x).to_pylist() for x in ("hub", "member", "sig", "size", "grams")), strict=True):
                own = np.frombuffer(grams, np.uint64)
                if not member:
                    head, n = np.sort(own), size
                elif 100 * min(n, size) >= percent * max(n, size):
                    at = np.searchsorted(head, own)
                    both = int((head[np.minimum(at, len(head) - 1)] == own).sum())
                    if 100 * both >= percent * (n + size - both):
                        hubs.append(hub)
                        others.append(sig)
            yield pa.RecordBatch.from_arrays([pa.array(hubs, pa.int64()), pa.array(others, pa.int64())], schema=_EDGES)

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(src, dst): the pairs (hub, sig) that link. A hub of many pairs is copied once for each hundred of them or so."""
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count("*") / _HUB_ROWS).cast("int").alias("parts"))
    busy = hot_keys(pairs, "hub")
    dealt = spread_join(pairs, sizes, "hub", busy).select("hub", F.pmod(F.hash("sig"), F.col("parts")).alias("part"), "sig")
    members = dealt.join(sets, "sig").select("hub", "part", F.lit(True).alias("member"), "sig", "size", "grams")
    heads = sets.join(sizes.withColumnRenamed("hub", "sig"), "sig").select(F.col("sig").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("member"), "sig", "size", "grams")
    met = members.union(heads).repartition("hub", "part").sortWithinPartitions("hub", "part", "member")
    return met.mapInArrow(_with_hub(percent), "src bigint, dst bigint")


def _labelled(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """(gram, sig, c): c is the component that the set is in so far, maybe by itself."""
    own = labels.select(F.col("node").alias("sig"), "component")
    return postings.join(own, "sig", "left").select("gram", "sig", F.coalesce("component", "sig").alias("c"))


def _open(marked: DataFrame, turn: int) -> DataFrame:
    """(gram, n, hub) of each shingle whose sets are in several components; the hub is one of its sets, another one in every turn."""
    hub = F.min_by(F.struct("sig", "c"), F.struct(F.xxhash64("sig", F.lit(turn)), "sig"))
    found = marked.groupBy("gram").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n"), hub.alias("hub"))
    return written(found.where("low < high").select("gram", "n", "hub"))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: these join components, so only as many rows as there are links go through the rounds."""
    own = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"{end}_c"))
    ends = links.join(own("src"), "src", "left").join(own("dst"), "dst", "left").select("src", "dst", F.coalesce("src_c", "src").alias("a"), F.coalesce("dst_c", "dst").alias("b"))
    ends = written(ends.where("a <> b"))
    if ends.isEmpty():
        return labels
    joined = connected_components(ends, "a", "b").select(F.col("node").alias("was"), F.col("component").alias("now"))
    nodes = labels.union(ends.select("src", "a")).union(ends.select("dst", "b")).toDF("node", "was").distinct()
    return written(spread_join(nodes, joined, "was", hot_keys(labels, "component"), "left").select("node", F.coalesce("now", "was").alias("component")))


def _links_of_sets(sets: DataFrame, percent: int, block_rows: int) -> DataFrame:
    """(node, component) of the sets that link with others."""
    postings = _telling(written(sets.select("sig", "n_prefix", "grams").mapInArrow(_postings, "gram bigint, sig bigint")))
    often = hot_keys(postings, "gram")
    marked = postings.withColumn("c", F.col("sig"))
    labels = postings.select(F.col("sig").alias("node"), F.col("sig").alias("component")).limit(0)
    for turn in range(HUB_TURNS + 1):
        left = _open(marked, turn)
        todo = left.where(F.col("n") > RARE) if turn else left
        if turn == HUB_TURNS or todo.isEmpty():
            break
        pairs = written(spread_join(marked, todo.select("gram", "hub"), "gram", often).where("c <> hub.c").select("hub.sig", "sig").toDF("hub", "sig").distinct())
        links = written(_verified(pairs, sets, percent))
        labels = _merged(labels, links) if turn else connected_components(links)
        marked = written(_labelled(postings, labels))
    if left.isEmpty():
        return labels
    few = spread_join(marked, left.where(F.col("n") <= RARE).select("gram", "n"), "gram", often)
    held = few.groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("sig", "c"))).alias("own"))  # RARE entries at most
    both = held.select("own", F.posexplode("own").alias("at", "hub")).select("hub", F.explode(F.slice("own", F.col("at") + 2, F.size("own"))).alias("other"))
    pairs = written(both.where("hub.c <> other.c").select("hub.sig", "other.sig").toDF("hub", "sig").distinct())
    links = written(_verified(pairs, sets, percent))
    frequent = left.where(F.col("n") > RARE)
    if not frequent.isEmpty():
        hubs = spread_join(marked, frequent.select("gram", F.col("hub.sig").alias("hub")), "gram", often)
        groups = connected_components(hubs.select("sig", "hub").distinct(), "sig", "hub")
        known = marked.groupBy("sig").agg(F.min("c").alias("c"))
        links = links.union(written(_paired(sets.join(known, "sig"), groups, percent, block_rows).groupBy("task").applyInArrow(_with_cells(percent), "src bigint, dst bigint")))
    return _merged(labels, links)


def _paired(sets: DataFrame, groups: DataFrame, percent: int, block_rows: int) -> DataFrame:
    """Rows dealt to pairs of blocks.

    Sets of a group are split by size class (factor 100 / percent, so that links stay within neighbouring classes), by component (`unit`;
    those of less than block_rows sets together, as unit 0) and by hash. Blocks of one unit other than 0 don't meet.
    """
    spark = sets.sparkSession
    factor = float(np.log(max(100 / percent, 1.0001)))
    member = written(sets.join(groups.select(F.col("node").alias("sig"), F.col("component").alias("group")), "sig").withColumn("class", F.floor(F.log("size") / F.lit(factor)).cast("int")))
    in_group = hot_keys(member, "group")
    large = member.groupBy("group", "c").agg(F.count("*").alias("n")).where(F.col("n") >= block_rows).select("c").distinct().withColumn("unit", F.col("c"))
    member = written(spread_join(member, large, "c", hot_keys(member, "c"), "left").withColumn("unit", F.coalesce("unit", F.lit(0))))
    cells = member.groupBy("group", "class", "unit").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / block_rows).cast("int"))
    shape = cells.groupBy("group").agg(F.sum("n").alias("n"), F.collect_list(F.struct("class", "unit", "parts")).alias("cells"))
    dealt = spread_join(member, shape, "group", in_group)
    mine = F.filter("cells", lambda x: (x["class"] == F.col("class")) & (x["unit"] == F.col("unit")))[0]["parts"]
    dealt = dealt.withColumn("part", F.pmod(F.hash("sig"), mine))
    small = dealt.where(F.col("n") <= block_rows)
    # Small groups share tasks: the pair of blocks is the group itself.
    bins = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1) * 4
    alone = small.select(F.pmod(F.hash("group"), F.lit(bins)).cast("bigint").alias("task"), "group", F.lit("").alias("cell"), F.lit(False).alias("right"), "sig", "size", "grams")
    near = F.filter("cells", lambda x: (F.abs(x["class"] - F.col("class")) <= 1) & ((x["unit"] != F.col("unit")) | (x["unit"] == 0)))
    own = F.struct("class", "unit", F.col("part").alias("part"))
    name = lambda x: F.concat_ws(",", x["class"], x["unit"], x["part"])
    others = F.flatten(F.transform(near, lambda x: F.transform(F.sequence(F.lit(0), x["parts"] - 1), lambda p: F.struct(x["class"].alias("class"), x["unit"].alias("unit"), p.alias("part")))))
    to = F.transform(others, lambda o: F.struct(F.concat_ws(":", name(F.least(own, o)), name(F.greatest(own, o))).alias("cell"), (own > o).alias("right")))
    spread = dealt.where(F.col("n") > block_rows).withColumn("to", F.explode(to))
    spread = spread.select(F.xxhash64("group", "to.cell").alias("task"), "group", F.col("to.cell").alias("cell"), F.col("to.right").alias("right"), "sig", "size", "grams")
    return alone.union(spread)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, block_rows: int = 256) -> DataFrame:
    """(id, n_shingles, component_id) for every row of docs.

    Two rows link when 100 * |intersection| >= percent * |union| of their shingle sets; component_id is the
    smallest id that links reach. Null and empty texts have no shingles, link with nothing and are their own
    component. Repeated rows, and ids that occur twice, are separate rows of the result. A null id takes part in
    links, but never names a component that has another id; other columns are ignored. An empty table gives an empty result; very
    long texts are handled whole, their shingles in memory one text at a time.
    """
    spark = docs.sparkSession
    ship(spark)
    keys = even_keys(spark)
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    blocks = source.mapInArrow(_blocks(keys, width), _BLOCK_SQL)
    counted = blocks.groupBy("key").applyInArrow(_count(keys), _SET_SQL)
    held = written(counted.groupBy("key").applyInArrow(_sets(percent), _SETS_SQL))
    rows = held.where("ids is not null").select(F.explode(F.arrays_zip("ids", "doc_sizes", "doc_sigs")).alias("x")).select(F.col("x.ids").alias("id"), F.col("x.doc_sizes").alias("n_shingles"), F.col("x.doc_sigs").alias("sig"))
    sets = held.where("ids is null").select("sig", "size", "n_prefix", "grams")
    linked = _links_of_sets(sets, percent, block_rows)
    worded = rows.where("n_shingles > 0")
    common = hot_keys(worded, "sig")
    least = worded.groupBy("sig").agg(F.min("id").alias("least"))
    named = written(least.join(linked.select(F.col("node").alias("sig"), "component"), "sig", "left").select("sig", "least", F.coalesce("component", "sig").alias("component")))
    lowest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_sig = spread_join(named, lowest, "component", hot_keys(named, "component")).select("sig", "component_id")
    found = spread_join(worded, of_sig, "sig", common, "left").select("id", "n_shingles", "component_id")
    return found.union(rows.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))).withColumnRenamed("id", id_col)


def _with_cells(percent: int):
    """A task holds small groups, or pairs of blocks whose hash is the task; each pair is multiplied by itself."""
    product = _product(percent)

    def run(table: pa.Table) -> pa.Table:
        names = [f"{g}/{c}" for g, c in zip(table.column("group").to_pylist(), table.column("cell").to_pylist(), strict=True)]
        number = {x: i for i, x in enumerate(dict.fromkeys(names))}
        return product(table.set_column(table.schema.get_field_index("group"), "group", pa.array([number[x] for x in names], pa.int64())))

    return run
