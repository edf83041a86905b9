"""Approximate nearest neighbours by cross-polytope hashing.

Each table rotates unit vectors pseudo-randomly (sign flips and fast Hadamard transforms, three times) and puts a vector into
the cell of its nearest signed axis; `hashes` rotations in a row make finer cells. A query probes the cells of its
nearest axes in every table. How fine the cells are follows from the number of rows, how many a query probes from the recall
that a sample of queries has against brute force; so the share of the index that is scored falls as the index grows.

Cells are split into blocks of bounded size, on the side of the queries and of the index; a block's task scores its pairs on the
original vectors in double precision, once more in a fixed order for those near the best, and passes on each query's
best. A cell with a blocks of index rows and b of queries sends its rows b and a times; with cells of about
`CELL_ROWS` rows both are few. Where the queries are rows of the index, of equal vectors only the k + 1 with the smallest ids can be
among anyone's k nearest, and only these stay in it, so a vector that a third of all rows share costs no more than others. A query whose
cells held fewer than k vectors is ranked against the whole index, in blocks of the same size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.session import settled, ship

#: Index rows that a cell should hold: a probe costs about as much as scoring so many.
CELL_ROWS = 500
#: Cells that a query of the sample is followed to, with two hashes or more.
_FARTHEST = 2048
_CELLS = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("query", pa.bool_()), ("vector", pa.binary()), ("cells", pa.list_(pa.int64()))])
_CELLS_SQL = "row bigint, id bigint, query boolean, vector binary, cells array<bigint>"
_FOUND = pa.schema([("asking", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
_FOUND_SQL = "asking bigint, query_id bigint, row bigint, vec_id bigint, score double"
_NEAR = pa.schema([("asking", pa.int64()), ("score", pa.float64()), ("vec_id", pa.int64()), ("vector", pa.list_(pa.float64()))])


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two, scaled to keep lengths."""
    n = x.shape[1]
    step = 1
    while step < n:
        y = x.reshape(len(x), n // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """Pseudo-rotation: rows padded to a power of two, three rounds of random signs and a Hadamard transform."""
    width = 1 << max(0, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    signs = np.random.default_rng(seed)
    for _ in range(3):
        x = hadamard(x * signs.choice([-1.0, 1.0], width))
    return x


def cells(x: np.ndarray, table: int, hashes: int, probes: int, seed: int) -> np.ndarray:
    """The `probes` nearest cells of each row in one table, best first; 1 gives the row's own cell."""
    n = len(x)
    axes, costs = [], []
    for k in range(hashes):
        y = rotated(x, seed + 1000 * table + k)
        both = np.concatenate([y, -y], 1)
        take = min(probes, both.shape[1])
        best = np.argsort(-both, axis=1, kind="stable")[:, :take]
        value = np.take_along_axis(both, best, 1)
        axes.append(best)
        costs.append((value[:, :1] - value) ** 2)
    span = both.shape[1]
    if hashes == 1:
        return axes[0]
    # The cheapest combinations lie among those whose ranks multiply to at most `probes`.
    combos = [c for c in product(*(range(a.shape[1]) for a in axes)) if np.prod([i + 1 for i in c]) <= probes]
    cost = np.stack([sum(costs[k][:, i] for k, i in enumerate(c)) for c in combos], 1)
    code = np.stack([sum(axes[k][:, i] * span**k for k, i in enumerate(c)) for c in combos], 1)
    return np.take_along_axis(code, np.argsort(cost, axis=1, kind="stable")[:, :probes], 1).reshape(n, -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that tiny and huge ones neither vanish nor overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hashed(tables: int, hashes: int, probes: int, seed: int):
    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in source:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                query = np.asarray(batch.column(2))
                x = _matrix(batch.column(3))
                u, n = unit(x), len(x)
                found: list[list[int]] = [[] for _ in range(n)]
                for t in range(tables):
                    # An index row visits its own cell alone.
                    for mine, many in ((np.flatnonzero(~query), 1), (np.flatnonzero(query), probes)):
                        if len(mine):
                            for i, own in zip(mine.tolist(), (cells(u[mine], t, hashes, many, seed) + (np.int64(t) << np.int64(48))).tolist(), strict=True):
                                found[i] += own
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(found, pa.list_(pa.int64()))], schema=_CELLS)

    return rows


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows, from their bytes or from arrays of doubles."""
    if pa.types.is_binary(column.type):
        return np.array([np.frombuffer(b, np.float64) for b in column.to_pylist()])
    flat = pc.list_flatten(column)
    return np.asarray(flat, np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def exact_scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, summed from the first component to the last whatever else is in the block."""
    total = np.zeros(len(x))
    with np.errstate(over="ignore", invalid="ignore"):
        for j in range(x.shape[1]):
            total += x[:, j] * y[:, j]
    return np.where(np.isnan(total), -np.inf, total)


def _ranked(k: int, by_id: bool):
    """A block: each query's k best of the block's vectors, by score, then by id and row. by_id: rows of the query's id are no candidates."""

    def run(table: pa.Table) -> pa.Table:
        query, rows, ids = np.asarray(table.column("query")), np.asarray(table.column("row")), np.asarray(table.column("id"))
        index, asked = np.flatnonzero(~query), np.flatnonzero(query)
        if not len(index) or not len(asked):
            return _FOUND.empty_table()
        index = index[np.lexsort((rows[index], ids[index]))]
        x = _matrix(table.column("vector"))
        own, theirs = x[asked], x[index]
        with np.errstate(over="ignore", invalid="ignore"):
            rough = own @ theirs.T
            # Sums in another order differ by less than this.
            slack = 4 * x.shape[1] * np.finfo(float).eps * np.sqrt((own * own).sum(1) * (theirs * theirs).sum(1).max())
        allowed = ids[asked][:, None] != ids[index][None, :] if by_id else rows[asked][:, None] != rows[index][None, :]
        sure = np.isfinite(rough).all() and np.isfinite(slack).all()
        if sure and k < len(index):
            rough[~allowed] = -np.inf
            least = np.partition(rough, len(index) - k, axis=1)[:, len(index) - k]
            allowed &= rough >= (least - 2 * slack)[:, None]
        i, j = np.nonzero(allowed)
        score = exact_scores(own[i], theirs[j])
        order = np.lexsort((j, -score, i))
        i, j, score = i[order], j[order], score[order]
        first = np.searchsorted(i, i)
        kept = np.arange(len(i)) - first < k
        i, j, score = asked[i[kept]], index[j[kept]], score[kept]
        return pa.table([pa.array(rows[i]), pa.array(ids[i]), pa.array(rows[j]), pa.array(ids[j]), pa.array(score)], schema=_FOUND)

    return run


def _nearest_to(asking: np.ndarray, wanted: np.ndarray, k: int):
    """For a few vectors, the k best of each batch with their vectors."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in source:
            for a in range(0, whole.num_rows, 4096):
                batch = whole.slice(a, 4096)
                rows, ids, x = np.asarray(batch.column(0)), np.asarray(batch.column(1)), _matrix(batch.column(2))
                with np.errstate(over="ignore", invalid="ignore"):
                    score = np.nan_to_num(wanted @ x.T, nan=-np.inf, posinf=np.finfo(float).max)
                score[asking[:, None] == rows[None, :]] = -np.inf
                best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                i, j = np.repeat(np.arange(len(asking)), best.shape[1]), best.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(asking[i]), pa.array(score[i, j]), pa.array(ids[j]), pa.array(x[j].tolist(), pa.list_(pa.float64()))], schema=_NEAR)

    return run


def probes_needed(asked: np.ndarray, near: np.ndarray, tables: int, hashes: int, seed: int, most: int) -> np.ndarray:
    """For each pair of rows, how many cells the first must probe in every table to meet the second in one; most + 1 if `most` aren't enough."""
    needed = np.full(len(asked), most + 1)
    distinct, at = np.unique(asked, axis=0, return_inverse=True)
    for t in range(tables):
        probed = cells(unit(distinct), t, hashes, most, seed)
        own = cells(unit(near), t, hashes, 1, seed)[:, 0]
        for i, place in enumerate(at.ravel()):
            met = np.flatnonzero(probed[place] == own[i])
            if len(met):
                needed[i] = min(needed[i], met[0] + 1)
    return needed


def _fitted(base: DataFrame, asked: DataFrame, n: int, width: int, k: int, tables: int, recall: float, sample: int, seed: int) -> tuple[int, int]:
    """(hashes, probes): of those that reach `recall` on at most `sample` queries (by a hash of their row), the cheapest for n rows."""
    chosen = asked.orderBy(F.xxhash64("row"), "row").limit(sample).select("row", "vector").collect()
    wanted = np.array([r["vector"] for r in chosen], np.float64).reshape(len(chosen), -1)
    asking = np.array([r["row"] for r in chosen], np.int64)
    near = base.select("row", "id", "vector").mapInArrow(_nearest_to(asking, wanted, k), "asking bigint, score double, vec_id bigint, vector array<double>")
    order = Window.partitionBy("asking").orderBy(F.desc("score"), "vec_id")
    pairs = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("asking", "vector").collect()  # sample * k rows at most
    place = {r: i for i, r in enumerate(asking.tolist())}
    x, y = wanted[[place[r["asking"]] for r in pairs]], np.array([r["vector"] for r in pairs], np.float64).reshape(len(pairs), -1)
    span = 2 << max(0, (width - 1).bit_length())
    fine = max(1, round(np.log(max(1, n / CELL_ROWS)) / np.log(span))) if span > 2 else 1
    found = None
    for hashes in {1, fine}:
        most = span if hashes == 1 else min(_FARTHEST, span**hashes)
        needed = np.sort(probes_needed(x, y, tables, hashes, seed, most)) if len(x) else np.ones(1, int)
        probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))])
        cost = probes * (n / span**hashes + CELL_ROWS)
        if probes <= most and (found is None or cost < found[0]):
            found = cost, hashes, probes
    return found[1:]


def neighbours(vectors: DataFrame, queries: DataFrame | None = None, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = 8, hashes: int | None = None, probes: int | None = None, recall: float = 0.95, sample: int = 100, block_rows: int = 512, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found by inner product, ties to the smaller id.

    queries has the columns of vectors (none: every row whose id is divisible by 20, which is no candidate of its own; a
    row of a table of queries has no candidates of its id). Vectors that are null, empty or zero, or hold a null or non-finite component,
    take no part, nor do null ids. Rows that share an id are separate candidates and separate queries. Sums that overflow count as
    infinite, those of opposite infinities as the least. Vectors of different lengths raise ValueError; their length may be any. Every
    query gets k rows, or all candidates if there are fewer; an empty table gives an empty result. Columns other than the two don't matter.

    hashes, probes: the fineness of the cells, (2 d) ** hashes of them in a table of d dimensions (padded to a power of two), and what
    each query visits in each table. Where one isn't given, both are chosen so that a sample of at most `sample` queries finds the share
    `recall` of its true neighbours, which are searched in the whole index.
    """
    ship(vectors.sparkSession)

    def clean(df: DataFrame, row) -> DataFrame:
        v = F.col("vector")
        sound = F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        own = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(sound)
        return settled(own.select(row.alias("row"), "id", "vector"))

    base = clean(vectors, F.monotonically_increasing_id())
    asked = base.where("id % 20 = 0") if queries is None else clean(queries, -1 - F.monotonically_increasing_id())
    shape = base.select("vector", F.lit(1).alias("one")).union(asked.select("vector", F.lit(0))).agg(F.sum("one").alias("n"), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("width")).first()
    n, width = shape["n"] or 0, shape["width"]
    if n and shape["least"] != width:
        raise ValueError(f"vectors differ in length: {shape['least']} to {width}")
    if not n or asked.isEmpty():
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if hashes is None or probes is None:
        hashes, probes = _fitted(base, asked, n, width, k, tables, recall, sample, seed)
    by_id = queries is not None
    copies = Window.partitionBy("vector").orderBy("id", "row")
    index = base if by_id else base.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy")
    index, asked = index.select("row", "id", F.lit(False).alias("query"), "vector"), asked.select("row", "id", F.lit(True).alias("query"), "vector")
    held = settled(index.union(asked).mapInArrow(_hashed(tables, hashes, probes, seed), _CELLS_SQL))
    visits = held.select("row", "id", "query", "vector", F.explode("cells").alias("cell"))
    full = held.select("query", F.explode("cells").alias("cell")).groupBy("cell").agg(F.count_if(~F.col("query")).alias("n_index"), F.count_if("query").alias("n_query"))
    parts = full.where("n_index > 0 and n_query > 0").select("cell", F.ceil(F.col("n_index") / block_rows).cast("int").alias("index_parts"), F.ceil(F.col("n_query") / block_rows).cast("int").alias("query_parts"))
    span = 2 << max(0, (width - 1).bit_length())
    if tables * span**hashes <= 200_000:  # so many rows at most
        parts = F.broadcast(parts)
    ranked = settled(_best(_in_blocks(visits.join(parts, "cell"), k, by_id), k))
    counted = ranked.groupBy(F.col("asking").alias("row")).agg(F.count("*").alias("n"))
    lacking = asked.select("row", "id").join(counted, "row", "left").select("row", "id", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < k)
    if by_id:
        same = base.groupBy("id").agg(F.count("*").alias("same"))
        lacking = lacking.join(same, "id", "left").where(F.col("n") < n - F.coalesce("same", F.lit(0)))
    else:
        lacking = lacking.where(F.col("n") < n - 1)
    short = settled(lacking.select("row"))
    n_short = short.count()
    answer = ["query_id", "rank", "vec_id", "score"]
    if not n_short:
        return ranked.select(answer)
    # Short of k, but not of candidates: these meet every row of the index.
    every = held.where("not query").union(held.where("query").join(short, "row", "left_semi").select(held.columns)).drop("cells")
    sized = every.select("*", F.lit(0).cast("bigint").alias("cell"), F.lit(-(-n // block_rows)).alias("index_parts"), F.lit(-(-n_short // block_rows)).alias("query_parts"))
    rest = ranked.join(short.withColumnRenamed("row", "asking"), "asking", "left_anti").select(answer)
    return rest.union(_best(_in_blocks(sized, k, by_id), k).select(answer))


def _in_blocks(rows: DataFrame, k: int, by_id: bool) -> DataFrame:
    """The k best of each block of a cell's queries and index. rows: (row, id, query, vector, cell, index_parts, query_parts)."""
    dealt = rows.withColumn("part", F.pmod(F.hash("row"), F.when(F.col("query"), F.col("query_parts")).otherwise(F.col("index_parts"))))
    other = F.sequence(F.lit(0), F.when(F.col("query"), F.col("index_parts")).otherwise(F.col("query_parts")) - 1)
    blocks = dealt.withColumn("other", F.explode(other)).select("cell", F.when(F.col("query"), F.col("other")).otherwise(F.col("part")).alias("i"), F.when(F.col("query"), F.col("part")).otherwise(F.col("other")).alias("j"), "row", "id", "query", "vector")
    return blocks.groupBy("cell", "i", "j").applyInArrow(_ranked(k, by_id), _FOUND_SQL)


def _best(found: DataFrame, k: int) -> DataFrame:
    """Ranks within each query; a row that several cells found counts once."""
    order = Window.partitionBy("asking").orderBy(F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k)
    return ranked.dropDuplicates(["asking", "rank"]).select("asking", "query_id", "rank", "vec_id", "score")
