"""Hierarchical density clusters of weighted points: core distances, a minimum spanning tree, a condensed tree and its most stable clusters.

Points are dealt to blocks around pivots. Blocks ask only those other blocks that the triangle inequality can't rule out: for core distances those
nearer than the farthest neighbour found in the block itself, for the tree those nearer than the bottleneck of a path over the pivots. Each pair of
blocks gives the minimum spanning tree of its own points under mutual reachability; an edge that isn't in it is the longest of a
cycle and can't be in the whole tree, so the union of these trees holds the exact one, and rounds over parts of it drop the rest by the same rule.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.functions.scalars import rounded
from fieldbook.session import settled, ship, written

#: Points of a block; distinct points that a tree may have, since the condensed tree is walked in one task.
BLOCK, MOST_POINTS = 1024, 2_000_000
#: Edges whose forest one task finds.
EDGES = 1_000_000
_EDGE = "a bigint, b bigint, d double"


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed dimension by dimension, so that equal points have distance 0 and both orders agree."""
    out = np.zeros((len(x), len(y)))
    for k in range(x.shape[1]):
        out += (x[:, k, None] - y[None, :, k]) ** 2
    return np.sqrt(out)


def _blocks(points: DataFrame, key: str, weight: str, vector: str, block: int) -> DataFrame:
    """(block, pivot, radius, weight, ids, w, v): packed points near each pivot; crowded pivots have several blocks."""
    own = settled(points.select(F.col(key).cast("bigint").alias("id"), F.col(weight).cast("double").alias("w"), F.col(vector).alias("v")))
    n = own.count()
    if n > MOST_POINTS:
        raise ValueError(f"more than {MOST_POINTS} distinct points: bucket their columns")
    pivots = [r["v"] for r in own.orderBy(F.xxhash64("id"), "id").limit(max(1, -(-n // block))).select("v").collect()]
    centres = np.array(pivots, float).reshape(len(pivots), len(pivots[0]) if pivots else 1)

    def near(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            x = np.array(batch.column("v").to_pylist(), float).reshape(batch.num_rows, -1)
            for a in range(0, len(x), 2048):
                d = _distances(x[a : a + 2048], centres)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, 2048) for c in batch.columns), pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1))], ["id", "w", "v", "pivot", "r"])

    dealt = written(own.mapInArrow(near, "id bigint, w double, v array<double>, pivot int, r double"))
    parts = dealt.groupBy("pivot").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    dealt = dealt.join(F.broadcast(parts), "pivot").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))  # a row for each pivot

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        v = np.array(t["v"].to_pylist(), float)
        row = [key[0].as_py() * 4096 + key[1].as_py(), key[0].as_py(), max(t["r"].to_pylist()), sum(t["w"].to_pylist()), t["id"].to_numpy().tobytes(), t["w"].to_numpy().tobytes(), v.tobytes()]
        return pa.table({k: [x] for k, x in zip(("block", "pivot", "radius", "weight", "ids", "w", "v"), row, strict=True)})

    return written(dealt.groupBy("pivot", "part").applyInArrow(pack, "block bigint, pivot bigint, radius double, weight double, ids binary, w binary, v binary")), centres


def _array(x: bytes, width: int | None = None) -> np.ndarray:
    out = np.frombuffer(x, float)
    return out.reshape(-1, width) if width else out


def _neighbours(x: np.ndarray, y: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of y for each x: their distances and weights."""
    d = _distances(x, y)
    k = min(k, len(y))
    at = np.argpartition(d, k - 1, axis=1)[:, :k]
    return np.take_along_axis(d, at, 1), w[at]


def _core(d: np.ndarray, w: np.ndarray, least: float) -> np.ndarray:
    """The distance within which each row's neighbours weigh `least` (infinite where they never do)."""
    order = np.argsort(d, axis=1, kind="stable")
    d, w = np.take_along_axis(d, order, 1), np.cumsum(np.take_along_axis(w, order, 1), 1)
    return np.where(w[:, -1] >= least, d[np.arange(len(d)), np.minimum((w < least).sum(1), d.shape[1] - 1)], np.inf)


def _asked(blocks: DataFrame, asks: dict[int, list[int]]) -> DataFrame:
    """A row for each pair of blocks (columns of the first as they are, of the second with the suffix _o). asks: by block, whom it asks."""
    spark = blocks.sparkSession
    pairs = spark.createDataFrame([(a, b) for a, bs in asks.items() for b in bs], "block bigint, other bigint")
    return pairs.join(blocks, "block").join(blocks.select(F.col("block").alias("other"), *(F.col(c).alias(f"{c}_o") for c in blocks.columns if c != "block")), "other")


def _with_cores(blocks: DataFrame, centres: np.ndarray, samples: int) -> DataFrame:
    width = centres.shape[1]

    def own(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            reach = []
            for w, v in zip(batch.column("w").to_pylist(), batch.column("v").to_pylist(), strict=True):
                x = _array(v, width)
                reach.append(float(_core(*_neighbours(x, x, _array(w), samples), samples).max()))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("pivot"), batch.column("radius"), pa.array(reach)], ["block", "pivot", "radius", "reach"])

    facts = blocks.select("block", "pivot", "radius", "w", "v").mapInArrow(own, "block bigint, pivot bigint, radius double, reach double").collect()  # a row for each block
    between = _distances(centres, centres)
    pivot, radius, name = np.array([r["pivot"] for r in facts], int), np.array([r["radius"] for r in facts]), np.array([r["block"] for r in facts], int)
    low = between[pivot][:, pivot] - radius[:, None] - radius[None, :]
    asks = {int(name[i]): name[low[i] <= facts[i]["reach"] * (1 + 1e-12)].tolist() for i in range(len(facts))}

    def partial(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for r in batch.to_pylist():
                d, w = _neighbours(_array(r["v"], width), _array(r["v_o"], width), _array(r["w_o"]), samples)
                yield pa.RecordBatch.from_pydict({"block": [r["block"]], "d": [d.tobytes()], "w": [w.tobytes()], "k": [d.shape[1]]}, schema=pa.schema([("block", pa.int64()), ("d", pa.binary()), ("w", pa.binary()), ("k", pa.int32())]))

    def merged(key: tuple, t: pa.Table) -> pa.Table:
        d, w = (np.concatenate([_array(x, k) for x, k in zip(t[c].to_pylist(), t["k"].to_pylist(), strict=True)], 1) for c in ("d", "w"))
        return pa.table({"block": [key[0].as_py()], "core": [_core(d, w, samples).tobytes()]})

    found = _asked(blocks.select("block", "w", "v"), asks).mapInArrow(partial, "block bigint, d binary, w binary, k int")
    cores = written(found.groupBy("block").applyInArrow(merged, "block bigint, core binary"))
    return written(blocks.join(cores, "block"))


def _spanning(x: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The minimum spanning tree of some points under mutual reachability: ends and lengths."""
    n = len(x)
    best, by = np.full(n, np.inf), np.zeros(n, np.int64)
    open_ = np.ones(n, bool)
    a, b, d = np.zeros(max(0, n - 1), np.int64), np.zeros(max(0, n - 1), np.int64), np.zeros(max(0, n - 1))
    now = 0
    for i in range(n - 1):
        open_[now] = False
        reach = np.maximum(np.maximum(_distances(x[now : now + 1], x)[0], core), core[now])
        nearer = open_ & (reach < best)
        best[nearer], by[nearer] = reach[nearer], now
        now = int(np.where(open_, best, np.inf).argmin())
        if not open_[now]:
            now = int(open_.argmax())  # only infinite ways are left
        a[i], b[i], d[i] = by[now], now, best[now]
    return a, b, d


def spanning_tree(points: DataFrame, key: str, weight: str, vector: str, samples: int, block: int = BLOCK) -> DataFrame:
    """(a, b, d): the edges of a minimum spanning tree of the points under mutual reachability, max(core a, core b, distance).

    A point's core distance is that within which points, itself included, weigh `samples`; it is infinite where all weigh less.
    """
    ship(points.sparkSession)
    blocks, centres = _blocks(points, key, weight, vector, block)
    width = centres.shape[1]
    blocks = _with_cores(blocks, centres, samples)

    def reach(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            top = [float(_array(c).max()) for c in batch.column("core").to_pylist()]
            low = [float(_array(c).min()) for c in batch.column("core").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("pivot"), batch.column("radius"), pa.array(top), pa.array(low)], ["block", "pivot", "radius", "top", "low"])

    facts = blocks.select("block", "pivot", "radius", "core").mapInArrow(reach, "block bigint, pivot bigint, radius double, top double, low double").collect()  # a row for each block
    between = _distances(centres, centres)
    largest = max((r["top"] for r in facts), default=0.0)
    # Between two points there is a way over their pivots and the pivots' own tree, no step of it longer than this.
    worst = between * 0
    a, b, d = _spanning(centres, np.full(len(centres), largest))
    seen = [0]
    for i, j, x in zip(a.tolist(), b.tolist(), d.tolist(), strict=True):
        worst[j, seen] = worst[seen, j] = np.maximum(worst[i, seen], x)
        seen.append(j)
    pivot, radius, name = np.array([r["pivot"] for r in facts], int), np.array([r["radius"] for r in facts]), np.array([r["block"] for r in facts], int)
    low = np.maximum(between[pivot][:, pivot] - radius[:, None] - radius[None, :], np.maximum.outer(*[np.array([r["low"] for r in facts])] * 2))
    way = np.maximum(np.maximum(worst[pivot][:, pivot], np.maximum.outer(radius, radius)), largest)
    asks = {int(name[i]): name[(low[i] <= way[i] * (1 + 1e-12)) & (name >= name[i])].tolist() for i in range(len(facts))}

    def trees(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for r in batch.to_pylist():
                ids, x, core = np.frombuffer(r["ids"], np.int64), _array(r["v"], width), _array(r["core"])
                if r["block"] != r["other"]:
                    ids, x, core = np.concatenate([ids, np.frombuffer(r["ids_o"], np.int64)]), np.concatenate([x, _array(r["v_o"], width)]), np.concatenate([core, _array(r["core_o"])])
                i, j, d = _spanning(x, core)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j])), pa.array(d)], ["a", "b", "d"])

    edges = _asked(blocks.select("block", "ids", "v", "core"), asks).select("block", "other", "ids", "v", "core", "ids_o", "v_o", "core_o").mapInArrow(trees, _EDGE)
    if len(facts) <= 1:
        return written(edges)
    return shortest_edges(edges)


def _forest(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of the edges of a minimum spanning forest (equal lengths: smaller ends first)."""
    order = np.lexsort((b, a, d))
    ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(ends)))
    left, right = at[: len(a)][order].tolist(), at[len(a) :][order].tolist()
    kept = []
    for k, i, j in zip(order.tolist(), left, right, strict=True):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        while parent[j] != j:
            parent[j] = j = parent[parent[j]]
        if i != j:
            parent[i] = j
            kept.append(k)
    return np.array(kept, np.int64)


def shortest_edges(edges: DataFrame, at_once: int = EDGES) -> DataFrame:
    """The minimum spanning forest of a graph's edges (a, b, d), written.

    Edges are dealt to parts; an edge outside its part's forest is the longest of a cycle and goes. What is left is dealt again, to fewer parts, until one is
    enough, or until dealing no longer helps (the forest alone is larger than at_once): then the rest is one part, no larger than some forests.
    """

    def part(key: tuple, t: pa.Table) -> pa.Table:
        return t.select(["a", "b", "d"]).take(pa.array(_forest(*(t[c].to_numpy() for c in ("a", "b", "d")))))

    left = written(edges.distinct())
    n = left.count()
    while True:
        parts = -(-n // at_once)
        left = written(left.withColumn("_p", F.pmod(F.xxhash64("a", "b"), F.lit(max(1, parts)))).groupBy("_p").applyInArrow(part, _EDGE))
        if parts <= 1:
            return left
        before, n = n, left.count()
        if 2 * n > before:
            at_once = n


def stable_clusters(ids: np.ndarray, weights: np.ndarray, a: np.ndarray, b: np.ndarray, d: np.ndarray, least: float) -> np.ndarray:
    """The cluster of each point (0, 1, ... by the smallest id in it; -1 for noise) from a spanning tree's edges.

    Edges are taken away from the longest on. A part that weighs less than `least` falls out of its cluster; two that don't are new clusters.
    A cluster's stability sums, over what it holds, the density 1 / d from its birth until that falls out or the cluster parts; the most stable
    clusters none of which holds another are taken, never the whole. A point as heavy as a cluster stays one at any density.
    """
    n = len(ids)
    order = np.lexsort((b, a, d))
    at = {int(x): i for i, x in enumerate(ids)}
    parent, size = list(range(2 * n - 1)), [*weights.tolist(), *[0.0] * (n - 1)]
    sons: list[tuple[int, int, float]] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k in order.tolist():
        i, j = find(at[int(a[k])]), find(at[int(b[k])])
        new = n + len(sons)
        parent[i] = parent[j] = new
        size[new] = size[i] + size[j]
        sons.append((i, j, float(d[k])))
    labels = np.full(n, -1)
    if not sons:
        return labels
    density = lambda x: 1 / x if x > 0 else math.inf
    born, stability, children, held = [0.0], [0.0], [[]], [[]]  # by cluster; 0 is the whole

    def points(node: int) -> Iterator[int]:
        todo = [node]
        while todo:
            x = todo.pop()
            if x < n:
                yield x
            else:
                todo += sons[x - n][:2]

    def gone(cluster: int, weight: float, at_density: float) -> None:
        if at_density > born[cluster]:
            stability[cluster] += weight * (at_density - born[cluster])

    # Edges of one length take parts away together: a part's ways of that length are followed first.
    todo = [(2 * n - 2, 0)]
    while todo:
        node, cluster = todo.pop()
        if node < n:
            gone(cluster, size[node], math.inf)
            held[cluster].append(node)
            continue
        at_d = sons[node - n][2]
        parts, open_ = [], [node]
        while open_:
            x = open_.pop()
            if x >= n and sons[x - n][2] == at_d:
                open_ += sons[x - n][:2]
            else:
                parts.append(x)
        large = [x for x in parts if size[x] >= least]
        for x in parts:
            if size[x] < least:
                gone(cluster, size[x], density(at_d))
                held[cluster] += points(x)
        if len(large) == 1:
            todo.append((large[0], cluster))
        for x in large if len(large) > 1 else ():
            gone(cluster, size[x], density(at_d))
            born.append(density(at_d))
            stability.append(0.0)
            children.append([])
            held.append([])
            children[cluster].append(len(born) - 1)
            todo.append((x, len(born) - 1))
    taken = [False] * len(born)
    best = list(stability)
    for c in range(len(born) - 1, -1, -1):  # children have larger numbers
        below = sum(best[x] for x in children[c])
        if c == 0 or (children[c] and below > stability[c]):
            best[c] = below
        else:
            taken[c] = True
    groups = []
    chosen = [0]
    while chosen:
        c = chosen.pop()
        if not taken[c]:
            chosen += children[c]
            continue
        inside, all_points = [c], []
        while inside:
            x = inside.pop()
            all_points += held[x]
            inside += children[x]
        groups.append(all_points)
    for k, group in enumerate(sorted(groups, key=lambda g: min(ids[i] for i in g))):
        labels[group] = k
    return labels


def density_clusters(points: DataFrame, key: str, weight: str, vector: str, least: float, samples: int = 20, block: int = BLOCK) -> DataFrame:
    """(key, cluster): the most stable density clusters of distinct weighted points (key: an integer), -1 for noise.

    least: the smallest weight of a cluster, no less than samples, the weight of neighbours that makes a core distance. The spanning tree is found
    in blocks and joins; its edges, one less than the points, of which there are MOST_POINTS at most, are condensed in one task.
    """
    if least < samples:
        raise ValueError("a cluster must weigh as much as makes a core distance")
    tree = spanning_tree(points, key, weight, vector, samples, block).withColumn("w", F.lit(0.0))
    own = points.select(F.col(key).cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("b"), F.lit(0.0).alias("d"), F.col(weight).cast("double").alias("w"))

    def condensed(key: tuple, t: pa.Table) -> pa.Table:
        real = t["b"].is_valid().to_numpy()
        a, b, d, w = (t[c].fill_null(0).to_numpy() for c in ("a", "b", "d", "w"))  # nulls would make them floats
        order = np.argsort(a[~real])
        ids = a[~real][order]
        got = stable_clusters(ids, w[~real][order], a[real], b[real], d[real], least)
        return pa.table({"id": ids, "cluster": got.astype(np.int32)})

    got = own.unionByName(tree).groupBy(F.lit(0).alias("_g")).applyInArrow(condensed, "id bigint, cluster int")
    return got.select(F.col("id").alias(key), "cluster")


def vector_silhouette(points: DataFrame, key: str, weight: str, vector: str, cluster: str, block: int = BLOCK) -> DataFrame:
    """One row: n, clusters, noise_share and the mean silhouette of the weighted points that are in clusters (a cluster of weight 1: 0).

    Blocks meet blocks, and each pair sends back a sum for each point and cluster.
    """
    ship(points.sparkSession)
    own = settled(points.select(F.col(key).cast("bigint").alias("id"), F.col(weight).cast("double").alias("w"), F.col(vector).alias("v"), F.col(cluster).alias("c")))
    inside = own.where("c >= 0")
    parts = max(1, -(-inside.count() // block))

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        return pa.table({"part": [key[0].as_py()], "ids": [t["id"].to_numpy().tobytes()], "w": [t["w"].to_numpy().tobytes()], "c": [t["c"].to_numpy().astype(float).tobytes()], "v": [np.array(t["v"].to_pylist(), float).tobytes()], "width": [len(t["v"][0])]})

    packed = written(inside.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))).groupBy("part").applyInArrow(pack, "part bigint, ids binary, w binary, c binary, v binary, width bigint"))
    pairs = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(packed.select(F.col("part").cast("int").alias("other"), F.col("w").alias("w_o"), F.col("c").alias("c_o"), F.col("v").alias("v_o")), "other")

    def sums(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for r in batch.to_pylist():
                d = _distances(_array(r["v"], r["width"]), _array(r["v_o"], r["width"])) * _array(r["w_o"])
                names, at = np.unique(_array(r["c_o"]), return_inverse=True)
                total = np.stack([d[:, at == k].sum(1) for k in range(len(names))], 1)
                n = len(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.frombuffer(r["ids"], np.int64), len(names))), pa.array(np.tile(names, n).astype(np.int32)), pa.array(total.ravel())], ["id", "k", "d"])

    weighed = inside.groupBy(F.col("c").alias("k")).agg(F.sum("w").alias("m"))
    d = pairs.mapInArrow(sums, "id bigint, k int, d double").groupBy("id", "k").agg(F.sum("d").alias("d")).join(weighed, "k").join(inside.select("id", "w", "c"), "id")
    per = d.groupBy("id", "w").agg(F.max(F.when(F.col("k") == F.col("c"), F.try_divide("d", F.col("m") - 1))).alias("own"), F.min(F.when(F.col("k") != F.col("c"), F.col("d") / F.col("m"))).alias("other"))
    value = F.coalesce(F.try_divide(F.col("other") - F.col("own"), F.greatest("own", "other")), F.lit(0.0))
    mean = per.agg(F.try_divide(F.sum(value * F.col("w")), F.sum("w")).alias("s"))
    all_of = own.agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("c") >= 0, F.col("c"))).alias("clusters"), rounded(F.try_divide(F.sum(F.when(F.col("c") < 0, F.col("w")).otherwise(0.0)), F.sum("w")), 6).alias("noise_share"))
    return all_of.join(F.broadcast(mean.select(rounded(F.coalesce("s", F.lit(0.0)), 6).alias("silhouette"))))  # one row each
