"""Leaf-wise boosted trees over histograms, for two classes, many classes and numbers, with path-dependent Shapley values.

A tree that splits on binned features cannot tell rows of equal bins apart, so Spark sums the rows to cells first: one for each combination of
bins that occurs, with its rows and its labels. Gradients of a cell follow from these sums, so boosting over cells is boosting over all rows, and
what one fit holds is bounded by the number of cells, however many rows there are. Bins are as fine as the bound allows: a ladder
of resolutions is counted in one pass, and the finest within the bound is taken. Models of several folds are fitted side by side,
a task each.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.session import settled, ship

#: Bins of a feature besides the one of missing and unknown values, which is 0.
MOST_BINS = 254
#: Cells that a fit holds at most.
CELLS = 400_000
_LADDER = (254, 128, 64, 32, 16, 8, 4, 2)


@dataclass
class Binning:
    """How raw values become bins: the levels of each category, by falling frequency, and the upper edges of each number's bins."""

    categories: list[str]
    numbers: list[str]
    levels: dict[str, list[str]]
    edges: dict[str, list[float]]

    @property
    def names(self) -> list[str]:
        return [*self.categories, *self.numbers]

    def coarse(self, most: int) -> Binning:
        """The same with `most` bins at most for each feature; rarer levels become unknown, edges are thinned evenly."""
        thin = lambda e: [e[i] for i in sorted({round(k) for k in np.linspace(0, len(e) - 1, most - 1)})] if len(e) > most - 1 else e
        return Binning(self.categories, self.numbers, {c: v[:most] for c, v in self.levels.items()}, {c: thin(e) for c, e in self.edges.items()})

    def bins(self, batch: pa.RecordBatch | pa.Table) -> np.ndarray:
        """Rows of bins, one byte for each feature."""
        out = np.zeros((batch.num_rows, len(self.names)), np.uint8)
        for k, c in enumerate(self.categories):
            at = {v: i + 1 for i, v in enumerate(self.levels[c])}
            coded = batch.column(c).cast(pa.string()).dictionary_encode()
            coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
            table = np.array([at.get(v, 0) for v in coded.dictionary.to_pylist()] + [0], np.uint8)
            out[:, k] = table[coded.indices.fill_null(len(table) - 1).to_numpy(zero_copy_only=False)]
        for k, c in enumerate(self.numbers, len(self.categories)):
            x = batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
            out[:, k] = np.where(np.isnan(x), 0, 1 + np.searchsorted(np.array(self.edges[c]), x))
        return out


@dataclass
class Tree:
    """Nodes as arrays; a leaf is its own child. left: for each node and bin, whether the bin goes to the first child."""

    feature: np.ndarray
    left: np.ndarray
    first: np.ndarray
    second: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while True:
            inner = self.first[node] != node
            if not inner.any():
                return node
            node = np.where(self.left[node, x[rows, self.feature[node]]], self.first[node], self.second[node])

    def told(self) -> dict:
        return {"feature": self.feature.tolist(), "left": np.packbits(self.left, axis=1).tobytes().hex(), "first": self.first.tolist(), "second": self.second.tolist(), "value": self.value.tolist(), "cover": self.cover.tolist(), "gain": self.gain.tolist()}

    @staticmethod
    def of(d: Mapping) -> Tree:
        n = len(d["feature"])
        left = np.unpackbits(np.frombuffer(bytes.fromhex(d["left"]), np.uint8).reshape(n, 32), axis=1).astype(bool)
        return Tree(np.array(d["feature"], np.int64), left, np.array(d["first"], np.int64), np.array(d["second"], np.int64), np.array(d["value"], float), np.array(d["cover"], float), np.array(d["gain"], float))


@dataclass
class Boosted:
    """A fitted model. objective: binary, multiclass or regression; trees: a list for each round, with a tree for each output."""

    objective: str
    binning: Binning
    base: list[float]
    classes: list[str] = field(default_factory=list)
    trees: list[list[Tree]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sums of the trees for rows of bins, a column for each output."""
        out = np.tile(np.array(self.base), (len(x), 1))
        for turn in self.trees:
            for k, tree in enumerate(turn):
                out[:, k] += tree.value[tree.leaves(x)]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1, of each class, or numbers."""
        return _link(self.objective, self.raw(x))

    def gains(self) -> dict[str, float]:
        total = np.zeros(len(self.binning.names))
        for turn in self.trees:
            for tree in turn:
                np.add.at(total, tree.feature, tree.gain)
        return dict(zip(self.binning.names, total.tolist(), strict=True))

    def dumps(self) -> str:
        b = self.binning
        return json.dumps({"objective": self.objective, "classes": self.classes, "base": self.base, "categories": b.categories, "numbers": b.numbers, "levels": b.levels, "edges": b.edges, "trees": [[t.told() for t in turn] for turn in self.trees]})

    @staticmethod
    def loads(text: str) -> Boosted:
        d = json.loads(text)
        return Boosted(d["objective"], Binning(d["categories"], d["numbers"], d["levels"], d["edges"]), d["base"], d["classes"], [[Tree.of(t) for t in turn] for turn in d["trees"]])


def _link(objective: str, raw: np.ndarray) -> np.ndarray:
    if objective == "regression":
        return raw[:, 0]
    if objective == "binary":
        return 1 / (1 + np.exp(-raw[:, 0]))
    e = np.exp(raw - raw.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _splits(hist: np.ndarray, categorical: np.ndarray, allowed: np.ndarray, least: int, smooth: float, penalty: float) -> tuple[float, int, np.ndarray] | None:
    """The best split (gain, feature, bins that go first) of a node's histogram (gradients, hessians, rows by feature and bin).

    Numbers are cut in order, with missing values on either side; categories are cut in the order of their mean gradients.
    """
    bins = hist.shape[2]
    plain, cats = allowed[~categorical[allowed]], allowed[categorical[allowed]]
    order = np.arange(bins)
    ratio = np.where(hist[2, cats] > 0, hist[0, cats] / np.maximum(hist[1, cats] + smooth, 1e-12), np.inf)
    orders = np.concatenate([np.tile(order, (len(plain), 1)), np.tile(np.roll(order, -1), (len(plain), 1)), np.argsort(ratio, axis=1, kind="stable")])
    rows = np.concatenate([plain, plain, cats])
    g, h, n = (np.cumsum(np.take_along_axis(hist[k, rows], orders, 1), 1) for k in range(3))
    more = np.where(categorical[rows], penalty, 0.0)[:, None]
    total_g, total_h, total_n = g[:, -1:], h[:, -1:], n[:, -1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = g**2 / (h + more) + (total_g - g) ** 2 / (total_h - h + more) - total_g**2 / total_h
    fits = (n >= least) & (total_n - n >= least) & (h > 1e-3) & (total_h - h > 1e-3)
    gain = np.where(fits, gain, -np.inf)
    at = int(gain.argmax()) if gain.size else 0
    r, k = divmod(at, bins)
    if not gain.size or not gain[r, k] > 1e-9:
        return None
    left = np.zeros(256, bool)
    left[orders[r, : k + 1]] = True
    return float(gain[r, k]), int(rows[r]), left


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, n: np.ndarray, categorical: np.ndarray, allowed: np.ndarray, leaves: int, least: int, rate: float, smooth: float, penalty: float) -> tuple[Tree, np.ndarray]:
    """A tree over cells (x: bins by feature and cell), best leaf first, and the leaf of each cell."""
    width, bins = len(x), int(x.max(initial=0)) + 1
    shifted = x.astype(np.int64) + (np.arange(width) * bins)[:, None]

    def histogram(own: np.ndarray) -> np.ndarray:
        at = shifted[:, own].ravel()
        return np.stack([np.bincount(at, np.tile(v[own], width), width * bins).reshape(width, bins) for v in (g, h, n)])

    feature, left, first, second, gain = [0], [np.zeros(256, bool)], [0], [0], [0.0]
    sums: list[tuple[float, float, float]] = []
    rows: dict[int, np.ndarray] = {}
    hists: dict[int, np.ndarray] = {}
    queue: list[tuple[float, int, int, np.ndarray]] = []

    def put(node: int, own: np.ndarray, hist: np.ndarray) -> None:
        rows[node], hists[node] = own, hist
        sums.append(tuple(float(hist[k, 0].sum()) for k in range(3)))
        if (best := _splits(hist, categorical, allowed, least, smooth, penalty)) is not None:
            heapq.heappush(queue, (-best[0], node, best[1], best[2]))

    every = np.arange(x.shape[1])
    put(0, every, histogram(every))
    while queue and len(rows) < leaves:
        lost, node, f, mask = heapq.heappop(queue)
        own, hist = rows.pop(node), hists.pop(node)
        goes = mask[x[f, own]]
        a, b = own[goes], own[~goes]
        small = histogram(a if len(a) <= len(b) else b)
        one, two = (small, hist - small) if len(a) <= len(b) else (hist - small, small)
        feature[node], left[node], gain[node] = f, mask, -lost
        for child, part, part_hist in ((0, a, one), (1, b, two)):
            at = len(feature)
            (second if child else first)[node] = at
            feature.append(0)
            left.append(np.zeros(256, bool))
            first.append(at)
            second.append(at)
            gain.append(0.0)
            put(at, part, part_hist)
    where = np.zeros(x.shape[1], np.int64)
    for node, own in rows.items():
        where[own] = node
    total = np.array(sums)
    value = -rate * total[:, 0] / np.maximum(total[:, 1], 1e-12)
    return Tree(np.array(feature), np.array(left), np.array(first), np.array(second), value, total[:, 2], np.array(gain)), where


def boost(x: np.ndarray, n: np.ndarray, sums: np.ndarray, objective: str, binning: Binning, classes: list[str], rounds: int, leaves: int, least: int, rate: float, row_share: float, column_share: float, smooth: float, penalty: float, seed: int) -> Boosted:
    """Boosting over cells: x (features by cells), their rows n, and sums of their labels (a row for each output)."""
    rng = np.random.default_rng(seed)
    width = len(x)
    total = float(n.sum())
    if objective == "regression":
        base = [float(sums[0].sum() / max(1.0, total))]
    elif objective == "binary":
        p = (float(sums[0].sum()) + 1) / (total + 2)
        base = [math.log(p / (1 - p))]
    else:
        base = [math.log((float(s.sum()) + 1) / (total + len(sums))) for s in sums]
    model = Boosted(objective, binning, base, classes)
    raw = np.tile(np.array(base)[:, None], (1, x.shape[1]))
    categorical = np.array([c in binning.levels for c in binning.names], bool)
    for _ in range(rounds if x.shape[1] else 0):
        m, s = n, sums
        if row_share < 1:
            if objective == "multiclass":
                s = rng.binomial(sums.astype(np.int64), row_share).astype(float)
                m = s.sum(0)
            elif objective == "binary":
                ones = rng.binomial(sums[0].astype(np.int64), row_share)
                m = (ones + rng.binomial((n - sums[0]).astype(np.int64), row_share)).astype(float)
                s = ones[None].astype(float)
            else:
                m = rng.binomial(n.astype(np.int64), row_share).astype(float)
                s = sums * m / n
        allowed = np.sort(rng.permutation(width)[: max(1, round(width * column_share))])
        p = _link(objective, raw.T)
        turn = []
        for k in range(len(raw)):
            if objective == "regression":
                g, h = m * p - s[0], m.astype(float)
            elif objective == "binary":
                g, h = m * p - s[0], m * p * (1 - p)
            else:
                g, h = m * p[:, k] - s[k], m * p[:, k] * (1 - p[:, k]) * len(raw) / max(1, len(raw) - 1)
            tree, where = grow(x, g, h, m, categorical, allowed, leaves, least, rate, smooth, penalty)
            raw[k] += tree.value[where]
            turn.append(tree)
        model.trees.append(turn)
        if all(len(t.feature) == 1 for t in turn) and column_share >= 1 and row_share >= 1:
            break  # nothing is left to split, and no other sample will come
    return model


def learn_binning(df: DataFrame, categories: Sequence[str], numbers: Sequence[str]) -> Binning:
    """The most frequent levels of each category and about MOST_BINS quantiles of each number: what comes back is bounded by them."""
    most = lambda c: df.select(F.col(c).cast("string").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").limit(MOST_BINS)
    levels = {c: [r["v"] for r in sorted(most(c).collect(), key=lambda r: (-r["n"], r["v"]))] for c in categories}
    edges: dict[str, list[float]] = {}
    if numbers:
        shares = [k / MOST_BINS for k in range(1, MOST_BINS)]
        clean = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in numbers]
        got = df.agg(*(F.percentile_approx(x, shares, 20_000).alias(f"e{i}") for i, x in enumerate(clean)), *(F.max(x).alias(f"m{i}") for i, x in enumerate(clean))).first()
        # The largest value is no edge: nothing lies beyond it.
        edges = {c: [e for e in sorted(set(got[f"e{i}"] or [])) if e < got[f"m{i}"]] for i, c in enumerate(numbers)}
    return Binning(list(categories), list(numbers), levels, edges)


def _cells(df: DataFrame, binning: Binning, label: str, fold: str | None, classes: list[str], objective: str) -> DataFrame:
    """(fold, key, n, sums): rows and label sums of each combination of bins, summed in the tasks first."""
    outputs = len(classes) if objective == "multiclass" else 1
    schema = pa.schema([("fold", pa.int32()), ("key", pa.binary()), ("n", pa.int64()), *((f"s{k}", pa.float64()) for k in range(outputs))])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if not batch.num_rows:
                continue
            y = batch.column("_y").to_numpy(zero_copy_only=False).astype(float)
            f = batch.column("_fold").to_numpy(zero_copy_only=False).astype(np.int32)
            x = np.concatenate([f.view(np.uint8).reshape(-1, 4), binning.bins(batch)], 1)
            x = np.ascontiguousarray(x)
            names, inverse = np.unique(x.view(np.dtype((np.void, x.shape[1])))[:, 0], return_inverse=True)
            names = names.view(np.uint8).reshape(-1, x.shape[1])
            weights = [y == k for k in range(outputs)] if objective == "multiclass" else [y]
            columns = [pa.array(np.ascontiguousarray(names[:, :4]).view(np.int32)[:, 0]), pa.array([r.tobytes() for r in names[:, 4:]], pa.binary()), pa.array(np.bincount(inverse, minlength=len(names)))]
            columns += [pa.array(np.bincount(inverse, w.astype(float), len(names))) for w in weights]
            yield pa.RecordBatch.from_arrays([c.cast(t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    y = F.col(label).cast("double")
    if objective == "multiclass":
        y = F.array_position(F.array(*map(F.lit, classes)), F.col(label).cast("string")) - 1
    own = df.select(*(F.col(c).cast("string").alias(c) for c in binning.categories), *(F.col(c).cast("double").alias(c) for c in binning.numbers), y.alias("_y"), (F.col(fold).cast("int") if fold else F.lit(-1)).alias("_fold"))
    sums = [f"s{k}" for k in range(outputs)]
    cells = own.mapInArrow(run, "fold int, key binary, n bigint, " + ", ".join(f"{c} double" for c in sums))
    return cells.groupBy("fold", "key").agg(*(F.sum(c).alias(c) for c in ("n", *sums)))


def _finest(df: DataFrame, binning: Binning, cells: int) -> Binning:
    """The finest of a ladder of resolutions whose combinations of bins stay within `cells`, all counted in one pass."""
    width = len(binning.names)
    tried = [binning.coarse(m) for m in _LADDER]
    most = math.prod(max(1, len(binning.levels.get(c, binning.edges.get(c, []))) + 2) for c in binning.names)
    if most <= cells:
        return binning

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            keys = [pa.array([r.tobytes() for r in b.bins(batch)], pa.binary()) for b in tried]
            yield pa.RecordBatch.from_arrays(keys, [f"k{i}" for i in range(len(tried))])

    own = df.select(*(F.col(c).cast("string").alias(c) for c in binning.categories), *(F.col(c).cast("double").alias(c) for c in binning.numbers))
    got = own.mapInArrow(run, ", ".join(f"k{i} binary" for i in range(len(tried)))).agg(*(F.approx_count_distinct(f"k{i}", 0.02).alias(f"k{i}") for i in range(len(tried)))).first()
    for i, b in enumerate(tried):
        if got[f"k{i}"] * 1.05 <= cells:
            return b
    raise ValueError(f"{width} features make more than {cells} combinations of two bins each: raise the bound or take fewer features")


def train(
    df: DataFrame, label: str, categories: Sequence[str], numbers: Sequence[str], objective: str = "binary", fold: str | None = None, folds: int = 0, whole: bool = True, rounds: int = 300, leaves: int = 63, least: int = 100,
    rate: float = 0.05, row_share: float = 0.9, column_share: float = 0.9, smooth: float = 10.0, penalty: float = 10.0, cells: int = CELLS, seed: int = 0,
) -> dict[int, Boosted]:
    """Models by the fold they leave out; -1 leaves none out (with `whole`) and is the only one without `folds`.

    Rows without a label teach nothing. Missing and unknown values are a bin of their own. least: rows of a leaf; row_share, column_share: samples of each
    round (rows are drawn within cells); smooth, penalty: of categories' gradients. cells: bound on the combinations of bins that a fit holds.
    """
    ship(df.sparkSession)
    df = df.where(F.col(label).isNotNull())
    classes = [r[0] for r in df.select(F.col(label).cast("string").alias("y")).distinct().orderBy("y").limit(1001).collect()] if objective == "multiclass" else []
    if len(classes) > 1000:
        raise ValueError(f"{label} has more than 1000 classes")
    binning = _finest(df, learn_binning(df, categories, numbers), cells)
    outputs = len(classes) if objective == "multiclass" else 1
    found = settled(_cells(df, binning, label, fold, classes, objective))
    models = [*range(folds), *([-1] if whole or not folds else [])]
    sums = [f"s{k}" for k in range(outputs)]
    spread = found.withColumn("model", F.explode(F.filter(F.array(*map(F.lit, models)), lambda m: m != F.col("fold")) if folds else F.array(F.lit(-1))))
    spread = spread.groupBy("model", "key").agg(*(F.sum(c).alias(c) for c in ("n", *sums)))
    options = (objective, binning, classes, rounds, leaves, least, rate, row_share, column_share, smooth, penalty, seed)

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        x = np.frombuffer(b"".join(table["key"].to_pylist()), np.uint8).reshape(table.num_rows, len(binning.names)).T
        model = boost(np.ascontiguousarray(x), table["n"].to_numpy().astype(float), np.stack([table[c].to_numpy() for c in sums]), *options)
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([model.dumps()])], ["model", "told"])

    fitted = {r["model"]: Boosted.loads(r["told"]) for r in spread.groupBy("model").applyInArrow(fit, "model int, told string").collect()}
    none = np.zeros((len(binning.names), 0), np.uint8)
    return {m: fitted.get(m) or boost(none, np.zeros(0), np.zeros((outputs, 0)), *options) for m in models}


def _remembered(model: Boosted) -> Callable[[np.ndarray], pa.Array]:
    """Predictions for rows of bins; equal rows are told once for as long as the task remembers them, CELLS of them at most."""
    held: dict[bytes, float | str] = {}

    def told(x: np.ndarray) -> pa.Array:
        x = np.ascontiguousarray(np.concatenate([np.zeros((len(x), 1), np.uint8), x], 1))  # a model may have no feature
        names, first, inverse = np.unique(x.view(np.dtype((np.void, x.shape[1])))[:, 0], return_index=True, return_inverse=True)
        keys = [v.tobytes() for v in names]
        if len(held) + len(keys) > CELLS:
            held.clear()
        if new := [i for i, v in enumerate(keys) if v not in held]:
            got = model.predict(x[first[new], 1:])
            held.update(zip((keys[i] for i in new), [model.classes[k] for k in got.argmax(1)] if model.objective == "multiclass" else got.tolist(), strict=True))
        return pa.array([held[v] for v in keys], pa.string() if model.objective == "multiclass" else pa.float64()).take(pa.array(inverse))

    return told


def predicted(model: Boosted, df: DataFrame, into: str = "score") -> DataFrame:
    """Adds the probability of label 1, the number, or for many classes the likeliest class (ties: the first)."""
    ship(df.sparkSession)
    names = model.binning.names
    kind = "string" if model.objective == "multiclass" else "double"
    own = df.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(df.columns)), *(F.col(c).cast("string" if c in model.binning.levels else "double").alias(f"_f{i}") for i, c in enumerate(names)))
    kept = [f"c{i}" for i in range(len(df.columns))]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = _remembered(model)
        for batch in source:
            x = model.binning.bins(pa.RecordBatch.from_arrays([batch.column(f"_f{i}") for i in range(len(names))], names) if names else batch)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), told(x)], [*kept, "_found"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema if f.name in kept)
    got = own.mapInArrow(run, f"{kinds}, _found {kind}")
    return got.select(*(F.col(k).alias(c) for k, c in zip(kept, df.columns, strict=True) if c != into), F.col("_found").alias(into))


def _paths(tree: Tree) -> Iterator[tuple[int, dict[int, tuple[np.ndarray, float]]]]:
    """(leaf, feature -> (bins that stay on the path, share of cover that does)) of every leaf."""
    held: list[tuple[int, dict[int, tuple[np.ndarray, float]]]] = [(0, {})]
    while held:
        node, path = held.pop()
        if tree.first[node] == node:
            yield node, path
            continue
        f = int(tree.feature[node])
        bins, share = path.get(f, (np.ones(256, bool), 1.0))
        for child, mask in ((tree.first[node], tree.left[node]), (tree.second[node], ~tree.left[node])):
            held.append((int(child), path | {f: (bins & mask, share * tree.cover[child] / max(tree.cover[node], 1e-12))}))


def shapley(model: Boosted, x: np.ndarray, output: int = 0) -> np.ndarray:
    """Path-dependent Shapley values of each row's sum of trees, a column for each feature and the expected sum last; a row's add up to its sum.

    A leaf sees of a row only which of its path's d features keep to the path, so its 2^d answers are worked out once and looked up.
    """
    out = np.zeros((len(x), len(model.binning.names) + 1))
    out[:, -1] = model.base[output]
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for turn in model.trees:
        tree = turn[output]
        for leaf, path in _paths(tree):
            features = list(path)
            d = len(features)
            z = np.array([path[f][1] for f in features])
            out[:, -1] += tree.value[leaf] * z.prod()
            if not d:
                continue
            if d not in tables:
                masks = np.array([[(s >> i) & 1 for i in range(d)] for s in range(2**d)], bool)
                weights = np.array([math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) if k < d else 0.0 for k in range(d + 1)])
                tables[d] = masks, weights
            masks, weights = tables[d]
            # The factor of a subset S of the path for a row of pattern o: o_i for i in S, z_i for the others.
            phi = np.zeros((2**d, d))
            for j in range(d):
                poly = np.zeros((2**d, d))  # coefficients by the size of S, without j
                poly[:, 0] = 1.0
                for i in range(d):
                    if i != j:
                        poly[:, 1:] = poly[:, 1:] * z[i] + poly[:, :-1] * masks[:, i : i + 1]
                        poly[:, 0] *= z[i]
                phi[:, j] = (masks[:, j] - z[j]) * (poly @ weights[:d])
            pattern = np.zeros(len(x), np.int64)
            for i, f in enumerate(features):
                pattern |= path[f][0][x[:, f]].astype(np.int64) << i
            out[:, features] += tree.value[leaf] * phi[pattern]
    return out


def row_contributions(model: Boosted, df: DataFrame, into: str = "contributions") -> DataFrame:
    """Adds an array of (feature, value): each feature's Shapley value for the row, the largest first (ties: the features' order)."""
    ship(df.sparkSession)
    names = model.binning.names
    kept = [f"c{i}" for i in range(len(df.columns))]
    own = df.select(*(F.col(c).alias(k) for k, c in zip(kept, df.columns, strict=True)), *(F.col(c).cast("string" if c in model.binning.levels else "double").alias(f"_f{i}") for i, c in enumerate(names)))
    item = pa.list_(pa.struct([("feature", pa.string()), ("value", pa.float64())]))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            x = model.binning.bins(pa.RecordBatch.from_arrays([batch.column(f"_f{i}") for i in range(len(names))], names))
            values = shapley(model, x)[:, :-1]
            order = np.argsort(-values, axis=1, kind="stable")
            found = [[{"feature": names[k], "value": float(v[k])} for k in o] for v, o in zip(values, order.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, item)], [*kept, "_found"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema if f.name in kept)
    got = own.mapInArrow(run, f"{kinds}, _found array<struct<feature: string, value: double>>")
    return got.select(*(F.col(k).alias(c) for k, c in zip(kept, df.columns, strict=True) if c != into), F.col("_found").alias(into))
