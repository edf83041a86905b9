"""Quality classifier: gradient-boosted trees over histograms of document statistics.

Statistics are computed where the texts are. The trees are fitted on at most `sample_rows` labelled rows (a bounded,
documented sample, taken by hash) and flattened into arrays, a full binary tree in each row; scoring walks all trees
for a whole batch of documents at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.llm.common import slices, utf8
from fieldbook.session import ship

#: Labelled rows that the trees see at most.
SAMPLE_ROWS = 20_000
# Frequent function words of the languages, told apart by no feature.
COMMON = frozenset(x.encode() for x in "the of and to in is that for it was on are as with be at by this from or an have not a de la le les et des du un une en que qui dans pour sur au par el los las del se y con para como der die das und ist von mit den für auf ein eine zu im nicht".split())
FEATURES = ("log_bytes", "log_words", "upper", "digit", "space", "newline", "other_ascii", "non_ascii", "bar", "marks", "stops", "commas", "quotes", "word_bytes", "long_words", "distinct_words", "common_words", "log_lines", "repeated_lines", "bytes_a_line", "repeated_pairs", "most_frequent_word", "letters_only", "capitalised")
_CLASS = np.full(256, 9)
for _name, _chars in enumerate((range(65, 91), range(97, 123), range(48, 58), (32, 9, 11, 12), (10, 13), range(128, 256), b"|", b"#$%&*!@^~_=<>\\+", b".?;:", b",", b"\"'()[]-")):
    _CLASS[list(_chars)] = _name if _name < 9 else _name + 1


def statistics(text: bytes | None) -> list[float]:
    """Numbers that describe a text whatever its language; all finite, and all 0 without text."""
    if not text:
        return [0.0] * len(FEATURES)
    n = len(text)
    kinds = np.bincount(_CLASS, np.bincount(np.frombuffer(text, np.uint8), minlength=256), 12) / n
    words = text.split()
    lines = [x for x in text.split(b"\n") if x]
    w = max(1, len(words))
    lower = [x.lower() for x in words]
    times: dict[bytes, int] = {}
    for x in lower:
        times[x] = times.get(x, 0) + 1
    pairs = len(set(zip(lower, lower[1:], strict=False)))
    return [
        np.log1p(n), np.log1p(len(words)), kinds[0], kinds[2], kinds[3], kinds[4], kinds[9], kinds[5], kinds[6], kinds[7], kinds[8], kinds[10], kinds[11],
        (n - len(words)) / w, sum(len(x) > 18 for x in words) / w, len(times) / w, sum(map(COMMON.__contains__, lower)) / w,
        np.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), 1 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0,
        max(times.values(), default=0) / w, sum(map(bytes.isalpha, words)) / w, sum(map(bytes.isupper, words)) / w,
    ]


def _described(texts: list[bytes | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


class Trees:
    """Boosted trees of one depth as arrays: the inner node i of a tree has the children 2 i + 1 and 2 i + 2."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray, depth: int) -> None:
        self.base, self.feature, self.cut, self.leaf, self.depth = base, feature, cut, leaf, depth

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        trees = np.arange(len(self.feature))[None, :]
        for a in range(0, len(x) if len(self.feature) else 0, 1000):
            rows = x[a : a + 1000]
            at = np.zeros((len(rows), len(self.feature)), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (np.take_along_axis(rows, self.feature[trees, at], 1) > self.cut[trees, at])
            total[a : a + 1000] += self.leaf[trees, at - (2**self.depth - 1)].sum(1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.1, least: int = 10, penalty: float = 1.0) -> Trees:
    """Log-loss boosting over histograms of quantile bins; one label alone, or none, gives its smoothed share everywhere."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return Trees(base, np.zeros((0, 0), int), np.zeros((0, 0)), np.zeros((0, 0)), depth)
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], 1)
    inner, last = 2**depth - 1, 2**depth
    features, cuts, leaves = [], [], []
    total = np.full(n, base)
    column = np.arange(width) * bins
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            slot = ((node - first)[:, None] * (width * bins) + column + binned).ravel()
            hist = [np.bincount(slot, np.repeat(v, width), many * width * bins).reshape(many, width, bins) for v in (g, h, np.ones(n))]
            left = [np.cumsum(v, 2) for v in hist]
            right = [v[:, :, -1:] - v for v in left]
            gain = sum(a**2 / (b + penalty) for a, b in ((left[0], left[1]), (right[0], right[1])))
            gain = gain - (left[0][:, :, -1:] ** 2 / (left[1][:, :, -1:] + penalty))
            gain[(left[2] < least) | (right[2] < least)] = 0
            for j, e in enumerate(edges):
                gain[:, j, len(e) :] = 0
            best = gain.reshape(many, -1).argmax(1)
            split = gain.reshape(many, -1)[np.arange(many), best] > 1e-9
            f, b = best // bins, best % bins
            feature[first : first + many] = np.where(split, f, 0)
            cut[first : first + many] = [edges[i][k] if s else np.inf for i, k, s in zip(f, b, split, strict=True)]
            at = node - first
            node = 2 * node + 1 + (split[at] & (binned[np.arange(n), f[at]] > b[at]))
        own = node - inner
        value = -rate * np.bincount(own, g, last) / (np.bincount(own, h, last) + penalty)
        total += value[own]
        features.append(feature)
        cuts.append(cut)
        leaves.append(value)
    return Trees(base, np.array(features), np.array(cuts), np.array(leaves), depth)


def held_out(id_col: str):
    """True for the fifth of the rows that learning never sees."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")), F.lit(5)) == 0


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees fitted on at most sample_rows labelled rows that aren't held out; the rows are chosen by a hash of the id."""
    ship(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out("id") & F.col("id").isNotNull())
    # Bounded by sample_rows, so that it may be broadcast.
    chosen = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("id", "y", "text")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(source):
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(_described(utf8(batch.column(2))).tolist(), pa.list_(pa.float64()))], ["id", "y", "x"])

    # Ids that repeat may bring more rows than ids; a hash chooses among them, too.
    kind = texts.schema["id"].dataType.simpleString()
    rows = texts.mapInArrow(run, f"id {kind}, y int, x array<double>").orderBy(F.xxhash64("id", "x"), "id", "x", "y").limit(sample_rows).select("y", "x").collect()
    return fit(np.array([r["x"] for r in rows], np.float64).reshape(len(rows), len(FEATURES)), np.array([r["y"] for r in rows], np.float64))


def score(docs: DataFrame, trees: Trees, text_col: str = "text", into: str = "score") -> DataFrame:
    """Adds the probability of label 1 to every row, from its whole text, however long; null and empty texts get a score too, equal texts the same.

    A column of that name is replaced; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c != into or c == text_col]
    at = kept.index(text_col)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(source):
            found = trees.scores(_described(utf8(batch.column(at))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, "_score"])

    own = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(kept)))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema)
    return own.mapInArrow(run, f"{kinds}, _score double").toDF(*kept, into)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted) for every row. Ids, languages, sources and labels are no inputs of a score.

    Repeated rows get equal scores; a null id counts as an empty one for held_out. Without labels every score is 0.5. An empty table
    gives an empty result; very long texts are scored whole; other columns don't matter.
    """
    trees = learn(docs, labels, id_col, text_col)
    scored = score(docs.select(id_col, F.col(text_col).alias("_text")), trees, "_text")
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
