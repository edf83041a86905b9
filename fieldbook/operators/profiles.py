"""Recurring profiles: weighted one-hot vectors, density clusters of distinct signatures, descriptions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions.scalars import rounded
from fieldbook.operators.density import density_clusters
from fieldbook.operators.ranking import mode_per_group, top_values


def bucketed(df: DataFrame, columns: Mapping[str, int]) -> DataFrame:
    """Rare values of the columns become OTHER; adds `signature`, which names the combination."""
    for c, n in columns.items():
        kept = top_values(df, c, n).withColumn("_kept", F.lit(True))
        df = df.join(F.broadcast(kept), c, "left").withColumn(c, F.when(F.col("_kept"), F.col(c)).otherwise("OTHER")).drop("_kept")
    return df.withColumn("signature", F.xxhash64(*columns))


def signatures(df: DataFrame, columns: Mapping[str, int]) -> DataFrame:
    """Distinct combinations of the bucketed columns with their number of rows and an id."""
    return bucketed(df, columns).groupBy(*columns, "signature").agg(F.count("*").alias("w"))


def singular_vectors(sigs: DataFrame, weights: Mapping[str, float], size: int = 5, times: str = "w") -> tuple[list[tuple[str, str]], np.ndarray, np.ndarray]:
    """(names of the one-hot columns, singular values, right singular vectors by column) of the weighted one-hot rows, each `times` over, not centred.

    The Gramian is counted by Spark, pair of values by pair of values, so what comes back is the square of the top lists of the signatures; its
    eigenvectors are the right singular vectors. Signs: the entry of the largest size is positive.
    """
    at = F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in weights))
    rows = sigs.select(F.col(times).cast("double").alias("n"), at.alias("x"))
    pairs = rows.select("n", "x", F.explode("x").alias("p")).select("n", "p", F.explode("x").alias("q")).groupBy("p", "q").agg(F.sum("n").alias("n")).collect()
    names = sorted({(r["p"]["c"], r["p"]["v"]) for r in pairs}, key=lambda x: (list(weights).index(x[0]), x[1] is None, x[1] or ""))
    place = {x: i for i, x in enumerate(names)}
    gram = np.zeros((len(names), len(names)))
    for r in pairs:
        gram[place[tuple(r["p"])], place[tuple(r["q"])]] = r["n"] * weights[r["p"]["c"]] * weights[r["q"]["c"]]
    values, vectors = np.linalg.eigh(gram)
    k = min(size, len(names))
    values, vectors = np.sqrt(np.maximum(values[::-1][:k], 0)), vectors[:, ::-1][:, :k]
    if k:
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    return names, values, vectors


def profile_vectors(sigs: DataFrame, weights: Mapping[str, float], size: int = 5, times: str = "w") -> DataFrame:
    """Adds `vector`: weighted one-hot blocks of the columns, reduced by a truncated singular value decomposition (not centred)."""
    names, _, vectors = singular_vectors(sigs, weights, size, times)
    k = vectors.shape[1]
    parts = []
    for c, w in weights.items():
        own = {v: (vectors[i] * w).tolist() for i, (of, v) in enumerate(names) if of == c}
        said = F.create_map(*(x for v, y in own.items() if v is not None for x in (F.lit(v), F.array(*map(F.lit, y))))) if any(v is not None for v in own) else None
        blank = F.array(*map(F.lit, own.get(None, [0.0] * k))).cast("array<double>")
        parts.append(F.coalesce(F.element_at(said, F.col(c).cast("string")), blank) if said is not None else blank)
    total = parts[0]
    for p in parts[1:]:
        total = F.zip_with(total, p, lambda a, b: a + b)
    return sigs.withColumn("vector", total)


def profile_cluster(vectors: DataFrame, key: str, weight: str, least: float, samples: int = 20) -> DataFrame:
    """(key, cluster): the most stable hierarchical density clusters of the distinct signatures, -1 for noise. least: rows of a cluster; samples: rows that make a core distance."""
    return density_clusters(vectors, key, weight, "vector", least, samples)


def profile_describe(df: DataFrame, cluster: str, head: str, details: Sequence[str], group: str) -> DataFrame:
    """Per cluster: rows, share, modal head and its purity, modal details of the rows with that head, and the three most frequent groups."""
    rows = df.where(F.col(cluster) >= 0)
    total = rows.agg(F.count("*").alias("_all"))
    size = rows.groupBy(cluster).agg(F.count("*").alias("size")).crossJoin(F.broadcast(total))
    top = mode_per_group(rows, [cluster], head).select(cluster, F.col(head).alias("_head"), "n")
    got = size.join(top, cluster).select(cluster, "size", rounded(F.col("size").cast("double") / F.col("_all")).alias("share"), F.col("_head").alias(head), rounded(F.col("n").cast("double") / F.col("size")).alias("purity"))
    matching = rows.join(top.select(cluster, "_head"), cluster).where(F.col(head) == F.col("_head"))
    for c in details:
        got = got.join(mode_per_group(matching, [cluster], c).select(cluster, c), cluster, "left")
    counts = rows.groupBy(cluster, group).agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("n"), group))).where("r <= 3")
    groups = counts.groupBy(cluster).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", group))), lambda x: x[group]), "; ").alias("groups"))
    return got.join(groups, cluster)


def signature_assign(df: DataFrame, value: str, cluster: str) -> DataFrame:
    """(value, cluster, n): the cluster that most rows of a value are in."""
    return mode_per_group(df, [value], cluster)


