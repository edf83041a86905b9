"""Density clusters of weighted points against a version that writes every point out and every pair."""

import math
from bisect import bisect_left

import numpy as np
import pytest

from fieldbook.operators import density as D


def written_out(x, w):
    return np.repeat(x, w, axis=0), np.repeat(np.arange(len(x)), w)


def mutual(x, samples):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, 1)[:, samples - 1]
    return np.maximum(np.maximum(core[:, None], core[None]), d)


def connected(reach, own, below, strict):
    """The parts of some points that ways of length below (or up to) a bound hold together."""
    own = np.array(own)
    near = reach[np.ix_(own, own)]
    near = near < below if strict else near <= below
    parts, left = [], np.ones(len(own), bool)
    while left.any():
        part = np.zeros(len(own), bool)
        part[left.argmax()] = True
        while (more := near[part].any(0) & left & ~part).any():
            part |= more
        parts.append(own[part].tolist())
        left &= ~part
    return parts


def brute(x, w, least, samples):
    """Cluster of each point, written from the definition, over all points one by one."""
    every, owner = written_out(x, w)
    reach = mutual(every, samples)
    clusters = []  # (points, birth, stability, children)

    def follow(own, birth):
        me = len(clusters)
        clusters.append(None)
        stability, children, members = 0.0, [], list(own)
        while True:
            sub = reach[np.ix_(own, own)]
            levels = np.unique(sub[~np.eye(len(own), dtype=bool)])
            bound = levels[bisect_left(range(len(levels)), True, key=lambda k: len(connected(reach, own, levels[k], False)) == 1)]  # noqa: B023
            parts = connected(reach, own, bound, True)
            now = 1 / bound if bound else math.inf
            large = [p for p in parts if len(p) >= least]
            if len(large) == 1:
                stability += (len(own) - len(large[0])) * (now - birth) if now > birth else 0
                own = large[0]
                continue
            stability += len(own) * (now - birth) if now > birth else 0
            children = [follow(p, now) for p in large]
            break
        clusters[me] = (members, stability, children)
        return me

    follow(list(range(len(every))), 0.0)

    def best(c, root=False):
        members, stability, children = clusters[c]
        below = [best(k) for k in children]
        if root or (children and sum(b for b, _ in below) > stability):
            return sum(b for b, _ in below), [g for _, gs in below for g in gs]
        return stability, [members]

    groups = sorted(best(0, True)[1], key=lambda g: min(owner[i] for i in g))
    out = np.full(len(x), -1)
    for k, g in enumerate(groups):
        out[owner[g]] = k
    return out


def case(seed, n=70):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 4, (5, 3))
    x = centres[rng.integers(0, 5, n)] + rng.normal(0, rng.choice([0.3, 0.9, 2.5], n)[:, None], (n, 3))
    x = np.round(x * 2) / 2 if seed % 2 else x  # ties
    x = np.unique(x, axis=0)
    return x, rng.choice([1, 1, 2, 5, 9, 25], len(x))


@pytest.mark.parametrize("seed", range(6))
def test_clusters_equal_the_definition(seed):
    x, w = case(seed)
    core = D._core(*D._neighbours(x, x, w.astype(float), 6), 6)
    a, b, d = D._spanning(x, core)
    expected = brute(x, w, 20, 6)
    assert D.stable_clusters(np.arange(len(x)), w.astype(float), a, b, d, 20).tolist() == expected.tolist() and len(set(expected)) > 2


def test_blocks_and_joins_give_the_same_clusters(spark):
    x, w = case(1, 90)
    far = 2**62 + 1  # ids that no float holds
    frame = spark.createDataFrame([(far + i, int(m), v.tolist()) for i, (v, m) in enumerate(zip(x, w, strict=True))], "id bigint, w bigint, v array<double>").repartition(2)
    got = {r["id"] - far: r["cluster"] for r in D.density_clusters(frame, "id", "w", "v", 20, 6, 30).collect()}
    assert [got[i] for i in range(len(x))] == brute(x, w, 20, 6).tolist()
    tree = D.spanning_tree(frame, "id", "w", "v", 6, 1024).collect()
    core = D._core(*D._neighbours(x, x, w.astype(float), 6), 6)
    assert len(tree) == len(x) - 1 and np.allclose(sorted(r["d"] for r in tree), sorted(D._spanning(x, core)[2]))


def test_forest_of_parts_is_the_forest_of_all(spark):
    rng = np.random.default_rng(2)
    edges = {(int(min(p)), int(max(p))): float(rng.integers(1, 40)) for p in rng.integers(0, 60, (900, 2)) if p[0] != p[1]}
    frame = spark.createDataFrame([(a, b, d) for (a, b), d in edges.items()], "a bigint, b bigint, d double")
    a, b, d = (np.array(x) for x in zip(*((a, b, d) for (a, b), d in edges.items()), strict=True))
    whole = sorted(d[D._forest(a, b, d)].tolist())
    for at_once in (200,):
        assert sorted(r["d"] for r in D.shortest_edges(frame, at_once).collect()) == whole


def test_few_points_and_silhouette(spark):
    schema = "id bigint, w bigint, v array<double>"
    assert D.density_clusters(spark.createDataFrame([], schema), "id", "w", "v", 2, 1).count() == 0
    one = D.density_clusters(spark.createDataFrame([(5, 100, [1.0])], schema), "id", "w", "v", 10, 2).collect()
    assert [(r["id"], r["cluster"]) for r in one] == [(5, -1)]
    two = D.density_clusters(spark.createDataFrame([(5, 100, [1.0]), (9, 50, [3.0]), (11, 1, [2.5])], schema), "id", "w", "v", 10, 2).collect()
    assert sorted((r["id"], r["cluster"]) for r in two) == [(5, 0), (9, 1), (11, 1)]
    with pytest.raises(ValueError):
        D.density_clusters(spark.createDataFrame([], schema), "id", "w", "v", 2, 5)
    x, w = case(3)
    labels = np.arange(len(x)) % 4 - 1
    every, owner = written_out(x, w)
    own = labels[owner]
    d = np.sqrt(((every[:, None] - every[None]) ** 2).sum(2))
    values = []
    for i in np.flatnonzero(own >= 0):
        same = d[i, own == own[i]].sum() / ((own == own[i]).sum() - 1)
        other = min(d[i, own == k].mean() for k in {*own} - {-1, own[i]})
        values.append((other - same) / max(other, same))
    frame = spark.createDataFrame([(i, int(m), v.tolist(), int(c)) for i, (v, m, c) in enumerate(zip(x, w, labels, strict=True))], schema + ", c int")
    got = D.vector_silhouette(frame, "id", "w", "v", "c", 16).first()
    assert got["silhouette"] == pytest.approx(np.mean(values), abs=1e-6) and got["clusters"] == 3 and got["noise_share"] == pytest.approx((own < 0).mean(), abs=1e-6)
