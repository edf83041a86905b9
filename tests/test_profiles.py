"""Truncated singular value decomposition of profiles against numpy."""

import numpy as np

from fieldbook.operators import profiles as P

ROWS = [("a", "x", 5), ("a", "y", 1), ("b", "x", 7), ("b", None, 2), ("c", "z", 3), ("a", "z", 4)]
WEIGHTS = {"p": 3.0, "q": 1.5}


def test_singular_values_equal_numpy(spark):
    sigs = spark.createDataFrame(ROWS, "p string, q string, w bigint")
    names, values, vectors = P.singular_vectors(sigs, WEIGHTS, 4)
    one_hot = np.array([[WEIGHTS[c] * ((p if c == "p" else q) == v) for c, v in names] for p, q, _ in ROWS])
    every = np.repeat(one_hot, [n for *_, n in ROWS], axis=0)
    _, expected, _ = np.linalg.svd(every, full_matrices=False)
    assert np.allclose(values, expected[:4]) and np.allclose(np.linalg.norm(every @ vectors, axis=0), values)
    got = {(r["p"], r["q"]): r["vector"] for r in P.profile_vectors(sigs, WEIGHTS, 4).collect()}
    for (p, q, _), row in zip(ROWS, one_hot, strict=True):
        assert np.allclose(got[p, q], row @ vectors)
    # All components keep every distance.
    whole = {(r["p"], r["q"]): np.array(r["vector"]) for r in P.profile_vectors(sigs, WEIGHTS, 99).collect()}
    assert np.isclose(np.linalg.norm(whole["a", "x"] - whole["b", "x"]), 3.0 * 2**0.5)


def test_profiles_of_nothing(spark):
    empty = spark.createDataFrame([], "p string, q string, w bigint, signature bigint")
    vectors = P.profile_vectors(empty, WEIGHTS)
    assert vectors.count() == 0 and P.profile_cluster(vectors, "signature", "w", 30).count() == 0
