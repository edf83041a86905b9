"""Boosted trees against exhaustive search, Shapley values against their definition, and planted signal."""

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from fieldbook.operators import boosting as B
from fieldbook.operators import models as M
from fieldbook.operators.stats import average_rank_auc


def by_definition(model, x, output=0):
    """Shapley values over all subsets of features; expectations follow the covers."""
    width = len(model.binning.names)

    def expected(tree, row, known, node=0):
        if tree.first[node] == node:
            return tree.value[node]
        a, b = int(tree.first[node]), int(tree.second[node])
        if tree.feature[node] in known:
            return expected(tree, row, known, a if tree.left[node, row[tree.feature[node]]] else b)
        return (tree.cover[a] * expected(tree, row, known, a) + tree.cover[b] * expected(tree, row, known, b)) / tree.cover[node]

    out = np.zeros((len(x), width + 1))
    for r, row in enumerate(x):
        worth = {s: sum(expected(turn[output], row, s) for turn in model.trees) for k in range(width + 1) for s in map(frozenset, combinations(range(width), k))}
        out[r, -1] = model.base[output] + worth[frozenset()]
        for j in range(width):
            for s, w in worth.items():
                if j not in s:
                    out[r, j] += math.factorial(len(s)) * math.factorial(width - len(s) - 1) / math.factorial(width) * (worth[s | {j}] - w)
    return out


BINNING = B.Binning(["c"], ["a", "b", "d"], {"c": list("uvwxyz")}, {k: [1.0, 2.0, 3.0, 4.0] for k in "abd"})


def cells(seed, n=200):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 6, (4, n)).astype(np.uint8)
    y = (x[0] % 2 * 2.0 + (x[1] > 2) * (x[2] > 1) - (x[3] == 0) + rng.normal(0, 0.3, n)).astype(float)
    return x, np.ones(n), y


def boosted(x, n, sums, objective="regression", rounds=6, leaves=6, **options):
    chosen = {"least": 5, "rate": 0.3, "row_share": 1.0, "column_share": 1.0, "smooth": 0.0, "penalty": 0.0, "seed": 0} | options
    return B.boost(x, n, np.atleast_2d(sums), objective, BINNING, ["p", "q", "r"] if objective == "multiclass" else [], rounds, leaves, **chosen)


@pytest.mark.parametrize("seed", range(3))
def test_shapley_values_equal_their_definition(seed):
    x, n, y = cells(seed)
    model = boosted(x, n, y)
    rows = np.ascontiguousarray(x.T[:12])
    got = B.shapley(model, rows)
    assert np.allclose(got, by_definition(model, rows)) and np.allclose(got.sum(1), model.raw(rows)[:, 0])
    wide = boosted(x, n, np.stack([x[0] == 1, x[0] > 2, (x[0] != 1) & (x[0] <= 2)]).astype(float), "multiclass", rounds=2)
    for k in range(3):
        assert np.allclose(B.shapley(wide, rows, k), by_definition(wide, rows, k))


def exhaustive(x, g, h, n, least, own):
    """The best gain of any split: cuts of numbers with missing values on either side, any subset of a category's bins."""
    total = g[own].sum() ** 2 / h[own].sum()
    best = 0.0
    for f in range(len(x)):
        bins = np.unique(x[f, own])
        if f == 0:
            sides = [s for k in range(1, len(bins)) for s in combinations(bins, k)]
        else:
            rest = [b for b in bins if b]
            sides = [tuple(b for b in rest if b <= c) + miss for c in [-1, *rest] for miss in ((), (0,))]
        for s in sides:
            left = own & np.isin(x[f], s)
            right = own & ~left
            if n[left].sum() >= least and n[right].sum() >= least:
                best = max(best, g[left].sum() ** 2 / h[left].sum() + g[right].sum() ** 2 / h[right].sum() - total)
    return best


@pytest.mark.parametrize("seed", range(4))
def test_trees_take_the_best_split_of_the_best_leaf(seed):
    x, n, y = cells(seed, 120)
    g, h = y.mean() - y, np.ones(len(y))
    tree, where = B.grow(x, g, h, n, np.array([True, False, False, False]), np.arange(4), 5, 8, 1.0, 0.0, 0.0)
    assert (tree.first == np.arange(len(tree.first))).sum() == 5 and (where == tree.leaves(np.ascontiguousarray(x.T))).all()
    assert np.allclose(tree.value[where], [-g[where == w].mean() for w in where])
    # Splits in the order of their making: each has the largest gain of any leaf then open, by exhaustive search.
    open_ = {0: np.ones(len(y), bool)}
    for node in sorted(range(len(tree.first)), key=lambda k: tree.first[k] if tree.first[k] != k else math.inf)[:4]:
        gains = {k: exhaustive(x, g, h, n, 8, own) for k, own in open_.items()}
        assert tree.gain[node] == pytest.approx(max(gains.values())) and gains[node] == pytest.approx(max(gains.values()))
        own = open_.pop(node)
        left = tree.left[node, x[tree.feature[node]]]
        open_[int(tree.first[node])], open_[int(tree.second[node])] = own & left, own & ~left


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(1)
    n = 6000
    c = rng.choice([f"k{i:02d}" for i in range(30)], n)
    odd = np.array([int(v[1:]) % 2 for v in c])
    x, z = rng.normal(size=n), rng.integers(0, 5, n)
    p = 1 / (1 + np.exp(-(3 * odd - 1.5 + 2 * (x > 0.3) * (z > 2) - 1)))
    y = (rng.random(n) < p).astype(int)
    kind = np.where(odd == 1, np.where(z > 2, "a", "b"), np.where(x > 0, "c", "d"))
    frame = pd.DataFrame({"id": range(n), "c": c, "x": x, "z": z, "y": y, "kind": kind, "fold": np.arange(n) % 3})
    return spark.createDataFrame(frame).repartition(4).selectExpr("id", "c", "IF(id % 50 = 0, NULL, x) AS x", "z", "IF(id % 97 = 0, NULL, y) AS y", "kind", "fold", "1 AS n", "'k' AS key").cache()


def test_two_classes_beat_the_majority_and_survive_a_round_trip(spark, planted):
    got = M.cross_validated(planted, "y", "fold", 3, ["c"], ["x", "z"], rounds=60, least=20).collect()
    assert len(got) == 3 and all(r["auc"] > 0.82 and r["accuracy"] > r["majority"] + 0.1 for r in got)
    model = M.train_binary(planted, "y", ["c"], ["x", "z"], rounds=40, least=20)
    again = B.Boosted.loads(model.dumps())
    rows = spark.createDataFrame([("k01", 1.0, 4, 0), ("new", None, None, 1), (None, float("nan"), 9, 2)], "c string, x double, z int, score int")
    one, two = (M.scores(m, rows).collect() for m in (model, again))
    assert [r["score"] for r in one] == [r["score"] for r in two] and [r.asDict().keys() for r in one] == [{"c": 0, "x": 0, "z": 0, "score": 0}.keys()] * 3 and all(0 < r["score"] < 1 for r in one)
    share = {r["feature"]: r["share"] for r in M.importances(spark, model).collect()}
    assert sum(share.values()) == pytest.approx(100, abs=0.01) and share["c"] > 50
    drivers = {r["c"]: r["drivers"] for r in M.row_drivers(model, rows.drop("score"), ["c"], names={"c": "Kind"}, none="mixed").collect()}
    assert drivers["k01"].startswith("Kind")


def test_rounds_raise_the_accuracy(planted):
    held = planted.where("fold = 0 and y is not null")
    auc = [average_rank_auc(M.scores(M.train_binary(planted.where("fold <> 0"), "y", ["c"], ["x", "z"], rounds=r, leaves=4, least=20), held), "y", "score").first()["auc"] for r in (1, 60)]
    assert auc[1] > auc[0] + 0.01


def test_many_classes(planted):
    r = M.train_multiclass(planted.where("fold <> 0"), planted.where("fold = 0"), "kind", ["c"], ["x", "z"], rounds=30, least=20).first()
    assert r["accuracy"] > 0.95 and r["macro_f1"] > 0.95 and r["majority"] < 0.4


def test_the_same_model_however_rows_are_dealt(planted):
    told = [M.train_binary(planted.repartition(k), "y", ["c"], ["z"], rounds=5).dumps() for k in (1, 7)]
    assert told[0] == told[1]


def test_cells_stay_within_their_bound(planted):
    binning = B.learn_binning(planted, ["c"], ["x", "z"])
    assert len(binning.levels["c"]) == 30 and len(binning.edges["x"]) > 200 and binning.edges["z"] == [0.0, 1.0, 2.0, 3.0]
    fine = B._finest(planted, binning, 1500)
    count = B._cells(planted.where("y is not null"), fine, "y", None, [], "binary").count()
    assert count <= 1500 and len(fine.edges["x"]) < len(binning.edges["x"])
    with pytest.raises(ValueError):
        B._finest(planted, binning, 5)


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "c string, x double, y int")
    rows = spark.createDataFrame([("a", 1.0, None)], "c string, x double, y int")
    for frame in (empty, rows):
        assert [r["score"] for r in M.scores(M.train_binary(frame, "y", ["c"], ["x"]), rows).collect()] == [0.5]
    assert M.scores(M.train_binary(rows, "y", ["c"], ["x"]), empty).count() == 0


def test_equal_rows_are_predicted_once():
    from fieldbook.operators.boosting import _remembered

    asked = []

    class Model:
        objective, classes = "binary", []

        def predict(self, x):
            asked.append(len(x))
            return x.sum(1) / 10

    told = _remembered(Model())
    rows = np.array([[1, 2], [0, 3], [1, 2], [0, 0]], np.uint8)
    assert told(rows).to_pylist() == [0.3, 0.3, 0.3, 0.0] and told(rows[::-1]).to_pylist() == [0.0, 0.3, 0.3, 0.3]
    assert asked == [3]
    assert told(np.zeros((2, 0), np.uint8)).to_pylist() == [0.0, 0.0]


def test_features_are_made_once(spark, data, monkeypatch):
    from fieldbook.plans import model_queries as Q

    made, real = spark.sparkContext.accumulator(0), Q.features

    def told(rows):
        for batch in rows:
            made.add(batch.num_rows)
            yield batch

    def counted(spark, d):
        f = real(spark, d)
        return f.mapInArrow(told, f.schema)

    monkeypatch.setattr(Q, "features", counted)
    n = real(spark, data).count()
    Q._labelled(spark, data)
    assert made.value == n
    monkeypatch.setattr(Q.M, "train_multiclass", lambda train, test, *a: train.count() + test.count())
    assert Q.train_multiclass(spark, data) == n and made.value == 2 * n
    monkeypatch.setattr(Q, "_saved", lambda *a: "")
    monkeypatch.setattr(Q.M, "read_contract", lambda *a: {"features": ["x"], "rows": 1, "levels": {"first_item": ["y"]}})
    Q.save_contract(spark, data).collect()
    assert made.value == 3 * n
