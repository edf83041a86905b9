"""Joins in time and subtotals against brute force."""

import random

from pyspark.sql import functions as F

from fieldbook.operators import temporal as T


def asof_plain(left, right, within=None):
    out = []
    for key, t, name in left:
        met = [(u, v) for k, u, v in right if None not in (k, u, key, t) and k == key and u <= t]
        best = max(met, key=lambda x: (x[0], x[1] is not None, x[1] or 0)) if met else None
        if best and within is not None and best[0] < t - within:
            best = None
        out.append((key, t, name, best and best[1]))
    return sorted(out, key=repr)


def test_asof_with_a_hot_key_ties_and_nulls(spark):
    draw = random.Random(5)
    key = lambda: draw.choice([1, 1, 1, 1, 2, 3, None])
    time = lambda: draw.choice([None, *range(60)]) if draw.random() < 0.7 else draw.randrange(5000)
    left = [(key(), time(), f"n{i % 40}") for i in range(900)]
    right = [(key(), time(), draw.choice([None, *range(9)])) for i in range(500)]
    a = spark.createDataFrame(left, "id int, at int, x string")
    b = spark.createDataFrame(right, "id int, at int, x int")
    for within in (None, 7):
        got = T.asof_join(a, b, ["id"], "at", {"x": "found"}, None if within is None else F.lit(within))
        assert sorted((tuple(r) for r in got.collect()), key=repr) == asof_plain(left, right, within)


def test_asof_carries_over_many_ranges(spark):
    """One key: its only fact lies in the first range, and later ranges hold none."""
    a = spark.range(5000).select(F.lit("k").alias("id"), (F.col("id") + 10).alias("at"))
    b = spark.createDataFrame([("k", 3, 1), ("j", 4000, 2)], "id string, at bigint, x int")
    assert [tuple(r) for r in T.asof_join(a, b, ["id"], "at", {"x": "x"}).groupBy("x").count().collect()] == [(1, 5000)]


def test_asof_of_empty_tables(spark):
    a, none = spark.createDataFrame([("k", 3)], "id string, at int"), spark.createDataFrame([], "id string, at int, x int")
    assert [tuple(r) for r in T.asof_join(a, none, ["id"], "at", {"x": "y"}).collect()] == [("k", 3, None)]
    assert T.asof_join(a.limit(0), none, ["id"], "at", {"x": "y"}).count() == 0


def spans(draw, n):
    for i in range(n):
        start = draw.randrange(-3000, 3000)
        yield draw.choice([1, 1, 1, 2, None]), draw.choice([start, start, None]) if i % 9 == 0 else start, start + draw.choice([0, -4, 1, 2, 3, 4, 5, 16, 17, 200, 5000]), i


def test_intervals_of_all_lengths(spark):
    draw = random.Random(8)
    left, right = list(spans(draw, 400)), list(spans(draw, 400))
    a = spark.createDataFrame(left, "k int, s bigint, e bigint, i int")
    b = spark.createDataFrame(right, "k int, s bigint, e bigint, i int")
    for by in (["k"], []):
        want = sorted((x[3], y[3]) for x in left for y in right if None not in (x[1], y[1]) and x[2] > x[1] and y[2] > y[1] and x[1] < y[2] and y[1] < x[2] and (not by or (x[0] is not None and x[0] == y[0])))
        joined = T.interval_join(a, b, by, ("s", "e"), ("s", "e"), {"i": "j"})
        assert joined.columns == ["k", "s", "e", "i", "j"]
        assert sorted((r["i"], r["j"]) for r in joined.collect()) == want
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_intervals_of_empty_tables(spark):
    none = spark.createDataFrame([], "k int, s timestamp, e timestamp")
    assert T.interval_join(none, none, ["k"], ("s", "e"), ("s", "e"), {"s": "t"}).count() == 0


def test_subtotals_tell_null_groups_from_totals(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", "x", 2), (None, "x", 4)], "p string, q string, v int")
    got = {(r["level"], r["p"], r["q"]): (r["n"], r["v"]) for r in T.subtotals(df, ["p", "q"], ["v"]).collect()}
    assert got[(0, "a", None)] == (1, 1) and got[(1, "a", None)] == (2, 3) and got[(1, None, None)] == (1, 4)
    assert got[(2, None, "x")] == (2, 6) and got[(2, None, None)] == (1, 1) and got[(3, None, None)] == (3, 7)
    some = T.subtotals(df, ["p", "q"], ["v"], [["p"], []])
    assert {r["level"] for r in some.collect()} == {1, 3}
    assert T.subtotals(df.limit(0), ["p"], ["v"], [["p"]]).count() == 0


def test_load_of_intervals_without_their_pairs(spark):
    draw = random.Random(9)
    left, right = list(spans(draw, 400)), list(spans(draw, 400))
    left += left[:3]
    a = spark.createDataFrame(left, "k int, s bigint, e bigint, i int")
    b = spark.createDataFrame(right, "k int, s bigint, e bigint, i int")
    for by in (["k"], []):
        want = {}
        for x in left:
            n = sum(None not in (x[1], y[1]) and x[2] > x[1] and y[2] > y[1] and x[1] < y[2] and y[1] < x[2] and (not by or (x[0] is not None and x[0] == y[0])) for y in right)
            want[x[3]] = want.get(x[3], 0) + n
        got = T.interval_load(a, b, ["i"], by, ("s", "e"), ("s", "e"))
        assert {r["i"]: r["n"] for r in got.collect()} == {k: v for k, v in want.items() if v}
    assert T.interval_load(a, b.limit(0), ["i"], [], ("s", "e"), ("s", "e")).count() == 0


def test_load_of_a_crowd(spark):
    """Everything overlaps everything: 10^10 pairs."""
    a = spark.range(100_000).select("id", (F.col("id") % 7).alias("s"), (F.col("id") % 5 + 100).alias("e"))
    got = T.interval_load(a, a, ["id"], [], ("s", "e"), ("s", "e"))
    assert [tuple(r) for r in got.groupBy("n").count().collect()] == [(100_000, 100_000)]
