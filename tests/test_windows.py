"""Streams by event time against plain counts, in any order of the files and over restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fieldbook.streaming import windows as W

START = dt.datetime(2024, 1, 1)
SCHEMA = "k string, at timestamp_ntz, v bigint"


def rows(n, seed=3):
    draw = random.Random(seed)
    return [(draw.choice(["a", "a", "b", None]), None if i % 50 == 0 else START + dt.timedelta(minutes=draw.randrange(0, 3000, 5)), i) for i in range(n)]


def put(spark, path, some):
    spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def sessions(some, gap):
    out = []
    for key in {k for k, t, v in some}:
        group = None
        for t, v in sorted((t, v) for k, t, v in some if k == key and t is not None):
            if group and t <= group[1] + gap:
                group = (group[0], t, group[2] + 1, group[3] + v)
            else:
                if group:
                    out.append((key, *group))
                group = (t, t, 1, v)
        if group:
            out.append((key, *group))
    return sorted(((k, a, b + gap, n, v) for k, a, b, n, v in out), key=repr)


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (3, 1, 0, 2)])
def test_windows_equal_a_batch_in_any_order_of_files(spark, tmp_path, order):
    some = rows(400)
    by_time = sorted(some, key=lambda r: (r[1] is None, r[1] or START))
    for i in order:
        put(spark, f"{tmp_path}/in", by_time[i * 100 : i * 100 + 100])
    got = W.event_windows(spark, f"{tmp_path}/in", "at", ["k"], ["v"], f"{tmp_path}/w", width="1 hour").collect()
    want = {}
    for k, t, v in some:
        if t is not None:
            place = want.setdefault((k, t.replace(minute=0)), [0, 0])
            place[0] += 1
            place[1] += v
    assert {(r["k"], r["window_start"]): [r["n"], r["v"]] for r in got} == want
    late = sum(r["n_late"] for r in got)
    assert late == 0 if order == (0, 1, 2, 3) else late > 0
    last = max(t for k, t, v in some if t) - dt.timedelta(hours=1)
    assert all(r["closed"] == (r["window_end"] <= last) for r in got)
    gap = dt.timedelta(minutes=15)
    got = W.event_windows(spark, f"{tmp_path}/in", "at", ["k"], ["v"], f"{tmp_path}/s", gap="15 minutes").collect()
    assert sorted(((r["k"], r["window_start"], r["window_end"], r["n"], r["v"]) for r in got), key=repr) == sessions(some, gap)


def test_windows_go_on_after_a_restart(spark, tmp_path):
    some = sorted((r for r in rows(200) if r[1]), key=lambda r: r[1])
    run = lambda: W.event_windows(spark, f"{tmp_path}/in", "at", ["k"], ["v"], f"{tmp_path}/w", gap="15 minutes")
    for part in (some[::2], some[1::2]):  # every session lies in both files
        put(spark, f"{tmp_path}/in", part)
        run()
    assert sorted(((r["k"], r["window_start"], r["window_end"], r["n"], r["v"]) for r in run().collect()), key=repr) == sessions(some, dt.timedelta(minutes=15))


def plain_spikes(counts, factor, least, history, mark):
    out = []
    for key, of in counts.items():
        first = min(of)
        for p in sorted(of):
            past = [of.get(q, 0) for q in range(p - history, p)]
            if p - history >= first and (p + 1) * 3600 <= mark and of[p] >= least and of[p] * history > factor * sum(past):
                out.append((key, p, of[p], sum(past)))
    return sorted(out)


def test_spikes_are_told_once_over_restarts(spark, tmp_path):
    draw = random.Random(4)
    some = []
    for h in range(60):
        for key in ("a", "b", "c"):
            if key == "c" and 20 <= h < 30:
                continue  # nothing for ten hours
            for _ in range(draw.choice([2, 3, 3, 4, 15])):
                some.append((key, START + dt.timedelta(hours=h, minutes=draw.randrange(60)), 1))
    some += [(None, START, 1), ("a", None, 1)]
    some.sort(key=lambda r: r[1] or START)
    epoch = dt.datetime(1970, 1, 1)
    counts = {}
    for k, t, _ in some:
        if k and t:
            p = int((t - epoch).total_seconds()) // 3600
            counts.setdefault(k, {})[p] = counts.get(k, {}).get(p, 0) + 1
    run = lambda: W.spike_stream(spark, f"{tmp_path}/in", "k", "at", f"{tmp_path}/s", 3600, 2.0, 6)
    third = len(some) // 3 + 1
    for i in range(3):
        put(spark, f"{tmp_path}/in", some[i * third : i * third + third])
        got = sorted(tuple(r) for r in run().collect())
        mark = (max(t for _, t, _ in some[: i * third + third] if t) - epoch).total_seconds() - 3600
        assert got == plain_spikes(counts, 2.0, 6, 4, mark)
    assert got and sorted(tuple(r) for r in run().collect()) == got
