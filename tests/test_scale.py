"""Operators that rank, search and assign by ranges, buckets and connected sets, against plain versions, with small ranges."""

import random

import pytest
from pyspark.sql import functions as F

from crucible import scratch
from crucible.operators import assign, graph, ranking, splits


def rows(n=300, seed=1):
    rng = random.Random(seed)
    return [(k, rng.choice(["a", "b", None]), rng.randrange(40), rng.random() * 10, rng.random() * 10) for k in range(n)]


def test_numbered(spark):
    data = rows()
    got = ranking.numbered(spark.createDataFrame(data, "k long, g string, v int, x double, y double"), ["g"], [F.desc("v"), "k"], "n", ranges=7).collect()
    want = {}
    for g in ("a", "b", None):
        for n, r in enumerate(sorted((r for r in data if r[1] == g), key=lambda r: (-r[2], r[0])), 1):
            want[r[0]] = n
    assert {r.k: r.n for r in got} == want
    assert ranking.numbered(spark.createDataFrame([], "k long, v int"), [], ["k"], "n").count() == 0


def test_pareto(spark):
    data = [(k, g or "", v, x) for k, g, v, x, _ in rows()]
    got = {r.k for r in ranking.pareto(spark.createDataFrame(data, "k long, g string, cost int, q double"), ["g"], "cost", "q", "k").collect()}
    want = set()
    for g in ("a", "b", ""):
        best = None
        for r in sorted((r for r in data if r[1] == g), key=lambda r: (r[2], -r[3], r[0])):
            if best is None or r[3] > best:
                best = r[3]
                want.add(r[0])
    assert got == want


@pytest.mark.parametrize("bucket", [2000, 20])
def test_nearest(spark, bucket):
    data = rows()
    points = spark.createDataFrame([*data, (900, "a", 1, None, 1.0)], "k long, g string, v int, x double, y double")
    got = {(r.k, r.other) for r in ranking.nearest(points, "k", ["x", "y"], 3, bucket).collect()}
    far = lambda a, b: (a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2
    assert got == {(a[0], b[0]) for a in data for b in sorted((b for b in data if b is not a), key=lambda b: (far(a, b), b[0]))[:3]}


def brute(pairs):
    """The greatest total of one-to-one pairs."""
    best = {frozenset(): 0.0}
    lefts = sorted({a for a, _, _ in pairs})
    for a in lefts:
        now = dict(best)
        for used, total in best.items():
            for x, b, s in pairs:
                if x == a and b not in used and total + s > now.get(used | {b}, -1):
                    now[used | {b}] = total + s
        best = now
    return max(best.values())


@pytest.mark.parametrize("most", [200_000, 3])
def test_assignment(spark, most):
    rng = random.Random(3)
    data = sorted({(g, rng.randrange(6), rng.randrange(7)): rng.randrange(1, 50) / 10 for g in "ab" for _ in range(14)}.items())
    df = spark.createDataFrame([(*k, v) for k, v in data], "g string, a long, b long, s double")
    got = assign.assign(df, ["g"], "a", "b", "s", most=most).collect()
    for g in "ab":
        own = [r for r in got if r.g == g]
        assert len({r.a for r in own}) == len({r.b for r in own}) == len(own)
        assert sum(r.score for r in own) == pytest.approx(brute([(a, b, s) for (x, a, b), s in data if x == g]))


def test_splits_keep_null_labels(spark):
    df = spark.createDataFrame(rows(), "k long, g string, v int, x double, y double")
    got = splits.stratified(df, "k", "g").collect()
    assert len(got) == 300
    for g in ("a", "b", None):
        own = [r for r in got if r.g == g]
        assert sum(r.test for r in own) == int(len(own) * 0.2)


def test_khop_and_counts_of_makers(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(6)], "src long, dst long")
    assert {(r.node, r.hops) for r in graph.khop(edges, spark.createDataFrame([(0,)], "node long"), 3).collect()} == {(k, k) for k in range(4)}


def test_scratch_is_one_folder_and_goes(spark):
    path = scratch.scratch_path(spark, "x")
    assert path.startswith(scratch.scratch_dir(spark) + "/x-")
    assert scratch.written(spark.range(3), "y").count() == 3
