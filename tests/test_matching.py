"""Matching in rounds, parts, sparse paths and auctions, against plain versions."""

import itertools
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crucible.operators import assign, graph, matching


def made(seed, groups="ab", n=60, ends=25):
    rng = random.Random(seed)
    cells = {(rng.choice([*groups, None]), rng.randrange(ends), rng.randrange(ends)): rng.choice([0.25, 0.5, 0.5, 0.75, rng.random()]) for _ in range(n * len(groups))}
    return [(*k, v) for k, v in cells.items()]


def sequence(rows):
    used, out = set(), set()
    for g, a, b, s in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        if (g, "l", a) not in used and (g, "r", b) not in used:
            used |= {(g, "l", a), (g, "r", b)}
            out.add((g, a, b, s))
    return out


@pytest.mark.parametrize(("most", "part", "shrink"), [(200_000, 500_000, 0.9), (5, 500_000, 0.9), (5, 7, 0.95), (5, 9, 0.0), (30, 1, 1.1)])
def test_greedy_is_the_sequence(spark, most, part, shrink):
    """In streams, in one part, in rounds and then parts, in parts alone, in rounds alone."""
    rows = made(1) if most > 5 else made(2, "a", 50, 12)
    df = spark.createDataFrame(rows, "g string, a long, b long, score double").repartition(3)
    got = matching.greedy(df, ["g"], "a", "b", [-F.col("score")], most, part, shrink)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(sequence(rows), key=repr)


def test_greedy_without_groups_and_of_nothing(spark):
    rows = [("x", a, b, s) for _, a, b, s in made(3, "a")]
    flat = {(a, b): s for _, a, b, s in rows}
    df = spark.createDataFrame([(*k, s) for k, s in flat.items()], "a long, b long, score double")
    for most in (200_000, 3):
        got = matching.greedy(df, [], "a", "b", [-F.col("score")], most, 4)
        assert {tuple(r) for r in got.collect()} == {(a, b, s) for _, a, b, s in sequence([("x", *k, s) for k, s in flat.items()])}
    assert matching.greedy(df.where("a < 0"), [], "a", "b", [-F.col("score")]).count() == 0


def best_total(rows):
    """The greatest total of one-to-one pairs, by trying all."""
    lefts = sorted({a for a, _, _ in rows})
    best = {frozenset(): 0.0}
    for x in lefts:
        now = dict(best)
        for used, total in best.items():
            for a, b, s in rows:
                if a == x and b not in used and total + s > now.get(used | {b}, -1):
                    now[used | {b}] = total + s
        best = now
    return max(best.values())


def test_sparse_paths_find_the_greatest_total():
    rng = random.Random(7)
    for k in range(300):
        n, m = rng.randint(1, 7), rng.randint(1, 7)
        cells = {(rng.randrange(n), rng.randrange(m)): rng.choice([rng.random(), 0.5, 1 / 3, 0.0, -1.0]) for _ in range(rng.randint(1, 16))}
        a, b, s = (np.array(c) for c in zip(*[(x, y, z) for (x, y), z in cells.items()], strict=True))
        keep = matching.sparse_assignment(a, b, s)
        assert len({a[i] for i in keep}) == len({b[i] for i in keep}) == len(keep)
        want = best_total([(x, y, z) for (x, y), z in cells.items() if z > 0] or [(0, 0, 0.0)])
        assert sum(s[i] for i in keep) == pytest.approx(want), k
        if (s > 0).all():
            assert sum(s[i] for i in assign.chosen_of(a, b, s)) == pytest.approx(want)


@pytest.mark.parametrize("kind", ["up", "random", "equal"])
def test_a_chain_of_many_pairs(spark, kind):
    """Two hundred thousand pairs in one connected set: their matrix would have 10^10 cells."""
    n = 100_000
    rng = np.random.default_rng(1)
    k = np.arange(2 * n - 1)
    score = {"up": 1.0 + k, "random": rng.random(len(k)) + 0.01, "equal": np.ones(len(k))}[kind]
    a, b = (k + 1) // 2, k // 2
    began = time.perf_counter()
    keep = matching.sparse_assignment(a, b, score)
    assert time.perf_counter() - began < 30
    taken = np.zeros(len(k), bool)
    taken[keep] = True
    # along a chain the greatest total follows from the two pairs before
    with_, without = 0.0, 0.0
    for s in score.tolist():
        with_, without = without + s, max(with_, without)
    assert score[taken].sum() == pytest.approx(max(with_, without))
    df = spark.createDataFrame(pd.DataFrame({"g": 0, "a": a, "b": b, "s": score}))
    if kind == "up":
        got = matching.greedy(df, ["g"], "a", "b", [-F.col("s")], most=1000, part=150_000)
        assert got.count() == n and got.agg(F.sum("s")).first()[0] == score[::2].sum()
    if kind == "random":
        got = assign.assign(df, ["g"], "a", "b", "s", most=1000)
        assert got.agg(F.sum("score")).first()[0] == pytest.approx(score[taken].sum())


def test_auction_comes_within_its_gap(spark):
    rng = random.Random(5)
    rows = [(g, a, b, rng.choice([0.5, 0.5, rng.random()])) for g, a, b in itertools.product(["x", None], range(4), range(3)) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "g string, a long, b long, s double")
    got = assign.assign(df, ["g"], "a", "b", "s", most=3, largest=4, gap=0.1).collect()  # sets of over four pairs are too large for a task here
    for g in ("x", None):
        own = [r for r in got if r.g == g]
        want = best_total([(a, b, s) for h, a, b, s in rows if h == g])
        assert len({r.a for r in own}) == len({r.b for r in own}) == len(own)
        assert want - 0.1 * 4 <= sum(r.score for r in own) <= want + 1e-9


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_components_in_one_task_and_in_rounds(spark, few):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1040)] + [(7, 7)]
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    want = {(x, find(x)) for x in up if any(x in e and e[0] != e[1] for e in links)}
    got = graph.components(spark.createDataFrame(links, "a long, b long"), few=few)
    assert {tuple(r) for r in got.collect()} == want
    assert graph.components(spark.createDataFrame([], "a long, b long"), few=few).count() == 0
