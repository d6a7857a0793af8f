"""Hard-negative mining against all pairs: ties, zero and negative scores, hot labels, blocks, odd rows, scores near 64 bits."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crucible.llm import negatives

ROWS = "vec_id long, embedding array<double>, label int, score long, _vec string, rank int"
MOST = (1 << 63) - 1


def brute(rows, every, positives=5, wanted=3, low=50, high=95):
    fit = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        fit.setdefault(i, []).append((str(label), v))
    fit = {i: min(r) for i, r in fit.items()}
    whole = {i: [max(-(2**62), min(2**62, math.floor(256 * x) if abs(x) < 1e300 else int(math.copysign(2**62, x)))) for x in v] for i, (_, v) in fit.items()}
    out = []
    for a in fit:
        if a % every:
            continue
        scores = sorted((-max(-MOST, min(MOST, sum(x * y for x, y in zip(whole[a], whole[b], strict=False)))), b) for b in fit if b != a)
        for s, p in [x for x in scores if fit[x[1]][0] == fit[a][0]][:positives]:
            near = [(t, n) for t, n in scores if fit[n][0] != fit[a][0] and 50 * -s <= 100 * -t <= 95 * -s] if (low, high) == (50, 95) else None
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n) in enumerate(near[:wanted])]
    return sorted(out)


def made(seed, n=400, dim=6):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rng.choice([0.0, 0.25, -0.5, 0.75, 1.0, 0.003]) if rng.random() < 0.7 else rng.gauss(0, 1) for _ in range(dim)]
        if rows and rng.random() < 0.3:
            v = list(rows[rng.randrange(len(rows))][1])
        rows.append((i * 3 - 300, v, 0 if rng.random() < 0.5 else rng.randrange(6)))
    rows += [(None, [1.0] * dim, 1), (10_000, None, 1), (10_050, [float("nan")] * dim, 1), (10_100, [float("inf")] * dim, 2), (10_150, [None] * dim, 2), (10_200, [1.0] * dim, None)]
    rows += [(10_250, [], 3), (10_300, [0.0] * dim, 3), (10_301, [0.0] * dim, 3), (10_350, [1.0, 1.0], 4), rows[5], rows[5], (rows[7][0], rows[7][1], 5)]
    return [(*r, 1, "x", 2) for r in rows]


@pytest.mark.parametrize(("seed", "every", "blocks"), [(1, 50, (2048, 1024)), (2, 10, (64, 16)), (3, 3, (37, 500))])
def test_equals_all_pairs(spark, seed, every, blocks):
    rows = made(seed)
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    got = negatives.mine(df, F.col("vec_id") % every == 0, row_block=blocks[0], anchor_block=blocks[1])
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows, every)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20
    assert every == 3 or any(w[4] == 0 for w in want), "a positive of score zero, with negatives of score zero"


def test_large_components(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([1e9, -3e12, 1e300, 5e6, 0.5]) * rng.random() for _ in range(3)], i % 3, 0, "", 0) for i in range(40)]
    got = negatives.mine(spark.createDataFrame(rows, ROWS), F.col("vec_id") % 2 == 0, row_block=7, anchor_block=3)
    assert sorted(map(tuple, got.collect())) == brute(rows, 2)


def test_floats_of_one_label_and_empty_tables(spark):
    rows = [(i, [float(i), 1.0], "a") for i in range(60)]
    one = negatives.mine(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string"))
    assert one.count() == 0
    assert negatives.mine(spark.createDataFrame([], ROWS)).count() == 0


def test_keys_sort_as_their_parts():
    rng = random.Random(4)
    parts = [(rng.choice([-5, 0, 7, -(2**63), MOST]), rng.choice([-9, 0, 4, MOST, -MOST]), rng.randrange(2), rng.choice([-2, 0, 3, MOST])) for _ in range(500)]
    keys = [k.tobytes() for k in negatives.packed(*(np.array(c) for c in zip(*parts, strict=True)))]
    assert [negatives.unpacked(k) for k in keys] == parts
    assert [negatives.unpacked(k) for k in sorted(keys)] == sorted(parts, key=lambda p: (p[0], -p[1], p[2], p[3]))


def test_iterator_holds_open_windows_only():
    """Keys of two anchors, as the sort gives them: the positive at 100 opens 50 to 95."""
    keys = [(1, 100, 0, 9), (1, 96, 1, 8), (1, 95, 1, 7), (1, 80, 0, 6), (1, 77, 1, 5), (1, 76, 1, 4), (1, 50, 1, 3), (1, 49, 1, 2), (2, 90, 1, 1)]
    packed = [k.tobytes() for k in negatives.packed(*(np.array(c) for c in zip(*keys, strict=True)))]
    assert list(negatives.mined(iter(packed), 5, 3, 50, 95)) == [(1, 9, 1, 7, 100, 95), (1, 9, 2, 5, 100, 77), (1, 9, 3, 4, 100, 76), (1, 6, 1, 4, 80, 76), (1, 6, 2, 3, 80, 50), (1, 6, 3, 2, 80, 49)]
