"""Exact neighbours by pivots against all pairs, in several dimensions and in bits, with the share of rows met."""

import math
import random

import pytest
from pyspark.sql import functions as F

from crucible.operators import knn, ranking


def clusters(n, dim, seed):
    rng = random.Random(seed)
    centres = [[rng.uniform(-20, 20) for _ in range(dim)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 1) for x in rng.choice(centres)], rng.choice("xy")) for i in range(n)]
    return [*rows, (n, rows[3][1], "x"), (n + 1, rows[3][1], "y"), (n + 2, None, "x")]


def brute(rows, queries, k, far, itself=False):
    out = set()
    for q, v in queries:
        near = sorted((far(v, w), i) for i, w in rows if itself or i != q)[:k]
        out |= {(q, i, r, round(d, 9)) for r, (d, i) in enumerate(near)}
    return out


@pytest.mark.parametrize(("rows_a_list", "k", "itself"), [(10_000, 3, False), (40, 3, True), (25, 60, False)])
def test_euclidean(spark, rows_a_list, k, itself):
    rows = clusters(900, 6, 1)
    db = spark.createDataFrame(rows, "db_id long, vec array<double>, label string").repartition(4)
    index = knn.build(db, "euclidean", rows_a_list, carry=["label"])
    queries = db.where("vec IS NOT NULL AND db_id % 50 = 0").select(F.col("db_id").alias("query_id"), "vec")
    got = knn.search(index, queries, k, itself)
    plain = [(i, v) for i, v, _ in rows if v]
    assert {(r.query_id, r.db_id, r["rank"], round(r.distance, 9)) for r in got.collect()} == brute(plain, [(i, v) for i, v in plain if i % 50 == 0], k, math.dist, itself)
    assert got.columns == ["query_id", "db_id", "label", "distance", "rank"]
    if rows_a_list == 40:
        share = knn.candidates(index, queries, k, itself).count() / (queries.count() * 902)
        assert share < 0.2, f"{share:.3f} of the rows are met"


def test_hamming(spark):
    rng = random.Random(3)
    bases = [[rng.getrandbits(63) - 2**62 for _ in range(2)] for _ in range(9)]
    rows = [(i, [w ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62)) for w in rng.choice(bases)]) for i in range(500)]
    db = spark.createDataFrame(rows, "db_id long, vec array<long>")
    far = lambda a, b: float(sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a, b, strict=True)))
    index = knn.build(db, "hamming", 30)
    queries = db.where("db_id % 10 = 0").select(F.col("db_id").alias("query_id"), "vec")
    got = {(r.query_id, r.db_id, r["rank"], r.distance) for r in knn.search(index, queries, 5, False).collect()}
    assert got == brute(rows, [r for r in rows if r[0] % 10 == 0], 5, far)
    assert knn.candidates(index, queries, 5, False).count() < 0.35 * 50 * 500


def test_points_whose_first_column_is_constant(spark):
    rng = random.Random(4)
    rows = [(i, 1.0, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(700)]
    points = spark.createDataFrame([*rows, (900, None, 1.0, 1.0)], "k long, x double, y double, z double")
    got = {(r.k, r.other) for r in ranking.nearest(points, "k", ["x", "y", "z"], 2, 50).collect()}
    assert got == {(a[0], b) for a in rows for _, b in sorted((math.dist(a[1:], b[1:]), b[0]) for b in rows if b is not a)[:2]}


def test_nothing(spark):
    none = spark.createDataFrame([], "db_id long, vec array<double>")
    assert knn.search(knn.build(none), none.withColumnRenamed("db_id", "query_id"), 3).count() == 0
