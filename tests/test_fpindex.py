"""Threshold search by the index against a scan, for sets and counts, with the share of pairs that it scores."""

import random

import pytest
from pyspark.sql import functions as F

from crucible.functions import similarity
from crucible.operators import fpindex
from crucible.plans import scoring
from crucible.plans.registry import Tables


def made(seed, n=400, width=120):
    """Sparse vectors of some families, with counts up to 3, copies and empty ones; low positions are common."""
    rng = random.Random(seed)
    rows, families = [], [{int(width * rng.random() ** 2): rng.choice([1, 1, 2, 3]) for _ in range(rng.randint(5, 25))} for _ in range(25)]
    for i in range(n):
        on = {p: c for p, c in rng.choice(families).items() if rng.random() < 0.85} if rng.random() < 0.8 else {int(width * rng.random() ** 2): 1 for _ in range(rng.randint(0, 20))}
        rows.append((i, [on.get(p, 0) for p in range(width)], rng.choice(["a", "b", "b"])))
    return [*rows, (n, [0] * width, "a"), (n + 1, [0] * width, "b"), (n + 2, rows[3][1], rows[3][2]), (n + 3, None, "a")]


@pytest.mark.parametrize(("metric", "least", "block"), [("jaccard", 0.6, []), ("jaccard", 0.3, ["g"]), ("dice", 0.8, []), ("sokal_sneath", 0.4, ["g"]), ("kulczynski1", 1.5, [])])
def test_equals_a_scan(spark, metric, least, block):
    rows = made(1)
    db = spark.createDataFrame(rows, "db_id long, fp array<int>, g string").repartition(3)
    queries = db.where("db_id % 3 = 0 OR db_id >= 400").select(F.col("db_id").alias("query_id"), F.col("fp").alias("query_fp"), "g")
    if metric == "kulczynski1":
        least = 0.6
    index = fpindex.build(db, least, metric, block)
    got = {(r.query_id, r.db_id, r.rank, round(r.score, 9)) for r in fpindex.search(index, queries, 7, least).collect()}
    pairs = queries.withColumnRenamed("g", "_g").crossJoin(db).where("query_id != db_id").where("g = _g" if block else "true")
    scan = pairs.withColumn("score", similarity.similarity("query_fp", "fp", metric)).where(F.col("score") > least).select("query_id", "db_id", "score").collect()
    want = set()
    for q in {r.query_id for r in scan}:
        own = sorted((r for r in scan if r.query_id == q), key=lambda r: (-r.score, r.db_id))[:7]
        want |= {(q, r.db_id, k + 1, round(r.score, 9)) for k, r in enumerate(own)}
    assert got == want and len(want) > 100
    if metric == "jaccard" and not block:
        share = fpindex.candidates(index, queries, least).count() / pairs.count()
        assert share < 0.12, f"{share:.3f} of the pairs are scored"
        higher = fpindex.candidates(index, queries, 0.9).count() / pairs.count()
        assert higher < share


def test_thresholds_and_metrics_that_are_not_served(spark):
    db = spark.createDataFrame([(1, [1, 0])], "db_id long, fp array<int>")
    with pytest.raises(ValueError, match="above 0"):
        fpindex.build(db, 0.5, "cosine")
    with pytest.raises(ValueError, match="0.5 and above"):
        fpindex.candidates(fpindex.build(db, 0.5), db.select(F.col("db_id").alias("query_id"), F.col("fp").alias("query_fp")), 0.4)


@pytest.mark.parametrize("width", [1, 2, 3])
def test_keys_of_any_width_miss_no_pair(spark, width):
    rows = made(2, n=150)
    db = spark.createDataFrame(rows, "db_id long, fp array<int>, g string").repartition(3)
    queries = db.where("db_id % 2 = 0").select(F.col("db_id").alias("query_id"), F.col("fp").alias("query_fp"), "g")
    for least in (0.25, 0.5):
        index = fpindex.build(db, least, "jaccard", ["g"])
        got = {(r.query_id, r.db_id) for r in fpindex.candidates(index, queries, least, width).collect()}
        pairs = queries.withColumnRenamed("g", "_g").crossJoin(db).where("g = _g")
        want = {(r.query_id, r.db_id) for r in pairs.where(similarity.similarity("query_fp", "fp", "jaccard") >= least).select("query_id", "db_id").collect()}
        assert want <= got and len(want) > 100


def test_copies_are_met_once(spark):
    """30,000 rows of 40 vectors, 6,000 of them queries: as rows, millions of pairs at the lowest threshold."""
    fp = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda k: F.when((k == F.col("db_id") % 40) | (k == (F.col("db_id") + 1) % 40), 1).otherwise(0))
    db = spark.range(30_000).select(F.col("id").alias("db_id")).select("db_id", fp.alias("fp"))
    index = fpindex.build(db, 0.3)
    queries = db.where("db_id % 5 = 0").select(F.col("db_id").alias("query_id"), F.col("fp").alias("query_fp"))
    assert index.classes.count() == 40
    got = fpindex.search(index, queries, 3, 0.3).where("query_id IN (0, 200)").collect()
    assert {(r.query_id, r.rank, r.db_id, r.score) for r in got} == {(0, 1, 40, 1.0), (0, 2, 80, 1.0), (0, 3, 120, 1.0), (200, 1, 0, 1.0), (200, 2, 40, 1.0), (200, 3, 80, 1.0)}


def test_small_sets_meet_few_others(spark):
    """6,000 sets of up to 9 of 100 positions: an eighth of the pairs that meet in a key reach the threshold at least, and no pair is missed."""
    rng = random.Random(3)
    sets = [set(rng.sample(range(100), rng.randint(1, 9))) for _ in range(6000)]
    db = spark.createDataFrame([(i, [int(p in s) for p in range(100)]) for i, s in enumerate(sets)], "db_id long, fp array<int>").repartition(3)
    queries = db.where("db_id % 50 = 0").select(F.col("db_id").alias("query_id"), F.col("fp").alias("query_fp"))
    index = fpindex.build(db, 0.45)
    got = {(r.query_id, r.db_id) for r in fpindex.candidates(index, queries, 0.45).collect()}
    want = {(q, i): len(sets[q] & s) / len(sets[q] | s) for q in range(0, 6000, 50) for i, s in enumerate(sets) if len(sets[q] & s) / len(sets[q] | s) >= 0.45}
    assert set(want) <= got and len(want) > 500
    assert len(got) < 8 * len(want), f"{len(got)} pairs for {len(want)}"
    found = {(r.query_id, r.db_id, r.rank, round(r.score, 9)) for r in fpindex.search(index, queries, 3, 0.45).collect()}
    others = {q: sorted((-s, i) for (x, i), s in want.items() if x == q and i != q and s > 0.45)[:3] for q in range(0, 6000, 50)}
    assert found == {(q, i, k, round(-s, 9)) for q, some in others.items() for k, (s, i) in enumerate(some, 1)}


def test_tokens_of_arrays_are_those_of_the_expression(spark):
    rows = [(0, [0, 2, 0, -1]), (1, []), (2, [0, 0]), (3, [None, 5]), (4, [7]), (5, None)]
    df = spark.createDataFrame(rows, "db_id long, fp array<int>").coalesce(1)
    want = {r.db_id: r.t for r in df.where("fp IS NOT NULL").select("db_id", fpindex.tokens("fp").alias("t")).collect()}
    for kind in ("array<int>", "array<bigint>", "array<tinyint>", "array<double>"):
        got = fpindex.build(df.withColumn("fp", F.col("fp").cast(kind)), 0.5).rows.collect()
        assert {r.db_id: r.tokens for r in got} == want


def test_contents_of_orders(spark, tmp_path):
    """Each supplier's place once, whatever the keys; an order without lines has no vector."""
    lines = [(1, 5), (1, 105), (1, 99), (2, None), (3, -5), (3, 50), (3, 49), (None, 7), (4, 1 << 40), (6, 0)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, "F") for k in (1, 2, 3, 4, 5, 4)], "o_orderkey long, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    got = scoring.contents(Tables(spark, str(tmp_path)))
    assert dict(got.dtypes)["fp"] == "array<int>"
    on = {1: [5, 99], 2: [], 3: [49, 50], 4: [(1 << 40) % 100]}
    want = [(k, [int(p in on[k]) for p in range(100)], "F") for k in (1, 2, 3, 4, 4)]
    assert sorted(map(tuple, got.select("db_id", "fp", "SCAFFOLD").collect())) == want
