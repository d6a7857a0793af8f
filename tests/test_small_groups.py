"""Many small groups, without a frame for each, and long windows read once."""

import random
import time

from pyspark.sql import functions as F

from crucible.operators import assign, boxes, matching


def test_groups_over_batches(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", "c", None]), k % 2 if k % 3 else None, k) for k in range(900)]
    df = spark.createDataFrame(rows, "g string, h long, v long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = matching.kept_in_groups(df, ["g", "h"], ["v"], ["v"], lambda v: [0, len(v) - 1]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    ends = {}
    for g, h, v in rows:
        ends.setdefault((g, h), []).append(v)
    assert sorted(r.v for r in got) == sorted(x for v in ends.values() for x in (v[0], v[-1]))


def test_many_groups_are_quick(spark):
    """With a frame for each of these groups, minutes."""
    pairs = spark.range(400_000).select((F.col("id") / 4).cast("long").alias("g"), (F.col("id") / 2 % 2).cast("long").alias("a"), (F.col("id") % 2).alias("b"), (F.col("id") % 4 + 1.0).alias("s"))
    start = time.time()
    assert assign.assign(pairs, ["g"], "a", "b", "s").agg(F.count("*"), F.sum("score")).first()[:] == (200_000, 500_000.0)
    x = (F.col("id") % 3) * 10.0
    line = spark.range(700_000).select((F.col("id") / 7).cast("long").alias("image"), (F.col("id") % 7).alias("idx"), x.alias("x1"), F.lit(0.0).alias("y1"), (x + 5).alias("x2"), F.lit(5.0).alias("y2"))
    assert boxes.dedupe_kept(line, ["image"]).count() == 300_000
    assert time.time() - start < 100


def test_precision_curve_is_read_once(spark):
    """60,000 hits in one stretch: a frame to its end for each hit would be 2 * 10^9 steps."""
    line = spark.range(60_000).select(F.col("id").alias("image"), F.lit(0).alias("idx"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(5.0).alias("x2"), F.lit(5.0).alias("y2"), F.lit(1).alias("category"))
    start = time.time()
    assert boxes.detection_ap(line, line.withColumn("score", -F.col("image").cast("double"))).first().ap == 1.0
    assert time.time() - start < 30
