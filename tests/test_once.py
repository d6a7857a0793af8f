"""Work on a row doesn't repeat an expression for each element, and resamples are drawn without a row for each draw."""

import time

from pyspark.sql import functions as F

from crucible.functions import molecules
from crucible.operators import rollup


def test_fingerprint_counts_slots(spark):
    texts = ["", "abc", "abcd", "abcabcabcabc", None, "x" * 40]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for bits in (1, 7, 256):
        for r in df.select("t", molecules.text_fingerprint("t", bits).alias("fp")).collect():
            grams = [r.t[k : k + 4] for k in range(len(r.t or "") - 3)] if r.t else []
            assert len(r.fp) == bits and sum(r.fp) == len(grams)
            slots = [x.s for x in spark.createDataFrame([(g,) for g in grams], "g string").select(F.pmod(F.xxhash64("g"), F.lit(bits)).alias("s")).collect()] if grams else []
            assert r.fp == [slots.count(b) for b in range(bits)]


def test_fingerprints_are_found_once(spark):
    df = spark.range(400).select(F.repeat(F.col("id").cast("string"), 30).alias("t"))
    start = time.time()
    df.select(molecules.text_fingerprint("t", 4096).alias("fp")).selectExpr("sum(aggregate(fp, 0, (a, x) -> a + x))").collect()
    assert time.time() - start < 20  # slots found again for each of 4,096 places: minutes


def test_resamples_are_not_rows(spark):
    df = spark.createDataFrame([("a", 1.0, 5), ("a", 0.0, 6), (None, 1.0, 7), ("b", None, 8), ("b", 3.0, 9)], "g string, v double, k long")
    rows = rollup.bootstrap(df, ["g"], "v", "k")
    assert "explode" not in rows._jdf.queryExecution().toString().lower()
    got = {r.g: (r.n, r["mean"], r.low, r.high) for r in rows.collect()}
    assert got == {"a": (2, 0.5, 0.0, 1.0), None: (1, 1.0, None, None), "b": (1, 3.0, None, None)}
