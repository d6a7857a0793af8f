"""Windows, top-k, Pareto fronts, normalisation, nearest neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crucible.functions import similarity
from crucible.operators import blocks, knn
from crucible.scratch import written


def numbered(df: DataFrame, by: list[str], order: list[str | Column], name: str, ranges: int | None = None) -> DataFrame:
    """The row number from 1 of each row in its group by ``order``, which must decide all ties that matter.

    Rows are dealt to ranges of (group, order) and ranked there; a range starts at what the ranges before it hold of the group. So a group of
    any size is ranked by many tasks, and the driver sees nothing.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(n, *by, *keys).withColumn("_range", F.spark_partition_id()), "ranges")  # so that the ranges stay
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_range", *by).orderBy(*keys)))
    counts = dealt.groupBy("_range", *by).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", *by, F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    same = [own[c].eqNullSafe(before[c]) for c in ("_range", *by)]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return own.join(before, condition).select(*[own[c] for c in df.columns], (F.col("_own") + F.col("_before")).alias(name))


def latest_by(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def top(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def pareto(df: DataFrame, by: list[str], cost: str, quality: str, tie: str) -> DataFrame:
    """Rows whose quality is strictly above that of all cheaper ones, by ascending cost.

    Of equal costs only the best row can stay, and of ranges of cost each is first held against the best of the ranges before it: what is
    left for the window of a group is its front within each range.
    """
    best = df.groupBy(*by, cost).agg(F.min_by(F.struct(*df.columns), F.struct((-F.col(quality)).alias("q"), F.col(tie))).alias("_r")).select("_r.*")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = best.repartitionByRange(n, *by, cost).withColumn("_range", F.spark_partition_id())
    before = lambda *part: Window.partitionBy(*by, *part).orderBy(cost, F.desc(quality), tie).rowsBetween(Window.unboundedPreceding, -1)
    front = dealt.withColumn("_m", F.max(quality).over(before("_range"))).where(F.col("_m").isNull() | (F.col(quality) > F.col("_m")))
    return front.withColumn("_m", F.max(quality).over(before())).where(F.col("_m").isNull() | (F.col(quality) > F.col("_m"))).drop("_m", "_range")


def minmax(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """(key, metric, value, scaled): constant columns are 1, all-null columns 0, other nulls stay null."""
    long = df.unpivot(key, columns, "metric", "value")
    ends = long.groupBy("metric").agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
    scaled = F.when(F.col("_low").isNull(), 0.0).when(F.col("value").isNull(), None).when(F.col("_low") == F.col("_high"), 1.0).otherwise((F.col("value") - F.col("_low")) / (F.col("_high") - F.col("_low")))
    return long.join(ends, "metric").select(*key, "metric", "value", scaled.alias("scaled"))


def neighbours(queries: DataFrame, db: DataFrame, block: list[str], metric: str, k: int, least: float | None = None, strict: bool = True) -> DataFrame:
    """(query_id, db_id, score, rank from 1): the k best rows of ``db`` (db_id, vec) for each query (query_id, vec), among those with equal ``block``
    columns (a tag or scaffold), above ``least`` (or at it); ties by id. A row is not its own neighbour.

    ``metric``: cosine, jaccard, or euclidean as a distance below zero. All pairs of a block are scored, in cells (``blocks.best``).
    """
    found = blocks.best(queries if least is None else queries.withColumn("bound", F.lit(float(least))), db, block, metric, k)
    return found if least is None else found.where(F.col("score") > least if strict else F.col("score") >= least)


def nearest_hamming(queries: DataFrame, db: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of ``db`` (db_id, bits, label) to each query (query_id, bits) by differing bits of packed fingerprints, rank from 0.

    ``queries`` is a stated query set; the database is scanned once against it.
    """
    q = queries.select("query_id", F.col("bits").alias("_q"))
    d = db.select("db_id", "label", F.col("bits").alias("_d")).join(q).withColumn("distance", similarity.packed_hamming("_q", "_d"))
    # the best k of each partition's share first, so that the shuffle carries k rows a query and task
    salted = d.withColumn("_part", F.spark_partition_id())
    first = salted.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "_part").orderBy("distance", "db_id"))).where(F.col("_n") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "db_id")) - 1).where(F.col("rank") < k).select("query_id", "db_id", "label", "distance", "rank")


def first_accepted(neighbours_: DataFrame, accepted: Column) -> DataFrame:
    """The nearest accepted label of each query and its raw rank; labels seen before don't count again."""
    once = neighbours_.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "label").orderBy("rank"))).where("_n = 1")
    return once.where(accepted).groupBy("query_id").agg(F.min_by("label", "rank").alias("label"), F.min("rank").alias("rank"))


def nearest(points: DataFrame, key: str, columns: list[str], n: int, bucket: int = 2000) -> DataFrame:
    """The n nearest other rows by Euclidean distance over ``columns``; a row is never its own neighbour. Rows with a null there have none.

    All columns count in the index (``knn``): rows lie in lists of about ``bucket`` rows around pivots, and of these only what the triangle
    inequality can't exclude is met, so no pair of far rows is formed and none near is missed. Keys must be distinct.
    """
    whole = points.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])).select(F.col(key).alias("db_id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("vec"))
    names = None
    if not isinstance(whole.schema["db_id"].dataType, T.IntegralType):  # the index takes whole numbers: the place of each key, so that ties go as keys do
        whole = written(numbered(whole, [], ["db_id"], "_n"), "numbered-points")
        names, whole = whole.select("db_id", "_n"), whole.select(F.col("_n").alias("db_id"), "vec")
    index = knn.build(whole, "euclidean", bucket)
    found = knn.search(index, whole.select(F.col("db_id").alias("query_id"), "vec"), n, itself=False)
    if names is not None:
        for c in ("query_id", "db_id"):
            found = found.withColumnRenamed(c, "_n").join(names.withColumnRenamed("db_id", c), "_n").drop("_n")
    return found.select(F.col("query_id").alias(key), F.col("db_id").alias("other"), "distance", (F.col("rank") + 1).alias("rank"))


def closest(candidates: DataFrame, by: list[str], score: str, order: str, least: float) -> DataFrame:
    """The best candidate of each group strictly above ``least``; the first of equals."""
    return latest_by(candidates.where(F.col(score) > least), by, [F.desc(score), F.col(order)])


def popular(df: DataFrame, by: list[str], name: str, score: str, without: str = "solvent-free") -> DataFrame:
    """The name with the greatest score, ``without`` aside, and whether ``without`` scores higher."""
    good = F.col(name) != without
    out = df.groupBy(*by).agg(F.max_by(F.when(good, F.col(name)), F.when(good, F.struct(F.col(score), F.col(name)))).alias("popular"), F.max(F.when(good, F.col(score))).alias("score"), F.max(F.when(~good, F.col(score))).alias("_other"))
    return out.withColumn("other_higher", F.coalesce(F.col("_other") > F.col("score"), F.lit(False))).drop("_other")


def worst(df: DataFrame, by: list[str], scores: list[str], tie: str, k: int = 3) -> DataFrame:
    return top(df, by, [*[F.col(s).asc_nulls_first() for s in scores], F.col(tie)], k)


def step_ceiling(sidecars: DataFrame, steps: int = 16) -> DataFrame:
    return sidecars.withColumn("hit_ceiling", F.coalesce(F.col("steps") >= steps, F.lit(False)))
