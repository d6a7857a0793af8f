"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crucible.llm.common import WORD, written

CYCLE = (5.0, 2.0, 1.0)
MOST = 3.0
STEPS = 1 << 12


def uniform(id_col: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the id and the seed only: 52 bits of md5."""
    digest = F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, cycle: tuple[float, ...] = CYCLE, most: float = MOST) -> DataFrame:
    """(source, source_size) to targets: weights by code point order, null last, share all sizes; none above ``most`` times its size.

    In ascending order of limit over weight, the level at a source is what the limits before it leave, over the weights left. It rises as
    long as sources meet their limit and falls after, so its maximum is the level of all sources that don't. Rows: one for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in cycle]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(cycle))) + 1).cast("int")))
    rise = Window.orderBy(F.col("_limit") / F.col("_w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    limited = weighed.withColumn("_limit", F.col("source_size").cast("double") * most)
    before = lambda c: F.coalesce(F.sum(c).over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.sum("source_size").over(every).cast("double") - before("_limit")) / (F.sum("_w").over(every) - before("_w"))
    levelled = limited.withColumn("_level", level)
    return levelled.select("source", "source_size", F.least(F.col("_limit"), F.col("_w") * F.max("_level").over(every)).alias("target"))


def mix(docs: DataFrame, weights: DataFrame | None = None, seed: str = "mix", cycle: tuple[float, ...] = CYCLE, most: float = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, *keep, size, source_size, target, taken), one for each row of ``docs``.

    size: words of the text (null: 0). A source takes all its documents as many complete epochs as fit its target, then a fraction: its
    documents ascend by -ln(u)/weight, u a hash of id and seed, and those are taken once more whose middle word is within what is left.
    Equal keys (repeated ids) are ordered by size. ``weights`` has one row (id, weight) for an id; ids that it lacks, and weights that are
    null, not finite or not positive count as 1. Null sources are one source, ordered last. No row, no source: an empty result.
    A text of any length counts whole and is not cut.

    The prefix sum is in two steps, so no source gathers in one task: sums over 4,096 key ranges of each source find the range in which
    its budget ends, and only that range's rows are sorted.
    """
    own = [c for c in keep if c != source_col]
    rows = docs.select(
        F.col(id_col).alias("_id"), *[F.col(c).alias(f"_keep_{c}") for c in own], F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"),
    )
    w = F.lit(1.0)
    if weights is not None:  # after the texts are gone: only sizes are shuffled
        rows = rows.join(weights.select(F.col(weights.columns[0]).alias("_of"), F.col(weights.columns[1]).cast("double").alias("_weight")), F.col("_id") == F.col("_of"), "left").drop("_of")
        w = F.coalesce(F.when((F.col("_weight") > 0) & (F.col("_weight") < float("inf")), F.col("_weight")), F.lit(1.0))
    rows = rows.withColumn("_key", -F.log(uniform(F.col("_id"), seed)) / w).drop("_weight")
    rows = written(rows.withColumn("_step", F.floor((1 - F.exp(-F.col("_key"))) * STEPS).cast("int")), "mix-keys")
    ranges = written(rows.groupBy("source", "_step").agg(F.sum("size").alias("_sum")), "mix-ranges")
    whole = targets(ranges.groupBy("source").agg(F.sum("_sum").alias("source_size")), cycle, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = written(whole.withColumn("_epochs", epochs.cast("long")).withColumn("_left", F.col("target") - F.col("_epochs") * F.col("source_size")), "mix-plan")
    upto = F.sum("_sum").over(Window.partitionBy("source").orderBy("_step").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = ranges.withColumn("_upto", upto).join(plan.select(F.col("source").alias("_s"), "_left"), F.col("source").eqNullSafe(F.col("_s")))
    # the first range that reaches what is left: everything before it is taken, everything after isn't
    ends = ends.where((F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_sum") < F.col("_left"))).groupBy("source").agg(F.min_by(F.struct("_step", (F.col("_upto") - F.col("_sum")).alias("start")), "_step").alias("_e"))
    plan = written(plan.join(ends.select(F.col("source").alias("_s"), F.col("_e._step").alias("_end"), F.col("_e.start").alias("_start")), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "mix-ends")
    joined = rows.join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    clear = joined.where(F.col("_end").isNull() | (F.col("_step") != F.col("_end")))
    edge = joined.where(F.col("_step") == F.col("_end"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("_key", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = edge.withColumn("_once", F.col("_start") + before + F.col("size") / 2 <= F.col("_left"))
    clear = clear.withColumn("_once", F.coalesce(F.col("_step") < F.col("_end"), F.lit(False)))
    taken = F.col("size") * (F.col("_epochs") + F.col("_once").cast("long"))
    names = [F.col("_id").alias(id_col), *[(F.col("source") if c == source_col else F.col(f"_keep_{c}")).alias(c) for c in keep]]
    return clear.unionByName(edge).select(*names, "size", "source_size", "target", taken.cast("long").alias("taken"))


def quality_weights(labels: DataFrame, good: float = 2.0, bad: float = 0.5, id_col: str = "doc_id") -> DataFrame:
    """(id, weight): ``good`` or ``bad`` by the label of quality, the best if an id has several; ids without one are absent."""
    marks = labels.where(F.col("quality").isNotNull()).groupBy(id_col).agg(F.max("quality").alias("_quality"))
    return marks.select(id_col, F.when(F.col("_quality") >= 1, good).otherwise(bad).alias("weight"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
l AS (SELECT doc_id, max(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY 1),
k AS (
  SELECT d.doc_id, source, size,
    -ln((CAST(('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || ':mix'), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
      / (CASE WHEN q >= 1 THEN 2.0::DOUBLE WHEN q < 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) AS key
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CAST(source_size AS DOUBLE) * 3 AS cap,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s),
v AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
      - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
t AS (SELECT source, source_size, least(cap, w * max(level) OVER ()) AS target FROM v),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
r AS (
  SELECT k.*, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN before + size / 2.0 <= rest AND rest > 0 THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
