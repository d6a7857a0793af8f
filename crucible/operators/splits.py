"""Seeded samples and splits by a hash of the key: the same on every run, cluster size and partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crucible.operators.ranking import numbered

PRIME = 2_147_483_647


def hash_rank(key: Column | str, seed: int = 42) -> Column:
    """A number below 2**31 from an integer key: two rounds of a multiplicative generator, in arithmetic every SQL engine repeats."""
    key = F.col(key) if isinstance(key, str) else key
    x = F.pmod(key.cast("long") * 48_271 + seed * 7919, F.lit(PRIME))
    return F.pmod(F.pmod(x * x, F.lit(PRIME)) * 69_621 + key.cast("long"), F.lit(PRIME))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The n rows of least hash (a sample is the feature)."""
    return df.orderBy(hash_rank(key, seed), key).limit(n)


def split(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """``test`` for each row, by its own hash: no shuffle."""
    return df.withColumn("test", hash_rank(key, seed) < int(share * PRIME))


def _ranked(df: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """Rows with their place ``_r`` in their label's order of hashes, and the label's size ``_n``; no label is ranked in one task."""
    ranked = numbered(df, [label], [hash_rank(key, seed), key], "_r")
    sizes = df.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_n"))
    return ranked.join(sizes, ranked[label].eqNullSafe(sizes._label)).drop("_label")


def stratified(df: DataFrame, key: str, label: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """``test`` for a share of each label; labels too rare to give one row stay in training."""
    n = F.col("_n")
    return _ranked(df, key, label, seed).withColumn("test", (n * share >= 1) & (F.col("_r") <= F.floor(n * share))).drop("_r", "_n")


def cold(df: DataFrame, group: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """``test`` for whole groups, a share of them and one at least; rows without a group stay in training.

    Distinct groups are ranked by ranges of their hash: arithmetic for whole numbers, else a hash of their text.
    """
    groups = df.where(F.col(group).isNotNull()).select(group).distinct()
    whole = isinstance(df.schema[group].dataType, T.IntegralType)
    rank = hash_rank(group, seed) if whole else F.xxhash64(F.col(group).cast("string"), F.lit(seed))
    n = groups.count()
    chosen = numbered(groups, [], [rank, group], "_n").where(F.col("_n") <= max(1, int(n * share))).select(group, F.lit(True).alias("_test"))
    return df.join(chosen, group, "left").withColumn("test", F.coalesce("_test", F.lit(False))).drop("_test")


def per_class(df: DataFrame, key: str, label: str, share: float = 0.2, least: int = 5, seed: int = 42) -> DataFrame:
    """``test`` for a share of each class of ``least`` rows or more, one row at least; smaller classes are left out."""
    ranked = _ranked(df, key, label, seed).where(F.col("_n") >= least)
    return ranked.withColumn("test", F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share))).drop("_n", "_r")


def quota_subset(df: DataFrame, key: str, source: str, reactions: str, quota: dict[str, int], total: int, seed: int = 42) -> DataFrame:
    """A balanced subset: each source's quota, scaled to ``total``, filled in turn from figures with few, some and many reactions."""
    whole = sum(quota.values())
    k = F.create_map(*[F.lit(x) for s, q in quota.items() for x in (s, round(q * total / whole))])
    tier = F.when(F.col(reactions) <= 2, 0).when(F.col(reactions) <= 8, 1).otherwise(2)
    wanted = df.where(F.col(source).isin(*quota)).withColumn("_tier", tier)
    tiered = numbered(wanted, [source, "_tier"], [hash_rank(key, seed), key], "_r")
    # of each tier no more than the quota can be taken, so the last window is over a few rows
    few = tiered.where(F.col("_r") <= F.element_at(k, F.col(source)))
    ranked = few.withColumn("_n", F.row_number().over(Window.partitionBy(source).orderBy("_r", "_tier")))
    return ranked.where(F.col("_n") <= F.element_at(k, F.col(source))).drop("_tier", "_r", "_n")


def coverage_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Coverage and mean rank when found, on a seeded sample of (correct, rank)."""
    return sample(df, key, n, seed).agg(F.count(F.lit(1)).alias("n"), (F.count_if("correct") / F.count(F.lit(1))).alias("coverage"), F.avg(F.when(F.col("correct"), F.col("rank"))).alias("mean_rank"))


def merge_new_wins(old: DataFrame, new: DataFrame, key: str, class_: str) -> DataFrame:
    """New rows, and old ones whose key they lack, without those in conflict."""
    kept = old.join(new, key, "left_anti").where(~F.coalesce(F.startswith(class_, F.lit("CONFLICT:")), F.lit(False)))
    return new.unionByName(kept, allowMissingColumns=True)
