"""The reaction database: distributions, condition rankings and scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The classes of the distribution.
CLASSES = ("Acylation", "Aromatic Heterocycle Formation", "C-C Coupling", "Deprotection", "Functional Group Addition", "Functional Group Interconversion", "Heteroatom Alkylation and Arylation", "Miscellaneous", "Oxidation", "Protection", "Reduction")


def class_distribution(df: DataFrame, column: str = "CLASS", classes: tuple[str, ...] | DataFrame = CLASSES) -> DataFrame:
    """Counts over a fixed list of classes, zeros included; others are dropped."""
    fixed = classes if isinstance(classes, DataFrame) else df.sparkSession.createDataFrame([(c,) for c in classes], f"{column} string")
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    return fixed.join(counts, column, "left").na.fill(0, ["count"])


def name_distribution(df: DataFrame, column: str = "NAME") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def condition_ranking(df: DataFrame, by: list[str], kinds: tuple[str, ...] = ("SOLVENT", "CATALYST", "REAGENT")) -> DataFrame:
    """Names of each kind by how often they occur; ties by name. One pass over all kinds."""
    long = df.unpivot(by, list(kinds), "kind", "name").where(F.col("name").isNotNull())
    counts = long.groupBy(*by, "kind", "name").agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "kind").orderBy(F.desc("count"), "name")))


def score_conditions(neighbours: DataFrame, by: list[str], kinds: tuple[str, ...] = ("SOLVENT", "CATALYST", "REAGENT"), score: str = "score", unknown: str = "unknown") -> DataFrame:
    """Names of each kind by the similarity of the neighbours that use them, as a share of all similarity.

    ``unknown`` counts in the whole but isn't listed. ``renormalised`` is the share among those listed, if there are several.
    """
    long = neighbours.select(*by, score, *kinds).unpivot([*by, score], list(kinds), "kind", "name").withColumn("name", F.coalesce("name", F.lit(unknown)))
    sums = long.groupBy(*by, "kind", "name").agg(F.sum(score).alias("_s"))
    whole = Window.partitionBy(*by, "kind")
    shares = sums.withColumn("share", F.col("_s") / F.sum("_s").over(whole)).where(F.col("name") != unknown).drop("_s")
    again = F.when(F.count(F.lit(1)).over(whole) > 1, F.col("share") / F.sum("share").over(whole)).otherwise(F.col("share"))
    return shares.withColumn("renormalised", again).withColumn("rank", F.row_number().over(whole.orderBy(F.desc("share"), "name")))


def precedent_counts(alternatives: DataFrame, db: DataFrame, tag: str = "TAG", solvent: str = "SOLVENT") -> DataFrame:
    """How many reactions of the same tag use each alternative solvent."""
    used = db.groupBy(tag, solvent).agg(F.count(F.lit(1)).alias("precedents"))
    return alternatives.join(used, [tag, solvent], "left").na.fill(0, ["precedents"])


def recommendation(alternatives: DataFrame, by: list[str]) -> DataFrame:
    """The nearest recommended alternative with a precedent, as a sentence. Of equal distances the first ``other`` counts, by its own type."""
    good = alternatives.where((F.col("ranking") == "Recommended") & (F.col("precedents") > 0))
    best = good.groupBy(*by).agg(F.min_by(F.struct("other", "precedents", "distance"), F.struct("distance", "other")).alias("b"))
    said = F.format_string("Use %s (%d precedents, distance %s).", F.col("b.other").cast("string"), "b.precedents", two_digits("b.distance"))
    return alternatives.select(*by).distinct().join(best, by, "left").select(*by, F.when(F.col("b").isNull(), "No recommended alternative has a precedent.").otherwise(said).alias("advice"))


@F.pandas_udf(T.StringType())
def two_digits(x: pd.Series) -> pd.Series:
    """Two digits of the number itself, where ``format_string`` rounds its shortest decimal form (the double next to 9.045 lies below it)."""
    return x.map(lambda v: f"{v:.2f}", na_action="ignore")


def buyability(routes: DataFrame, prices: DataFrame, by: list[str], molecule: str = "molecule") -> DataFrame:
    """Whether all, and what share, of a route's molecules are for sale, and their price."""
    joined = routes.join(prices.select(F.col("molecule").alias(molecule), "price"), molecule, "left")
    return joined.groupBy(*by).agg(F.bool_and(F.col("price").isNotNull()).alias("buyable"), F.avg(F.when(F.col("price").isNotNull(), 1.0).otherwise(0.0)).alias("share"), F.sum(F.coalesce("price", F.lit(0.0))).alias("price"))


def score_routes(steps: DataFrame, prices: DataFrame, path: str = "path", k: int = 10) -> DataFrame:
    """The k routes of least penalty: 10 a step, up to 100 for what isn't for sale, the price (100 if there is none), less 3 times the mean
    references and 20 times the mean similarity of its steps. ``steps``: (path, similarity, references, leaves: its starting materials)."""
    bought = buyability(steps.select(path, F.explode("leaves").alias("molecule")).distinct(), prices, [path])
    own = steps.groupBy(path).agg(F.count(F.lit(1)).alias("length"), F.avg("similarity").alias("similarity"), F.avg("references").alias("references"))
    cost = F.when(F.coalesce("price", F.lit(0.0)) == 0, 100.0).otherwise(F.col("price"))
    penalty = 10 * F.col("length") + 100 * (1 - F.coalesce("share", F.lit(0.0))) + cost - 3 * F.col("references") - 20 * F.col("similarity")
    return own.join(bought, path, "left").withColumn("penalty", F.round(penalty, 2)).orderBy("penalty", path).limit(k)


def score_disconnections(candidates: DataFrame, least: float = 10.0, k: int = 10, buyable: bool = False, flow: bool = False) -> DataFrame:
    """The k best disconnections above ``least``; equal reactions are merged: the first kept, references added, templates listed.

    20 for similarity, 1 for each of up to ten references and 20 for the gain in accessibility (10 less if it is a loss); with ``buyable``
    10 for the share for sale, with ``flow`` 20 for the flow factor.
    """
    columns = ["similarity", "accessibility", *(["buyable"] if buyable else []), *(["flow"] if flow else [])]
    merged = candidates.groupBy("reaction").agg(F.min_by(F.struct(*columns), "ord").alias("f"), F.sum("references").alias("references"), F.array_sort(F.collect_set("template")).alias("templates"))
    score = 20 * F.col("f.similarity") + F.least("references", F.lit(10)) + 20 * F.col("f.accessibility") - F.when(F.col("f.accessibility") < 0, 10).otherwise(0)
    score = score + (10 * F.col("f.buyable") if buyable else 0) + (20 * F.col("f.flow") if flow else 0)
    return merged.withColumn("score", score.cast("double")).where(F.col("score") > least).orderBy(F.desc("score"), "reaction").limit(k).select("reaction", "references", "templates", "score")
