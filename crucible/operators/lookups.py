"""Lookups, searches and small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crucible.functions import text
from crucible.operators import containment, fpindex, ranking


def resolve_names(df: DataFrame, lexicon: DataFrame, name: str = "name") -> DataFrame:
    """``smiles`` of each name by a lexicon (name, smiles); spaces and kinds of dashes don't matter. The first structure by order of text wins."""
    keyed = lexicon.groupBy(text.lexicon_key("name").alias("_key")).agg(F.min("smiles").alias("smiles"))
    return df.withColumn("_key", text.lexicon_key(name)).join(keyed, "_key", "left").drop("_key")


def search_product(db: DataFrame, products: DataFrame, key: str = "product_key") -> DataFrame:
    """Reactions whose product has one of the wanted keys."""
    return db.join(products.select(key).distinct(), key, "left_semi")


def find_neighbours(queries: DataFrame, db: DataFrame, k: int, least: float, mode: str = "tag", metric: str = "jaccard") -> DataFrame:
    """The k most similar reactions above ``least``: of equal tag, of equal broad tag, or (for a stated query set) of the whole table."""
    block = {"tag": ["TAG"], "broad": ["TAG2"], "scaffold": ["SCAFFOLD"], "full": []}[mode]
    q = queries.select("query_id", F.col("query_fp").alias("vec"), *block)
    return ranking.neighbours(q, db.select("db_id", F.col("fp").alias("vec"), *block), block, metric, k, least)


def find_similar(queries: DataFrame, db: DataFrame, k: int, least: float, mode: str = "tag", metric: str = "jaccard") -> DataFrame:
    """``find_neighbours`` by an index of rare tokens: of equal tag, broad tag or scaffold, or of the whole table. Queries may be a whole table too."""
    block = {"tag": ["TAG"], "broad": ["TAG2"], "scaffold": ["SCAFFOLD"], "full": []}[mode]
    return fpindex.search(fpindex.build(db, least, metric, block), queries, k, least)


def composition(reactions: DataFrame, slice_: str = "slice") -> tuple[DataFrame, DataFrame]:
    """(images, reactions and their median per slice; reactants per reaction in four bins, the last open)."""
    per = reactions.groupBy(slice_, "stem").agg(F.count(F.lit(1)).alias("_n")).groupBy(slice_).agg(F.count(F.lit(1)).alias("images"), F.sum("_n").alias("reactions"), F.median("_n").alias("median"))
    bins = reactions.groupBy(slice_, F.least(F.size("reactants"), F.lit(4)).alias("reactants")).agg(F.count(F.lit(1)).alias("count"))
    return per, bins


def item_counts(df: DataFrame, by: list[str], items: str, name: str = "item") -> DataFrame:
    """How often each item of an array column occurs: ring fragments per system, and the like."""
    return df.select(*by, F.explode(items).alias(name)).groupBy(*by, name).agg(F.count(F.lit(1)).alias("count"))


def trend(series: DataFrame, categories: DataFrame, first: int = 1990, end: int = 2026) -> DataFrame:
    """Yearly sums by category from (year, series, value) and (prefix, category); years from ``first`` up to, not with, ``end``."""
    met = series.join(containment.beginning(series, "series", categories, "prefix"), "series").join(categories, "prefix")
    return met.where((F.col("year") >= first) & (F.col("year") < end)).groupBy("year", "category").agg(F.sum("value").alias("value"))


def suite_trajectory(scored: DataFrame, metrics: list[str]) -> DataFrame:
    """A row for each suite: images, those without a failure, and mean scores."""
    return scored.groupBy("suite_id").agg(F.count(F.lit(1)).alias("images"), F.count_if(F.col("rc") == 0).alias("ok"), *[F.round(F.avg(m), 4).alias(m) for m in metrics])


def multiset(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Rows of two tables as multisets: ``both`` keeps the lesser count of each row, ``less`` takes b's rows from a's."""
    return a.intersectAll(b) if how == "both" else a.exceptAll(b)


def first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys in order of their first appearance."""
    return ranking.numbered(df.groupBy(key).agg(F.min(order).alias(order)), [], [order, key], "position")
