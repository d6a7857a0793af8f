"""Names that hold, or begin with, other names: equi-joins on the pieces that can match, in place of comparing every two."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lengths_of(df: DataFrame, column: str) -> list[int]:
    """The distinct lengths of a column's texts; at most as many as the longest has characters."""
    return sorted(r[0] for r in df.select(F.length(column)).where(F.col(column).isNotNull()).distinct().collect())


def holding(names: DataFrame, whole: str, parts: DataFrame, part: str) -> DataFrame:
    """Distinct (whole, part) where a text of ``names`` contains one of ``parts``; an empty part is in every text.

    Each distinct text gives its pieces of the lengths that parts have: its length times the number of such lengths, however many parts there are.
    """
    a, b = names.select(whole).where(F.col(whole).isNotNull()).distinct(), parts.select(part).where(F.col(part).isNotNull()).distinct()
    n = F.length(whole)
    cut = lambda size: F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda at: F.substring(F.col(whole), at, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    found = F.concat(F.array().cast("array<string>"), *[cut(k) for k in lengths_of(b, part)])
    pieces = a.select(whole, F.explode(F.array_distinct(found)).alias("_piece"))
    return pieces.join(b, F.col("_piece") == F.col(part)).select(whole, part)


def beginning(names: DataFrame, whole: str, parts: DataFrame, part: str) -> DataFrame:
    """Distinct (whole, part) where a text of ``names`` begins with one of ``parts``."""
    a, b = names.select(whole).where(F.col(whole).isNotNull()).distinct(), parts.select(part).where(F.col(part).isNotNull()).distinct()
    lengths = lengths_of(b, part)
    heads = F.filter(F.array(*[F.when(F.length(whole) >= k, F.substring(F.col(whole), F.lit(1), F.lit(k))) for k in lengths]).cast("array<string>"), lambda x: x.isNotNull())
    return a.select(whole, F.explode(heads).alias("_head")).join(b, F.col("_head") == F.col(part)).select(whole, part)
