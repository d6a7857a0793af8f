"""Sinks and incremental work."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crucible.schemas import ENRICHED_COLUMNS, FLAT_COLUMNS


def flat_text(df: DataFrame, join: str = "|") -> DataFrame:
    """Array columns as text, for sinks that hold no lists."""
    return df.select(*[F.array_join(F.transform(f.name, lambda x: x.cast("string")), join).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema])


def write_db(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").parquet(path)


def write_csv(df: DataFrame, path: str, columns: tuple[str, ...] | list[str] | None = None) -> None:
    """Rows as CSV with a header; a column of ``columns`` that ``df`` lacks is empty."""
    out = flat_text(df)
    if columns:
        out = out.select(*[F.col(c) if c in out.columns else F.lit(None).cast("string").alias(c) for c in columns])
    out.write.mode("overwrite").csv(path, header=True)


def write_flat_csv(df: DataFrame, path: str) -> None:
    """The flat product table with its fixed columns."""
    write_csv(df, path, FLAT_COLUMNS)


def write_enriched_csv(df: DataFrame, path: str) -> None:
    """Annotated reactions with their fixed columns; those that an annotator didn't give are empty."""
    write_csv(df, path, ENRICHED_COLUMNS)


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """A workbook as one table for each sheet."""
    for name, df in sheets.items():
        write_csv(df, f"{path}/{name}")


def write_report(df: DataFrame, path: str, by: list[str]) -> None:
    """One JSON document for each group, its rows in ``rows``, in order."""
    rest = [c for c in df.columns if c not in by]
    df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("rows")).write.mode("overwrite").json(path)


def write_patterns(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines with a ``pos`` column from 1: the order of files isn't one to rely on.

    Ranges of the order are ranked apart and start where the ranges before them end, so no task holds the whole table.
    """
    from crucible.operators.ranking import numbered

    numbered(df, [], order, "pos").write.mode("overwrite").json(path)


def merge_chunks(chunks: list[DataFrame]) -> DataFrame:
    """Chunks of one table as one: missing columns are null, and a column whose type differs between chunks is text."""
    kinds: dict[str, set[str]] = {}
    for df in chunks:
        for name, kind in df.dtypes:
            kinds.setdefault(name, set()).add(kind)
    mixed = {name for name, k in kinds.items() if len(k) > 1}
    as_one = [df.select(*[F.col(c).cast("string").alias(c) if c in mixed else F.col(c) for c in df.columns]) for df in chunks]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), as_one)


def pending(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of ``todo`` whose key isn't in ``done``."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def replace_partition(df: DataFrame, path: str, column: str) -> None:
    """Replace the partitions of ``column`` that ``df`` holds and leave the others; running it again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
