"""Queries over the driver tables and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crucible.plans import analytics as _analytics  # noqa: F401  registers its queries
from crucible.plans import evaluation
from crucible.plans import hierarchy as _hierarchy  # noqa: F401
from crucible.plans import more as _more  # noqa: F401
from crucible.plans import records as _records  # noqa: F401
from crucible.plans import scoring as _scoring  # noqa: F401
from crucible.plans.registry import QUERIES, SQL, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES[evaluation.flagship.__name__](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
