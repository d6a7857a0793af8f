"""A user's per-row annotator over Spark partitions; rows that fail are data, not failures."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def enrich(df: DataFrame, annotate: Callable[[dict], dict], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(annotated rows, skipped rows with their ``error``); ``annotate`` gets a row as a dict and returns the new columns."""
    names = [f.name for f in schema]
    out = T.StructType([*df.schema.fields, *schema.fields, T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType())])

    def work(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                try:
                    rows.append({**row, **annotate(row), "ok": True, "error": None})
                except Exception as e:  # the user's code
                    rows.append({**row, **dict.fromkeys(names), "ok": False, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=[f.name for f in out])

    done = df.mapInPandas(work, out)
    return done.where("ok").drop("ok", "error"), done.where("NOT ok").select(*df.columns, F.col("error"))
