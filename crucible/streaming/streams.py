"""Streams: running costs, first-wins de-duplication, windowed counts, exactly-once work, alerts and price enrichment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from crucible import schemas
from crucible.operators import rollup
from crucible.streaming.commits import write_once  # noqa: F401  streams are written by it


def sidecar_stream(spark: SparkSession, path: str) -> DataFrame:
    """Sidecars as they land, with the run from their folder; one JSON document for each file."""
    raw = spark.readStream.schema("value string").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.meta.json").text(path)
    return raw.select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("run"), F.from_json("value", schemas.SIDECAR).alias("s")).select("run", "s.*")


def running_costs(sidecars: DataFrame) -> DataFrame:
    """Totals of each run so far; output mode update or complete."""
    return rollup.cost_summary(sidecars, ["run"])


def first_wins(events: DataFrame, key: str, time: str, within: str = "1 hour") -> DataFrame:
    """The first event of each key; repeats within the watermark are dropped, later ones count as new."""
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str, by: list[str], length: str, slide: str | None = None, late: str = "10 minutes", value: str | None = None) -> DataFrame:
    """Counts (and sums of ``value``) per tumbling or sliding window; rows later than ``late`` are dropped."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    out = events.withWatermark(time, late).groupBy(w, *by).agg(F.count(F.lit(1)).alias("n"), *([F.sum(value).alias("total")] if value else []))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", *(["total"] if value else []))


def session_counts(events: DataFrame, time: str, by: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of each key: as long as no gap of ``gap`` opens."""
    out = events.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def stuck_runs(events: DataFrame, run: str, time: str, kind: str, steps: int = 16, minutes: int = 30) -> DataFrame:
    """(run, alert, steps): runs over ``steps`` events, or without a ``done`` event ``minutes`` after their last one by event time."""

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, alerted = state.get if state.exists else (0, False)
        out = []
        if state.hasTimedOut:
            out.append((key[0], "timeout", count))
            state.remove()
        else:
            done, last = False, None
            for frame in frames:
                count += len(frame)
                done = done or (frame["kind"] == "done").any()
                last = frame["time"].max() if last is None else max(last, frame["time"].max())
            if count > steps and not alerted:
                out.append((key[0], "steps", count))
                alerted = True
            if done:
                state.remove()
            else:
                state.update((count, alerted))
                state.setTimeoutTimestamp(max(int(last.timestamp() * 1000) + minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["run", "alert", "steps"])

    rows = events.select(F.col(run).cast("string").alias("run"), F.col(time).alias("time"), F.col(kind).alias("kind")).withWatermark("time", "10 minutes")
    return rows.groupBy("run").applyInPandasWithState(watch, "run string, alert string, steps long", "count long, alerted boolean", "append", GroupStateTimeout.EventTimeTimeout)


def with_prices(stream: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """A stream of runs with the price of their model, by its exact name."""
    return stream.join(prices.select(F.col("model").alias(model), "input_per_m", "output_per_m"), model, "left")


def run_now(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is there now, through the stream, as a table in memory; for tests and small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return stream.sparkSession.table(name)


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All that is there now, through the stream, as Parquet at ``path``; complete mode keeps the last batch only.

    Each batch has a folder of its own and replaces it, so a batch that is tried again is not written twice.
    """
    def put(batch: DataFrame, number: int) -> None:
        out = finish(batch) if finish else batch
        out.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(path).drop("batch")
