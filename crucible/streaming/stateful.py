"""Stuck runs with timers and several state variables: a stateful processor, and its state read back as a table."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ALERTS = "run string, alert string, steps long, kinds string"


@contextmanager
def rocksdb(spark: SparkSession):
    """State variables and timers need this state store; the setting counts for queries that start inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class RunWatch(StatefulProcessor):
    """Alerts of one run: over ``steps`` events once, and no ``done`` event ``minutes`` after the last one by event time.

    State: ``total`` (events, whether alerted, time of the last), ``kinds`` (events of each kind), and a timer at the end of the wait, which
    later events put off. All of it goes when a run is done or has timed out.
    """

    def __init__(self, steps: int, minutes: int):
        self.steps, self.wait = steps, minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "n long, alerted boolean, last long")
        self.kinds = handle.getMapState("kinds", "kind string", "n long")

    def _row(self, run: str, alert: str, n: int) -> pd.DataFrame:
        kinds = ",".join(f"{k}:{v}" for k, v in sorted((k[0], v[0]) for k, v in self.kinds.iterator()))
        return pd.DataFrame([(run, alert, n, kinds)], columns=["run", "alert", "steps", "kinds"])

    def _forget(self) -> None:
        self.total.clear()
        self.kinds.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, alerted, last = self.total.get() if self.total.exists() else (0, False, 0)
        done = False
        for frame in rows:
            n += len(frame)
            last = max(last, int(frame["time"].max().timestamp() * 1000))
            for kind, more in frame["kind"].value_counts().items():
                self.kinds.updateValue((kind,), ((self.kinds.getValue((kind,))[0] if self.kinds.containsKey((kind,)) else 0) + int(more),))
            done = done or bool((frame["kind"] == "done").any())
        if n > self.steps and not alerted:
            alerted = True
            yield self._row(key[0], "steps", n)
        if done:
            self._forget()
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.wait)
        self.total.update((n, alerted, last))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n = self.total.get()[0] if self.total.exists() else 0
        yield self._row(key[0], "timeout", n)
        self.total.clear()
        self.kinds.clear()

    def close(self) -> None:
        pass


def run_alerts(events: DataFrame, run: str, time: str, kind: str, steps: int = 16, minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """(run, alert, steps, kinds) of stuck runs, by ``RunWatch``; start the query inside ``rocksdb``."""
    rows = events.select(F.col(run).cast("string").alias("run"), F.col(time).alias("time"), F.coalesce(F.col(kind).cast("string"), F.lit("")).alias("kind")).withWatermark("time", late)
    return rows.groupBy("run").transformWithStateInPandas(RunWatch(steps, minutes), ALERTS, "append", "eventTime")


def state_rows(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """A state variable of a query's last committed batch, as (run, its columns); a map gives a row for each entry."""
    read = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable)
    if variable == "kinds":
        return read.option("flattenCollectionTypes", True).load().select("key.run", "user_map_key.kind", "user_map_value.n")
    return read.load().select("key.run", "value.*")
