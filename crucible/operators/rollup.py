"""Roll-ups: micro and macro means, intervals, costs, usage, comparison of runs."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crucible.functions import text
from crucible.operators.containment import holding
from crucible.operators.ranking import numbered


def micro(df: DataFrame, by: list[str], matched: str = "matched", n_pred: str = "n_pred", n_gold: str = "n_gold") -> DataFrame:
    """Ratios of sums; an empty denominator gives 0."""
    out = df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in (matched, n_pred, n_gold)])
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    p, r = zero(F.try_divide(F.col(matched), F.col(n_pred))), zero(F.try_divide(F.col(matched), F.col(n_gold)))
    out = out.withColumns({"precision": p, "recall": r})
    return out.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def macro(df: DataFrame, by: list[str], metrics: list[str], digits: int = 4) -> DataFrame:
    """Means over the rows that have a metric."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(m), digits).alias(m) for m in metrics])


def group_labels(held_out: Column, dev: Column, slice_: Column) -> Column:
    """The overlapping groups that a row belongs to: all, heldout, dev, its slice, and its slice held out."""
    return F.array_compact(F.array(F.lit("all"), F.when(held_out, "heldout"), F.when(dev, "dev"), slice_, F.when(held_out, F.concat(slice_, F.lit("_heldout")))))


def group_report(df: DataFrame, labels: Column, metrics: list[str]) -> DataFrame:
    """Macro means of each overlapping group, in one grouping."""
    return macro(df.withColumn("group", F.explode(labels)), ["group"], metrics)


#: 2**31 - 1, a prime, and the cumulative Poisson(1) distribution in its units: how often a row is drawn by a number below it.
PRIME = 2_147_483_647
POISSON = tuple(int(PRIME * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(12))


def bootstrap(df: DataFrame, by: list[str], value: str, order: str, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """(n, mean, low, high): the 95 % percentile interval of the mean over resamples of each group; null below two rows.

    A resample draws each row a Poisson(1) number of times, by arithmetic on (resample, the integer ``order``, seed) that every SQL engine
    repeats. So rows are weighted where they are, a block at a time, and what moves is a sum and a count for each group, resample and task. Resamples that draw no
    row don't count.
    """
    key = F.pmod(F.col(order).cast("long"), F.lit(PRIME))
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"), key.alias("_k"))
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"))
    keys = rows.select(*by).schema
    schema = T.StructType([*keys.fields, T.StructField("_b", T.LongType()), T.StructField("_s", T.DoubleType()), T.StructField("_n", T.LongType())])
    start = np.arange(resamples, dtype=np.int64) * 1_000_003 + seed

    def draw(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}  # sums and counts of each resample, of some groups

        def out() -> Iterator[pd.DataFrame]:
            for group, (s, n) in held.items():
                yield pd.DataFrame({**{c: pd.Series([x] * resamples, dtype=object) for c, x in zip(by, group, strict=True)}, "_b": np.arange(resamples), "_s": s, "_n": n})
            held.clear()

        for frame in frames:
            codes = frame.groupby(by, sort=False, dropna=False).ngroup().to_numpy() if by else np.zeros(len(frame), int)
            for code in np.unique(codes):
                places = np.flatnonzero(codes == code)
                group = tuple(None if pd.isna(x := frame[c].iloc[places[0]]) else x for c in by)
                if group not in held:
                    if len(held) >= 256:
                        yield from out()
                    held[group] = (np.zeros(resamples), np.zeros(resamples, np.int64))
                s, n = held[group]
                v, k = frame["_v"].to_numpy()[places], frame["_k"].to_numpy()[places]
                for at in range(0, len(v), 32):
                    x = (start + (k[at : at + 32, None] * 7919) % PRIME) % PRIME
                    u = (x * x) % PRIME * 48_271 % PRIME
                    times = sum(((u >= limit).view(np.uint8) for limit in POISSON[1:]), (u >= POISSON[0]).view(np.uint8))
                    n += times.sum(axis=0, dtype=np.int64)
                    s += v[at : at + 32] @ times
        yield from out()

    parts = rows.mapInPandas(draw, schema).groupBy(*by, "_b").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    means = parts.where("_n > 0").select(*by, "_b", (F.col("_s") / F.col("_n")).alias("_m"))
    ends = means.groupBy(*by).agg(F.percentile("_m", F.array(F.lit(0.025), F.lit(0.975))).alias("_p"))
    low, high = (F.when(F.col("n") > 1, F.round(F.col("_p")[k], 4)).alias(c) for k, c in enumerate(("low", "high")))
    return sizes.join(ends, by, "left").select(*by, "n", F.round("mean", 4).alias("mean"), low, high)


def cost_summary(sidecars: DataFrame, by: list[str]) -> DataFrame:
    """Totals and means of each run; token means are cut to whole numbers."""
    return sidecars.groupBy(*by).agg(
        F.count(F.lit(1)).alias("figures"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.floor(F.avg("input_tokens")).alias("mean_input"), F.floor(F.avg("output_tokens")).alias("mean_output"),
        F.round(F.sum("elapsed_s"), 1).alias("elapsed_s"), F.round(F.avg("elapsed_s"), 1).alias("mean_elapsed_s"),
    )


def usage_by_agent(messages: DataFrame, *by: str) -> DataFrame:
    """Tokens and calls of each agent; messages without tokens don't count, and an agent without a name is ``unknown``."""
    some = messages.where((F.coalesce("prompt_tokens", F.lit(0)) > 0) | (F.coalesce("completion_tokens", F.lit(0)) > 0))
    return some.groupBy(*by, F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")).alias("agent")).agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.count(F.lit(1)).alias("calls"))


def price_join(runs: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """Runs with the price of their model: the same name, else the first by ``ord`` that contains it or is contained in it, in lower case.

    Names that hold one another are found by equi-joins on their pieces (``containment.holding``), over distinct models.
    """
    names = runs.select(model, F.lower(model).alias("_a")).where(F.col(model).isNotNull()).distinct()
    p = prices.select(F.col("model").alias("_priced"), F.lower("model").alias("_b"), "input_per_m", "output_per_m", "ord")
    exact = F.col(model) == F.col("_priced")
    pairs = holding(names, "_a", p, "_b").select("_a", "_b").union(holding(p, "_b", names, "_a").select("_a", "_b")).distinct()
    met = names.join(pairs, "_a").join(p, "_b")
    best = met.groupBy(model).agg(F.min_by(F.struct(F.col("_priced").alias("priced_as"), "input_per_m", "output_per_m"), F.struct((~exact).alias("a"), F.col("ord"))).alias("_p")).select(model, "_p.*")
    return runs.join(best, model, "left")


def with_fallback(sidecars: DataFrame, logs: DataFrame, key: list[str]) -> DataFrame:
    """Costs from sidecars where they have tokens, else from logs, with their ``source``."""
    values = [c for c in ("input_tokens", "output_tokens", "elapsed_s") if c in sidecars.columns]
    good = sidecars.where(F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0)) > 0).select(*key, F.struct(*values).alias("_a"))
    both = good.join(logs.select(*key, F.struct(*values).alias("_b")), key, "full")
    return both.select(*key, F.when(F.col("_a").isNotNull(), "sidecar").otherwise("log").alias("source"), *[F.coalesce(f"_a.{c}", f"_b.{c}").alias(c) for c in values])


def cost_points(runs: DataFrame, prices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cost and coverage of each run, runs without a price)."""
    priced = price_join(runs, prices)
    cost = (F.col("input_tokens") * F.col("input_per_m") + F.col("output_tokens") * F.col("output_per_m")) / 1e6
    points = priced.where(F.col("input_per_m").isNotNull()).withColumns({"cost": F.round(cost, 6), "coverage": F.concat(F.lit("("), F.col("ok").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(")"))})
    return points, priced.where(F.col("input_per_m").isNull()).select(*runs.columns, F.lit("no price for the model").alias("reason"))


def run_medians(df: DataFrame, by: list[str], values: list[str], ok: str = "ok") -> DataFrame:
    return df.where(ok).groupBy(*by).agg(*[F.median(v).alias(f"median_{v}") for v in values])


def compare_runs(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Both runs' values of every key; delta only where both have one."""
    joined = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key, "full")
    return joined.withColumn("delta", F.col("b") - F.col("a")).withColumn("improved", F.col("delta") > 0)


def diff_sets(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, side): in a only, in b only, or both."""
    mark = lambda df, c: df.select(key, value).distinct().withColumn(c, F.lit(True))
    both = mark(a, "_a").join(mark(b, "_b"), [key, value], "full")
    return both.select(key, value, F.when(F.col("_b").isNull(), "a").when(F.col("_a").isNull(), "b").otherwise("both").alias("side"))


def regressions(new: DataFrame, base: DataFrame, by: list[str], metrics: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Metrics that fell by more than ``tolerance`` (true before, false now, for flags)."""
    long = lambda df, name: df.select(*by, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(by, metrics, "metric", name)
    return long(new, "now").join(long(base, "before"), [*by, "metric"]).where(F.col("now") + tolerance < F.col("before"))


def missing_gold(pred: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    return pred.join(gold, key, "left_anti").select(key).distinct()


def pair_manifest(manifest: DataFrame, pred: DataFrame, key: str, missing: str = "empty") -> DataFrame:
    """Manifest rows with their prediction; those without one count as empty, or are left out with ``missing="skip"``."""
    joined = manifest.join(pred.withColumn("predicted", F.lit(True)), key, "inner" if missing == "skip" else "left")
    arrays = {c: F.coalesce(c, F.array().cast(t)) for c, t in pred.dtypes if t.startswith("array")}
    return joined.withColumns(arrays | {"predicted": F.coalesce("predicted", F.lit(False))})


def pair_gold(pred: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """Predictions with their gold, whose arrays are empty where there is none (``has_gold``)."""
    arrays = {c: F.coalesce(c, F.array().cast(t)) for c, t in gold.dtypes if t.startswith("array")}
    joined = pred.join(gold.withColumn("has_gold", F.lit(True)), key, "left")
    return joined.withColumns(arrays | {"has_gold": F.coalesce("has_gold", F.lit(False))})


def crosstab(df: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    """Counts of ``values`` of one column by another, and of all, with a last row (null) for all together."""
    counts = [F.count_if(F.col(columns) == v).alias(v) for v in values]
    return df.rollup(rows).agg(*counts, F.count(F.lit(1)).alias("total"))


def counts(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts by every subset of ``by``; a column that is summed over is null."""
    return df.cube(*by).agg(F.count(F.lit(1)).alias("n"))


def filter_manifest(rows: DataFrame, manifest: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of valid manifest keys, valid keys without a row); no flag means valid."""
    valid = manifest.where(F.coalesce("valid", F.lit(True))).select(key).distinct()
    return rows.join(valid, key, "left_semi"), valid.join(rows, key, "left_anti")


def billing(df: DataFrame) -> DataFrame:
    """Costs, calls and tokens by key and model with sub-totals; a level that is summed over is null."""
    return df.rollup("key", "model").agg(F.round(F.sum("cost"), 6).alias("cost"), F.sum("calls").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def trend_fit(df: DataFrame, x: str, y: str, by: list[str] | None = None, without: tuple[str, ...] = (), name: str = "system") -> DataFrame:
    """Slope, intercept and R squared of y over log10(x)."""
    kept = df.where(~F.col(name).isin(*without)) if without else df
    logged = kept.where(F.col(x) > 0).withColumn("_x", F.log10(F.col(x).cast("double")))
    y_ = F.col(y).cast("double")
    return logged.groupBy(*(by or [])).agg(F.regr_slope(y_, F.col("_x")).alias("slope"), F.regr_intercept(y_, F.col("_x")).alias("intercept"), F.regr_r2(y_, F.col("_x")).alias("r2"))


def agent_stats(a: DataFrame, b: DataFrame, agent: str = "agent") -> DataFrame:
    """Turns of each agent in two conversations."""
    count = lambda df, c: df.groupBy(agent).agg(F.count(F.lit(1)).alias(c))
    joined = count(a, "a").join(count(b, "b"), agent, "full").na.fill(0, ["a", "b"])
    return joined.withColumn("differs", F.col("a") != F.col("b"))


def align_turns(a: DataFrame, b: DataFrame, order: str, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Turns of two conversations side by side, by position."""
    by = by or []
    ranked = lambda df, side: numbered(df.select(*by, order, *[c for c in columns if c not in (*by, order)]), by, [order], "position").select(*by, "position", *[F.col(c).alias(f"{side}_{c}") for c in columns])
    return ranked(a, "a").join(ranked(b, "b"), [*by, "position"], "full")


def system_means(df: DataFrame, system: str, metrics: list[str]) -> DataFrame:
    """A row for each metric, a column for each system."""
    return df.unpivot(system, metrics, "metric", "value").groupBy("metric").pivot(system).agg(F.round(F.avg("value"), 4))


def record_summary(records: DataFrame) -> DataFrame:
    """Reactions, conditions and structures of each record."""
    r = F.coalesce("reactions", F.array().cast(records.schema["reactions"].dataType))
    total = lambda f: F.aggregate(F.transform(r, f), F.lit(0), lambda a, x: a + F.greatest(x, F.lit(0)))
    some = lambda arr: F.size(F.filter(arr, lambda m: text.blank_to_null(m["smiles"]).isNotNull()))
    return records.select("stem", F.size(r).alias("reactions"), total(lambda x: F.size(x["conditions"])).alias("conditions"), (total(lambda x: some(x["reactants"])) + total(lambda x: some(x["products"]))).alias("structures"))
