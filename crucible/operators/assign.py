"""One-to-one assignment within groups: Spark finds the scored pairs, a small solver runs on each connected set of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crucible.operators.graph import components, least_reachable
from crucible.operators.matching import auction, greedy, kept_in_groups, sparse_assignment
from crucible.scratch import written


def hungarian(cost: np.ndarray) -> list[int]:
    """The column of each row (rows <= columns) at least total cost, by shortest augmenting paths."""
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    row_of = np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        row_of[0], j0 = i, 0
        slack, back, done = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while row_of[j0]:
            done[j0] = True
            open_ = np.flatnonzero(~done[1:]) + 1
            reduced = cost[row_of[j0] - 1, open_ - 1] - u[row_of[j0]] - v[open_]
            better = reduced < slack[open_]
            slack[open_[better]], back[open_[better]] = reduced[better], j0
            j1 = open_[np.argmin(slack[open_])]
            delta = slack[j1]
            u[row_of[done]] += delta
            v[done] -= delta
            slack[~done] -= delta
            j0 = j1
        while j0:
            row_of[j0], j0 = row_of[back[j0]], back[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if row_of[j]:
            out[row_of[j] - 1] = j - 1
    return out


def chosen_of(left: np.ndarray, right: np.ndarray, gain: np.ndarray, dense: int = 10_000) -> list[int]:
    """Places of the pairs of one connected set with the greatest total: a full matrix of up to ``dense`` cells, or the pairs alone."""
    if len(gain) == 1:
        return [0]
    if len(gain) == 2 and (left[0] == left[1] or right[0] == right[1]):
        return [int(np.argmax(gain))]
    (a, lefts), (b, rights) = (pd.factorize(x, sort=True) for x in (left, right))
    if len(lefts) * len(rights) > dense:
        return sparse_assignment(a, b, gain)
    cells = np.zeros((len(lefts), len(rights)))
    where = np.full(cells.shape, -1)
    cells[a, b], where[a, b] = gain, np.arange(len(gain))
    turned = cells.shape[0] > cells.shape[1]
    found = (where[j, i] if turned else where[i, j] for i, j in enumerate(hungarian(-(cells.T if turned else cells))))
    return [k for k in found if k >= 0]


def assign(pairs: DataFrame, by: list[str], left: str, right: str, score: str, optimal: bool = True, most: int = 200_000, largest: int = 2_000_000, gap: float = 0.001) -> DataFrame:
    """(by, left, right, score) of the pairs chosen in each group: no row twice on either side.

    optimal: the greatest total score; otherwise the best pair first, then the best of what is left, ties by left then right
    (``matching.greedy``). Pairs that are not in ``pairs`` score 0 and are never chosen.

    Each connected set of a group's pairs is solved alone, in memory that grows with its pairs. Where some group has over ``most`` pairs,
    Spark finds the connected sets of all groups first and deals them out one by one. Sets of over ``largest`` pairs are not given to a task: an
    auction finds their pairs, in rounds of joins, to within ``gap`` times the largest score for each pair chosen.
    """
    rows = written(pairs.select(*by, F.col(left).cast("long").alias(left), F.col(right).cast("long").alias(right), F.col(score).cast("double").alias("score")), "pairs")
    if not optimal:
        return greedy(rows, by, left, right, [-F.col("score")], most)
    schema = rows.schema

    def solve(a: np.ndarray, b: np.ndarray, gains: np.ndarray) -> list[int]:
        if len(gains) == 1:
            return [0]
        (lefts, rows_), rights = pd.factorize(a), pd.factorize(b, sort=True)[0]
        sets = least_reachable(len(rows_) + len(rights), lefts, rights + len(rows_))[lefts]
        order, keep = np.argsort(sets, kind="stable"), []
        for part in np.split(order, np.flatnonzero(np.diff(sets[order])) + 1):
            keep += part[chosen_of(lefts[part], rights[part], gains[part])].tolist()
        return sorted(keep)

    def solved(df: DataFrame, keys: list[str]) -> DataFrame:
        return kept_in_groups(df, keys, [left, right], [left, right, "score"], solve).select(*schema.names)

    biggest = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if biggest <= most:
        return solved(rows, by)
    node = lambda side, c: F.xxhash64(F.lit(side), *by, c)
    sets = components(rows.select(node("left", left).alias("a"), node("right", right).alias("b"))).select(F.col("node").alias("_node"), F.col("component").alias("_set"))
    dealt = written(rows.withColumn("_node", node("left", left)).join(sets, "_node").drop("_node"), "sets-of-pairs")
    huge = written(dealt.groupBy("_set").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > largest).select("_set"), "huge-sets")
    small = solved(dealt.join(huge, "_set", "left_anti").select(*schema.names, "_set"), ["_set"])
    if huge.isEmpty():
        return small
    rest = dealt.join(huge, "_set", "left_semi").select(*schema.names)
    top = rest.agg(F.max("score")).first()[0]
    return small.union(auction(rest, by, left, right, "score", gap * top).select(*schema.names))
