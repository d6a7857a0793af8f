"""One-to-one matching of pairs: greedy by rounds of joins, optimal by sparse augmenting paths, and by an auction where a set is too large for a task."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crucible.operators import graph, ranking
from crucible.scratch import written


def per_group(df: DataFrame, by: list[str], work: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str) -> DataFrame:
    """``work`` on the rows of each group, for many small groups: they are sorted together and come one after the other, not as a frame each."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # rows of the last group, and of whole ones before it
        for frame in frames:
            if not len(frame):
                continue
            keys = pd.concat([held[-1][by].tail(1), frame[by]]) if held else frame[by]
            new = ~((keys == keys.shift()) | (keys.isna() & keys.shift().isna())).all(axis=1).to_numpy()
            if not held:
                new[0] = True  # a null key equals what comes before the first row
            edges = np.flatnonzero(new[1:] if held else new).tolist()
            if held and not edges:
                held.append(frame)
                continue
            if held:
                yield work(pd.concat([*held, frame.iloc[: edges[0]]]))
            done = [work(frame.iloc[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            if done:
                yield pd.concat(done)
            held = [frame.iloc[edges[-1] :]]
        if held:
            yield work(pd.concat(held))

    return df.repartition(*by).sortWithinPartitions(*by).mapInPandas(run, schema)


def kept_in_groups(df: DataFrame, by: list[str], order: list[str], columns: list[str], keep: Callable[..., list[int]]) -> DataFrame:
    """The rows of each group that ``keep`` names by place, from arrays of ``columns`` in ``order``. For many small groups: no frame is made for one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last group so far

        def solved(table: pa.Table, starts: list[int]) -> Iterator[pa.RecordBatch]:
            arrays = [table.column(c).to_numpy() for c in columns]
            places = [a + k for a, b in zip(starts[:-1], starts[1:], strict=True) for k in keep(*[x[a:b] for x in arrays])]
            yield from table.take(pa.array(places, pa.int64())).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = (pa.concat_tables([held, table]) if held is not None else table).combine_chunks()
            new = np.zeros(table.num_rows, bool)
            for c in by:
                codes = table.column(c).chunk(0).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            starts = [0, *np.flatnonzero(new).tolist()]
            if len(starts) > 1:
                yield from solved(table, starts)
            held = table.slice(starts[-1])
        if held is not None:
            yield from solved(held.combine_chunks(), [0, held.num_rows])

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, df.schema)


# --- greedy ----------------------------------------------------------------------------------------------------------


def greedy(pairs: DataFrame, by: list[str], left: str, right: str, order: list[Column], most: int = 200_000, part: int = 500_000, shrink: float = 0.9) -> DataFrame:
    """The pairs taken one after the other in each group, by ``order`` ascending, then left, then right: no row twice on either side.

    Where no group has over ``most`` pairs, groups are worked off one after the other in sorted streams. In larger ones a pair that comes first
    at both its ends is taken, in rounds of joins: the result is that of the sequence, since nothing before such a pair can take its ends. Once
    ``part`` pairs are left, or a round leaves over ``shrink`` of them (a chain whose order runs along it settles one pair a round), the rest
    is cut by the order into parts of ``part`` pairs. Each part loses the pairs whose ends are taken, and its connected sets are solved one a
    task. So no task holds over ``part`` pairs or the largest small group, whatever a group's size.
    """
    names = pairs.columns
    node = lambda side, c: F.xxhash64(F.lit(side), *by, c)
    keyed = pairs.select("*", F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], left, right).alias("_o"), node("left", left).alias("_l"), node("right", right).alias("_r"))
    rows = written(keyed, "pairs")
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")) if by else rows.agg(F.count(F.lit(1)).alias("_n"))
    if (sizes.agg(F.max("_n")).first()[0] or 0) <= most:
        return streamed(rows, by).select(*names)
    large = written(sizes.where(F.col("_n") > most), "large-groups")
    if by:
        same = [rows[c].eqNullSafe(large[c]) for c in by]
        inside = same[0] if len(same) == 1 else same[0] & same[1] if len(same) == 2 else F.lit(True)
        for s in same[2:]:
            inside = inside & s
        small, open_ = streamed(rows.join(large, inside, "left_anti"), by), written(rows.join(large, inside, "left_semi"), "open-pairs")
        chosen = [small]
    else:
        open_, chosen = rows, []
    n = open_.count()
    while n > part:
        first = lambda side: open_.groupBy(side).agg(F.min(F.struct("_o", "_l", "_r")).alias("_f")).select("_f.*")  # noqa: E731, B023
        both = written(first("_l").join(first("_r").select("_l", "_r"), ["_l", "_r"]).select("_l", "_r"), "taken-pairs")
        chosen.append(open_.join(both, ["_l", "_r"], "left_semi"))
        open_ = written(open_.join(both.select("_l"), "_l", "left_anti").join(both.select("_r"), "_r", "left_anti").select(*rows.columns), "open-pairs")
        before, n = n, open_.count()
        if n > shrink * before:
            break
    if n:
        chosen += by_parts(open_, n, part)
    out = chosen[0].select(*names)
    for c in chosen[1:]:
        out = out.union(c.select(*names))
    return out


def streamed(rows: DataFrame, by: list[str]) -> DataFrame:
    """The pairs taken in each group, in a stream sorted by group and order that holds one group's taken ends; rows are (..., _o, _l, _r)."""

    def take(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, used = None, set()
        for batch in batches:
            keep = []
            for g, a, b in zip(*(batch.column(c).to_pylist() for c in ("_group", "_l", "_r")), strict=True):
                if g != group:
                    group, used = g, set()
                keep.append(a not in used and b not in used)  # ends of both sides are hashes that hold the side
                if keep[-1]:
                    used |= {a, b}
            yield batch.filter(pa.array(keep, pa.bool_()))

    keyed = rows.withColumn("_group", F.xxhash64(*by) if by else F.lit(0).cast("long"))
    ready = keyed.repartition("_group").sortWithinPartitions("_group", *by, "_o").drop("_o")
    return ready.mapInArrow(take, ready.schema).drop("_group")


def by_parts(open_: DataFrame, n: int, part: int) -> list[DataFrame]:
    """What is taken of ``open_``, part by part in the order of the pairs; each part's connected sets are solved one a task."""
    chosen: list[DataFrame] = []
    numbered = written(ranking.numbered(open_, [], ["_o", "_l", "_r"], "_n"), "ordered-pairs") if n > part else open_.withColumn("_n", F.lit(1).cast("long"))
    for k in range(-(-n // part)):
        now = numbered.where((F.col("_n") > k * part) & (F.col("_n") <= (k + 1) * part)).drop("_n")
        for before in chosen:
            now = now.join(before.select("_l"), "_l", "left_anti").join(before.select("_r"), "_r", "left_anti")
        now = written(now.select(*open_.columns), "part-of-pairs")
        sets = graph.components(now.select(F.col("_l").alias("a"), F.col("_r").alias("b"))).select(F.col("node").alias("_l"), F.col("component").alias("_set"))
        solved = streamed(now.join(sets, "_l").select(*open_.columns, "_set"), ["_set"])
        chosen.append(written(solved, "taken-in-part"))
    return chosen


# --- optimal ---------------------------------------------------------------------------------------------------------


def sparse_assignment(left: np.ndarray, right: np.ndarray, score: np.ndarray) -> list[int]:
    """Places of the one-to-one pairs with the greatest total score, by shortest augmenting paths over the given pairs alone.

    ``left`` and ``right`` are numbers from 0. Memory grows with the pairs, not with left times right. Pairs that score 0 or less are not taken.
    """
    some = np.flatnonzero(score > 0)
    if not len(some):
        return []
    order = some[np.argsort(left[some], kind="stable")]
    n, m = int(left.max()) + 1, int(right.max()) + 1
    first = np.searchsorted(left[order], np.arange(n + 1)).tolist()
    to, gain, place = right[order].tolist(), score[order].tolist(), order.tolist()
    u = [max(gain[first[x] : first[x + 1]], default=0.0) for x in range(n)]
    v = [0.0] * m
    pair_of_left, owner = [-1] * n, [-1] * m
    for start in np.random.default_rng(0).permutation(n).tolist():  # so that the searches of a long chain stay short
        if first[start] == first[start + 1]:
            continue
        reached, back, done = {}, {}, {}
        at_left = {start: 0.0}
        heap: list[tuple[float, bool, int]] = []  # of equal distances free rights first, which end the search
        best, end_left, end_right = u[start], start, -1  # the start itself may stay alone
        x, d = start, 0.0
        while True:
            for k in range(first[x], first[x + 1]):
                r = to[k]
                if r in done:
                    continue
                far = d + max(u[x] + v[r] - gain[k], 0.0)  # below zero by rounding alone
                if far < best and far < reached.get(r, np.inf):
                    reached[r], back[r] = far, (x, k)
                    heapq.heappush(heap, (far, owner[r] >= 0, r))
            while heap and heap[0][2] in done:
                heapq.heappop(heap)
            if not heap or heap[0][0] >= best:
                break
            d, _, r = heapq.heappop(heap)
            done[r] = d
            if owner[r] < 0:
                best, end_left, end_right = d, -1, r
                break
            x = owner[r]
            at_left[x] = d
            if d + u[x] < best:
                best, end_left, end_right = d + u[x], x, -1
        for y, dist in at_left.items():
            u[y] -= max(best - dist, 0.0)
        for y, dist in done.items():
            v[y] += max(best - dist, 0.0)
        if end_right < 0:
            if end_left == start:
                continue
            end_right = to[pair_of_left[end_left]]  # the last of the path stays alone and leaves its partner
            pair_of_left[end_left] = -1
        r = end_right
        while True:
            x, k = back[r]
            before, pair_of_left[x], owner[r] = pair_of_left[x], k, x
            if x == start:
                break
            r = to[before]
    return [place[k] for k in pair_of_left if k >= 0]


def auction(pairs: DataFrame, by: list[str], left: str, right: str, score: str, gap: float, most_rounds: int = 2000) -> DataFrame:
    """``pairs`` chosen one-to-one so that their total is within ``gap`` for each chosen pair of the greatest, by rounds of bids as joins.

    Each free left bids for the right that is worth most to it, its score less the price, as much as it has over its second choice (or over
    staying alone) and ``gap``; each right goes to its highest bid. The prices stand at the bids, so no round undoes an earlier one's work.
    For scores that are multiples of a unit, a gap below the unit over the number of lefts gives the optimum itself. No task holds more than
    the pairs of its share of rows.
    """
    names = pairs.columns
    node = lambda side, c: F.xxhash64(F.lit(side), *by, c)
    keyed = written(pairs.select("*", F.col(score).cast("double").alias("_w"), node("left", left).alias("_l"), node("right", right).alias("_r")).where("_w > 0"), "auction-pairs")
    offers = keyed.groupBy("_l", "_r").agg(F.max("_w").alias("_w"))
    free = written(keyed.select("_l").distinct(), "bidders")
    prices = None
    for _ in range(most_rounds):
        nets = offers.join(free, "_l")
        if prices is None:
            nets = nets.withColumn("_price", F.lit(0.0))
        else:
            nets = nets.join(prices.select("_r", F.col("_price").alias("_p")), "_r", "left").withColumn("_price", F.coalesce("_p", F.lit(0.0)))
        nets = nets.withColumn("_net", F.col("_w") - F.col("_price")).where("_net > 0")
        two = nets.withColumn("_k", F.row_number().over(Window.partitionBy("_l").orderBy(F.desc("_net"), "_r"))).where("_k <= 2")
        bids = two.groupBy("_l").agg(F.max(F.when(F.col("_k") == 1, F.struct("_r", "_price", "_net"))).alias("_b"), F.coalesce(F.max(F.when(F.col("_k") == 2, F.col("_net"))), F.lit(0.0)).alias("_second"))
        bids = written(bids.select("_l", "_b._r", (F.col("_b._price") + F.col("_b._net") - F.col("_second") + gap).alias("_bid")), "bids")
        won = bids.groupBy("_r").agg(F.max(F.struct("_bid", "_l")).alias("_w")).select("_r", F.col("_w._bid").alias("_bid"), F.col("_w._l").alias("_by"))
        if prices is None:
            now = won.select("_r", F.col("_bid").alias("_price"), F.col("_by").alias("_owner"), F.lit(None).cast("long").alias("_out"))
        else:
            old = prices.select("_r", "_price", F.col("_owner"))
            now = old.join(won, "_r", "full").select("_r", F.coalesce("_bid", "_price").alias("_price"), F.coalesce("_by", "_owner").alias("_owner"), F.when(F.col("_by").isNotNull(), F.col("_owner")).alias("_out"))
        prices = written(now, "prices")
        lost = bids.join(prices.select(F.col("_owner").alias("_l")), "_l", "left_anti").select("_l")
        free = written(lost.union(prices.where("_out IS NOT NULL").select("_out")), "bidders")
        if free.isEmpty():
            break
    else:
        raise RuntimeError(f"bids go on after {most_rounds} rounds; take a wider gap")
    sold = prices.select("_r", F.col("_owner").alias("_l"))
    best = keyed.join(sold, ["_l", "_r"]).withColumn("_k", F.row_number().over(Window.partitionBy("_l").orderBy(F.desc("_w"), left, right)))
    return best.where("_k = 1").select(*names)
