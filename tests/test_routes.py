"""Route search against enumeration of all trees on small graphs."""

import itertools
import random

from crucible import scratch
from crucible.operators import reactiondb, routes
from pyspark.sql import functions as F


def made(seed, n=9, reactions=16):
    rng = random.Random(seed)
    names = [f"m{k}" for k in range(n)]
    rows = [(f"r{k:02}", rng.choice(names), rng.sample(names, rng.randint(1, 3)), float(rng.randint(1, 6))) for k in range(reactions)]
    return rows, {m: float(rng.randint(1, 5)) for m in names[:3]}


def trees(m, depth, rows, prices):
    """Costs of all trees of at most ``depth`` reactions above each other."""
    out = [prices[m]] if m in prices else []
    for _, product, reactants, cost in rows if depth else ():
        if product == m:
            out += [cost + sum(p) for p in itertools.product(*[best(x, depth - 1, rows, prices) for x in reactants])]
    return out


def best(m, depth, rows, prices):
    found = trees(m, depth, rows, prices)
    return [min(found)] if found else []


def test_equals_enumeration(spark):
    """Three graphs at once, their names apart; depths 1 to 3."""
    rows, prices = [], {}
    for seed in range(3):
        own, bought = made(seed)
        rows += [(f"{seed}{r}", f"{seed}{p}", [f"{seed}{x}" for x in xs], c) for r, p, xs, c in own]
        prices |= {f"{seed}{m}": p for m, p in bought.items()}
    kind = "reaction string, product string, reactants array<string>, cost double"
    df = spark.createDataFrame([*rows, ("x", "0m1", [], 0.0), ("y", "0m1", None, 0.0), ("z", None, ["0m1"], 0.0)], kind).repartition(3)
    bought = spark.createDataFrame([*prices.items(), ("0m0", 99.0), ("none", None)], "molecule string, price double")
    history = routes.least_costs(df, bought, 3)
    molecules = sorted({p for _, p, _, _ in rows} | set(prices))
    for depth in (1, 3):
        want = {(m, c) for m in molecules for c in best(m, depth, rows, prices)}
        assert {(r.molecule, r.cost) for r in routes.at_depth(history, depth).collect()} == want
    targets = spark.createDataFrame([(m,) for m in molecules], "molecule string")
    ways = {}
    for r in routes.best_ways(df, history, targets, 2, 3).collect():
        ways.setdefault(r.target, []).append((r.way, r.cost, r.reaction))
    for m in molecules:
        each = sorted((c + sum(min(trees(x, 2, rows, prices)) for x in xs), r) for r, p, xs, c in rows if p == m and all(trees(x, 2, rows, prices) for x in xs))
        assert sorted(ways.get(m, [])) == [(k + 1, c, r) for k, (c, r) in enumerate(each[:2])]
    steps = routes.routes(df, bought, targets, 2, 3, history)
    plain = {r: (p, set(xs), c) for r, p, xs, c in rows}
    cost = {}
    for s in steps.collect():
        product, reactants, own = plain[s.reaction]
        assert s.product == product and set(s.leaves) <= reactants & set(prices)
        cost[s.target, s.way] = cost.get((s.target, s.way), 0) + own + sum(prices[x] for x in s.leaves)
        assert s.level < 3 and (s.level or s.product == s.target)
    assert cost == {(m, w): c for m, own in ways.items() for w, c, _ in own}
    # the steps are what the scores of routes take
    scored = reactiondb.score_routes(steps.select(F.concat_ws("/", "target", "way").alias("path"), F.lit(1.0).alias("similarity"), F.lit(1).alias("references"), "leaves"), bought, k=1000)
    assert scored.count() == len(cost)


def test_nothing_for_sale(spark):
    df = spark.createDataFrame([("r", "a", ["b"], 1.0)], "reaction string, product string, reactants array<string>, cost double")
    none = spark.createDataFrame([], "molecule string, price double")
    assert routes.least_costs(df, none).count() == 0
    assert routes.routes(df, none, spark.createDataFrame([("a",)], "molecule string")).count() == 0


def test_tasks_group_a_bounded_number_of_rows(spark, monkeypatch):
    """Reactions are grouped in parts of so many rows: more of them make more tasks, not greater ones."""
    rows, prices = made(5, n=9, reactions=60)
    df = spark.createDataFrame(rows, "reaction string, product string, reactants array<string>, cost double")
    bought = spark.createDataFrame([*prices.items()], "molecule string, price double")
    legs = routes.legs_of(df).cache()
    known = bought.select("molecule", F.col("price").alias("cost"))
    want = {(r.molecule, r.depth, r.cost, r.reaction) for r in routes.least_costs(df, bought, 3).collect()}
    monkeypatch.setattr(scratch, "_PART", 10)
    assert routes._made(legs, known).rdd.getNumPartitions() >= legs.count() // 10 > 4
    assert {(r.molecule, r.depth, r.cost, r.reaction) for r in routes.least_costs(df, bought, 3).collect()} == want
