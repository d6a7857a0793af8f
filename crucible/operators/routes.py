"""Route search over reactions as hyperedges: a molecule is bought, or made by a reaction all of whose reactants are bought or made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crucible.operators import ranking
from crucible.scratch import in_parts, written


def legs_of(reactions: DataFrame) -> DataFrame:
    """(reaction, product, cost, n, molecule): a row for each distinct reactant; reactions without reactants or cost are left out."""
    some = F.array_distinct(F.filter("reactants", lambda x: x.isNotNull()))
    rows = reactions.where("product IS NOT NULL AND cost IS NOT NULL").select("reaction", "product", F.col("cost").cast("double").alias("cost"), some.alias("_r")).where(F.size("_r") > 0)
    return rows.select("reaction", "product", "cost", F.size("_r").alias("n"), F.explode("_r").alias("molecule"))


def _made(legs: DataFrame, known: DataFrame, fallen: DataFrame | None = None) -> DataFrame:
    """(reaction, product, total) of the reactions whose reactants are all known (and some ``fallen``), with what they and the reaction cost."""
    costs = known.select("molecule", F.col("cost").alias("_c"))
    costs = costs.withColumn("_new", F.lit(True)) if fallen is None else costs.join(fallen.select("molecule", F.lit(True).alias("_new")), "molecule", "left")
    met = in_parts(legs.join(costs, "molecule"), legs.count(), "reaction")
    whole = met.groupBy("reaction", "product", "cost", "n").agg(F.count(F.lit(1)).alias("_k"), F.sum("_c").alias("_s"), F.count("_new").alias("_f")).where("_k = n AND _f > 0")
    return whole.select("reaction", "product", (F.col("cost") + F.col("_s")).alias("total"))


def least_costs(reactions: DataFrame, prices: DataFrame, max_depth: int = 5) -> DataFrame:
    """(molecule, depth, cost, reaction): each fall of a molecule's least cost, at depth 0 what it is bought for (reaction is null).

    ``reactions``: (reaction, product, reactants, cost), ids distinct, cost not negative; ``prices``: (molecule, price). A row of depth d is the cost of the best
    tree of at most d reactions above each other; a molecule that a tree uses twice is paid twice. Each round looks at the reactions of
    molecules whose cost has just fallen, and ends the search if none falls; all rounds are joins on molecules and are written. Of equal costs
    the earlier depth stays, then the first reaction.
    """
    legs = written(legs_of(reactions), "legs")
    bought = prices.where("price IS NOT NULL").groupBy("molecule").agg(F.min("price").cast("double").alias("cost"))
    now = written(bought.select("molecule", F.lit(0).alias("depth"), "cost", F.lit(None).cast(legs.schema["reaction"].dataType).alias("reaction")), "costs")
    history, fallen = now, now
    for depth in range(1, max_depth + 1):
        best = _made(legs, now, fallen).groupBy("product").agg(F.min(F.struct("total", "reaction")).alias("_b")).select(F.col("product").alias("molecule"), "_b.total", F.col("_b.reaction").alias("_by"))
        lower = best.join(now.select("molecule", "cost"), "molecule", "left").where(F.col("cost").isNull() | (F.col("total") < F.col("cost")))
        fallen = written(lower.select("molecule", F.lit(depth).alias("depth"), F.col("total").alias("cost"), F.col("_by").alias("reaction")), "fallen")
        if fallen.isEmpty():
            break
        now = written(now.join(fallen.select("molecule"), "molecule", "left_anti").unionByName(fallen), "costs")
        history = history.unionByName(fallen)
    return history


def at_depth(history: DataFrame, depth: int) -> DataFrame:
    """(molecule, cost, reaction, depth) of ``least_costs`` for trees of at most ``depth`` reactions above each other."""
    rows = history.where(F.col("depth") <= depth)
    return rows.groupBy("molecule").agg(F.max_by(F.struct("cost", "reaction", "depth"), "depth").alias("_b")).select("molecule", "_b.cost", "_b.reaction", "_b.depth")


def best_ways(reactions: DataFrame, history: DataFrame, targets: DataFrame, k: int, max_depth: int = 5) -> DataFrame:
    """(target, way, reaction, cost): the k cheapest last reactions of each target (molecule), each with the best trees of its reactants."""
    made = _made(written(legs_of(reactions), "legs"), at_depth(history, max_depth - 1))
    # ranked before targets are chosen: what leaves a task is then k rows a product
    ranked = ranking.top(made, ["product"], [F.col("total"), F.col("reaction")], k, "way").join(targets.select(F.col("molecule").alias("product")).distinct(), "product", "left_semi")
    return ranked.select(F.col("product").alias("target"), "way", "reaction", F.col("total").alias("cost"))


def routes(reactions: DataFrame, prices: DataFrame, targets: DataFrame, k: int = 3, max_depth: int = 5, history: DataFrame | None = None) -> DataFrame:
    """(target, way, level, product, reaction, leaves): the steps of the k best ways to each target, from the target (level 0) back.

    ``leaves``: the reactants that a step buys. Every other reactant is the product of a step one level on. Unfolded level by level, each
    written; rows are those of the trees.
    """
    history = history if history is not None else least_costs(reactions, prices, max_depth)
    legs = written(legs_of(reactions), "legs")
    ways = best_ways(reactions, history, targets, k, max_depth)
    front = written(ways.select("target", "way", F.lit(0).alias("level"), F.col("target").alias("product"), "reaction", F.lit(max_depth - 1).alias("left"), F.expr("uuid()").alias("_step")), "route-front")
    out = None
    past = history.select("molecule", F.col("depth").alias("_d"), "cost", F.col("reaction").alias("_by"))
    for level in range(max_depth):
        used = front.join(legs.select("reaction", "product", "molecule"), ["reaction", "product"]).join(past, "molecule").where(F.col("_d") <= F.col("left"))
        pick = used.groupBy("_step", "target", "way", "level", "product", "reaction", "molecule").agg(F.max_by(F.struct("_d", "_by"), "_d").alias("_c"))
        pick = written(pick.select("_step", "target", "way", "level", "product", "reaction", "molecule", "_c._d", "_c._by"), "route-legs")
        steps = pick.groupBy("_step", "target", "way", "level", "product", "reaction").agg(F.array_sort(F.collect_list(F.when(F.col("_by").isNull(), F.col("molecule")))).alias("leaves")).drop("_step")
        out = steps if out is None else out.union(steps)
        front = written(pick.where("_by IS NOT NULL").select("target", "way", F.lit(level + 1).alias("level"), F.col("molecule").alias("product"), F.col("_by").alias("reaction"), (F.col("_d") - 1).alias("left"), F.expr("uuid()").alias("_step")), "route-front")
        if front.isEmpty():
            break
    return out
