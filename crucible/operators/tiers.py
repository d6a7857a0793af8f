"""Analytics on class hierarchies: template coverage, gains, recommended tiers, false positives, splits of classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crucible.functions import classes
from crucible.operators.ranking import numbered
from crucible.scratch import written


def topn_coverage(df: DataFrame, by: list[str], template: str, n: int) -> DataFrame:
    """The share of a class's reactions that its n most frequent templates cover."""
    counts = df.groupBy(*by, template).agg(F.count(F.lit(1)).alias("_c"))
    ranked = counts.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_c"), template)))
    return ranked.groupBy(*by).agg(F.sum("_c").alias("reactions"), F.count(F.lit(1)).alias("templates"), (F.sum(F.when(F.col("_n") <= n, F.col("_c")).otherwise(0)) / F.sum("_c")).alias("coverage"))


def auto_topn(df: DataFrame, by: list[str], template: str, schedule: tuple[int, ...] = (10, 20, 40, 50), enough: float = 0.9) -> DataFrame:
    """The first n of the schedule whose templates cover ``enough`` of a class, else the last; the coverage reached."""
    counts = df.groupBy(*by, template).agg(F.count(F.lit(1)).alias("_c"))
    own = Window.partitionBy(*by).orderBy(F.desc("_c"), template)
    ranked = counts.withColumns({"_n": F.row_number().over(own)})
    at = [F.sum(F.when(F.col("_n") <= n, F.col("_c")).otherwise(0)) / F.sum("_c") for n in schedule]
    sums = ranked.groupBy(*by).agg(F.sum("_c").alias("reactions"), *[c.alias(f"_at{n}") for c, n in zip(at, schedule, strict=True)])
    n, reached = F.lit(schedule[-1]), F.col(f"_at{schedule[-1]}")
    for k in reversed(schedule[:-1]):
        good = F.col(f"_at{k}") >= enough
        n, reached = F.when(good, k).otherwise(n), F.when(good, F.col(f"_at{k}")).otherwise(reached)
    return sums.select(*by, "reactions", n.alias("n"), reached.alias("coverage"))


def shortest_example(df: DataFrame, template: str, reaction: str, order: str) -> DataFrame:
    return df.groupBy(template).agg(F.min_by(reaction, F.struct(F.length(reaction), F.col(order))).alias("example"), F.count(F.lit(1)).alias("count"))


def majority_class(df: DataFrame, template: str, class_: str) -> DataFrame:
    counts = df.groupBy(template, class_).agg(F.count(F.lit(1)).alias("_c"))
    return counts.withColumn("_n", F.row_number().over(Window.partitionBy(template).orderBy(F.desc("_c"), class_))).where("_n = 1").select(template, class_, F.col("_c").alias("count"))


def diverse_topn(df: DataFrame, by: list[str], group: str, count: str, tie: str, n: int) -> DataFrame:
    """n rows of each class spread over its groups: slots in proportion to their counts, one at least, what is left to the largest."""
    sizes = df.groupBy(*by, group).agg(F.sum(count).alias("_g"), F.count(F.lit(1)).alias("_rows"))
    w = Window.partitionBy(*by)
    slots = sizes.withColumn("_s", F.least(F.greatest(F.lit(1), F.bround(F.lit(n) * F.col("_g") / F.sum("_g").over(w)).cast("int")), F.col("_rows")))
    order = w.orderBy(F.desc("_g"), group)
    # what the rounding left over or overspent is the largest group's
    spare = F.lit(n) - F.sum("_s").over(w)
    slots = slots.withColumn("_s", F.when(F.row_number().over(order) == 1, F.least(F.col("_rows"), F.greatest(F.lit(1), F.col("_s") + spare))).otherwise(F.col("_s")))
    slots = slots.withColumn("_before", F.coalesce(F.sum("_s").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_s", F.greatest(F.lit(0), F.least("_s", F.lit(n) - F.col("_before"))))
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*by, group).orderBy(F.desc(count), tie)))
    return ranked.join(slots.select(*by, group, "_s"), [*by, group]).where(F.col("_n") <= F.col("_s")).drop("_n", "_s")


def tier_table(df: DataFrame, code: str, template: str, tiers: int) -> DataFrame:
    """(tier, class, template, count): each row counts at every tier of its code."""
    long = df.select(template, F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), classes.at_tier(code, t).alias("class")) for t in range(1, tiers + 1)])).alias("x")).select(template, "x.*")
    return long.where(F.col("class").isNotNull()).groupBy("tier", "class", template).agg(F.count(F.lit(1)).alias("count"))


def _coverage(table: DataFrame, template: str, n: int) -> DataFrame:
    ranked = table.withColumn("_n", F.row_number().over(Window.partitionBy("tier", "class").orderBy(F.desc("count"), template)))
    return ranked.groupBy("tier", "class").agg(F.sum("count").alias("reactions"), F.count(F.lit(1)).alias("templates"), (F.sum(F.when(F.col("_n") <= n, F.col("count")).otherwise(0)) / F.sum("count")).alias("coverage"))


def subclass_gain(table: DataFrame, template: str, n: int, small: int = 5) -> DataFrame:
    """For each class with children the weighted coverage of its children, and what they gain over the class itself.

    Children of fewer than ``small`` reactions count at their parent's coverage.
    """
    return _gain(_coverage(table, template, n), small)


def _gain(cov: DataFrame, small: int) -> DataFrame:
    child = cov.withColumn("_parent", classes.parent("class")).where(F.col("_parent").isNotNull()).select(F.col("_parent").alias("class"), F.col("reactions").alias("_r"), F.col("coverage").alias("_c"))
    met = cov.join(child, "class").withColumn("_c", F.when(F.col("_r") < small, F.col("coverage")).otherwise(F.col("_c")))
    return met.groupBy("tier", "class", "reactions", "coverage").agg(F.count(F.lit(1)).alias("children"), (F.sum(F.col("_r") * F.col("_c")) / F.sum("_r")).alias("children_coverage")).withColumn("gain", F.col("children_coverage") - F.col("coverage"))


def recommend_tiers(table: DataFrame, template: str, n: int, enough: float = 0.9, least: int = 5, max_tier: int = 4, gain: float = 0.05) -> DataFrame:
    """(tier, class, reactions, coverage, decision, recommended): which class of each branch to keep.

    A class stays if its own coverage is ``enough``, it is at ``max_tier`` (deepest), it has no subclasses (leaf), its only subclass stays (single)
    or its subclasses gain less than ``gain`` (whole). Otherwise its subclasses take its place: all of one, else those of at least ``least``
    reactions; smaller ones are dropped. Recommended are the classes that stay and whose place it is. One join a tier up, one down.
    """
    cov = written(_coverage(table.where(F.col("tier") <= max_tier), template, n), "class-coverage")  # a row a class: every step below reads it
    gains = _gain(cov, least).select("tier", "class", "gain", "children")
    all_ = cov.join(gains, ["tier", "class"], "left").withColumns({"_p": classes.parent("class"), "children": F.coalesce("children", F.lit(0))})
    below, levels = None, {}
    for tier in range(max_tier, 0, -1):
        level = all_.where(F.col("tier") == tier)
        if below is None:
            level = level.withColumn("_only", F.lit(None).cast("boolean"))
        else:
            level = level.join(below.groupBy(F.col("_p").alias("class")).agg(F.bool_and("_stays").alias("_only")), "class", "left")
        reason = F.when(F.col("coverage") >= enough, "enough").when(F.col("tier") == max_tier, "deepest").when(F.col("children") == 0, "leaf").when(F.col("children") == 1, F.when(F.col("_only"), "single").otherwise("pass")).when(F.col("gain") < gain, "whole").otherwise("split")
        below = levels[tier] = level.select("tier", "class", "_p", "reactions", "coverage", "children", reason.alias("decision")).withColumn("_stays", ~F.col("decision").isin("pass", "split"))
    out = levels[1].withColumn("_reached", F.lit(True))
    above = out
    for tier in range(2, max_tier + 1):
        parent = above.select(F.col("class").alias("_p"), (F.col("_reached") & ~F.col("_stays")).alias("_open"), F.col("children").alias("_siblings"))
        above = levels[tier].join(parent, "_p", "left").withColumn("_reached", F.coalesce(F.col("_open") & ((F.col("_siblings") == 1) | (F.col("reactions") >= least)), F.lit(False))).drop("_open", "_siblings")
        out = out.unionByName(above)
    return out.select("tier", "class", "reactions", "coverage", "decision", (F.col("_reached") & F.col("_stays")).alias("recommended"))


def match_type(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    """exact, ancestor (of the truth), descendant, mismatch or unmatched; codes without their conflict mark."""
    p, t = classes.without_conflict(predicted), classes.without_conflict(truth)
    kind = F.when(p.isNull() | (p == ""), "unmatched").when(p == t, "exact").when(classes.is_below(t, p), "ancestor").when(classes.is_below(p, t), "descendant").otherwise("mismatch")
    return df.withColumn("match_type", kind)


def naming_summary(df: DataFrame, predicted: str, truth: str, in_db: str) -> DataFrame:
    """Counts of match types and of the kinds of mismatch (siblings, same first tier, across), overall and by whether the class is known."""
    typed = match_type(df, predicted, truth)
    kind = F.when(F.col("match_type") != "mismatch", None).when(classes.parent(predicted) == classes.parent(truth), "sibling").when(classes.at_tier(predicted, 1) == classes.at_tier(truth, 1), "same_super").otherwise("cross")
    return typed.withColumn("mismatch", kind).rollup(in_db).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("match_type") == t).alias(t) for t in ("exact", "ancestor", "descendant", "mismatch", "unmatched")], *[F.count_if(F.col("mismatch") == t).alias(t) for t in ("sibling", "same_super", "cross")])


def expand_classes(specs: DataFrame, known: DataFrame) -> DataFrame:
    """(spec, class): ``x.*`` are the children of x, ``x.**`` all below it, neither x itself; anything else is itself."""
    stem = F.regexp_replace("spec", r"\.\*{1,2}$", "")
    marked = specs.withColumns({"_stem": stem, "_depth": classes.depth(stem), "_kind": F.when(F.endswith("spec", F.lit(".**")), "below").when(F.endswith("spec", F.lit(".*")), "child").otherwise("self")})
    up = known.select("class", F.explode(F.concat(classes.ancestors("class"), F.array("class"))).alias("_stem"))
    met = marked.join(up, "_stem")
    good = F.when(F.col("_kind") == "self", F.col("class") == F.col("_stem")).when(F.col("_kind") == "child", classes.depth("class") == F.col("_depth") + 1).otherwise(classes.depth("class") > F.col("_depth"))
    return met.where(good).select("spec", "class").distinct()


def class_members(wanted: DataFrame, rows: DataFrame, column: str = "class") -> DataFrame:
    """Rows of each wanted class: those of exactly that class if there are any, else of all below it."""
    up = rows.withColumn("wanted", F.explode(F.concat(classes.ancestors(column), F.array(column))))
    met = up.join(wanted, "wanted").withColumn("_exact", F.col("wanted") == F.col(column))
    return met.withColumn("_any", F.max("_exact").over(Window.partitionBy("wanted"))).where(F.col("_exact") | ~F.col("_any")).drop("_exact", "_any")


def fp_pairs(fires: DataFrame, truth: DataFrame) -> DataFrame:
    """(pattern_class, true_class, weight): patterns that fire on reactions of a class that is neither theirs, above nor below it."""
    met = fires.select("pattern_class", "reaction_id").join(truth.select("reaction_id", "true_class"), "reaction_id")
    wrong = (F.col("pattern_class") != F.col("true_class")) & ~classes.is_below("true_class", "pattern_class") & ~classes.is_below("pattern_class", "true_class")
    return met.where(wrong).groupBy("pattern_class", "true_class").agg(F.count(F.lit(1)).alias("weight"))


def resolve_true_class(rows: DataFrame, known: DataFrame, tiers: list[str], key: str, mode: str = "exact_first") -> DataFrame:
    """The finest tier of each row that is a known class, else the finest that is above one; ``mode="combined"`` takes the finest that is either."""
    long = rows.select(key, F.explode(F.array(*[F.struct(F.lit(k).alias("tier"), F.col(c).alias("class")) for k, c in enumerate(tiers, 1)])).alias("x")).select(key, "x.*").where(F.col("class").isNotNull())
    marks = known.select("class", F.lit(2).alias("_m")).union(known.select(F.explode(classes.ancestors("class")).alias("class"), F.lit(1).alias("_m"))).groupBy("class").agg(F.max("_m").alias("_m"))
    met = long.join(marks, "class")
    order = F.struct("_m", "tier") if mode == "exact_first" else F.struct("tier", "_m")
    return met.groupBy(key).agg(F.max_by("class", order).alias("true_class"), F.max_by("tier", order).alias("tier"))


def merge_class(df: DataFrame, merged: DataFrame, column: str) -> DataFrame:
    """Codes under a merged prefix in the code that stands for it; ``merged``: (prefix, into). The longest prefix wins."""
    ups = df.select(column).distinct().withColumn("prefix", F.explode(F.concat(classes.ancestors(column), F.array(column))))
    best = ups.join(merged, "prefix").groupBy(column).agg(F.max_by("into", F.length("prefix")).alias("_into"))
    return df.join(best, column, "left").withColumn(column, F.coalesce("_into", column)).drop("_into")


def categorize_fps(pairs: DataFrame) -> DataFrame:
    """Weights of false positives by how much of the hierarchy both classes share, overall and by first tier."""
    n = classes.shared_depth("pattern_class", "true_class")
    level = F.when(n == 0, "cross_tier1").otherwise(F.concat(F.lit("same_tier"), n.cast("string")))
    return pairs.select("weight", level.alias("category"), classes.at_tier("pattern_class", 1).alias("tier1")).groupingSets([["category"], ["category", "tier1"]], "category", "tier1").agg(F.sum("weight").alias("weight"))


def precedence(edges: DataFrame) -> DataFrame:
    """Classes by net weight of false positives: those that others fire on most come first. ``ordering.class_order`` avoids no less."""
    net = edges.select(F.col("true_class").alias("class"), F.col("weight").alias("_w")).union(edges.select("pattern_class", -F.col("weight"))).groupBy("class").agg(F.sum("_w").alias("net"))
    return numbered(net, [], [F.desc("net"), "class"], "position")


def order_stats(edges: DataFrame, order: DataFrame) -> DataFrame:
    """The share of false-positive weight that an order of classes avoids: the true class is tried before the pattern that misfires."""
    at = lambda c, name: order.select(F.col("class").alias(c), F.col("position").alias(name))
    met = edges.join(at("true_class", "_t"), "true_class").join(at("pattern_class", "_p"), "pattern_class")
    return met.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("weight"), F.coalesce(F.sum(F.when(F.col("_t") < F.col("_p"), F.col("weight")).otherwise(0)), F.lit(0)).alias("avoided")).withColumn("share", F.when(F.col("weight") == 0, 1.0).otherwise(F.col("avoided") / F.col("weight")))


def atom_filter(spec: dict[str, int | list[int] | None], counts: Column, strict: bool = False) -> Column:
    """Whether an element-count map fits ``spec``: None is at least one, a number exactly that many, a list one of them; {} allows none.

    ``strict`` forbids elements that the spec doesn't name.
    """
    if not spec:
        return F.size(F.map_filter(counts, lambda k, v: v > 0)) == 0
    good = F.lit(True)
    for element, want in spec.items():
        n = F.coalesce(F.element_at(counts, element), F.lit(0))
        good = good & (n >= 1 if want is None else n.isin(*want) if isinstance(want, list) else n == want)
    return good & F.forall(F.map_keys(counts), lambda k: k.isin(*spec)) if strict else good
