"""Bounding boxes: matches, duplicates and scores. Boxes have (image, side or id, x1, y1, x2, y2, category); joins are equi-joins on the image with an overlap test."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crucible.operators.matching import greedy, kept_in_groups
from crucible.operators.ranking import numbered


def iou(a: str, b: str) -> Column:
    """Intersection over union of boxes under two column prefixes; boxes that only touch have 0."""
    c = F.col
    width = F.least(c(f"{a}x2"), c(f"{b}x2")) - F.greatest(c(f"{a}x1"), c(f"{b}x1"))
    height = F.least(c(f"{a}y2"), c(f"{b}y2")) - F.greatest(c(f"{a}y1"), c(f"{b}y1"))
    inter = F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))
    area = lambda p: (c(f"{p}x2") - c(f"{p}x1")) * (c(f"{p}y2") - c(f"{p}y1"))
    return F.coalesce(F.try_divide(inter, area(a) + area(b) - inter), F.lit(0.0))


def _named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select("image", *[F.col(c).alias(f"{prefix}{c}") for c in ("idx", "x1", "y1", "x2", "y2", "category") if c in df.columns])


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of boxes of an image that overlap, with their ``iou``."""
    c = F.col
    met = _named(a, "a_").join(_named(b, "b_"), "image").where((c("a_x1") < c("b_x2")) & (c("b_x1") < c("a_x2")) & (c("a_y1") < c("b_y2")) & (c("b_y1") < c("a_y2")))
    return met.withColumn("iou", iou("a_", "b_"))


def match_boxes(a: DataFrame, b: DataFrame, least: float = 0.5, same_category: bool = False) -> DataFrame:
    """(image, idx, matched, iou) for every box of ``a``: its best box in ``b``, the first of equals, or -1 below ``least``."""
    met = overlaps(a, b)
    if same_category:
        met = met.where("a_category = b_category")
    best = met.groupBy("image", F.col("a_idx").alias("idx")).agg(F.max_by("b_idx", F.struct("iou", -F.col("b_idx"))).alias("_b"), F.max("iou").alias("_i"))
    joined = a.select("image", "idx").join(best, ["image", "idx"], "left")
    return joined.select("image", "idx", F.when(F.col("_i") >= least, F.col("_b")).otherwise(-1).alias("matched"), F.coalesce("_i", F.lit(0.0)).alias("iou"))


def dedupe_boxes(boxes: DataFrame, most: float = 0.9) -> DataFrame:
    """Boxes that no earlier box overlaps by more than ``most``."""
    late = overlaps(boxes, boxes).where((F.col("b_idx") < F.col("a_idx")) & (F.col("iou") > most)).select("image", F.col("a_idx").alias("idx")).distinct()
    return boxes.join(late, ["image", "idx"], "left_anti")


def dedupe_kept(boxes: DataFrame, by: list[str], most: float = 0.6) -> DataFrame:
    """Boxes of a reaction in order, each compared with those kept before it; empty ones are dropped. Groups are single reactions."""
    def keep(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> list[int]:
        kept: list[tuple[float, float, float, float, float]] = []
        places = []
        for k, (a, b, c, d) in enumerate(zip(x1.tolist(), y1.tolist(), x2.tolist(), y2.tolist(), strict=True)):
            if not (c > a and d > b):
                continue
            area = (c - a) * (d - b)
            for e, f, g, h, other in kept:
                inter = max(min(g, c) - max(e, a), 0.0) * max(min(h, d) - max(f, b), 0.0)
                if inter / (other + area - inter) > most:
                    break
            else:
                kept.append((a, b, c, d, area))
                places.append(k)
        return places

    return kept_in_groups(boxes, by, ["idx"], ["x1", "y1", "x2", "y2"], keep)


def box_reaction_match(gold: DataFrame, pred: DataFrame, gold_boxes: DataFrame, pred_boxes: DataFrame, molecules_only: bool = False, merge_conditions: bool = False, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(gold reactions with ``hit``, predicted ones with ``hit``). Reactions: (image, idx, reactants, conditions, products: arrays of box indices).

    Predicted boxes are put in terms of the gold boxes they match; a reaction is hit if an equal one is on the other side: the same boxes for
    each role, for reactants with conditions together if these are merged, or molecules only.
    """
    mapping = match_boxes(pred_boxes, gold_boxes, least)
    molecule = gold_boxes.where("category = 1").select("image", F.col("idx").alias("_i"))

    as_role = lambda c: lambda x: F.struct(F.lit(c).alias("role"), x.alias("box"))

    def keyed(df: DataFrame, mapped: bool) -> DataFrame:
        long = df.select("image", F.col("idx").alias("_r"), F.explode(F.concat(*[F.transform(c, as_role(c)) for c in ("reactants", "conditions", "products")])).alias("e")).select("image", "_r", "e.role", "e.box")
        if mapped:
            long = long.join(mapping.select("image", F.col("idx").alias("box"), F.col("matched").alias("_i")), ["image", "box"], "left").withColumn("_i", F.coalesce("_i", F.lit(-1)))
        else:
            long = long.withColumn("_i", F.col("box"))
        if molecules_only:
            long = long.join(molecule, ["image", "_i"], "left_semi")
        if merge_conditions:
            long = long.withColumn("role", F.when(F.col("role") == "conditions", "reactants").otherwise(F.col("role")))
        each = F.to_json(F.array_sort(F.collect_list(F.struct("role", "_i"))))
        keys = long.groupBy("image", "_r").agg(each.alias("_key"), (F.min("_i") >= 0).alias("_all"))
        return df.join(keys, (df.image == keys.image) & (df.idx == keys._r), "left").select(df["*"], "_key", F.coalesce("_all", F.lit(False)).alias("_all"))

    g, p = keyed(gold, False), keyed(pred, True)
    hit = lambda a, b: a.join(b.where("_all").select("image", "_key").distinct().withColumn("_hit", F.lit(True)), ["image", "_key"], "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit", "_key", "_all")
    return hit(g, p), hit(p, g)


def box_scores(gold: DataFrame, pred: DataFrame, size: str = "size", kind: str = "kind") -> DataFrame:
    """Precision, recall and F1 of hits, overall, by gold size and by diagram kind."""
    rows = gold.select(size, kind, F.col("hit").cast("int").alias("_g"), F.lit(1).alias("_ng"), F.lit(0).alias("_p"), F.lit(0).alias("_np")).union(pred.select(size, kind, F.lit(0), F.lit(0), F.col("hit").cast("int"), F.lit(1)))
    out = rows.groupingSets([[], [size], [kind]], size, kind).agg(F.sum("_g").alias("gold_hits"), F.sum("_ng").alias("n_gold"), F.sum("_p").alias("pred_hits"), F.sum("_np").alias("n_pred"))
    out = out.withColumns({"precision": F.col("pred_hits") / F.greatest("n_pred", F.lit(1)), "recall": F.col("gold_hits") / F.greatest("n_gold", F.lit(1))})
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def coref_score(gold_pairs: DataFrame, pred_pairs: DataFrame, gold_boxes: DataFrame, pred_boxes: DataFrame) -> DataFrame:
    """Label pairs (image, molecule, label): hits of predicted pairs mapped to gold boxes, counted for precision and recall.

    A gold pair is one whose label follows its molecule with nothing but labels (category 3) between them.
    """
    best = match_boxes(pred_boxes, gold_boxes, 1e-9)
    at = lambda c: best.select("image", F.col("idx").alias(c), F.col("matched").alias(f"_{c}"))
    mapped = pred_pairs.join(at("molecule"), ["image", "molecule"], "left").join(at("label"), ["image", "label"], "left")
    other = gold_boxes.where("category != 3").select("image", F.col("idx").alias("_o"))
    between = gold_pairs.join(other, "image", "left").groupBy("image", "molecule", "label").agg(F.count_if((F.col("_o") > F.col("molecule")) & (F.col("_o") < F.col("label"))).alias("_n"))
    good = between.where("_n = 0 AND label > molecule").select("image", F.col("molecule").alias("_molecule"), F.col("label").alias("_label"))
    hits = mapped.join(good, ["image", "_molecule", "_label"]).select("image", "_molecule", "_label").distinct().groupBy("image").agg(F.count(F.lit(1)).alias("hits"))
    sizes = gold_pairs.select("image", F.lit(1).alias("_g"), F.lit(0).alias("_p")).union(pred_pairs.select("image", F.lit(0), F.lit(1))).groupBy("image").agg(F.sum("_g").alias("n_gold"), F.sum("_p").alias("n_pred"))
    return sizes.join(hits, "image", "left").na.fill(0, ["hits"])


def detection_ap(gold: DataFrame, pred: DataFrame, least: float = 0.5, step: int = 100_000) -> DataFrame:
    """Average precision of each category: predictions by score, each takes its best free gold box; precision is interpolated.

    The greedy choice is ``matching.greedy``; the curve is read at its hits, which are numbered by ranges, and the best precision from a hit on
    is taken within ``step`` hits and then over such stretches. So no task holds a category.
    """
    c = F.col
    scored = _named(pred.drop("score"), "b_").join(pred.select("image", c("idx").alias("b_idx"), "score"), ["image", "b_idx"])
    met = _named(gold, "a_").join(scored, "image").where("a_category = b_category").withColumn("iou", iou("a_", "b_")).where(c("iou") >= least)
    order = [-c("score"), c("b_idx"), -c("iou")]
    hit = greedy(met.select("image", "a_category", "a_idx", "b_idx", "score", "iou"), ["image", "a_category"], "a_idx", "b_idx", order).select("image", c("b_idx").alias("idx"), F.lit(1).alias("_hit"))
    rows = numbered(pred.select("category", "image", "idx", "score"), ["category"], [F.desc("score"), "image", "idx"], "_n")
    hits = numbered(rows.join(hit, ["image", "idx"]).select("category", "_n"), ["category"], ["_n"], "_tp").withColumns({"_precision": c("_tp") / c("_n"), "_stretch": F.floor((c("_tp") - 1) / step)})
    later = hits.groupBy("category", "_stretch").agg(F.max("_precision").alias("_m")).withColumn("_after", F.max("_m").over(Window.partitionBy("category").orderBy(F.desc("_stretch")).rowsBetween(Window.unboundedPreceding, -1))).drop("_m")
    # from the last hit back: a frame up to the end of a stretch would be read again for each of its rows
    own = Window.partitionBy("category", "_stretch").orderBy(F.desc("_tp")).rowsBetween(Window.unboundedPreceding, 0)
    best = hits.withColumn("_own", F.max("_precision").over(own)).join(later, ["category", "_stretch"]).groupBy("category").agg(F.sum(F.greatest("_own", "_after")).alias("_sum"))
    totals = gold.groupBy("category").agg(F.count(F.lit(1)).alias("_total"))
    return totals.join(best, "category", "left").select("category", F.coalesce(c("_sum") / c("_total"), F.lit(0.0)).alias("ap"))
