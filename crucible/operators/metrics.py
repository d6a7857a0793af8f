"""Prediction-versus-gold metrics on exploded reaction tables.

A reaction table has a row for each reaction: ``by`` columns (run, stem), ``idx``, ``reactants`` and ``products`` (arrays of canonical
structures) and ``conditions`` (array of structs role, text, smiles). Matching on an equality relation is a multiset join; only optimal and
greedy assignment run per group, on the overlapping pairs that Spark found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crucible.functions import molecules, text
from crucible.operators import structures
from crucible.operators.assign import assign
from crucible.schemas import ROLES
from crucible.scratch import written


def f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def with_prf(df: DataFrame, matched: str = "matched", n_pred: str = "n_pred", n_gold: str = "n_gold") -> DataFrame:
    """precision, recall and f1 of counts; both sides empty count as perfect."""
    m, p, g = (F.col(c).cast("double") for c in (matched, n_pred, n_gold))
    none = (p == 0) & (g == 0)
    precision = F.when(none, 1.0).otherwise(F.coalesce(F.try_divide(m, p), F.lit(0.0)))
    recall = F.when(none, 1.0).otherwise(F.coalesce(F.try_divide(m, g), F.lit(0.0)))
    return df.withColumns({"precision": precision, "recall": recall}).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def set_overlap(pred: DataFrame, gold: DataFrame, by: list[str], value: str) -> DataFrame:
    """Set IoU, precision and recall of distinct values of each group, with counts on either side only.

    Groups of either table appear. An empty union has IoU 1; an empty side alone has precision or recall 0.
    """
    # a value's sides meet in one shuffle; null values stand for the group alone
    side = lambda df, p: df.select(*by, F.col(value).alias("_v"), F.lit(p).alias("_p"))
    seen = side(pred, True).union(side(gold, False)).groupBy(*by, "_v").agg(F.bool_or("_p").alias("_p"), F.bool_or(~F.col("_p")).alias("_g"))
    real, p, g = F.col("_v").isNotNull(), F.col("_p"), F.col("_g")
    out = seen.groupBy(*by).agg(F.count_if(real & p & g).alias("both"), F.count_if(real & p & ~g).alias("extra"), F.count_if(real & g & ~p).alias("missing"))
    both, extra, missing = (F.col(c).cast("double") for c in ("both", "extra", "missing"))
    share = lambda top, bottom, empty: F.when(bottom == 0, empty).otherwise(top / bottom)
    out = out.withColumns({"iou": share(both, both + extra + missing, 1.0), "precision": share(both, both + extra, 0.0), "recall": share(both, both + missing, 0.0)})
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def set_lists(pred: Column, gold: Column) -> Column:
    """(iou, missing, extra) of two arrays as sets, for rows that hold both sides."""
    pred, gold = (F.array_distinct(F.filter(F.coalesce(x, F.array().cast("array<string>")), lambda v: v.isNotNull())) for x in (pred, gold))
    union = F.size(F.array_union(pred, gold))
    return F.struct(
        F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(pred, gold)) / union).alias("iou"),
        F.array_sort(F.array_except(gold, pred)).alias("missing"), F.array_sort(F.array_except(pred, gold)).alias("extra"),
    )


def multiset_match(pred: DataFrame, gold: DataFrame, by: list[str], key: str) -> DataFrame:
    """How many rows of each group match one-to-one where equality of ``key`` is the relation: the sum of the lesser counts."""
    a = pred.groupBy(*by, key).agg(F.count(F.lit(1)).alias("_p"))
    b = gold.groupBy(*by, key).agg(F.count(F.lit(1)).alias("_g"))
    joined = a.join(b, [*by, key], "full")
    out = joined.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("_p").isNotNull() & F.col("_g").isNotNull(), F.least("_p", "_g"))), F.lit(0)).alias("matched"), F.coalesce(F.sum("_p"), F.lit(0)).alias("n_pred"), F.coalesce(F.sum("_g"), F.lit(0)).alias("n_gold"))
    return with_prf(out)


def signature(*parts: Column) -> Column:
    """A string key of arrays as sets: each sorted and distinct."""
    return F.to_json(F.struct(*[F.array_sort(F.array_distinct(F.filter(p, lambda x: x.isNotNull()))).alias(f"p{k}") for k, p in enumerate(parts)]))


def condition_keys(conditions: Column) -> Column:
    """Conditions as distinct ``role|text`` keys; the text is normalised, the structure counts where there is no text."""
    return F.array_sort(F.array_distinct(F.transform(conditions, lambda c: F.concat_ws("|", F.lower(c["role"]), F.coalesce(F.nullif(text.condition_text(c["text"]), F.lit("")), c["smiles"], F.lit(""))))))


def soft_match(pred: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """Reactions with equal reactant and product sets, one-to-one."""
    keyed = lambda df: df.withColumn("_key", signature(F.col("reactants"), F.col("products")))
    return multiset_match(keyed(pred), keyed(gold), by, "_key")


def side_match(pred: DataFrame, gold: DataFrame, by: list[str], side: str) -> DataFrame:
    """Reactions with equal sets on one side alone, ``reactants`` or ``products``, one-to-one."""
    keyed = lambda df: df.withColumn("_key", signature(F.col(side)))
    return multiset_match(keyed(pred), keyed(gold), by, "_key")


def constitution_match(pred: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """Soft match with stereo marks removed."""
    flat = lambda df: df.withColumns({c: F.transform(c, molecules.without_stereo) for c in ("reactants", "products")})
    return soft_match(flat(pred), flat(gold), by)


def hard_match(pred: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """Soft match with equal conditions; gold reactions without conditions match on structures alone, after all others.

    Stage one matches (structures, conditions) keys of gold reactions that have conditions. Stage two matches the others by structures with
    the predictions that stage one left. Columns strict, lenient, skipped_cond_check and the usual counts.
    """
    def keyed(df: DataFrame, pred_: bool) -> DataFrame:
        cond = F.to_json(F.struct(condition_keys(F.col("conditions")).alias("c")))
        has = F.size(F.coalesce("conditions", F.array().cast(df.schema["conditions"].dataType))) > 0
        return df.select(*by, signature(F.col("reactants"), F.col("products")).alias("_soft"), cond.alias("_cond"), F.lit(pred_).alias("_pred"), has.alias("_has"))

    # both sides in one pass: counts by (structures, conditions), then by structures, then by group
    p = F.col("_pred")
    fine = keyed(pred, True).union(keyed(gold, False)).groupBy(*by, "_soft", "_cond").agg(F.count_if(p).alias("_p"), F.count_if(~p & F.col("_has")).alias("_need"), F.count_if(~p & ~F.col("_has")).alias("_free"))
    soft = fine.withColumn("_hit", F.least("_p", "_need")).groupBy(*by, "_soft").agg(*[F.sum(c).alias(c) for c in ("_p", "_need", "_free", "_hit")])
    lenient = F.least(F.col("_p") - F.col("_hit"), F.col("_free"))
    out = soft.groupBy(*by).agg(F.sum("_p").alias("n_pred"), F.sum(F.col("_need") + F.col("_free")).alias("n_gold"), F.sum("_free").alias("skipped_cond_check"), F.sum("_hit").alias("strict"), F.sum(lenient).alias("lenient"))
    return with_prf(out.withColumn("matched", F.col("strict") + F.col("lenient")))


def condition_coverage(pred: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """Recall and precision of distinct (role, normalised text); a side without conditions counts as covered."""
    keyed = lambda df: df.select(*by, "role", text.condition_text("text").alias("_t")).withColumn("_key", F.concat_ws("|", "role", "_t"))
    out = set_overlap(keyed(pred), keyed(gold), by, "_key")
    whole = lambda part, other: F.when(F.col(part) + F.col(other) == 0, 1.0).otherwise(F.col(part) / (F.col(part) + F.col(other)))
    return out.select(*by, whole("both", "missing").alias("recall"), whole("both", "extra").alias("precision"))


def lenient_coverage(pred: DataFrame, gold: DataFrame, by: list[str], bucket: str = "bucket", structure: str = "smiles", words: str = "text") -> DataFrame:
    """Conditions matched first by (bucket, structure), then the rest by (bucket, lenient text).

    Both sides keep the first of equal conditions. Each pass pairs the k-th with the k-th of a key, which is exact for an equality relation.
    """
    def prepared(df: DataFrame) -> DataFrame:
        df = df.select(*by, "idx", bucket, F.nullif(structure, F.lit("")).alias("_s"), text.lenient_text(words).alias("_t"))
        return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by, bucket, "_s", "_t").orderBy("idx"))).where("_n = 1").drop("_n")

    def paired(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
        keys = [*by, bucket, key]
        rank = lambda df: df.where(F.col(key).isNotNull() & (F.col(key) != "")).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("idx")))
        return rank(a).join(rank(b).select(*keys, "_r", F.col("idx").alias("_other")), [*keys, "_r"]).select(*by, "idx", "_other")

    p, g = prepared(pred), prepared(gold)
    first = paired(g, p, "_s")
    rest_g = g.join(first.select(*by, "idx"), [*by, "idx"], "left_anti")
    rest_p = p.join(first.select(*by, F.col("_other").alias("idx")), [*by, "idx"], "left_anti")
    second = paired(rest_g, rest_p, "_t")
    hits = first.union(second).groupBy(*by).agg(F.count(F.lit(1)).alias("matched"))
    counts = g.select(*by, F.lit(1).alias("_g"), F.lit(0).alias("_p")).union(p.select(*by, F.lit(0), F.lit(1))).groupBy(*by).agg(F.sum("_g").alias("n_gold"), F.sum("_p").alias("n_pred"))
    return with_prf(counts.join(hits, by, "left").na.fill(0, ["matched"]))


def reaction_pairs(pred: DataFrame, gold: DataFrame, by: list[str], value: str = "molecules") -> DataFrame:
    """(pred_idx, gold_idx, shared, jaccard) of the reactions of a group that share a molecule; others have Jaccard 0.

    Two reactions without molecules have Jaccard 1 and are included.
    """
    sets = lambda df: df.select(*by, "idx", F.array_distinct(F.filter(value, lambda x: x.isNotNull())).alias("_m"))
    p, g = sets(pred), sets(gold)
    single = lambda df, i, n: df.select(*by, F.col("idx").alias(i), F.size("_m").alias(n), F.explode("_m").alias("_v"))
    met = single(p, "pred_idx", "_np").join(single(g, "gold_idx", "_ng"), [*by, "_v"]).groupBy(*by, "pred_idx", "gold_idx", "_np", "_ng").agg(F.count(F.lit(1)).alias("shared"))
    met = met.select(*by, "pred_idx", "gold_idx", "shared", (F.col("shared") / (F.col("_np") + F.col("_ng") - F.col("shared"))).alias("jaccard"))
    bare = lambda df, i: df.where(F.size("_m") == 0).select(*by, F.col("idx").alias(i))
    return met.union(bare(p, "pred_idx").join(bare(g, "gold_idx"), by).select(*by, "pred_idx", "gold_idx", F.lit(0).cast("long"), F.lit(1.0)))


def partial_match(pred: DataFrame, gold: DataFrame, by: list[str], threshold: float = 0.5, stereo: bool = False) -> DataFrame:
    """Reactions assigned one-to-one so that the total Jaccard of their molecules is greatest; matched where it reaches ``threshold``.

    mean_jaccard averages over the lesser number of reactions; pairs without overlap count 0.
    """
    flat = molecules.without_stereo if not stereo else lambda c: c
    joined = lambda df: df.select(*by, "idx", F.transform(F.array_union("reactants", "products"), flat).alias("molecules"))
    chosen = assign(reaction_pairs(joined(pred), joined(gold), by), by, "pred_idx", "gold_idx", "jaccard")
    hits = chosen.groupBy(*by).agg(F.count_if(F.col("score") >= threshold).alias("matched"), F.sum("score").alias("_total"))
    counts = pred.select(*by, F.lit(1).alias("_p"), F.lit(0).alias("_g")).union(gold.select(*by, F.lit(0), F.lit(1))).groupBy(*by).agg(F.sum("_p").alias("n_pred"), F.sum("_g").alias("n_gold"))
    out = with_prf(counts.join(hits, by, "left").na.fill(0, ["matched", "_total"]))
    least = F.least("n_pred", "n_gold")
    return out.withColumn("mean_jaccard", F.when(least == 0, F.when(F.greatest("n_pred", "n_gold") == 0, 1.0).otherwise(0.0)).otherwise(F.col("_total") / least)).drop("_total")


def greedy_pairs(pred: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """Reactions paired greedily by shared products, then shared reactants, then closeness of position; pairs without overlap never."""
    def shared(side: str) -> DataFrame:
        one = lambda df, i: df.select(*by, F.col("idx").alias(i), F.explode(F.transform(side, molecules.without_stereo)).alias("_v"))
        return one(pred, "pred_idx").distinct().join(one(gold, "gold_idx"), [*by, "_v"]).groupBy(*by, "pred_idx", "gold_idx").agg(F.count(F.lit(1)).alias(side))

    keys = [*by, "pred_idx", "gold_idx"]
    pairs = shared("products").join(shared("reactants"), keys, "full").na.fill(0, ["products", "reactants"])
    pairs = pairs.withColumn("_score", F.col("products") * 1e12 + F.col("reactants") * 1e6 - F.abs(F.col("gold_idx") - F.col("pred_idx")))
    chosen = assign(pairs, by, "pred_idx", "gold_idx", "_score", optimal=False)
    return chosen.drop("score").join(pairs.drop("_score"), keys)


def image_score(pred: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """Matched reactions and products, and yields of matched products, of each group.

    ``products`` here are arrays of structs (smiles, yield_pct). A reaction is matched if all of its gold products are found in the paired
    prediction (or any reactant, if it has no products); yields agree if they round to the same whole number, half to even.
    """
    names = lambda df: df.withColumn("products", F.transform("products", lambda x: x["smiles"]))
    pairs = greedy_pairs(names(pred), names(gold), by)
    spread = lambda df, i, y: df.select(*by, F.col("idx").alias(i), F.posexplode("products").alias(f"_k{i}", "_x")).select(*by, i, f"_k{i}", molecules.without_stereo(F.col("_x.smiles")).alias("_v"), F.col("_x.yield_pct").alias(y))
    nth = lambda df, i: df.withColumn("_n", F.row_number().over(Window.partitionBy(*by, i, "_v").orderBy(f"_k{i}")))
    found = nth(spread(gold, "gold_idx", "gold_yield"), "gold_idx").join(pairs.select(*by, "pred_idx", "gold_idx"), [*by, "gold_idx"]).join(nth(spread(pred, "pred_idx", "pred_yield"), "pred_idx"), [*by, "pred_idx", "_v", "_n"])
    per = found.groupBy(*by, "gold_idx").agg(F.count(F.lit(1)).alias("_hit"), F.count_if(F.col("gold_yield").isNotNull() & F.col("pred_yield").isNotNull()).alias("_pairs"), F.count_if(F.bround("gold_yield") == F.bround("pred_yield")).alias("_right"))
    rows = gold.select(*by, F.col("idx").alias("gold_idx"), F.size("products").alias("_n")).join(pairs.select(*by, "gold_idx", "reactants"), [*by, "gold_idx"], "left").join(per, [*by, "gold_idx"], "left").na.fill(0, ["_hit", "_pairs", "_right", "reactants"])
    full = F.when(F.col("_n") > 0, F.col("_hit") == F.col("_n")).otherwise(F.col("reactants") > 0)
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("gold_reactions"), F.count_if(full).alias("matched_reactions"), F.sum("_n").alias("gold_products"), F.sum("_hit").alias("matched_products"), F.sum("_pairs").alias("yield_pairs"), F.sum("_right").alias("yield_correct"))
    predicted = pred.groupBy(*by).agg(F.sum(F.size("products")).alias("predicted_products"))
    return out.join(predicted, by, "left").na.fill(0, ["predicted_products"])


def validity(reactions: DataFrame, by: list[str]) -> DataFrame:
    """The share of lexically valid structures among reactants, products and conditions; 1 where there are none."""
    every = F.concat("reactants", "products", F.transform("conditions", lambda c: c["smiles"]))
    rows = reactions.select(*by, F.explode_outer(F.filter(every, lambda x: x.isNotNull())).alias("_s"))
    return rows.groupBy(*by).agg(F.count("_s").alias("structures"), F.count_if(molecules.lexically_valid("_s")).alias("valid")).withColumn("rate", F.when(F.col("structures") == 0, 1.0).otherwise(F.col("valid") / F.col("structures")))


def role_compliance(conditions: DataFrame, by: list[str], roles: tuple[str, ...] = ROLES) -> DataFrame:
    """The share of conditions whose role is one of ``roles``, and the sorted others."""
    good = F.coalesce(F.col("role").isin(*roles), F.lit(False))
    out = conditions.groupBy(*by).agg(F.count(F.lit(1)).alias("conditions"), F.count_if(good).alias("legal"), F.array_sort(F.collect_set(F.when(~good, F.col("role")))).alias("illegal_roles"))
    return out.withColumn("rate", F.col("legal") / F.col("conditions"))


def conformance(records: DataFrame, extra_keys: str | None = None) -> DataFrame:
    """``records`` with (valid, errors): ids of the form 1_1, legal roles, no attachment marks, no unknown keys (an array column)."""
    r = F.coalesce("reactions", F.array().cast(records.schema["reactions"].dataType))
    each = lambda test, name: F.when(F.exists(r, test), F.lit(name))
    rules = [
        F.when(F.coalesce(F.col("file_name"), F.lit("")) == "", "no file_name"),
        each(lambda x: ~F.coalesce(x["reaction_id"].rlike(r"^\d+_\d+$"), F.lit(False)), "reaction_id"),
        each(lambda x: F.exists(F.coalesce(x["conditions"], F.array().cast("array<struct<role:string,text:string,smiles:string,raw_value:double>>")), lambda c: ~F.coalesce(c["role"].isin(*ROLES), F.lit(False))), "role"),
        each(lambda x: F.exists(F.concat(x["reactants"], x["products"]), lambda m: F.coalesce(F.contains(m["smiles"], F.lit("[*:")), F.lit(False))), "attachment"),
    ]
    if extra_keys:
        rules.append(F.when(F.size(extra_keys) > 0, F.concat(F.lit("unknown keys: "), F.array_join(F.array_sort(extra_keys), ", "))))
    return records.withColumn("errors", F.array_compact(F.array(*rules))).withColumn("valid", F.size("errors") == 0)


def failure_modes(pairs: DataFrame) -> DataFrame:
    """``failure`` of aligned molecule pairs (gold, pred: structures, either null): what went wrong, the first of the list that holds."""
    found = pairs.withColumns({"_g": molecules.canon("gold"), "_p": molecules.canon("pred"), "_d": molecules.count_difference(molecules.atom_counts("gold"), molecules.atom_counts("pred"))})
    gold, pred, difference = F.col("_g"), F.col("_p"), F.col("_d")
    values = F.map_values(difference)
    same_atoms = F.size(values) == 0
    tag = (
        F.when(F.col("pred").isNull(), "missing").when(F.col("gold").isNull(), "hallucinated").when(pred.isNull(), "schema_failure").when(gold == pred, "match")
        .when(molecules.without_stereo(gold) == molecules.without_stereo(pred), "stereo_error")
        .when((F.size(values) == 1) & (F.map_keys(difference)[0] == "C") & (F.abs(values[0]) <= 2), "methylene_shift")
        .when(same_atoms & gold.rlike("[bcnops]") & pred.rlike("[bcnops]"), "substituent_position").when(same_atoms, "connectivity_misread").otherwise("other")
    )
    return found.withColumn("failure", tag).drop("_g", "_p", "_d")


def paired_exact_match(pairs: DataFrame, gold: str = "gold", pred: str = "pred", by: list[str] | None = None) -> DataFrame:
    """Rates over row pairs: equal, equal without chirality, equal without cis/trans, valid, and on chiral gold alone (-1 if there is none).

    An empty gold never matches.
    """
    g, p = F.coalesce(F.nullif(gold, F.lit("")), F.lit("<empty>")), F.coalesce(F.col(pred), F.lit(""))
    bare = lambda c, marks: F.regexp_replace(c, marks, "")
    chiral = F.contains(g, F.lit("@"))
    rate = lambda test: F.avg(F.when(test, 1.0).otherwise(0.0))
    return pairs.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), rate(g == p).alias("exact"), rate(bare(g, "@") == bare(p, "@")).alias("no_chirality"), rate(bare(g, r"[/\\]") == bare(p, r"[/\\]")).alias("no_cis_trans"),
        rate(molecules.lexically_valid(pred)).alias("valid"), rate(chiral).alias("chiral_share"), F.coalesce(F.avg(F.when(chiral, F.when(g == p, 1.0).otherwise(0.0))), F.lit(-1.0)).alias("chiral_exact"),
    )


def reaction_issues(reactions: DataFrame) -> DataFrame:
    """``issues`` of each reaction: missing or unparseable species, and elements of which products hold more than what went in."""
    structures = F.transform("conditions", lambda c: c["smiles"])
    ins = F.filter(F.concat("reactants", structures), lambda x: x.isNotNull())
    every = F.concat(ins, "products")
    counts = lambda arr: molecules.merged_counts(F.transform(arr, molecules.atom_counts))
    more = F.map_filter(molecules.count_difference(counts(F.col("products")), counts(ins)), lambda k, v: v > 0)
    open_ = F.exists(every, lambda x: molecules.has_wildcard(x))
    issues = F.array(
        F.when(F.size("reactants") == 0, "no reactants"), F.when(F.size("products") == 0, "no products"), F.when(F.exists(every, lambda x: ~molecules.lexically_valid(x)), "unparseable"),
        F.when(~open_ & (F.size("products") > 0) & (F.size(ins) > 0) & (F.size(F.map_keys(more)) > 0), F.concat(F.lit("gained "), F.array_join(F.array_sort(F.map_keys(more)), ","))),
    )
    return reactions.withColumn("issues", F.array_compact(issues))


def _assigned_distance(pred: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """Mean distance of count maps (by, idx, _m) assigned one-to-one at least total distance; unmatched ones count their whole size."""
    def sized(df: DataFrame, i: str) -> DataFrame:
        return df.select(*by, F.col("idx").alias(i), "_m", F.aggregate(F.map_values("_m"), F.lit(0), lambda a, x: a + x).alias(f"_n{i}"))

    p, g = sized(pred, "pred_idx"), sized(gold, "gold_idx").withColumnRenamed("_m", "_mg")
    pairs = p.join(g, by).withColumn("distance", F.aggregate(F.map_values(molecules.count_difference("_m", "_mg")), F.lit(0), lambda a, x: a + F.abs(x)).cast("double"))
    gain = F.col("_npred_idx") + F.col("_ngold_idx") - F.col("distance")  # what the pair saves against both unmatched
    chosen = assign(pairs.withColumn("_gain", gain.cast("double")).where("_gain > 0"), by, "pred_idx", "gold_idx", "_gain")
    saved = chosen.groupBy(*by).agg(F.sum("score").alias("_saved"))
    sums = p.select(*by, F.col("_npred_idx").alias("_x"), F.lit(1).alias("_p"), F.lit(0).alias("_g")).union(g.select(*by, "_ngold_idx", F.lit(0), F.lit(1))).groupBy(*by).agg(F.sum("_x").alias("_whole"), F.sum("_p").alias("n_pred"), F.sum("_g").alias("n_gold"))
    out = sums.join(saved, by, "left").na.fill(0, ["_saved"])
    return out.select(*by, "n_pred", "n_gold", ((F.col("_whole") - F.col("_saved")) / F.greatest("n_pred", "n_gold")).alias("distance"))


def composition_distance(pred: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """Mean difference of element counts between reactions assigned at least total distance; unmatched ones count their whole size.

    Structures that differ only in their bonds are at distance 0; ``structure_distance`` tells them apart.
    """
    counted = lambda df: df.select(*by, "idx", molecules.merged_counts(F.transform(F.concat("reactants", "products"), molecules.atom_counts)).alias("_m"))
    return _assigned_distance(counted(pred), counted(gold), by)


def structure_distance(pred: DataFrame, gold: DataFrame, by: list[str], rounds: int = 3) -> DataFrame:
    """``composition_distance`` on refined colours of atoms (``structures.colours``), averaged over the rounds.

    0 where the reactions hold equal graphs, however written; structures that can't be read count nothing. Colours are found once for each
    distinct structure of both tables.
    """
    spread = lambda df: df.select(*by, "idx", F.explode_outer(F.concat("reactants", "products")).alias("structure"))
    rows = [written(spread(df), "reaction-structures") for df in (pred, gold)]
    known = written(structures.features(rows[0].select("structure").union(rows[1].select("structure")), rounds=rounds), "structure-features")

    def counted(df: DataFrame) -> DataFrame:
        each = df.join(known, "structure", "left").select(*by, "idx", F.explode_outer("features").alias("_k", "_n")).groupBy(*by, "idx", "_k").agg(F.sum("_n").cast("int").alias("_n"))
        entry = F.when(F.col("_k").isNotNull(), F.struct(F.col("_k"), F.col("_n")))
        return each.groupBy(*by, "idx").agg(F.map_from_entries(F.collect_list(entry)).alias("_m"))

    return _assigned_distance(counted(rows[0]), counted(rows[1]), by).withColumn("distance", F.col("distance") / (rounds + 1))


def similarity_alignment(pairs: DataFrame, by: list[str], n_pred: str = "n_pred", n_gold: str = "n_gold", score: str = "similarity") -> DataFrame:
    """Mean similarity of molecules aligned greedily by it, over the greater number of molecules; ``pairs``: (pred_idx, gold_idx, score, counts)."""
    chosen = assign(pairs, by, "pred_idx", "gold_idx", score, optimal=False)
    sizes = pairs.groupBy(*by).agg(F.max(n_pred).alias("_p"), F.max(n_gold).alias("_g"))
    return sizes.join(chosen.groupBy(*by).agg(F.sum("score").alias("_s")), by, "left").select(*by, (F.coalesce("_s", F.lit(0.0)) / F.greatest("_p", "_g")).alias("mean_similarity"))


def score_policy(scored: DataFrame, full_slice: str = "gt1") -> DataFrame:
    """Which scores count for a slice: coverage only where gold has conditions, the hard match with conditions only in ``full_slice``."""
    return scored.withColumns({"condition_recall": F.when(F.col("gold_conditions") > 0, F.col("condition_recall")), "hard_match_full": F.when(F.col("slice") == full_slice, F.col("hard_match_full"))})


def retrieval(neighbours: DataFrame, by: list[str], ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Of (query, rank from 1, label, truth): accuracy within k, mean reciprocal and mean rank over those found, and how many are found."""
    first = neighbours.groupBy(*by, "query").agg(F.min(F.when(F.col("label") == F.col("truth"), F.col("rank"))).alias("_r"))
    hits = [F.avg(F.when(F.col("_r") <= k, 1.0).otherwise(0.0)).alias(f"top{k}") for k in ks]
    return first.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), *hits, F.avg(1 / F.col("_r")).alias("mrr"), F.avg(F.when(F.col("_r").isNotNull(), 1.0).otherwise(0.0)).alias("found_rate"), F.avg("_r").alias("mean_rank"))


def pattern_coverage(fires: DataFrame, reactions: DataFrame, by: list[str], threshold: float = 0.9) -> DataFrame:
    """Share of a class's reactions that at least one of its patterns covers correctly, and whether it reaches ``threshold``."""
    hit = fires.where("correct").select(*by, "reaction_id").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("_hit"))
    whole = reactions.groupBy(*by).agg(F.countDistinct("reaction_id").alias("reactions"))
    return whole.join(hit, by, "left").withColumn("coverage", F.coalesce(F.col("_hit"), F.lit(0)) / F.col("reactions")).withColumn("enough", F.col("coverage") >= threshold).drop("_hit")
