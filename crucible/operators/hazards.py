"""Solvents and safety: hazard scores, mixtures, green preferences, liquid ranges, drug-likeness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Health and environment scores by the worst hazard code.
HEALTH = (
    (9, ("H300", "H310", "H330", "H340", "H350", "H360")), (7, ("H314",)), (6, ("H301", "H311", "H331", "H341", "H351", "H361", "H370", "H372")), (4, ("H318", "H334")),
    (2, ("H302", "H304", "H315", "H317", "H319", "H332", "H335", "H336", "H371", "H373")),
)
ENVIRONMENT = ((10, ("H420",)), (7, ("H400", "H410", "H411")), (5, ("H412", "H413")))
SEVERITY = ("recommended", "problematic", "hazardous")


def _worst(codes: Column, table, otherwise: int) -> Column:
    out = F.when(F.lit(False), 0)
    for score, group in table:
        out = out.when(F.arrays_overlap(codes, F.array(*map(F.lit, group))), score)
    return out.otherwise(otherwise)


def ehs_scores(df: DataFrame) -> DataFrame:
    """Health, environment and safety scores of solvents (the more, the worse) and a ranking in three levels.

    Safety sums scores of flash point, auto-ignition, peroxides and resistivity. The boiling point adds one to health from 85 °C, and its own
    score is the least that the environment's counts; it is no part of safety. An unknown property scores 0.
    """
    codes = F.coalesce("codes", F.array().cast("array<string>"))
    bp, fp = F.col("ExpBP"), F.col("FP")
    bp_score = F.when(bp.isNull(), 0).when(bp < 50, 7).when(bp < 70, 5).when(bp < 140, 3).when(bp < 200, 5).otherwise(7)
    fp_score = F.when(fp.isNull(), 0).when(fp < -20, 7).when(fp < 0, 5).when(fp < 24, 4).when(fp < 60, 3).otherwise(1)
    safety = fp_score + F.when(F.col("AIT") <= 200, 1).otherwise(0) + F.coalesce("peroxide", F.lit(0)) + F.coalesce("resistivity", F.lit(0))
    out = df.withColumns({"bp_score": bp_score, "safety_score": safety, "health_score": _worst(codes, HEALTH, 1), "env_score": _worst(codes, ENVIRONMENT, 3)})
    out = out.withColumns({"corrected_health_score": F.col("health_score") + F.when(bp >= 85, 1).otherwise(0), "corrected_env_score": F.greatest("env_score", "bp_score")})
    three = F.array("safety_score", "corrected_health_score", "corrected_env_score")
    many = lambda low, high: F.size(F.filter(three, lambda x: (x >= low) & (x <= high)))
    return out.withColumn("ranking", F.when((many(8, 99) > 0) | (many(7, 99) > 1), "hazardous").when((F.array_max(three) == 7) | (many(4, 6) > 1), "problematic").otherwise("recommended"))


def severity(ranking: Column | str) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITY)), ranking)


def ehs_summary(scored: DataFrame) -> DataFrame:
    whole = F.sum("count").over(Window.partitionBy())
    out = scored.groupBy("ranking").agg(F.count(F.lit(1)).alias("count"), *[F.round(F.avg(c), 4).alias(f"mean_{c}") for c in ("safety_score", "corrected_health_score", "corrected_env_score")])
    return out.withColumn("percent", F.round(F.col("count") * 100.0 / whole, 2))


def ehs_report(scored: DataFrame, key: str) -> DataFrame:
    """The most severe first."""
    return scored.orderBy(F.desc(severity(F.col("ranking"))), key)


def rate_mixture(mixtures: DataFrame, guide: DataFrame, key: str, solvents: str = "SOLVENT") -> DataFrame:
    """The rating of dotted solvent mixtures: their worst member's, unknown if one is, ``solvent-free`` if empty; and their names.

    ``guide``: (smiles, name, severity), a greater severity being worse.
    """
    parts = mixtures.select(key, F.explode(F.array_distinct(F.filter(F.split(F.coalesce(solvents, F.lit("")), r"\."), lambda x: x != ""))).alias("smiles"))
    met = parts.join(guide, "smiles", "left").groupBy(key).agg(F.max("severity").alias("_s"), F.bool_or(F.col("severity").isNull()).alias("_unknown"), F.array_sort(F.collect_set(F.coalesce("name", "smiles"))).alias("_names"))
    n = F.size("_names")
    name = F.when(n == 1, F.col("_names")[0]).when(n == 2, F.array_join("_names", " and ")).otherwise(F.concat(F.array_join(F.slice("_names", F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at("_names", -1)))
    out = mixtures.join(met, key, "left")
    return out.withColumns({"severity": F.when(F.col("_unknown"), None).otherwise(F.col("_s")), "rating": F.when(F.col("_unknown").isNull(), "solvent-free").when(F.col("_unknown"), "unknown").otherwise(F.col("_s").cast("string")), "names": F.coalesce(name, F.lit("solvent-free"))}).drop("_s", "_unknown", "_names")


def liquid_at(mixtures: DataFrame, ranges: DataFrame, key: str, temperature: float, solvents: str = "SOLVENT") -> DataFrame:
    """Mixtures all of whose known members are liquid at a temperature; ``ranges``: (smiles, mp, bp)."""
    parts = mixtures.select(key, F.explode(F.split(solvents, r"\.")).alias("smiles")).join(ranges, "smiles", "left")
    good = parts.groupBy(key).agg(F.coalesce(F.bool_and((F.col("mp") <= temperature) & (F.col("bp") >= temperature)), F.lit(True)).alias("_ok")).where("_ok")
    return mixtures.join(good.select(key), key, "left_semi")


def prefer_green(df: DataFrame, by: list[str], n: int, score: str = "score", ranking: str = "ranking", gsk: str = "gsk") -> DataFrame:
    """The n best rows, recommended ones first, then problematic ones; by score, those of 7 or more count as recommended, 5 and 6 as problematic."""
    level = F.when((F.lower(ranking) == "recommended") | (F.col(gsk) >= 7), 0).when((F.lower(ranking) == "problematic") | (F.col(gsk) >= 5), 1)
    ranked = df.withColumn("_level", level).where(F.col("_level").isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_level", F.desc(score), "name")))
    return ranked.where(F.col("_n") <= n).drop("_level", "_n")


def druglike_counts(df: DataFrame) -> DataFrame:
    """Violations of five rule sets over property columns: mw, logp, hbd, hba, tpsa, rotatable, rings, atoms, carbons, hetero, refractivity."""
    c = F.col
    count = lambda *tests: reduce(lambda a, b: a + b, [F.when(t, 1).otherwise(0) for t in tests])
    outside = lambda name, low, high: (c(name) < low) | (c(name) > high)
    return df.withColumns({
        "lipinski": count(c("mw") > 500, c("logp") > 5, c("hbd") > 5, c("hba") > 10),
        "ghose": count(outside("mw", 160, 480), outside("logp", -0.4, 5.6), outside("atoms", 20, 70), outside("refractivity", 40, 130)),
        "egan": count(c("logp") > 5.88, c("tpsa") > 131.6),
        "veber": count(c("rotatable") > 10, c("tpsa") > 140),
        "muegge": count(outside("mw", 200, 400), outside("logp", -2, 5), c("tpsa") > 150, c("rings") > 7, c("carbons") <= 4, c("hetero") <= 1, c("rotatable") > 15, c("hba") > 10, c("hbd") > 5),
    })


def cns_score(df: DataFrame, pka: str | None = None) -> DataFrame:
    """Sum of six desirabilities of a central-nervous-system drug; an unknown pKa counts none.

    Between 360 and 500 the term of the molecular weight is (360 - mw) / 140, below zero, as in the scores it has to match.
    """
    c = F.col
    fall = lambda name, low, high: F.when(c(name) < low, 1.0).when(c(name) > high, 0.0).otherwise((high - c(name)) / (high - low))
    weight = F.when(c("mw") < 360, 1.0).when(c("mw") > 500, 0.0).otherwise((360 - c("mw")) / 140)
    hump = F.when(c("tpsa") < 20, 0.0).when(c("tpsa") < 40, (c("tpsa") - 20) / 20).when(c("tpsa") < 90, 1.0).when(c("tpsa") < 120, (120 - c("tpsa")) / 30).otherwise(0.0)
    donors = F.greatest(F.lit(0.0), 1 - c("hbd") / 4)
    base = fall(pka, 8.0, 10.0) if pka else F.lit(0.0)
    return df.withColumn("cns", fall("logp", 3.0, 5.0) + fall("logd", 2.0, 4.0) + weight + hump + donors + base)


def inclusion(df: DataFrame, by: list[str], reaction_id: str = "reaction_id", wildcard: str = "wildcard") -> DataFrame:
    """``decision`` for each reaction of a figure: DROP_GENERIC where all siblings hold wildcards, DROP_TEMPLATE_PARENT for a template with a concrete sibling, KEEP_PARTIAL for others with wildcards, else KEEP_FULL."""
    w = Window.partitionBy(*by)
    template = F.endswith(reaction_id, F.lit("_template"))
    concrete = F.max(~template & ~F.col(wildcard)).over(w)
    return df.withColumn("decision", F.when(F.min(wildcard).over(w), "DROP_GENERIC").when(template & concrete, "DROP_TEMPLATE_PARENT").when(F.col(wildcard), "KEEP_PARTIAL").otherwise("KEEP_FULL"))
