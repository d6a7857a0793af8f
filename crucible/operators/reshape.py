"""Reshaping: flat tables, canonical records, repairs and de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crucible.functions import molecules, text
from crucible.schemas import RECORD, ROLES

CONDITION = RECORD["reactions"].dataType.elementType["conditions"].dataType
COMPOUND = "struct<smiles: string, label: string, uncertain: boolean>"


def empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def species_summary(c: Column | str, kind: str = "reactant") -> Column:
    """``label|name|? (loading, role): smiles; ...`` of an array of species."""
    def one(s: Column) -> Column:
        name = F.coalesce(F.nullif(s["label"], F.lit("")), F.nullif(s["name"], F.lit("")), F.lit("?"))
        more = [s["loading"], s["role"]] if kind == "reagent" else [s["equiv"]] if kind == "reactant" else []
        detail = F.concat_ws(", ", *[F.nullif(x, F.lit("")) for x in more]) if more else F.lit("")
        return F.concat(name, F.when(detail != "", F.concat(F.lit(" ("), detail, F.lit(")"))).otherwise(""), F.when(F.coalesce(s["smiles"], F.lit("")) != "", F.concat(F.lit(": "), s["smiles"])).otherwise(""))

    return F.array_join(F.transform(text.column(c), one), "; ")


def flatten_products(extractions: DataFrame) -> DataFrame:
    """The flat product table: a row for each figure, reaction and product; a reaction without products keeps one row."""
    r = extractions.select("stem", "figure_caption", F.explode("reactions").alias("r")).select("stem", "figure_caption", "r", F.explode_outer("r.products").alias("p"))
    t = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return r.select(
        F.col("stem").alias("source_image"), t("figure_caption").alias("figure_caption"), t("r.entry_id").alias("entry_id"), t("r.title").alias("reaction_title"), F.coalesce(species_summary("r.reactants"), F.lit("")).alias("reactants"), F.coalesce(species_summary("r.reagents", "reagent"), F.lit("")).alias("reagents"),
        t("r.conditions.solvent").alias("solvent"), t("r.conditions.temperature").alias("temperature"), t("r.conditions.time").alias("time"), t("r.conditions.atmosphere").alias("atmosphere"),
        t("p.label").alias("product_label"), t("p.name").alias("product_name"), t("p.smiles").alias("product_smiles"), F.col("p.yield_pct").alias("yield_pct"), t("p.yield_note").alias("yield_note"), t("r.notes").alias("notes"),
    )


def conditions_of(r: Column) -> Column:
    """Conditions of an extracted reaction: reagents, then the scalar ones, then product yields (``87 %``)."""
    condition = lambda role, words, smiles=None, raw=None: F.struct(role.alias("role"), words.alias("text"), (smiles if smiles is not None else F.lit(None).cast("string")).alias("smiles"), (raw if raw is not None else F.lit(None).cast("double")).alias("raw_value"))
    reagents = F.transform(F.coalesce(r["reagents"], F.array().cast("array<struct<label: string, name: string, smiles: string, role_note: string, loading: string, role: string>>")), lambda x: condition(coerce_role(x["role"]), text.first_filled(x["name"], x["label"], x["smiles"]), F.nullif(x["smiles"], F.lit(""))))
    scalar = F.array_compact(F.array(*[F.when(F.coalesce(r["conditions"][c], F.lit("")) != "", condition(F.lit("reagent" if c == "other" else c), r["conditions"][c])) for c in ("temperature", "time", "atmosphere", "solvent", "other")]))
    made = F.filter(F.coalesce(r["products"], F.array().cast("array<struct<label: string, name: string, smiles: string, role_note: string, yield_pct: double, yield_note: string>>")), lambda p: p["yield_pct"].isNotNull())
    yields = F.transform(made, lambda p: condition(F.lit("yield"), F.concat(text.plain_number(p["yield_pct"]), F.lit(" %")), raw=p["yield_pct"]))
    return F.concat(reagents, scalar, yields)


def to_record(extractions: DataFrame) -> DataFrame:
    """Extractions as canonical records: ids by position, what they were called in ``additional_info``."""
    compounds = lambda arr: F.transform(arr, lambda s: F.struct(text.blank_to_null(s["smiles"]).alias("smiles"), F.nullif(s["label"], F.lit("")).alias("label"), F.lit(None).cast("boolean").alias("uncertain")))
    tag = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    reaction = lambda r, i: F.struct(
        F.concat(i.cast("string"), F.lit("_1")).alias("reaction_id"), compounds(r["reactants"]).alias("reactants"), compounds(r["products"]).alias("products"), conditions_of(r).alias("conditions"),
        F.array_compact(F.array(tag("entry", r["entry_id"]), tag("title", r["title"]), tag("notes", r["notes"]))).alias("additional_info"),
    )
    return extractions.select(*[c for c in ("run", "stem") if c in extractions.columns], F.transform("reactions", reaction).alias("reactions"))


def coerce_role(c: Column | str, roles: tuple[str, ...] = ROLES) -> Column:
    """A role of the enumeration in lower case; anything else (bases, additives, oxidants, nothing) is a reagent."""
    low = F.lower(text.column(c))
    return F.when(low.isin(*roles), low).otherwise("reagent")


def bucket_role(c: Column | str) -> Column:
    """Roles that are hard to tell apart count as one; no role is an empty one."""
    low = F.lower(F.coalesce(text.column(c), F.lit("")))
    return F.when(low.isin("reagent", "catalyst", "additive", "base", "oxidant", "reductant", "trap", "other"), "reagent_bucket").otherwise(low)


def clean_compounds(c: Column | str) -> Column:
    """Compounds with missing structures as null, and without those that have neither structure nor label."""
    cleaned = F.transform(text.column(c), lambda m: F.struct(text.blank_to_null(m["smiles"]).alias("smiles"), text.blank_to_null(m["label"]).alias("label"), m["uncertain"].alias("uncertain")))
    return F.filter(cleaned, lambda m: m["smiles"].isNotNull() | m["label"].isNotNull())


def info_text(c: Column | str) -> Column:
    """An ``additional_info`` array in JSON, of strings or of objects with ``text``, as an array of strings."""
    parsed = F.try_parse_json(text.column(c))
    items = F.try_variant_get(parsed, "$", "array<variant>")
    return F.filter(F.transform(items, lambda v: F.coalesce(F.try_variant_get(v, "$.text", "string"), F.when(~F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$", "string")))), lambda x: x.isNotNull())


def normalise_record(records: DataFrame) -> DataFrame:
    """Records with cleaned compounds, roles from the enumeration (from the text's ending where missing) and no empty conditions."""
    condition = lambda c: F.struct(coerce_role(text.suffix_role(c["role"], c["text"]), (*ROLES, "er")).alias("role"), F.nullif(F.trim(c["text"]), F.lit("")).alias("text"), text.blank_to_null(c["smiles"]).alias("smiles"), c["raw_value"].alias("raw_value"))
    reaction = lambda r: F.struct(r["reaction_id"].alias("reaction_id"), clean_compounds(r["reactants"]).alias("reactants"), clean_compounds(r["products"]).alias("products"), F.filter(F.transform(F.coalesce(r["conditions"], F.array().cast(CONDITION)), condition), lambda c: c["text"].isNotNull() | c["smiles"].isNotNull()).alias("conditions"), F.filter(r["additional_info"], lambda x: x.isNotNull()).alias("additional_info"))
    return records.withColumn("reactions", F.transform("reactions", reaction))


def explode_reactions(records: DataFrame, *by: str) -> DataFrame:
    """The reaction table of records: (by, idx, reaction_id, reactants, products, conditions), structures as canonical text."""
    structures = lambda arr: F.transform(arr, lambda m: molecules.canon(m["smiles"]))
    rows = records.select(*by, F.posexplode("reactions").alias("idx", "r"))
    slim = F.transform(F.coalesce("r.conditions", F.array().cast(CONDITION)), lambda c: F.struct(c["role"].alias("role"), c["text"].alias("text"), c["smiles"].alias("smiles")))
    return rows.select(*by, "idx", "r.reaction_id", structures(F.col("r.reactants")).alias("reactants"), structures(F.col("r.products")).alias("products"), slim.alias("conditions"))


def explode_variants(variants: DataFrame) -> DataFrame:
    """R-group gold as reactions: variants in the order of their letters, ids ``0_1``, ``1_1`` and so on."""
    rows = variants.select("file_name", F.posexplode(F.array_sort(F.map_entries("detailed_reactions"))).alias("pos", "e"))
    return rows.select("file_name", F.concat(F.col("pos").cast("string"), F.lit("_1")).alias("reaction_id"), F.col("e.key").alias("variant"), F.col("e.value.reactants").alias("reactants"), F.col("e.value.products").alias("products"))


def rows_to_records(rows: DataFrame) -> DataFrame:
    """Tabular gold as one record for each file, reactions in row order; percentages as text."""
    compounds = lambda *cs: F.filter(F.transform(F.array(*[text.blank_to_null(c) for c in cs]), lambda s: F.struct(s.alias("smiles"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("boolean").alias("uncertain"))), lambda m: m["smiles"].isNotNull())
    condition = lambda role, words, smiles=None: F.when(F.coalesce(words if words is not None else F.lit(None), smiles if smiles is not None else F.lit(None)).isNotNull(), F.struct(F.lit(role).alias("role"), (words if words is not None else F.lit(None).cast("string")).alias("text"), (smiles if smiles is not None else F.lit(None).cast("string")).alias("smiles"), F.lit(None).cast("double").alias("raw_value")))
    plain, percent = text.blank_to_null, lambda c: text.percent_text(text.blank_to_null(c))
    conditions = F.array_compact(F.array(condition("catalyst", plain("catalyst_text"), plain("cat_1")), condition("catalyst", None, plain("cat_2")), condition("solvent", plain("solvent")), condition("temperature", plain("temperature")), *[condition(k, percent(k)) for k in ("yield", "ee")], *[condition(k, plain(k)) for k in ("dr", "er")]))
    one = F.struct("row_no", F.col("reaction_id"), compounds("rec_1", "rec_2").alias("reactants"), compounds("pro_1", "pro_2").alias("products"), conditions.alias("conditions"), F.array_compact(F.array(plain("label"))).alias("additional_info"))
    grouped = rows.groupBy("file_name").agg(F.array_sort(F.collect_list(one), lambda a, b: F.when(a["row_no"] < b["row_no"], -1).when(a["row_no"] > b["row_no"], 1).otherwise(0)).alias("reactions"))
    return grouped.withColumn("reactions", F.transform("reactions", lambda r, i: F.struct(F.coalesce(F.nullif(r["reaction_id"], F.lit("")), F.concat(i.cast("string"), F.lit("_1"))).alias("reaction_id"), r["reactants"].alias("reactants"), r["products"].alias("products"), r["conditions"].alias("conditions"), r["additional_info"].alias("additional_info"))))


def fix_names(df: DataFrame, repairs: DataFrame, column: str = "file_name") -> tuple[DataFrame, DataFrame]:
    """(``df`` with repaired names, the rows that were repaired); ``repairs``: (wrong, right)."""
    joined = df.join(repairs, df[column] == repairs.wrong, "left")
    fixed = joined.withColumn("_old", F.col(column)).withColumn(column, F.coalesce("right", column))
    return fixed.drop("wrong", "right", "_old"), fixed.where(F.col("right").isNotNull()).select(F.col("_old").alias("wrong"), F.col("right"))


def dedupe_first(df: DataFrame, key: str, order: list[str], content: list[str], valid: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded): of rows with equal keys the first by ``order`` stays.

    Only valid rows may claim a key, if a column says which are. Excluded rows have a ``reason`` (no key, duplicate, not valid) and, for
    duplicates, whether they are identical to the one kept.
    """
    w = Window.partitionBy(key).orderBy(*([F.desc(valid)] if valid else []), *order)
    digest = F.sha2(F.to_json(F.struct(*content)), 256)
    named = df.withColumn("_key_ok", F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    ranked = named.where("_key_ok").withColumns({"_n": F.row_number().over(w), "_h": digest}).withColumn("_first", F.first("_h").over(w))
    ok = F.col(valid) if valid else F.lit(True)
    kept = ranked.where((F.col("_n") == 1) & ok).select(*df.columns)
    out = ranked.where((F.col("_n") > 1) | ~ok).select(*df.columns, F.when(~ok, "not valid").otherwise("duplicate").alias("reason"), F.when(ok, F.col("_h") == F.col("_first")).alias("identical"))
    return kept, out.unionByName(named.where("NOT _key_ok").select(*df.columns, F.lit("no key").alias("reason"), F.lit(None).cast("boolean").alias("identical")))


def reaction_rows(reactions: DataFrame, *by: str, keep_parseable: bool = False) -> tuple[DataFrame, DataFrame]:
    """(reactions as ``A.B>>C`` text, lone molecules). A reaction with an empty or wildcard structure is dropped, or loses it with ``keep_parseable``."""
    bad = lambda x: x.isNull() | molecules.has_wildcard(x)
    df = reactions
    if keep_parseable:
        df = df.withColumns({c: F.filter(c, lambda x: ~F.coalesce(bad(x), F.lit(True))) for c in ("reactants", "products")})
    whole = (F.size("reactants") > 0) & (F.size("products") > 0) & ~F.exists("reactants", bad) & ~F.exists("products", bad)
    rows = df.where(whole).select(*by, "idx", F.concat(F.array_join("reactants", "."), F.lit(">>"), F.array_join("products", ".")).alias("reaction"))
    lone = df.where((F.size("reactants") == 0) != (F.size("products") == 0)).select(*by, "idx", F.explode(F.concat("reactants", "products")).alias("molecule")).where(~bad(F.col("molecule")))
    return rows, lone


def wildcard_policy(pred: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """Predicted reactions without those that hold wildcards, in groups whose gold has none."""
    holds = F.exists(F.concat("reactants", "products"), lambda x: F.coalesce(molecules.has_wildcard(x), F.lit(False)))
    generic = gold.groupBy(*by).agg(F.bool_or(holds).alias("_generic"))
    return pred.join(generic, by, "left").where(F.coalesce("_generic", F.lit(False)) | ~holds).drop("_generic")


def merge_enrichment(rows: DataFrame, enriched: DataFrame, key: str) -> DataFrame:
    """Rows with non-empty values of the enrichment in place of their own; its other columns are added."""
    shared = [c for c in enriched.columns if c != key and c in rows.columns]
    renamed = enriched.select(key, *[F.col(c).alias(f"_new_{c}") if c in shared else F.col(c) for c in enriched.columns if c != key])
    joined = rows.join(renamed, key, "left")
    return joined.withColumns({c: F.coalesce(F.when(F.col(f"_new_{c}").cast("string") != "", F.col(f"_new_{c}")), F.col(c)) for c in shared}).drop(*[f"_new_{c}" for c in shared])


def standardise_db(df: DataFrame, **columns: str) -> DataFrame:
    """A user's table under the database's names; columns that it lacks are ``not-reported``."""
    out = df.withColumnsRenamed({v: k for k, v in columns.items()})
    return out.withColumns({c: F.lit("not-reported") for c in ("SOLVENT", "REAGENT", "CATALYST", "REF") if c not in out.columns} | {c: F.lit(None).cast("double") for c in ("YIELD",) if c not in out.columns})


def sanitise_db(df: DataFrame) -> DataFrame:
    """Missing conditions as ``solvent-free`` and the like; rows whose template isn't a reaction are dropped."""
    filled = {c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(f"{c.lower()}-free")) for c in ("SOLVENT", "CATALYST", "REAGENT")}
    return df.where(F.contains("TEMPLATE", F.lit(">>"))).withColumns(filled)


def tag(class_: Column | str, *groups: Column | str) -> Column:
    """A deterministic tag of a class and its sorted groups (functional groups, rings)."""
    return F.sha2(F.concat_ws(" ", text.column(class_), *[F.array_join(F.array_sort(text.column(g)), " ") for g in groups]), 256)


def explode_dots(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.filter(F.split(column, r"\."), lambda x: x != "")))


def hazard_counts(codes: Column | str, **categories: tuple[str, ...]) -> Column:
    """How many of each category's codes are among ``codes``."""
    return F.struct(*[F.size(F.array_intersect(text.column(codes), F.array(*map(F.lit, group)))).alias(name) for name, group in categories.items()])


def map_names(df: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """``column`` by a table (name, group); names that it lacks stay."""
    return df.join(mapping.select(F.col("name").alias(column), F.col("group").alias("_group")), column, "left").withColumn(column, F.coalesce("_group", column)).drop("_group")


def classification_rows(results: DataFrame, enriched: DataFrame | None = None) -> DataFrame:
    """A row for each reaction of each figure for a classifier: structures per side, reagents from conditions, hints by role, page from the file's name."""
    joined = lambda arr: F.array_join(F.filter(F.transform(arr, lambda m: text.blank_to_null(m["smiles"])), lambda s: s.isNotNull()), ".")
    r = results.select("stem", F.explode("reactions").alias("r"))
    hint = lambda role: F.array_join(F.transform(F.filter("r.conditions", lambda c: c["role"] == role), lambda c: F.coalesce(c["text"], F.lit(""))), "; ")
    out = r.select("stem", F.nullif(F.regexp_extract("stem", r"(?:page|p)[_-]?(\d+)", 1), F.lit("")).cast("int").alias("page"), "r.reaction_id", joined(F.col("r.reactants")).alias("reactants"), joined(F.col("r.products")).alias("products"), joined(F.col("r.conditions")).alias("reagents"), *[hint(k).alias(f"{k}_hint") for k in ("solvent", "catalyst", "temperature", "time", "yield")])
    out = out.withColumns({"reaction": F.concat_ws(">>", "reactants", "products"), "full_reaction": F.concat_ws(">", "reactants", "reagents", "products")})
    if enriched is not None:
        out = out.join(enriched, ["page", "reaction_id"], "left")
    return out.na.fill("")


def manuscript_text(pages: DataFrame, *by: str, most: int = 80_000) -> DataFrame:
    """Page texts in order under ``[Page n]`` heads, empty pages left out, cut at ``most`` characters (the cut is the feature)."""
    some = pages.where(F.trim("text") != "")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: F.concat(F.lit("[Page "), x["page"].cast("string"), F.lit("]\n"), x["text"])), "\n\n")
    return some.groupBy(*by).agg(F.substring(joined, 1, most).alias("text"))
