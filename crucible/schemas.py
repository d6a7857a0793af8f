"""Spark schemas of the record shapes that the library reads."""

from __future__ import annotations

from pyspark.sql import types as T


_ATOMS = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType()}


def _split(s: str) -> list[str]:
    """Parts at commas outside angle brackets."""
    parts, level, at = [], 0, 0
    for k, c in enumerate(s):
        level += (c == "<") - (c == ">")
        if c == "," and not level:
            parts.append(s[at:k])
            at = k + 1
    return [p.strip() for p in [*parts, s[at:]]]


def kind(s: str) -> T.DataType:
    """A type from its name, without a running session."""
    if s.startswith("array<"):
        return T.ArrayType(kind(s[6:-1]))
    if s.startswith("map<"):
        return T.MapType(*map(kind, _split(s[4:-1])))
    if s.startswith("struct<"):
        return T.StructType([T.StructField(n.strip(), kind(t.strip())) for n, t in (p.split(":", 1) for p in _split(s[7:-1]))])
    return _ATOMS[s]


def schema(ddl: str) -> T.StructType:
    return T.StructType([T.StructField(n, kind(t)) for n, t in (p.split(" ", 1) for p in _split(ddl))])


#: The canonical record: predictions and gold alike, one for each figure.
RECORD = schema(
    "file_name string, slice string, reaction_template struct<reactants: array<string>, products: array<string>>, "
    "reactions array<struct<reaction_id: string, "
    "reactants: array<struct<smiles: string, label: string, uncertain: boolean>>, "
    "products: array<struct<smiles: string, label: string, uncertain: boolean>>, "
    "conditions: array<struct<role: string, text: string, smiles: string, raw_value: double>>, "
    "additional_info: array<string>>>"
)
#: What an extractor returns for a figure.
EXTRACTION = schema(
    "figure_caption string, extraction_notes string, intermediates array<struct<label: string, name: string, smiles: string, role_note: string>>, "
    "reactions array<struct<entry_id: string, title: string, notes: string, "
    "reactants: array<struct<label: string, name: string, smiles: string, role_note: string, equiv: string>>, "
    "reagents: array<struct<label: string, name: string, smiles: string, role_note: string, loading: string, role: string>>, "
    "conditions: struct<temperature: string, time: string, atmosphere: string, solvent: string, other: string>, "
    "products: array<struct<label: string, name: string, smiles: string, role_note: string, yield_pct: double, yield_note: string>>>>"
)
#: R-group gold: variants by letter.
VARIANTS = schema("file_name string, reaction_template struct<reactants: array<string>, products: array<string>>, detailed_reactions map<string, struct<reactants: array<string>, products: array<string>>>")
SIDECAR = schema("stem string, backend string, model string, steps int, tool_calls int, input_tokens long, output_tokens long, elapsed_s double")
USAGE = "struct<model: string, prompt_tokens: long, completion_tokens: long, total_tokens: long, calls: long, by_agent: map<string, struct<prompt_tokens: long, completion_tokens: long, calls: long>>>"
SUITE = schema(f"suite_id string, kind string, model string, vision_model string, per_image array<struct<image: string, stem: string, rc: int, elapsed_s: double, run_dir: string, error: string, usage: {USAGE}>>, usage_total {USAGE}, elapsed_total_s double, elapsed_s double")
PATTERN = schema("class string, name string, smirks string, pos long")
#: The roles a condition may have.
ROLES = ("reagent", "solvent", "catalyst", "temperature", "time", "yield", "atmosphere", "loading", "ee", "dr", "pressure")
#: The 16 columns of the flat product table, in order.
FLAT_COLUMNS = (
    "source_image", "figure_caption", "entry_id", "reaction_title", "reactants", "reagents", "solvent", "temperature", "time", "atmosphere", "product_label", "product_name", "product_smiles", "yield_pct", "yield_note", "notes",
)
#: The columns of the annotated table, in order.
ENRICHED_COLUMNS = (
    "ENTRY_ID", "REACTION", "REACTANTS", "PRODUCTS", "SANITIZED_REACTION", "MAPPED_REACTION", "N_REACTANTS", "N_PRODUCTS", "CLASS", "NAME", "FG_REACTANTS", "FG_PRODUCTS", "PARTICIPATING_RINGS_REACTANTS",
    "PARTICIPATING_RINGS_PRODUCTS", "ALL_RINGS_PRODUCTS", "BY-PRODUCTS", "TEMPLATE", "TEMPLATE_NR", "TAG", "TAG2", "SCAFFOLD", "rxn_str_patt_fp", "rxn_dif_patt_fp", "rxn_str_morgan_fp", "rxn_dif_morgan_fp",
    "SOLVENT", "REAGENT", "CATALYST", "YIELD", "REF", "STATUS", "ERROR",
)
