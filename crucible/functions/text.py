"""Text functions on condition, yield and name strings; all are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a yield, an enantiomeric excess and a diastereomeric ratio.
YIELD = r"(?i)\d+(?:\.\d+)?\s*%(?:\s*yield)?"
EE = r"(?i)\d+(?:\.\d+)?\s*%\s*ee"
DR = r"(?i)\d+(?::\d+)+\s*dr"


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    """Null for the ways a structure is marked as missing: null, empty, ``None`` and ``<invalid>``."""
    c = column(c)
    return F.when(~F.trim(c).isin("", "None", "<invalid>"), c)


def first_filled(*cs: Column | str) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(column(c), F.lit("")) for c in cs])


def condition_text(c: Column | str) -> Column:
    """Lower case, with runs of white space as one space and none at the ends."""
    return F.lower(F.trim(F.regexp_replace(column(c), r"\s+", " ")))


def lenient_text(c: Column | str) -> Column:
    """Condition text without parentheses, and with amounts written one way: ``5 mol%``, ``80%``, ``2 equiv``."""
    c = F.lower(column(c))
    for old, new in ((r"[()]", " "), (r"(\d+(?:\.\d+)?)\s*mol\s*%", "$1 mol%"), (r"(\d+(?:\.\d+)?)\s*%", "$1%"), (r"(\d+(?:\.\d+)?)\s*equiv", "$1 equiv"), (r"\s+", " ")):
        c = F.regexp_replace(c, old, new)
    return F.trim(c)


def yield_percent(c: Column | str, any_digits: bool = False) -> Column:
    """The first percentage in a text as a number, else null."""
    pattern = r"(\d+(?:\.\d+)?)\s*%" if any_digits else r"(\d{1,3}(?:\.\d+)?)\s*%"
    return F.nullif(F.regexp_extract(column(c), pattern, 1), F.lit("")).try_cast("double")


def plain_number(c: Column | str) -> Column:
    """A number as short as it goes: 87.0 is ``87``, 0.5 is ``0.5``."""
    return F.regexp_replace(column(c).cast("double").cast("string"), r"\.0$", "")


def percent_text(c: Column | str) -> Column:
    """``0.13`` to ``13%`` and ``87`` to ``87%``; text that isn't a number stays."""
    c = column(c)
    number = c.try_cast("double")
    share = F.round(F.when((number > 0) & (number <= 1), number * 100).otherwise(number), 6)
    return F.when(number.isNull(), c).otherwise(F.concat(plain_number(share), F.lit("%")))


def split_conditions(c: Column | str) -> Column:
    """Free condition text as an array of (role, text): yields, ee and dr values, and what is left as a reagent.

    Each kind is sought in the whole text, so ``91% ee`` gives a yield ``91%`` too, and leaves ``ee`` behind.
    """
    c = F.coalesce(column(c), F.lit(""))
    found = [(role, F.regexp_extract_all(c, F.lit(p), F.lit(0))) for role, p in (("yield", YIELD), ("ee", EE), ("dr", DR))]
    rest = c
    for p in (YIELD, EE, DR):
        rest = F.regexp_replace(rest, p, "")
    rest = F.regexp_replace(rest, r"^[ ,;]+|[ ,;]+$", "")
    as_role = lambda role: lambda t: F.struct(F.lit(role).alias("role"), F.trim(t).alias("text"))
    rows = [F.transform(hits, as_role(role)) for role, hits in found]
    left = F.when(rest != "", F.array(F.struct(F.lit("reagent").alias("role"), rest.alias("text")))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    return F.concat(*rows, left)


#: Strings that tell a condition's role, in the order they are tried.
ROLE_WORDS = (
    ("yield", ("yield",)), ("temperature", ("°c", "* c", " c,", " c.", " r.t", "rt,", " rt", "room temp", "reflux")), ("time", (" h ", " h,", " h.", " min", " hour", " day", " week")), ("atmosphere", ("atm", "n2", "ar,", " air")),
)


def condition_role(c: Column | str) -> Column:
    """The role that a condition's wording suggests, else ``reagent``; a percentage of something isolated is a yield."""
    low = F.lower(column(c))
    has = lambda w: F.contains(low, F.lit(w))
    out = F.when(has("%") & has("isolat"), "yield")
    for role, words in ROLE_WORDS:
        test = F.lit(False)
        for w in words:
            test = test | has(w)
        out = out.when(test, role)
    return out.otherwise("reagent")


def suffix_role(role: Column | str, text: Column | str) -> Column:
    """A role in the singular; a missing one taken from the text's ending ``ee``, ``er`` or ``dr``."""
    ending = F.regexp_extract(F.lower(F.trim(column(text))), "(ee|er|dr)$", 1)
    one = F.regexp_replace(F.lower(F.trim(column(role))), "^(reagent|solvent|catalyst)s$", "$1")
    return F.coalesce(F.nullif(one, F.lit("")), F.nullif(ending, F.lit("")))


def path_stem(c: Column | str) -> Column:
    return F.regexp_extract(column(c), r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)


def path_suffix(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(column(c), r"(\.[^./\\]+)$", 1))


def path_parent(c: Column | str) -> Column:
    return F.regexp_extract(column(c), r"([^/\\]+)[/\\][^/\\]*$", 1)


def lexicon_key(c: Column | str) -> Column:
    """A name without spaces and with one kind of dash; case is kept."""
    return F.translate(F.regexp_replace(column(c), r"\s+", ""), "‐‑‒–—−", "------")


def slug(c: Column | str) -> Column:
    return F.substring(F.regexp_replace(F.trim(column(c)), r"[^a-zA-Z0-9._-]+", "_"), 1, 120)


def cell(c: Column | str, digits: int = 3, missing: str = "–") -> Column:
    """A number as shown in a table."""
    c = column(c)
    return F.when(c.isNull() | F.isnan(c.cast("double")), missing).otherwise(F.format_string(f"%.{digits}f", c.cast("double")))
