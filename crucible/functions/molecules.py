"""Structure strings: rules on text only.

Limit: two spellings of one molecule stay different unless a ``Canonicaliser`` with a chemistry toolkit is plugged in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crucible.functions.text import blank_to_null, column

ATOM = r"(\[[^\]]*\]|Br|Cl|[BCNOSPFIbcnosp])"
_TOKENS = r"^(?:\[[^\[\]]+\]|Br|Cl|[BCNOSPFIbcnosp*]|[-=#$:/\\.~@+]|%[0-9]{2}|[0-9()])+$"


def wildcards(c: Column | str) -> Column:
    """``[12*]`` as ``*``, ``[*:3]`` as ``[*]``, and hydrogen on a chiral centre inside its brackets."""
    c = F.regexp_replace(column(c), r"\[\d+\*\]", "*")
    c = F.regexp_replace(c, r"\[\*:\d+\]", "[*]")
    return F.regexp_replace(c, r"\[C(@{1,2})\]\(H\)|\[C(@{1,2})\]\(\[H\]\)", "[C$1$2H]")


def has_wildcard(c: Column | str) -> Column:
    return column(c).rlike(r"\*|\[R\d*\]|\[Ar\d*\]")


def without_stereo(c: Column | str) -> Column:
    c = F.regexp_replace(column(c), r"[@/\\]", "")
    return F.regexp_replace(c, r"\[CH\]|\[C\]", "C")


def lexically_valid(c: Column | str) -> Column:
    """Whether tokens cover the string and its brackets balance; null is not valid."""
    c = column(c)
    count = lambda x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    return F.coalesce(c.rlike(_TOKENS) & (count("(") == count(")")), F.lit(False))


def canonical(df: DataFrame, structures: str, toolkit: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(smiles, canon, canon_ns, valid) for each distinct string of ``structures``; compare molecules by joining to it.

    ``toolkit`` may replace the text rules: it gets the distinct (smiles) and returns the four columns, as by an Arrow UDF.
    """
    distinct = df.select(F.col(structures).alias("smiles")).where("smiles IS NOT NULL").distinct()
    if toolkit:
        return toolkit(distinct)
    return distinct.withColumns({"canon": canon("smiles"), "canon_ns": without_stereo(canon("smiles")), "valid": lexically_valid("smiles")})


def canon(c: Column | str) -> Column:
    """The text rules' canonical form: trimmed, wildcards normalised, null if missing or not valid."""
    c = F.trim(blank_to_null(c))
    return F.when(lexically_valid(c), wildcards(c))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is found once: an expression inside a lambda is otherwise evaluated again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def element(token: Column) -> Column:
    """The element of an atom token: ``[13CH3]`` is C, ``n`` is N, ``*`` and hydrogen are null."""
    inner = F.regexp_extract(token, r"^\[?\d*([A-Z][a-z]?|[a-z])", 1)
    two = lambda inner: F.when(inner.rlike("^[A-Z][a-z]$") & ~inner.isin("Cl", "Br", "Si", "Se", "Sn", "Li", "Na", "Mg", "Al", "Ca", "Mn", "Fe", "Co", "Ni", "Cu", "Zn", "Pd", "Ag", "Pt", "Au", "Hg", "Ru", "Rh", "Ir", "Os", "Cs", "Ti", "Zr", "As", "Te", "Ge", "Ga", "In", "Sb", "Bi", "Pb", "Ba", "Be", "Ce", "Cr", "Mo", "Sc", "Sm", "Yb", "La"), F.substring(inner, 1, 1)).otherwise(inner)
    symbol = F.initcap(F.when(F.substring(token, 1, 1) != "[", token).otherwise(bound(inner, two)))
    return bound(symbol, lambda s: F.when(~s.isin("H", "", "R"), s))


def atom_counts(c: Column | str) -> Column:
    """A map of heavy elements to their counts; an unparsed or missing string has none."""
    tokens = F.transform(F.regexp_extract_all(F.coalesce(column(c), F.lit("")), F.lit(ATOM), F.lit(1)), element)
    tokens = F.filter(tokens, lambda x: x.isNotNull())
    counted = lambda ts: bound(F.array_sort(F.array_distinct(ts)), lambda kinds: F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter(ts, lambda t: t == k)))))
    return bound(tokens, counted)


def merged_counts(maps: Column) -> Column:
    """The sum of an array of count maps."""
    keys = lambda ms: F.array_sort(F.array_distinct(F.flatten(F.transform(ms, lambda m: F.map_keys(m)))))
    total = lambda ms, k: F.aggregate(ms, F.lit(0), lambda a, m: a + F.coalesce(m[k], F.lit(0)))
    return bound(maps, lambda ms: bound(keys(ms), lambda ks: F.map_from_arrays(ks, F.transform(ks, lambda k: total(ms, k)))))


def count_difference(a: Column | str, b: Column | str) -> Column:
    """a - b by key, zero entries left out."""
    less = lambda x, y, ks: F.map_from_arrays(ks, F.transform(ks, lambda k: F.coalesce(x[k], F.lit(0)) - F.coalesce(y[k], F.lit(0))))
    keys = lambda x, y: F.array_sort(F.array_union(F.map_keys(x), F.map_keys(y)))
    whole = bound(column(a), lambda x: bound(column(b), lambda y: bound(keys(x, y), lambda ks: less(x, y, ks))))
    return F.map_filter(whole, lambda k, v: v != 0)


def balance(reaction: Column | str) -> Column:
    """Product counts minus reactant counts of ``A.B>>C``."""
    sides = F.split(column(reaction), ">>")
    return count_difference(atom_counts(F.get(sides, F.lit(1))), atom_counts(F.get(sides, F.lit(0))))


def sides(reaction: Column | str) -> Column:
    """(reactants, agents, products) of ``A.B>>C`` or ``A>B>C`` as arrays."""
    parts = F.split(column(reaction), ">")
    listed = lambda k: F.filter(F.split(F.coalesce(F.get(parts, F.lit(k)), F.lit("")), r"\."), lambda x: x != "")
    return F.struct(listed(0).alias("reactants"), listed(1).alias("agents"), listed(2).alias("products"))


def pattern_arity(pattern: Column | str) -> Column:
    s = sides(pattern)
    return F.struct(F.size(s["reactants"]).alias("reactants"), F.size(s["products"]).alias("products"))


def text_fingerprint(c: Column | str, bits: int = 256, gram: int = 4) -> Column:
    """Hashed counts of ``gram`` letters of a structure's text, as an array of ``bits`` integers; a stand-in for circular fingerprints."""
    c = F.coalesce(column(c), F.lit(""))
    n = F.greatest(F.length(c) - gram + 1, F.lit(0))
    slots = F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda k: F.pmod(F.xxhash64(F.substr(c, k, F.lit(gram))), F.lit(bits)).cast("int"))
    # sorted slots, the places where a slot's run ends, and for each run the zeros before it and its length
    ends = lambda x: F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda k: ~F.get(x, k).eqNullSafe(F.get(x, k + 1)))
    at = lambda x, e, k: F.when(k < 0, F.lit(-1)).otherwise(F.get(x, F.get(e, k)))
    run = lambda x, e, k: F.concat(F.array_repeat(F.lit(0), at(x, e, k) - at(x, e, k - 1) - 1), F.array(F.get(e, k) - F.coalesce(F.when(k > 0, F.get(e, k - 1)), F.lit(-1))))
    filled = lambda x, e: F.concat(F.flatten(F.transform(F.sequence(F.lit(0), F.size(e) - 1), lambda k: run(x, e, k))), F.array_repeat(F.lit(0), F.lit(bits - 1) - F.element_at(x, -1)))
    return bound(F.array_sort(slots), lambda x: F.when(F.size(x) == 0, F.array_repeat(F.lit(0), bits)).otherwise(bound(ends(x), lambda e: filled(x, e))))
