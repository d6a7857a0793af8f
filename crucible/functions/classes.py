"""Dotted class codes such as ``5.1.1.3``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crucible.functions.text import column


def parts(c: Column | str) -> Column:
    return F.split(column(c), r"\.")


def depth(c: Column | str) -> Column:
    return F.size(parts(c))


def at_tier(c: Column | str, tier: int | Column) -> Column:
    """The code cut to a tier; null if it is shorter."""
    n = F.lit(tier) if isinstance(tier, int) else tier
    return F.when(depth(c) >= n, F.array_join(F.slice(parts(c), F.lit(1), n), "."))


def parent(c: Column | str) -> Column:
    n = depth(c) - 1
    return F.when(n > 0, F.array_join(F.slice(parts(c), F.lit(1), F.greatest(n, F.lit(1))), "."))


def ancestors(c: Column | str) -> Column:
    """All proper ancestors, the widest first."""
    p, n = parts(c), depth(c) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.array_join(F.slice(p, F.lit(1), k), "."))).otherwise(F.array().cast("array<string>"))


def is_below(c: Column | str, above: Column | str) -> Column:
    return F.startswith(column(c), F.concat(column(above), F.lit(".")))


def shared_depth(a: Column | str, b: Column | str) -> Column:
    """How many leading parts two codes share."""
    same = F.zip_with(parts(a), parts(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    run = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + F.when(s["on"] & x, 1).otherwise(0)).alias("n"), (s["on"] & x).alias("on")))
    return run["n"]


def without_conflict(c: Column | str) -> Column:
    return F.regexp_replace(column(c), "^CONFLICT:", "")


def display_name(c: Column | str, names: Column | str) -> Column:
    """Names of the code's tiers joined by ``: ``, the first tier left out; ``names`` is a map of codes to names."""
    chain = F.concat(ancestors(c), F.array(column(c)))
    named = F.filter(F.transform(F.slice(chain, F.lit(2), F.greatest(F.size(chain) - 1, F.lit(0))), lambda x: F.element_at(column(names), x)), lambda x: x.isNotNull())
    return F.array_join(named, ": ")
