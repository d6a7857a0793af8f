"""Similarities of equal-length vectors, as expressions of higher-order functions; all are 1 - distance unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crucible.functions.text import column


def _sum(a: Column, b: Column, each) -> Column:
    return F.aggregate(F.zip_with(a, b, each), F.lit(0.0), lambda s, x: s + x)


def _share(top: Column, bottom: Column, empty: float) -> Column:
    return F.when(bottom == 0, F.lit(empty)).otherwise(top / bottom)


def similarity(a: Column | str, b: Column | str, metric: str = "jaccard") -> Column:
    """The similarity ``metric`` of two numeric arrays.

    On counts, positions where either is non-zero matter to jaccard, dice and their kin; unequal values there are a mismatch. Two vectors
    without any have similarity 1. ``yule`` is Yule's Q distance. Unknown names raise.
    """
    a, b = (F.transform(column(x), lambda v: v.cast("double")) for x in (a, b))
    n = F.size(a).cast("double")
    on = lambda test: _sum(a, b, lambda x, y: F.when(test(x, y), 1.0).otherwise(0.0))
    both = lambda: on(lambda x, y: (x != 0) & (x == y))
    differ = lambda: on(lambda x, y: x != y)
    total = lambda each: _sum(a, b, each)
    if metric == "jaccard":
        return 1 - _share(differ(), on(lambda x, y: (x != 0) | (y != 0)), 0.0)
    if metric == "dice":
        return 1 - _share(differ(), 2 * both() + differ(), 0.0)
    if metric == "kulczynski1":
        return _share(both(), differ(), float("inf"))
    if metric == "rogers_tanimoto":
        return 1 - _share(2 * differ(), n + differ(), 0.0)
    if metric == "sokal_michener":
        return 1 - _share(differ(), n, 0.0)
    if metric == "sokal_sneath":
        return 1 - _share(2 * differ(), both() + 2 * differ(), 0.0)
    if metric == "russell_rao":
        return 1 - _share(n - both(), n, 0.0)
    if metric == "yule":
        left, right, none = on(lambda x, y: (x != 0) & (y == 0)), on(lambda x, y: (x == 0) & (y != 0)), on(lambda x, y: (x == 0) & (y == 0))
        cross = left * right
        return 1 - _share(2 * cross, on(lambda x, y: (x != 0) & (y != 0)) * none + cross, 0.0)
    if metric == "bray_curtis":
        return 1 - _share(total(lambda x, y: F.abs(x - y)), total(lambda x, y: F.abs(x + y)), 0.0)
    if metric == "canberra":
        return 1 - total(lambda x, y: F.when((x == 0) & (y == 0), 0.0).otherwise(F.abs(x - y) / (F.abs(x) + F.abs(y))))
    if metric == "chebyshev":
        return 1 - F.coalesce(F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))), F.lit(0.0))
    if metric == "manhattan":
        return 1 - total(lambda x, y: F.abs(x - y))
    if metric == "euclidean":
        return 1 - F.sqrt(total(lambda x, y: (x - y) * (x - y)))
    if metric == "minkowski":
        return 1 - F.pow(total(lambda x, y: F.pow(F.abs(x - y), F.lit(3.0))), F.lit(1 / 3))
    if metric == "cosine":
        return _share(total(lambda x, y: x * y), F.sqrt(total(lambda x, y: x * x)) * F.sqrt(total(lambda x, y: y * y)), 0.0)
    if metric == "correlation":
        mean_a, mean_b = total(lambda x, y: x) / n, total(lambda x, y: y) / n
        cov = total(lambda x, y: x * y) - n * mean_a * mean_b
        return _share(cov, F.sqrt(total(lambda x, y: x * x) - n * mean_a * mean_a) * F.sqrt(total(lambda x, y: y * y) - n * mean_b * mean_b), 0.0)
    if metric == "hamming":
        return differ()
    raise ValueError(f"unknown metric {metric!r}")


METRICS = ("jaccard", "dice", "kulczynski1", "rogers_tanimoto", "russell_rao", "sokal_michener", "sokal_sneath", "yule", "bray_curtis", "canberra", "chebyshev", "manhattan", "correlation", "cosine", "euclidean", "minkowski")


def packed_hamming(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two arrays of 64-bit words."""
    return F.aggregate(F.zip_with(column(a), column(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def assemble(reactants: Column | str, products: Column | str, concatenate: bool = True) -> Column:
    """A reaction's fingerprint from arrays of its molecules' fingerprints: sums of each side, laid end to end or added."""
    total = lambda side: F.aggregate(column(side), F.transform(F.get(column(side), F.lit(0)), lambda x: F.lit(0)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("int")))
    left, right = total(reactants), total(products)
    return F.concat(left, right) if concatenate else F.zip_with(left, right, lambda x, y: x + y)


def to_digits(fp: Column | str) -> Column:
    """A count vector as a string with a digit for each position; a count over 9 is an error."""
    fp = column(fp)
    return F.when(F.exists(fp, lambda x: (x > 9) | (x < 0)), F.raise_error(F.lit("a count doesn't fit a digit"))).otherwise(F.array_join(fp, ""))


def from_digits(c: Column | str) -> Column:
    return F.transform(F.filter(F.split(column(c), ""), lambda x: x != ""), lambda x: x.cast("int"))


def product_half(fp: Column | str) -> Column:
    fp = column(fp)
    half = (F.size(fp) / 2).cast("int")
    return F.slice(fp, half + 1, half)
