"""Structures as graphs: atoms and bonds as rows, colours refined in rounds of joins, and distances of colour multisets."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crucible.scratch import written

_TOKEN = re.compile(r"(\[[^\]]+\]|Br|Cl|[BCNOPSFIbcnops*])|(%\d\d|\d)|([-=#$:/\\~])|([()])|(\.)")
_IN_BRACKET = re.compile(r":\d+$|@+(TH\d|AL\d|SP\d|TB\d+|OH\d+)?")
GRAPH = "structure string, atoms array<string>, bonds array<struct<a: int, b: int, kind: string>>"


def parse(text: str) -> tuple[list[str], list[tuple[int, int, str]]] | None:
    """(atom labels, bonds) of a line notation; None where it can't be read.

    Labels are the symbols as written, lower case where aromatic, brackets without map numbers and chirality; hydrogens are not added. A bond
    without a mark is ``-`` between atoms of which one is not aromatic, else ``:``; marks of direction count as ``-``.
    """
    atoms: list[str] = []
    bonds: list[tuple[int, int, str]] = []
    rings: dict[str, tuple[int, str]] = {}
    stack: list[int | None] = []
    last, mark, at = None, "", 0

    def link(a: int, b: int, kind: str) -> None:
        plain = ":" if atoms[a][:1].islower() and atoms[b][:1].islower() else "-"
        bonds.append((a, b, {"": plain, "/": "-", "\\": "-"}.get(kind, kind)))

    for m in _TOKEN.finditer(text):
        if m.start() != at:
            return None
        at = m.end()
        atom, ring, bond, paren, dot = m.groups()
        if atom:
            atoms.append(_IN_BRACKET.sub("", atom[1:-1]) if atom[0] == "[" else atom)
            if last is not None:
                link(last, len(atoms) - 1, mark)
            last, mark = len(atoms) - 1, ""
        elif last is None:
            return None
        elif ring:
            ring = ring.lstrip("%")
            if ring in rings:
                other, before = rings.pop(ring)
                if other == last:
                    return None
                link(other, last, mark or before)
            else:
                rings[ring] = last, mark
            mark = ""
        elif bond:
            mark = bond
        elif paren == "(":
            stack.append(last)
        elif paren == ")":
            if not stack:
                return None
            last = stack.pop()
        elif dot:
            last = None
    return None if at != len(text) or rings or stack or mark or not atoms else (atoms, bonds)


def graphs(structures: DataFrame, column: str = "structure") -> DataFrame:
    """(structure, atoms, bonds) of each distinct text that can be read."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s, *g) for s in batch.column("structure").to_pylist() if (g := parse(s))]
            yield pa.RecordBatch.from_pylist(
                [{"structure": s, "atoms": a, "bonds": [{"a": x, "b": y, "kind": k} for x, y, k in b]} for s, a, b in rows],
                pa.schema([("structure", pa.string()), ("atoms", pa.list_(pa.string())), ("bonds", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("kind", pa.string())])))]),
            )

    return structures.select(F.col(column).cast("string").alias("structure")).where("structure IS NOT NULL").distinct().mapInArrow(read, GRAPH)


def colours(structures: DataFrame, column: str = "structure", rounds: int = 3) -> DataFrame:
    """(structure, round, colour, n): how many atoms of each distinct structure have a colour after each round, round 0 included.

    An atom's colour is its label first, then a 64-bit hash of its colour with the sorted colours of its neighbours and their bonds. Equal graphs
    have equal colours however their atoms are numbered. A round is one join of bonds with colours and one grouping by atom.
    """
    read = written(graphs(structures, column), "structure-graphs")
    atoms = read.select("structure", F.posexplode("atoms").alias("atom", "label")).select("structure", "atom", F.xxhash64("label").alias("colour"))
    one = read.select("structure", F.explode("bonds").alias("x")).select("structure", "x.a", "x.b", "x.kind")
    bonds = written(one.union(one.select("structure", "b", "a", "kind")).select("structure", F.col("a").alias("atom"), F.col("b").alias("other"), "kind"), "structure-bonds")
    now = written(atoms, "colours")
    count = lambda df, k: df.groupBy("structure", "colour").agg(F.count(F.lit(1)).alias("n")).select("structure", F.lit(k).alias("round"), "colour", "n")
    out = count(now, 0)
    for k in range(1, rounds + 1):
        beside = bonds.join(now.select("structure", F.col("atom").alias("other"), F.col("colour").alias("_c")), ["structure", "other"])
        around = beside.groupBy("structure", "atom").agg(F.array_sort(F.collect_list(F.struct("kind", "_c"))).alias("_around"))
        now = written(now.join(around, ["structure", "atom"], "left").select("structure", "atom", F.xxhash64("colour", F.coalesce("_around", F.array().cast("array<struct<kind:string,_c:bigint>>"))).alias("colour")), "colours")
        out = out.union(count(now, k))
    return out


def features(structures: DataFrame, column: str = "structure", rounds: int = 3) -> DataFrame:
    """(structure, features): its colours of all rounds as a map of counts, and ``_atoms``, their number in one round."""
    rows = colours(structures, column, rounds)
    return rows.groupBy("structure").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("/", "round", "colour"), F.col("n").cast("int")))).alias("features"))


def pair_distances(pairs: DataFrame, a: str, b: str, rounds: int = 3) -> DataFrame:
    """``pairs`` with ``distance``: atoms whose colour the other structure lacks, both ways, averaged over the rounds; null where one can't be read.

    0 for equal graphs. At least the difference of element counts over the number of rounds, and more where bonds differ.
    """
    own = written(features(pairs.select(F.col(a).alias("structure")).union(pairs.select(b)), rounds=rounds), "features")
    side = lambda c, name: own.select(F.col("structure").alias(c), F.col("features").alias(name))
    both = pairs.join(side(a, "_fa"), a, "left").join(side(b, "_fb"), b, "left")
    values = F.map_values(F.map_zip_with("_fa", "_fb", lambda k, x, y: F.abs(F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0)))))
    return both.withColumn("distance", F.aggregate(values, F.lit(0), lambda s, x: s + x) / (rounds + 1)).drop("_fa", "_fb")
