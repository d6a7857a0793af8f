"""Parsing, colours and distances of structures against plain versions on graphs."""

import collections
import random

import pytest

from crucible.operators import metrics, structures


@pytest.mark.parametrize(("text", "atoms", "bonds"), [
    ("CCO", ["C", "C", "O"], {(0, 1, "-"), (1, 2, "-")}), ("C=C(Cl)Br", ["C", "C", "Cl", "Br"], {(0, 1, "="), (1, 2, "-"), (1, 3, "-")}),
    ("c1ccncc1", list("cccncc"), {(0, 1, ":"), (1, 2, ":"), (2, 3, ":"), (3, 4, ":"), (4, 5, ":"), (0, 5, ":")}), ("[Na+].[OH-]", ["Na+", "OH-"], set()),
    ("C%12CC%12", ["C", "C", "C"], {(0, 1, "-"), (1, 2, "-"), (0, 2, "-")}), ("F/C=C\\\\F".replace("\\\\", "\\"), ["F", "C", "C", "F"], {(0, 1, "-"), (1, 2, "="), (2, 3, "-")}),
    ("N[C@@H:3](C)O", ["N", "CH", "C", "O"], {(0, 1, "-"), (1, 2, "-"), (1, 3, "-")}), ("C1CC=1", ["C", "C", "C"], {(0, 1, "-"), (1, 2, "-"), (0, 2, "=")}),
])
def test_parse(text, atoms, bonds):
    got = structures.parse(text)
    assert got[0] == atoms and {(min(a, b), max(a, b), k) for a, b, k in got[1]} == bonds


@pytest.mark.parametrize("text", ["", "C(", "C)", "C1CC", "C=", "CX", "(C)", "1C", "C C", "[C", "C11"])
def test_unreadable(text):
    assert structures.parse(text) is None


def refined(graph, rounds):
    atoms, bonds = graph
    colour, out = [str(a) for a in atoms], []
    for k in range(rounds + 1):
        out.append(collections.Counter(colour))
        beside = collections.defaultdict(list)
        for a, b, kind in bonds:
            beside[a].append((kind, colour[b]))
            beside[b].append((kind, colour[a]))
        colour = [repr((c, sorted(beside[i]))) for i, c in enumerate(colour)]
    return out


def far(a, b, rounds):
    x, y = (refined(structures.parse(s), rounds) for s in (a, b))
    return sum(sum(((p - q) + (q - p)).values()) for p, q in zip(x, y, strict=True)) / (rounds + 1)


TEXTS = ["CCO", "OCC", "COC", "C(C)O", "CC(C)C", "CCCC", "c1ccccc1O", "Oc1ccccc1", "C1CCCCC1", "C1CC1CCC", "CC=O", "C=CO", "[Na+].[Cl-]", "[Cl-].[Na+]", "Cc1ccc(O)cc1", "Cc1cccc(O)c1", "Cc1ccccc1O", "N"]


@pytest.mark.parametrize("rounds", [0, 3])
def test_distances(spark, rounds):
    rows = [(i * 100 + j, a, b) for i, a in enumerate(TEXTS) for j, b in enumerate(TEXTS)] + [(9999, "C(", "C"), (9998, None, "C")]
    got = {r.k: r.distance for r in structures.pair_distances(spark.createDataFrame(rows, "k long, a string, b string"), "a", "b", rounds).collect()}
    assert got.pop(9999) is None and got.pop(9998) is None
    for k, a, b in rows[:-2]:
        assert got[k] == pytest.approx(far(a, b, rounds)), (a, b)
    at = {t: i for i, t in enumerate(TEXTS)}
    pair = lambda a, b: got[at[a] * 100 + at[b]]
    assert pair("CCO", "OCC") == pair("CCO", "C(C)O") == pair("c1ccccc1O", "Oc1ccccc1") == pair("[Na+].[Cl-]", "[Cl-].[Na+]") == 0
    isomers = [("CCO", "COC"), ("CC(C)C", "CCCC"), ("CC=O", "C=CO"), ("Cc1ccc(O)cc1", "Cc1cccc(O)c1"), ("Cc1ccccc1O", "Cc1cccc(O)c1"), ("C1CCCCC1", "C1CC1CCC")]
    assert all((pair(a, b) > 0) == (rounds > 0) for a, b in isomers)


def test_reactions(spark):
    """Equal reactions written in other ways are at 0, isomers are not; the cheapest way to pair them counts."""
    kind = "g string, idx int, reactants array<string>, products array<string>"
    pred = spark.createDataFrame([("x", 0, ["CCO"], ["CC=O"]), ("x", 1, ["N"], ["CN"]), ("y", 0, ["CCO"], []), ("z", 0, ["C("], ["C"])], kind)
    gold = spark.createDataFrame([("x", 0, ["N"], ["NC"]), ("x", 1, ["OCC"], ["O=CC"]), ("y", 0, ["COC"], []), ("z", 0, [], ["C"])], kind)
    got = {r.g: r.distance for r in metrics.structure_distance(pred, gold, ["g"], 2).collect()}
    assert got["x"] == 0 and got["z"] == 0 and got["y"] == pytest.approx(far("CCO", "COC", 2))
    assert {r.g: r.distance for r in metrics.composition_distance(pred, gold, ["g"]).collect()}["y"] == 0


def test_equal_graphs_in_any_order():
    rng = random.Random(1)
    for text in TEXTS:
        atoms, bonds = structures.parse(text)
        order = list(range(len(atoms)))
        rng.shuffle(order)
        moved = [atoms[order.index(k)] for k in range(len(atoms))], [(order[a], order[b], k) for a, b, k in bonds]
        assert refined((atoms, bonds), 3) == refined(moved, 3)
