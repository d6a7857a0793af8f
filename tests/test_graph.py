"""Edges of a reaction database in one pass, and pairs of reactions without moving the pairs."""

import random

from crucible.operators import graph


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_read_the_database_once(spark, tmp_path):
    rows = [("r1", "A.B.A", "C", "THF", "ref"), ("r2", "C", None, None, ""), ("r2", "C", "A..B", "THF", "ref"), ("r3", None, None, None, None)]
    spark.createDataFrame(rows, "REACTION string, PRODUCTS string, REACTANTS string, SOLVENT string, REF string").write.parquet(str(tmp_path / "db"))
    db = spark.read.parquet(str(tmp_path / "db"))
    edges = graph.keyed_edges(db)
    assert plan(edges).count("FileScan") == 1
    got = {(r.type, r.label, r.reaction, r.key, r.out) for r in edges.collect()}
    want = {("HAS_PRODUCT", "Molecule", r, m, True) for r, m in (("r1", "A"), ("r1", "B"), ("r2", "C"))} | {("IS_REACTANT_OF", "Molecule", r, m, False) for r, m in (("r1", "C"), ("r2", "A"), ("r2", "B"))}
    want |= {("USES_SOLVENT", "Solvent", r, "THF", True) for r in ("r1", "r2")} | {("REPORTS", "Reference", r, "ref", False) for r in ("r1", "r2")}
    assert got == want and edges.count() == len(want)
    nodes, hashed = graph.nodes_and_edges(db)
    names = {r.id: (r.label, r.key) for r in nodes.collect()}
    assert {(names[r.src][1], names[r.dst][1], r.type) for r in hashed.collect()} == {(a, b, t) if out else (b, a, t) for t, _, a, b, out in want} and ("Reaction", "r3") in names.values()


def test_pairs_come_once_without_a_shuffle_of_pairs(spark):
    rng = random.Random(4)
    made, used = ({(rng.randrange(30), rng.randrange(12)) for _ in range(90)} for _ in range(2))
    rows = [(r, m, "HAS_PRODUCT") for r, m in made] + [(m, r, "IS_REACTANT_OF") for r, m in used]
    edges = spark.createDataFrame([*rows, *rows[:5], (None, 3, "HAS_PRODUCT"), (3, None, "IS_REACTANT_OF")], "src int, dst int, type string")
    got = graph.precedes(edges)
    want = sorted({(a, b) for a, m in made for b, n in used if m == n and a != b})
    assert sorted((r.src, r.dst) for r in got.collect()) == want and len(want) > 100
    assert "keys=[src#" not in plan(got).split("Join")[0]  # nothing is grouped above the join
