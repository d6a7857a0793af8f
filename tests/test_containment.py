"""Pieces against comparing every two names, and plans without nested loops."""

import random

from crucible.operators import containment, lookups, metrics, rollup
from crucible import schemas
from crucible.sources import writers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_equal_to_every_two(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abé") for _ in range(n))
    names = [word(rng.randint(0, 7)) for _ in range(60)] + [None, ""]
    parts = [word(rng.randint(0, 4)) for _ in range(25)] + [None]
    a, b = spark.createDataFrame([(x,) for x in names], "w string"), spark.createDataFrame([(x,) for x in parts], "p string")
    both = {(x, y) for x in names for y in parts if x is not None and y is not None}
    assert {tuple(r) for r in containment.holding(a, "w", b, "p").collect()} == {(x, y) for x, y in both if y in x}
    assert {tuple(r) for r in containment.beginning(a, "w", b, "p").collect()} == {(x, y) for x, y in both if x.startswith(y)}
    none = b.where("p = 'none'")
    assert containment.holding(a, "w", none, "p").count() == containment.beginning(a, "w", none, "p").count() == 0


def test_plans_have_no_nested_loops(spark):
    runs = spark.createDataFrame([("GPT-x-mini", 1), ("other", 2), ("claim", 3), (None, 4)], "model string, n int")
    prices = spark.createDataFrame([("gpt-x", 1.0, 2.0, 1), ("gpt-x-mini-2", 3.0, 4.0, 0), ("claim", 5.0, 6.0, 2), ("cl", 7.0, 8.0, 0)], "model string, input_per_m double, output_per_m double, ord int")
    joined = rollup.price_join(runs, prices)
    assert {r.n: r.priced_as for r in joined.collect()} == {1: "gpt-x-mini-2", 2: None, 3: "claim", 4: None}
    series = spark.createDataFrame([(1990, "abc", 1.0), (1991, "b", 2.0)], "year int, series string, value double")
    yearly = lookups.trend(series, spark.createDataFrame([("a", "x"), ("ab", "y"), ("b", "x")], "prefix string, category string"))
    assert {tuple(r) for r in yearly.collect()} == {(1990, "x", 1.0), (1990, "y", 1.0), (1991, "x", 2.0)}
    for df in (joined, yearly):
        assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


def test_matches_on_one_side(spark):
    kind = "g string, reactants array<string>, products array<string>"
    pred = spark.createDataFrame([("x", ["A", "B"], ["C"]), ("x", ["B", "A", "A"], ["D"]), ("x", ["Q"], ["D"])], kind)
    gold = spark.createDataFrame([("x", ["A", "B"], ["D"]), ("x", ["Z"], ["D"])], kind)
    assert metrics.side_match(pred, gold, ["g"], "reactants").first().matched == 1
    assert metrics.side_match(pred, gold, ["g"], "products").first().matched == 2


def test_fixed_columns_of_tables(spark, tmp_path):
    """Both written tables have their columns in their order, whatever the input has."""
    df = spark.createDataFrame([("n", "e", 1)], "NAME string, ENTRY_ID string, other int")
    writers.write_enriched_csv(df, str(tmp_path / "e"))
    got = spark.read.csv(str(tmp_path / "e"), header=True)
    assert got.columns == list(schemas.ENRICHED_COLUMNS) and len(got.columns) == len(set(got.columns)) == 32
    assert got.first().asDict() == {c: {"NAME": "n", "ENTRY_ID": "e"}.get(c) for c in got.columns}
    writers.write_flat_csv(spark.createDataFrame([("a", ["x", "y"])], "source_image string, reactants array<string>"), str(tmp_path / "f"))
    flat = spark.read.csv(str(tmp_path / "f"), header=True)
    assert flat.columns == list(schemas.FLAT_COLUMNS) and len(flat.columns) == 16 and flat.first().reactants == "x|y"
