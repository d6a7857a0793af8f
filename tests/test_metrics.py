"""Hand-worked expectations on small records."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crucible.functions import classes, molecules, similarity, text
from crucible.operators import assign, boxes, hazards, metrics, ranking, reactiondb, reshape, rollup, splits, tiers
from crucible.operators.enrich import enrich
from crucible.schemas import EXTRACTION, RECORD, kind

REACTION = "stem string, idx int, reactants array<string>, products array<string>, conditions array<struct<role: string, text: string, smiles: string>>"


@pytest.fixture(scope="module")
def m1(spark):
    gold = [("f", 0, ["CCO", "CC(=O)O"], ["CCOC(C)=O"], [("solvent", "toluene", "Cc1ccccc1"), ("temperature", "50 °C", None)]), ("f", 1, ["CCBr", "N"], ["CCN"], [])]
    pred = [("f", 0, ["CCO", "CC(=O)O"], ["CCOC(C)=O"], [("solvent", "Toluene", "Cc1ccccc1"), ("temperature", "50  °C", None)]), ("f", 1, ["CCBr"], ["CCN"], []), ("f", 2, ["C"], ["CO"], [])]
    return spark.createDataFrame(pred, REACTION), spark.createDataFrame(gold, REACTION)


def close(got, **want):
    for k, v in want.items():
        assert got[k] == pytest.approx(v), (k, got[k])


def test_sets(m1):
    p, g = m1
    side = lambda df, c: df.select("stem", F.explode(c).alias("v"))
    close(metrics.set_overlap(side(p, "reactants"), side(g, "reactants"), ["stem"], "v").first(), iou=3 / 5)
    close(metrics.set_overlap(side(p, "products"), side(g, "products"), ["stem"], "v").first(), iou=2 / 3)


def test_matches(m1):
    p, g = m1
    close(metrics.soft_match(p, g, ["stem"]).first(), matched=1, precision=1 / 3, recall=1 / 2, f1=0.4)
    close(metrics.hard_match(p, g, ["stem"]).first(), matched=1, strict=1, lenient=0, skipped_cond_check=1, f1=0.4)
    close(metrics.constitution_match(p, g, ["stem"]).first(), matched=1)
    close(metrics.partial_match(p, g, ["stem"]).first(), matched=2, precision=2 / 3, recall=1, f1=0.8, mean_jaccard=5 / 6)


def test_conditions(m1):
    each = lambda df: df.select("stem", F.posexplode("conditions").alias("idx", "c")).select("stem", "idx", "c.*")
    p, g = (each(df) for df in m1)
    close(metrics.condition_coverage(p, g, ["stem"]).first(), recall=1, precision=1)
    bucket = lambda df: df.withColumn("bucket", reshape.bucket_role("role"))
    close(metrics.lenient_coverage(bucket(p), bucket(g), ["stem"]).first(), matched=2, f1=1)


def test_image_score(spark, m1):
    shape = "stem string, idx int, reactants array<string>, products array<struct<smiles: string, yield_pct: double>>"
    give = lambda df, ys: spark.createDataFrame([(r.stem, r.idx, r.reactants, [(s, y) for s in r.products]) for r, y in zip(df.orderBy("idx").collect(), ys, strict=True)], shape)
    close(metrics.image_score(give(m1[0], [82.5, 10.0, None]), give(m1[1], [82.0, 11.0]), ["stem"]).first(), matched_reactions=2, gold_reactions=2, matched_products=2, gold_products=2, predicted_products=3, yield_pairs=2, yield_correct=1)


def test_empty_sides(spark, m1):
    none = m1[0].limit(0)
    close(metrics.soft_match(none, m1[1], ["stem"]).first(), f1=0, n_pred=0, n_gold=2)
    bare = spark.createDataFrame([("f", 0, [], [], [])], REACTION)
    close(metrics.soft_match(bare, bare, ["stem"]).first(), matched=1)
    close(metrics.partial_match(bare, bare, ["stem"]).first(), matched=1, mean_jaccard=1)


def test_pair_manifest(spark):
    manifest, pred = spark.createDataFrame([("a",), ("b",)], "stem string"), spark.createDataFrame([("a", ["x"])], "stem string, reactions array<string>")
    assert {(r.stem, tuple(r.reactions), r.predicted) for r in rollup.pair_manifest(manifest, pred, "stem").collect()} == {("a", ("x",), True), ("b", (), False)}
    assert rollup.pair_manifest(manifest, pred, "stem", "skip").count() == 1


def test_swapping_sides_keeps_f1_and_soft_bounds_hard(spark):
    rng = random.Random(3)
    make = lambda n: spark.createDataFrame([("f", k, rng.sample("ABCD", rng.randint(1, 2)), rng.sample("XY", 1), [("solvent", rng.choice("pq"), None)] if rng.random() < 0.6 else []) for k in range(n)], REACTION)
    a, b = make(14), make(11)
    for f in (metrics.soft_match, metrics.partial_match):
        assert f(a, b, ["stem"]).first()["f1"] == pytest.approx(f(b, a, ["stem"]).first()["f1"])
    assert metrics.hard_match(a, b, ["stem"]).first()["matched"] <= metrics.soft_match(a, b, ["stem"]).first()["matched"] <= 11


def test_hungarian_against_brute_force(spark):
    rng = np.random.default_rng(4)
    for _ in range(40):
        n, m = sorted(rng.integers(1, 6, 2).tolist())
        cost = rng.integers(0, 9, (n, m)).astype(float)
        best = min(sum(cost[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(m), n))
        assert sum(cost[i, c] for i, c in enumerate(assign.hungarian(cost))) == best


def test_assignment_is_one_to_one_and_optimal_beats_greedy(spark):
    rng = random.Random(5)
    rows = [(g, i, j, rng.random()) for g in "ab" for i in range(6) for j in range(5) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "g string, i int, j int, s double")
    best, greedy = (assign.assign(df, ["g"], "i", "j", "s", optimal=o).toPandas() for o in (True, False))
    for out in (best, greedy):
        assert not out.duplicated(["g", "i"]).any() and not out.duplicated(["g", "j"]).any()
    assert (best.groupby("g").score.sum() >= greedy.groupby("g").score.sum() - 1e-9).all()


@pytest.mark.parametrize(("given", "want"), [("71% yield, 14:1 dr, 91% ee", [("yield", "71% yield"), ("yield", "91%"), ("ee", "91% ee"), ("dr", "14:1 dr"), ("reagent", "ee")]), ("", []), ("toluene", [("reagent", "toluene")])])
def test_split_conditions(spark, given, want):
    got = spark.createDataFrame([(given,)], "t string").select(text.split_conditions("t").alias("c")).first().c
    assert [(x.role, x.text) for x in got] == want


def test_text(spark):
    df = spark.createDataFrame([("Pd(OAc)2 (5 mol %)", "0.13", "trace", "a  B ")], "a string, b string, c string, d string")
    r = df.select(text.lenient_text("a").alias("a"), text.percent_text("b").alias("b"), text.percent_text("c").alias("c"), text.condition_text("d").alias("d"), text.percent_text(F.lit("1")).alias("e"), text.percent_text(F.lit("87")).alias("f"), text.yield_percent(F.lit("x 87.5 %")).alias("g"), text.path_stem(F.lit("/a/b.c.json")).alias("h"), text.slug(F.lit(" a b/c ")).alias("i")).first()
    assert tuple(r) == ("pd oac 2 5 mol%", "13%", "trace", "a b", "100%", "87%", 87.5, "b.c", "a_b_c")


def test_similarities(spark):
    df = spark.createDataFrame([([1, 0, 1, 1], [1, 1, 1, 0])], "a array<int>, b array<int>")
    r = df.select(*[similarity.similarity("a", "b", m).alias(m) for m in (*similarity.METRICS, "hamming")]).first()
    close(r, jaccard=0.5, dice=2 / 3, cosine=2 / 3, manhattan=-1, hamming=2, sokal_michener=0.5, russell_rao=0.5, chebyshev=0, rogers_tanimoto=1 / 3, kulczynski1=1)
    with pytest.raises(ValueError, match="unknown"):
        similarity.similarity("a", "b", "nope")


def test_molecules(spark):
    r = spark.range(1).select(molecules.atom_counts(F.lit("C[13CH2]c1ncBrCl[NH3+]")).alias("a"), molecules.balance(F.lit("CCBr.N>>CCN")).alias("b"), molecules.lexically_valid(F.lit("CC(")).alias("c"), molecules.canon(F.lit(" [12*]CC ")).alias("d"), molecules.pattern_arity(F.lit("A.B>>C")).alias("e"), molecules.canon(F.lit("None")).alias("f")).first()
    assert r.a == {"C": 4, "N": 2, "Br": 1, "Cl": 1} and r.b == {"Br": -1} and r.c is False and r.d == "*CC" and tuple(r.e) == (2, 1) and r.f is None


def test_classes(spark):
    r = spark.range(1).select(classes.ancestors(F.lit("1.2.3")).alias("a"), classes.parent(F.lit("1")).alias("b"), classes.shared_depth(F.lit("1.2.3"), F.lit("1.2.7.1")).alias("c"), classes.at_tier(F.lit("1.2"), 3).alias("d"), classes.is_below(F.lit("1.2"), F.lit("1")).alias("e")).first()
    assert tuple(r) == (["1", "1.2"], None, 2, None, True)


def test_pareto_minmax_costs(spark):
    rows = spark.createDataFrame([("g", 10, 0.5), ("g", 20, 0.4), ("g", 30, 0.6)], "g string, t int, q double")
    assert sorted(r.t for r in ranking.pareto(rows, ["g"], "t", "q", "t").collect()) == [10, 30]
    df = spark.createDataFrame([(1, 1.0, 2.0, None), (2, 3.0, 2.0, None), (3, 2.0, None, None)], "k int, a double, b double, c double")
    got = {(r.k, r.metric): r.scaled for r in ranking.minmax(df, ["k"], ["a", "b", "c"]).collect()}
    assert [got[k, "a"] for k in (1, 2, 3)] == [0, 1, 0.5] and [got[k, "b"] for k in (1, 2, 3)] == [1, 1, None] and got[1, "c"] == 0
    runs = spark.createDataFrame([("GPT-5-mini-x", 1_000_000, 500_000, 1, 2), ("none", 1, 1, 1, 1)], "model string, input_tokens long, output_tokens long, ok int, total int")
    points, skipped = rollup.cost_points(runs, spark.createDataFrame([("gpt-5-mini", 2.0, 10.0, 1)], "model string, input_per_m double, output_per_m double, ord int"))
    assert points.first().cost == 7.0 and points.first().coverage == "(1/2)" and skipped.count() == 1


def test_topn_and_false_positives(spark):
    rows = spark.createDataFrame([("c", "A")] * 6 + [("c", "B")] * 3 + [("c", "C")], "class string, t string")
    assert tiers.topn_coverage(rows, ["class"], "t", 2).first().coverage == pytest.approx(0.9)
    truth = spark.createDataFrame([(1, "1.2.7"), (2, "2.1"), (3, "1.2.3.4")], "reaction_id int, true_class string")
    pairs = tiers.fp_pairs(truth.select(F.lit("1.2.3").alias("pattern_class"), "reaction_id"), truth)
    assert {(r.category, r.tier1): r.weight for r in tiers.categorize_fps(pairs).collect()} == {("same_tier2", None): 1, ("cross_tier1", None): 1, ("same_tier2", "1"): 1, ("cross_tier1", "1"): 1}
    assert tiers.order_stats(pairs.limit(0), tiers.precedence(pairs)).first().share == 1


def test_hazards(spark):
    rows = spark.createDataFrame([(["H350"], None, None, 100.0, 0, 0)], "codes array<string>, FP double, AIT double, ExpBP double, peroxide int, resistivity int")
    r = hazards.ehs_scores(rows).first()
    assert (r.health_score, r.corrected_health_score, r.bp_score, r.env_score, r.ranking) == (9, 10, 3, 3, "hazardous")


def test_boxes(spark):
    shape = "image int, idx int, x1 double, y1 double, x2 double, y2 double, category int"
    a = spark.createDataFrame([(1, 0, 0.0, 0.0, 2.0, 2.0, 1), (1, 1, 5.0, 5.0, 6.0, 6.0, 1), (1, 2, 0.0, 0.0, 2.0, 1.9, 1)], shape)
    b = spark.createDataFrame([(1, 0, 0.0, 0.0, 2.0, 2.2, 1), (1, 1, 2.0, 0.0, 3.0, 2.0, 1)], shape)
    assert {(r.idx, r.matched) for r in boxes.match_boxes(a, b).collect()} == {(0, 0), (1, -1), (2, 0)}
    assert sorted(r.idx for r in boxes.dedupe_boxes(a, 0.9).collect()) == [0, 1] == sorted(r.idx for r in boxes.dedupe_kept(a, ["image"]).collect())
    assert boxes.detection_ap(b, a.withColumn("score", 1.0 / (1 + F.col("idx")))).first().ap == pytest.approx(0.5)
    reaction = lambda r, p: spark.createDataFrame([(1, 0, r, [], p, 1, "k")], "image int, idx int, reactants array<int>, conditions array<int>, products array<int>, size int, kind string")
    gold, pred = boxes.box_reaction_match(reaction([0], []), reaction([0], []), b, a)
    moved, _ = boxes.box_reaction_match(reaction([0], []), reaction([], [0]), b, a)
    assert not moved.first().hit
    assert gold.first().hit and pred.first().hit and boxes.box_scores(gold, pred).where("size IS NULL AND kind IS NULL").first().f1 == 1


def test_reshape(spark):
    figure = {"reactions": [{"entry_id": "e1", "title": "t", "reactants": [{"label": "1a", "smiles": "CC"}], "reagents": [{"name": "Pd", "role": "cat", "loading": "5%"}], "conditions": {"solvent": "THF"}, "products": []}, {"entry_id": "e2", "reactants": [], "reagents": [], "conditions": {}, "products": [{"smiles": "C", "yield_pct": 87.0}, {"smiles": "CO"}]}]}

    def fill(t, v):
        name = type(t).__name__
        if name == "StructType":
            return tuple(fill(f.dataType, (v or {}).get(f.name)) for f in t)
        return [fill(t.elementType, x) for x in v] if name == "ArrayType" and v is not None else v

    df = spark.createDataFrame([fill(EXTRACTION, figure)], EXTRACTION).withColumn("stem", F.lit("fig"))
    flat = reshape.flatten_products(df).orderBy("entry_id", "product_smiles").collect()
    assert [(r.entry_id, r.product_smiles) for r in flat] == [("e1", ""), ("e2", "C"), ("e2", "CO")] and flat[0].reactants == "1a: CC" and flat[0].reagents == "Pd (5%, cat)"
    record = reshape.to_record(df)
    rows = reshape.explode_reactions(record, "stem").orderBy("idx").collect()
    assert rows[0].reaction_id == "0_1" and [(c.role, c.text) for c in rows[0].conditions] == [("reagent", "Pd"), ("solvent", "THF")]
    assert [(c.role, c.text) for c in rows[1].conditions] == [("yield", "87 %")] and rows[1].products == ["C", "CO"]
    full = record.select(F.lit("f.json").alias("file_name"), F.lit(None).cast("string").alias("slice"), F.lit(None).cast(RECORD["reaction_template"].dataType).alias("reaction_template"), F.col("reactions").cast(RECORD["reactions"].dataType).alias("reactions"))
    assert metrics.conformance(full).first().valid and reshape.normalise_record(full).count() == 1
    lone, molecules_ = reshape.reaction_rows(reshape.explode_reactions(record, "stem"), "stem")
    assert lone.count() == 0 and sorted(r.molecule for r in molecules_.collect()) == ["C", "CC", "CO"]


def test_info_and_variants(spark):
    df = spark.createDataFrame([('["a", {"text": "b"}, null]',)], "j string")
    assert df.select(reshape.info_text("j").alias("x")).first().x == ["a", "b"]
    v = spark.createDataFrame([("f", {"b": (["2"], []), "a": (["1"], ["x"])})], "file_name string, detailed_reactions map<string, struct<reactants: array<string>, products: array<string>>>")
    assert [(r.reaction_id, r.variant) for r in reshape.explode_variants(v).orderBy("reaction_id").collect()] == [("0_1", "a"), ("1_1", "b")]


def test_tabular_gold(spark):
    columns = "file_name reaction_id label rec_1 rec_2 pro_1 pro_2 cat_1 cat_2 catalyst_text solvent temperature yield ee dr er".split()
    rows = spark.createDataFrame([(1, *["f", "", "L2", "CC", None, "CO", "None", None, None, None, "THF", "25", "0.5", None, None, None]), (0, *["f", "7_1", None, "C", "N", "CN", None, "Pd", None, "cat A", None, None, "99", "0.9", "3:1", None])], "row_no long, " + ", ".join(f"`{c}` string" for c in columns))
    r = reshape.rows_to_records(rows).first().reactions
    assert [x.reaction_id for x in r] == ["7_1", "1_1"] and [(c.role, c.text, c.smiles) for c in r[0].conditions] == [("catalyst", "cat A", "Pd"), ("yield", "99%", None), ("ee", "90%", None), ("dr", "3:1", None)] and [(c.role, c.text) for c in r[1].conditions] == [("solvent", "THF"), ("temperature", "25"), ("yield", "50%")]


def test_failure_modes_and_issues(spark):
    pairs = spark.createDataFrame([("CC", None), (None, "C"), ("CC", "C("), ("CC", "CC"), ("C[C@H](O)N", "C[C@@H](O)N"), ("CCO", "CCCO"), ("Cc1ccccc1O", "Oc1cccc(C)c1"), ("CCO", "COC"), ("CCO", "CCN")], "gold string, pred string")
    assert [r.failure for r in metrics.failure_modes(pairs).collect()] == ["missing", "hallucinated", "schema_failure", "match", "stereo_error", "methylene_shift", "substituent_position", "connectivity_misread", "other"]
    rows = spark.createDataFrame([("f", 0, ["CCO"], ["CCN"], []), ("f", 1, ["CC", "*"], ["CCN"], []), ("f", 2, [], ["C("], [])], REACTION)
    assert [r.issues for r in metrics.reaction_issues(rows).orderBy("idx").collect()] == [["gained N"], [], ["no reactants", "unparseable"]]


def test_enrich_keeps_failures_as_rows(spark):
    df = spark.createDataFrame([(1,), (0,)], "n int")
    ok, skipped = enrich(df, lambda r: {"inverse": 1 / r["n"]}, kind("struct<inverse: double>"))
    assert ok.first().inverse == 1 and "ZeroDivisionError" in skipped.first().error


def test_splits(spark):
    df = spark.range(400).withColumn("label", F.when(F.col("id") < 3, "rare").otherwise((F.col("id") % 3).cast("string")))
    out = splits.stratified(df, "id", "label").toPandas()
    assert not out[out.label == "rare"].test.any() and 0.15 < out.test.mean() < 0.25
    groups = splits.cold(df, "label").toPandas()
    assert (groups.groupby("label").test.nunique() == 1).all() and groups.test.any()
    assert sorted(r.id for r in splits.sample(df, "id", 9).collect()) == sorted(r.id for r in splits.sample(df.repartition(7), "id", 9).collect())


def test_conditions_and_mixtures(spark):
    near = spark.createDataFrame([("q", 0.6, "THF"), ("q", 0.2, "unknown"), ("q", 0.2, "DCM")], "q string, score double, SOLVENT string")
    got = {r.name: (round(r.share, 6), round(r.renormalised, 6)) for r in reactiondb.score_conditions(near, ["q"], ("SOLVENT",)).collect()}
    assert got == {"THF": (0.6, 0.75), "DCM": (0.2, 0.25)}
    guide = spark.createDataFrame([("a", "A", 1), ("b", "B", 3)], "smiles string, name string, severity int")
    mixtures = spark.createDataFrame([(1, "a.b"), (2, "a.z"), (3, ""), (4, "a")], "key int, SOLVENT string")
    assert {r.key: (r.rating, r.names) for r in hazards.rate_mixture(mixtures, guide, "key").collect()} == {1: ("3", "A and B"), 2: ("unknown", "A and z"), 3: ("solvent-free", "solvent-free"), 4: ("1", "A")}


def test_bootstrap_of_one_row_is_null(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.0), ("b", 2, 1.0)], "g string, k int, v double")
    got = {r.g: (r.low, r.high) for r in rollup.bootstrap(df, ["g"], "v", "k", 100).collect()}
    assert got["a"] == (None, None) and got["b"][0] < got["b"][1]




def test_routes_disconnections_and_cns(spark):
    steps = spark.createDataFrame([("p", 0.5, 2, ["a", "b"]), ("p", 1.0, 4, ["a", "b"]), ("q", 1.0, 0, ["z"])], "path string, similarity double, references int, leaves array<string>")
    got = {r.path: r.penalty for r in reactiondb.score_routes(steps, spark.createDataFrame([("a", 7.0)], "molecule string, price double")).collect()}
    assert got == {"p": 20 + 50 + 7 - 9 - 15, "q": 10 + 100 + 100 - 20}
    found = spark.createDataFrame([("r", 0.5, 0.1, 8, "t1", 0), ("r", 0.9, 0.9, 7, "t2", 1), ("s", 0.1, -0.1, 1, "t", 0)], "reaction string, similarity double, accessibility double, references int, template string, ord int")
    r = reactiondb.score_disconnections(found).collect()
    assert [(x.reaction, x.references, x.templates, round(x.score, 6)) for x in r] == [("r", 15, ["t1", "t2"], 22.0)]
    df = spark.createDataFrame([(4.0, 1.0, 430.0, 30.0, 1, 9.0)], "logp double, logd double, mw double, tpsa double, hbd int, pka double")
    assert hazards.cns_score(df, "pka").first().cns == pytest.approx(0.5 + 1 - 0.5 + 0.5 + 0.75 + 0.5)


def test_recommended_tiers(spark):
    """1 splits: 1.1 covers itself, 1.2 has only 1.2.1, which passes on to 1.2.1.1 and 1.2.1.2; 1.3 is too small. 2 gains nothing."""
    rows = [("1.1", f"a{k % 2}") for k in range(20)] + [("1.2.1.1", f"b{k % 2}") for k in range(20)] + [("1.2.1.2", f"c{k % 2}") for k in range(20)] + [("1.3", "d")] * 2
    rows += [(f"2.{k % 2 + 1}", f"e{k // 2}") for k in range(20)]
    table = tiers.tier_table(spark.createDataFrame(rows, "code string, t string"), "code", "t", 4)
    got = {r["class"]: r.decision for r in tiers.recommend_tiers(table, "t", 2).where("recommended").collect()}
    assert got == {"1.1": "enough", "1.2.1.1": "enough", "1.2.1.2": "enough", "2": "whole"}
