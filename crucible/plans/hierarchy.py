"""Class tiers, splits, hazards, boxes, trends and streams, on the driver's tables. A part's class code is region.nation.segment of its customer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crucible.functions import classes
from crucible.operators import boxes, hazards, splits, tiers
from crucible.plans.registry import Tables, big, query, rounded
from crucible.scratch import scratch_path, written
from crucible.streaming import commits, stateful, streams

S = F.col

# --- tiers


def coded(t: Tables) -> DataFrame:
    """Orders with a dotted code of three tiers and a template, their month and status."""
    place = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat_ws(".", F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string"), F.col("c_mktsegment")).alias("code"))
    rows = t.orders.join(place, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("o_orderkey", "code", F.concat_ws("-", "o_orderstatus", F.month("o_orderdate").cast("string")).alias("template"), "o_orderpriority")


CODED = """
WITH c AS (SELECT o_orderkey, n_regionkey || '.' || n_nationkey || '.' || c_mktsegment AS code, CAST(n_regionkey AS VARCHAR) AS t1, n_regionkey || '.' || n_nationkey AS t2, o_orderstatus || '-' || month(o_orderdate) AS template, o_orderpriority
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
"""
COUNTS = CODED + "k AS (SELECT t2 AS class, template, count(*) AS c FROM c GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY c DESC, template) AS n FROM k),"


@query(COUNTS + "x AS (SELECT 1) SELECT class, CAST(sum(c) AS BIGINT) AS reactions, count(*) AS templates, round(sum(CASE WHEN n <= 5 THEN c ELSE 0 END) / sum(c), 6) AS coverage FROM r GROUP BY 1")
def topn_coverage(t: Tables) -> DataFrame:
    rows = coded(t).withColumn("class", classes.at_tier("code", 2))
    return rounded(tiers.topn_coverage(rows, ["class"], "template", 5), "coverage").select("class", *big("reactions", "templates"), "coverage")


@query(COUNTS + """s AS (SELECT class, sum(c) AS reactions, sum(CASE WHEN n <= 10 THEN c ELSE 0 END) / sum(c) AS a, sum(CASE WHEN n <= 20 THEN c ELSE 0 END) / sum(c) AS b, sum(CASE WHEN n <= 40 THEN c ELSE 0 END) / sum(c) AS d FROM r GROUP BY 1)
SELECT class, CAST(reactions AS BIGINT) AS reactions, CAST(CASE WHEN a >= 0.7 THEN 10 WHEN b >= 0.7 THEN 20 ELSE 40 END AS BIGINT) AS n, round(CASE WHEN a >= 0.7 THEN a WHEN b >= 0.7 THEN b ELSE d END, 6) AS coverage FROM s""")
def auto_topn(t: Tables) -> DataFrame:
    rows = coded(t).withColumn("class", classes.at_tier("code", 2))
    return rounded(tiers.auto_topn(rows, ["class"], "template", (10, 20, 40), 0.7), "coverage").select("class", *big("reactions", "n"), "coverage")


GAINS = CODED + """l AS (SELECT 1 AS tier, t1 AS class, NULL AS parent, template FROM c UNION ALL SELECT 2, t2, t1, template FROM c UNION ALL SELECT 3, code, t2, template FROM c),
k AS (SELECT tier, class, parent, template, count(*) AS c FROM l GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY tier, class ORDER BY c DESC, template) AS n FROM k),
v AS (SELECT tier, class, parent, sum(c) AS reactions, sum(CASE WHEN n <= 5 THEN c ELSE 0 END) / sum(c) AS coverage FROM r GROUP BY ALL),
g AS (SELECT p.tier, p.class, p.reactions, p.coverage, count(*) AS children, sum(k.reactions * CASE WHEN k.reactions < 5 THEN p.coverage ELSE k.coverage END) / sum(k.reactions) AS cc FROM v p JOIN v k ON k.parent = p.class GROUP BY ALL),
"""


@query(GAINS + "x AS (SELECT 1) SELECT CAST(tier AS BIGINT) AS tier, class, CAST(reactions AS BIGINT) AS reactions, round(coverage, 6) AS coverage, children, round(cc, 6) AS children_coverage, round(cc - coverage, 6) AS gain FROM g")
def subclass_gain(t: Tables) -> DataFrame:
    out = tiers.subclass_gain(tiers.tier_table(coded(t), "code", "template", 3), "template", 5)
    return rounded(out, "coverage", "children_coverage", "gain").withColumns({c: F.col(c).cast("long") for c in ("tier", "reactions", "children")})


@query(GAINS + """d AS (SELECT v.tier, v.class, v.parent, v.reactions, v.coverage, coalesce(g.children, 0) AS children, cc - v.coverage AS gain FROM v LEFT JOIN g ON v.tier = g.tier AND v.class = g.class),
e3 AS (SELECT *, CASE WHEN coverage >= 0.9 THEN 'enough' ELSE 'deepest' END AS decision FROM d WHERE tier = 3),
e2 AS (SELECT *, CASE WHEN coverage >= 0.9 THEN 'enough' WHEN children = 0 THEN 'leaf' WHEN children = 1 THEN 'single' WHEN gain < 0.05 THEN 'whole' ELSE 'split' END AS decision FROM d WHERE tier = 2),
o AS (SELECT parent, bool_and(decision <> 'split') AS lone FROM e2 GROUP BY 1),
e1 AS (SELECT d.*, CASE WHEN coverage >= 0.9 THEN 'enough' WHEN children = 0 THEN 'leaf' WHEN children = 1 THEN CASE WHEN lone THEN 'single' ELSE 'pass' END WHEN gain < 0.05 THEN 'whole' ELSE 'split' END AS decision FROM d LEFT JOIN o ON o.parent = d.class WHERE tier = 1),
r2 AS (SELECT e2.*, e1.decision IN ('pass', 'split') AND (e1.children = 1 OR e2.reactions >= 5) AS reached FROM e2 JOIN e1 ON e2.parent = e1.class),
r3 AS (SELECT e3.*, r2.reached AND r2.decision = 'split' AND (r2.children = 1 OR e3.reactions >= 5) AS reached FROM e3 JOIN r2 ON e3.parent = r2.class)
SELECT class, decision, decision NOT IN ('pass', 'split') AS recommended FROM e1 UNION ALL SELECT class, decision, reached AND decision <> 'split' FROM r2 UNION ALL SELECT class, decision, reached FROM r3""")
def recommend_tiers(t: Tables) -> DataFrame:
    out = tiers.recommend_tiers(tiers.tier_table(coded(t), "code", "template", 3), "template", 5, max_tier=3)
    return out.select("class", "decision", "recommended")


PAIRED = CODED + "p AS (SELECT a.o_orderkey, a.code AS truth, CASE a.o_orderkey % 5 WHEN 0 THEN a.code WHEN 1 THEN a.t2 WHEN 2 THEN a.code || '.x' WHEN 3 THEN b.code END AS predicted FROM c a JOIN c b ON b.o_orderkey = a.o_orderkey + 1),"


def predicted(t: Tables) -> DataFrame:
    """A code predicted for each order: its own, a tier up, a tier below, the next order's, or none."""
    c = coded(t)
    other = c.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("code").alias("_other"))
    k = F.col("o_orderkey") % 5
    return c.join(other, "o_orderkey").select("o_orderkey", F.col("code").alias("truth"), F.when(k == 0, F.col("code")).when(k == 1, classes.parent("code")).when(k == 2, F.concat("code", F.lit(".x"))).when(k == 3, F.col("_other")).alias("predicted"))


@query(PAIRED + """m AS (SELECT o_orderkey, CASE WHEN predicted IS NULL THEN 'unmatched' WHEN predicted = truth THEN 'exact' WHEN starts_with(truth, predicted || '.') THEN 'ancestor' WHEN starts_with(predicted, truth || '.') THEN 'descendant' ELSE 'mismatch' END AS match_type FROM p)
SELECT o_orderkey, match_type FROM m""")
def match_type(t: Tables) -> DataFrame:
    return tiers.match_type(predicted(t), "predicted", "truth").select("o_orderkey", "match_type")


@query(PAIRED + """f AS (SELECT truth, predicted, count(*) AS weight FROM p WHERE predicted <> truth AND NOT starts_with(truth, predicted || '.') AND NOT starts_with(predicted, truth || '.') GROUP BY ALL),
g AS (SELECT weight, split_part(predicted, '.', 1) AS tier1, CASE WHEN split_part(predicted, '.', 1) <> split_part(truth, '.', 1) THEN 'cross_tier1' WHEN split_part(predicted, '.', 2) <> split_part(truth, '.', 2) THEN 'same_tier1' ELSE 'same_tier2' END AS category FROM f)
SELECT category, tier1, CAST(sum(weight) AS BIGINT) AS weight FROM g GROUP BY GROUPING SETS ((category), (category, tier1))""")
def categorize_fps(t: Tables) -> DataFrame:
    rows = predicted(t).where("predicted IS NOT NULL")
    pairs = tiers.fp_pairs(rows.select(F.col("predicted").alias("pattern_class"), F.col("o_orderkey").alias("reaction_id")), rows.select(F.col("o_orderkey").alias("reaction_id"), F.col("truth").alias("true_class")))
    return tiers.categorize_fps(pairs)


@query(COUNTS + "x AS (SELECT 1) SELECT template, class, c AS count FROM (SELECT *, row_number() OVER (PARTITION BY template ORDER BY c DESC, class) AS m FROM k) WHERE m = 1")
def majority_class(t: Tables) -> DataFrame:
    return tiers.majority_class(coded(t).withColumn("class", classes.at_tier("code", 2)), "template", "class")


@query(CODED + "s AS (SELECT DISTINCT t1 || '.*' AS spec, t1 FROM c), k AS (SELECT DISTINCT t2, t1 FROM c) SELECT spec, t2 AS class FROM s JOIN k USING (t1)")
def expand_classes(t: Tables) -> DataFrame:
    c = coded(t)
    known = c.select(F.col("code").alias("class")).union(c.select(classes.at_tier("code", 2))).union(c.select(classes.at_tier("code", 1))).distinct()
    return tiers.expand_classes(c.select(F.concat(classes.at_tier("code", 1), F.lit(".*")).alias("spec")).distinct(), known)


@query(CODED + "s AS (SELECT DISTINCT t1 || '.**' AS spec, t1 FROM c), k AS (SELECT DISTINCT t2 AS class, t1 FROM c UNION SELECT code, t1 FROM c) SELECT DISTINCT spec, class FROM s JOIN k USING (t1) WHERE class <> t1")
def expand_below(t: Tables) -> DataFrame:
    """All classes below each first tier."""
    c = coded(t)
    known = c.select(F.col("code").alias("class")).union(c.select(classes.at_tier("code", 2))).union(c.select(classes.at_tier("code", 1))).distinct()
    return tiers.expand_classes(c.select(F.concat(classes.at_tier("code", 1), F.lit(".**")).alias("spec")).distinct(), known)


# --- splits: the hash is arithmetic, so SQL repeats it


def hashed(key: str) -> str:
    x = f"(({key} * 48271 + 42 * 7919) % 2147483647)"
    return f"((({x} * {x}) % 2147483647) * 69621 + {key}) % 2147483647"


@query(f"SELECT o_orderkey, {hashed('o_orderkey')} < 429496729 AS test FROM orders")
def splits_random(t: Tables) -> DataFrame:
    return splits.split(t.orders, "o_orderkey", 0.2).select("o_orderkey", "test")


@query(f"SELECT o_orderkey FROM orders ORDER BY {hashed('o_orderkey')}, o_orderkey LIMIT 100")
def splits_sample(t: Tables) -> DataFrame:
    return splits.sample(t.orders, "o_orderkey", 100).select("o_orderkey")


RANKED = f"SELECT c_custkey, c_nationkey, count(*) OVER (PARTITION BY c_nationkey) AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY {hashed('c_custkey')}, c_custkey) AS r FROM customer"


@query(f"SELECT c_custkey, n * 0.2 >= 1 AND r <= floor(n * 0.2) AS test FROM ({RANKED})")
def splits_stratified(t: Tables) -> DataFrame:
    return splits.stratified(t.customer, "c_custkey", "c_nationkey").select("c_custkey", "test")


@query(f"SELECT c_custkey, r <= greatest(1, floor(n * 0.2)) AS test FROM ({RANKED}) WHERE n >= 5")
def splits_per_class(t: Tables) -> DataFrame:
    return splits.per_class(t.customer, "c_custkey", "c_nationkey").select("c_custkey", "test")


@query(f"WITH g AS (SELECT c_nationkey, row_number() OVER (ORDER BY {hashed('k')}, k) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT c_nationkey, CAST(c_nationkey AS BIGINT) AS k FROM customer)) SELECT c_custkey, c_nationkey, r <= greatest(1, floor(n * 0.2)) AS test FROM customer JOIN g USING (c_nationkey)")
def splits_cold(t: Tables) -> DataFrame:
    """Whole nations held out."""
    return splits.cold(t.customer, "c_nationkey").select("c_custkey", "c_nationkey", "test")


@query(f"""WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey, o_orderpriority AS source, CASE WHEN n <= 2 THEN 0 WHEN n <= 8 THEN 1 ELSE 2 END AS tier FROM orders JOIN c ON o_orderkey = l_orderkey),
r AS (SELECT *, row_number() OVER (PARTITION BY source, tier ORDER BY {hashed('o_orderkey')}, o_orderkey) AS r FROM o), s AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY r, tier) AS n FROM r)
SELECT o_orderkey, source FROM s WHERE n <= CASE source WHEN '1-URGENT' THEN 30 WHEN '2-HIGH' THEN 10 ELSE 0 END""")
def quota_subset(t: Tables) -> DataFrame:
    rows = t.orders.join(t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n")), "o_orderkey").select("o_orderkey", F.col("o_orderpriority").alias("source"), "n")
    return splits.quota_subset(rows, "o_orderkey", "source", "n", {"1-URGENT": 3, "2-HIGH": 1}, 40).select("o_orderkey", "source")


# --- hazards: part sizes and prices stand in for measured properties


@query("""
WITH s AS (SELECT p_partkey AS key, CASE WHEN p_size % 3 = 0 THEN ['H350', 'H411'] WHEN p_size % 3 = 1 THEN ['H315'] ELSE ['H412', 'H301'] END AS codes, p_size * 5.0 AS bp, p_size * 2.0 - 30 AS fp, p_retailprice - 800 AS ait FROM part),
a AS (SELECT key, CASE WHEN list_contains(codes, 'H350') THEN 9 WHEN list_contains(codes, 'H301') THEN 6 ELSE 2 END AS health, CASE WHEN list_contains(codes, 'H411') THEN 7 WHEN list_contains(codes, 'H412') THEN 5 ELSE 3 END AS env, bp,
  CASE WHEN bp < 50 THEN 7 WHEN bp < 70 THEN 5 WHEN bp < 140 THEN 3 WHEN bp < 200 THEN 5 ELSE 7 END AS bps, CASE WHEN fp < -20 THEN 7 WHEN fp < 0 THEN 5 WHEN fp < 24 THEN 4 WHEN fp < 60 THEN 3 ELSE 1 END + CASE WHEN ait <= 200 THEN 1 ELSE 0 END AS safety FROM s),
b AS (SELECT *, health + CASE WHEN bp >= 85 THEN 1 ELSE 0 END AS ch, greatest(env, bps) AS ce FROM a),
c AS (SELECT *, greatest(safety, ch, ce) AS top, CASE WHEN safety >= 7 THEN 1 ELSE 0 END + CASE WHEN ch >= 7 THEN 1 ELSE 0 END + CASE WHEN ce >= 7 THEN 1 ELSE 0 END AS high, CASE WHEN safety BETWEEN 4 AND 6 THEN 1 ELSE 0 END + CASE WHEN ch BETWEEN 4 AND 6 THEN 1 ELSE 0 END + CASE WHEN ce BETWEEN 4 AND 6 THEN 1 ELSE 0 END AS mid FROM b)
SELECT key, CAST(safety AS BIGINT) AS safety, CAST(ch AS BIGINT) AS health, CAST(ce AS BIGINT) AS env, CASE WHEN top >= 8 OR high > 1 THEN 'hazardous' WHEN top = 7 OR mid > 1 THEN 'problematic' ELSE 'recommended' END AS ranking FROM c""")
def ehs_scores(t: Tables) -> DataFrame:
    k = F.col("p_size") % 3
    rows = t.part.select(F.col("p_partkey").alias("key"), F.when(k == 0, F.array(F.lit("H350"), F.lit("H411"))).when(k == 1, F.array(F.lit("H315"))).otherwise(F.array(F.lit("H412"), F.lit("H301"))).alias("codes"), (F.col("p_size") * 5.0).alias("ExpBP"), (F.col("p_size") * 2.0 - 30).alias("FP"), (F.col("p_retailprice") - 800).alias("AIT"), F.lit(0).alias("peroxide"), F.lit(0).alias("resistivity"))
    return hazards.ehs_scores(rows).select("key", F.col("safety_score").cast("long").alias("safety"), F.col("corrected_health_score").cast("long").alias("health"), F.col("corrected_env_score").cast("long").alias("env"), "ranking")


@query("""WITH m AS (SELECT p_partkey AS key, unnest(string_split(p_name, ' ')) AS s FROM part), d AS (SELECT DISTINCT key, s FROM m WHERE s <> ''), g AS (SELECT key, s, CASE WHEN length(s) < 6 THEN length(s) END AS v FROM d),
w AS (SELECT key, max(v) AS v, bool_or(v IS NULL) AS u FROM g GROUP BY 1) SELECT p_partkey AS key, CASE WHEN u IS NULL THEN 'solvent-free' WHEN u THEN 'unknown' ELSE CAST(v AS VARCHAR) END AS rating FROM part LEFT JOIN w ON p_partkey = key""")
def rate_mixture(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_partkey").alias("key"), F.replace("p_name", F.lit(" "), F.lit(".")).alias("SOLVENT"))
    guide = rows.select(F.explode(F.split("SOLVENT", r"\.")).alias("smiles")).where("length(smiles) BETWEEN 1 AND 5").distinct().select("smiles", F.col("smiles").alias("name"), F.length("smiles").alias("severity"))
    return hazards.rate_mixture(rows, guide, "key").select("key", "rating")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST((l_quantity * 20 > 500)::INT + (l_linenumber > 5)::INT + (l_suppkey > 5)::INT + (l_partkey > 10)::INT AS BIGINT) AS lipinski, CAST((l_linenumber > 5.88)::INT + (l_quantity * 4 > 131.6)::INT AS BIGINT) AS egan,
  CAST((l_suppkey > 10)::INT + (l_quantity * 4 > 140)::INT AS BIGINT) AS veber FROM lineitem""")
def druglike(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") * 20).alias("mw"), F.col("l_linenumber").alias("logp"), F.col("l_suppkey").alias("hbd"), F.col("l_partkey").alias("hba"), (F.col("l_quantity") * 4).alias("tpsa"), F.col("l_suppkey").alias("rotatable"), *[F.lit(5).alias(c) for c in ("rings", "atoms", "carbons", "hetero", "refractivity")])
    return hazards.druglike_counts(rows).select("l_orderkey", "l_linenumber", "l_partkey", *big("lipinski", "egan", "veber"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'P' AS w, o_orderpriority = '1-URGENT' AS t FROM orders),
v AS (SELECT *, bool_and(w) OVER p AS generic, bool_or(NOT t AND NOT w) OVER p AS concrete FROM r WINDOW p AS (PARTITION BY o_custkey))
SELECT o_orderkey, CASE WHEN generic THEN 'DROP_GENERIC' WHEN t AND concrete THEN 'DROP_TEMPLATE_PARENT' WHEN w THEN 'KEEP_PARTIAL' ELSE 'KEEP_FULL' END AS decision FROM v""")
def inclusion(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "P").alias("wildcard"), F.when(F.col("o_orderpriority") == "1-URGENT", "a_template").otherwise("a").alias("reaction_id"))
    return hazards.inclusion(rows, ["o_custkey"]).select("o_orderkey", "decision")


# --- boxes: a line's quantity and number place it on its order


def line_boxes(t: Tables) -> DataFrame:
    """Of lines with one image and number the table's first stays, by file and row: that is what DISTINCT ON takes in the order of the table."""
    line = t.lineitem.select("*", S("_metadata.file_path").alias("_file"), S("_metadata.row_index").alias("_row"))
    box = F.struct(S("l_quantity").alias("x1"), S("l_linenumber").cast("double").alias("y1"), (S("l_quantity") + 5 + 100 * S("l_discount")).alias("x2"), (S("l_linenumber") + 1 + 10 * S("l_tax")).alias("y2"), F.lit(1).alias("category"), "l_returnflag")
    idx = (S("l_linenumber").cast("long") * 100_000 + S("l_partkey")).alias("idx")
    return line.groupBy(S("l_orderkey").alias("image"), idx).agg(F.min_by(box, F.struct("_file", "_row")).alias("_box")).select("image", "idx", "_box.*")


BOXES = """
WITH b AS (SELECT DISTINCT ON (l_orderkey, l_linenumber * 100000 + l_partkey) l_orderkey AS image, CAST(l_linenumber * 100000 + l_partkey AS BIGINT) AS idx, l_quantity AS x1, CAST(l_linenumber AS DOUBLE) AS y1, l_quantity + 5 + 100 * l_discount AS x2, l_linenumber + 1 + 10 * l_tax AS y2, l_returnflag AS f FROM lineitem),
o AS (SELECT a.image, a.idx AS ai, c.idx AS ci, a.f AS af, c.f AS cf, greatest(least(a.x2, c.x2) - greatest(a.x1, c.x1), 0) * greatest(least(a.y2, c.y2) - greatest(a.y1, c.y1), 0) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) AS s, (c.x2 - c.x1) * (c.y2 - c.y1) AS r
  FROM b a JOIN b c ON a.image = c.image AND a.x1 < c.x2 AND c.x1 < a.x2 AND a.y1 < c.y2 AND c.y1 < a.y2),
"""


@query(BOXES + """m AS (SELECT image, ai AS idx, ci, i / (s + r - i) AS iou, row_number() OVER (PARTITION BY image, ai ORDER BY i / (s + r - i) DESC, ci) AS n FROM o WHERE af = 'R' AND cf <> 'R')
SELECT b.image, b.idx, CASE WHEN iou >= 0.2 THEN ci ELSE -1 END AS matched, round(coalesce(iou, 0), 6) AS iou FROM b LEFT JOIN m ON b.image = m.image AND b.idx = m.idx AND n = 1 WHERE f = 'R'""")
def match_boxes(t: Tables) -> DataFrame:
    b = line_boxes(t)
    return rounded(boxes.match_boxes(b.where("l_returnflag = 'R'"), b.where("l_returnflag <> 'R'"), 0.2), "iou").withColumn("matched", F.col("matched").cast("long"))


@query(BOXES + "d AS (SELECT DISTINCT image, ai AS idx FROM o WHERE ci < ai AND i / (s + r - i) > 0.3) SELECT image, idx FROM b ANTI JOIN d USING (image, idx)")
def dedupe_boxes(t: Tables) -> DataFrame:
    return boxes.dedupe_boxes(line_boxes(t), 0.3).select("image", "idx")


@query(BOXES + """g AS (SELECT * FROM b WHERE f <> 'N'), p AS (SELECT * FROM b WHERE f <> 'A'), c AS (SELECT image, ai, ci, i / (s + r - i) AS iou FROM (SELECT * FROM o WHERE af <> 'A' AND cf <> 'N')),
m AS (SELECT image, ai, CASE WHEN iou >= 0.5 THEN ci ELSE -1 END AS t FROM (SELECT *, row_number() OVER (PARTITION BY image, ai ORDER BY iou DESC, ci) AS n FROM c) WHERE n = 1),
pk AS (SELECT p.image, list_sort(list(coalesce(t, -1))) AS k, bool_and(coalesce(t, -1) >= 0) AS ok, count(*) AS size FROM p LEFT JOIN m ON p.image = m.image AND p.idx = m.ai GROUP BY 1), gk AS (SELECT image, list_sort(list(idx)) AS k, count(*) AS size FROM g GROUP BY 1),
r AS (SELECT gk.size, CAST(gk.image % 3 AS VARCHAR) AS kind, CASE WHEN ok AND pk.k = gk.k THEN 1 ELSE 0 END AS g, 1 AS ng, 0 AS p, 0 AS np FROM gk LEFT JOIN pk USING (image) UNION ALL SELECT pk.size, CAST(pk.image % 3 AS VARCHAR), 0, 0, CASE WHEN ok AND pk.k = gk.k THEN 1 ELSE 0 END, 1 FROM pk LEFT JOIN gk USING (image)),
s AS (SELECT CAST(size AS BIGINT) AS size, kind, CAST(sum(g) AS BIGINT) AS gold_hits, CAST(sum(ng) AS BIGINT) AS n_gold, CAST(sum(p) AS BIGINT) AS pred_hits, CAST(sum(np) AS BIGINT) AS n_pred FROM r GROUP BY GROUPING SETS ((), (size), (kind))), v AS (SELECT *, pred_hits / greatest(n_pred, 1) AS a, gold_hits / greatest(n_gold, 1) AS c FROM s)
SELECT size, kind, gold_hits, n_gold, pred_hits, n_pred, round(a, 6) AS precision, round(c, 6) AS recall, round(CASE WHEN a + c = 0 THEN 0 ELSE 2 * a * c / (a + c) END, 6) AS f1 FROM v""")
def box_reaction_match(t: Tables) -> DataFrame:
    """Orders as single reactions over their boxes; predicted boxes leave one flag out, gold boxes another."""
    b = line_boxes(t)
    as_reaction = lambda df: df.groupBy("image").agg(F.collect_list("idx").alias("reactants")).withColumns({"idx": F.lit(0), "conditions": F.array().cast("array<long>"), "products": F.array().cast("array<long>")})
    gold, pred = boxes.box_reaction_match(as_reaction(b.where("l_returnflag <> 'N'")), as_reaction(b.where("l_returnflag <> 'A'")), b.where("l_returnflag <> 'N'"), b.where("l_returnflag <> 'A'"))
    sized = lambda df: df.withColumns({"size": F.size("reactants"), "kind": (F.col("image") % 3).cast("string")})
    out = boxes.box_scores(sized(gold), sized(pred))
    return rounded(out, "precision", "recall", "f1").select(F.col("size").cast("long").alias("size"), "kind", *big("gold_hits", "n_gold", "pred_hits", "n_pred"), "precision", "recall", "f1")


# --- trends and cross-tabs


@query("""WITH y AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS year, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY year), 6) AS share FROM y""")
def trend(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    rows = t.orders.select(F.year("o_orderdate").cast("long").alias("year"), F.col("o_orderpriority").alias("priority")).groupBy("year", "priority").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("year")), 6))


@query("""SELECT o_orderstatus AS status, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY ROLLUP (o_orderstatus)""")
def crosstab(t: Tables) -> DataFrame:
    one = t.orders.groupBy(F.col("o_orderstatus").alias("status")).pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(F.count(F.lit(1))).na.fill(0).withColumnsRenamed({"1-URGENT": "urgent", "5-LOW": "low"})
    return one.union(one.agg(F.lit(None).cast("string").alias("status"), F.sum("urgent"), F.sum("low")))


@query("SELECT source, lang, CAST(quality AS BIGINT) AS quality, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY CUBE (source, lang, quality)")
def source_counts(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents.select("doc_id", "source", "lang"), "doc_id").withColumn("quality", F.col("quality").cast("long"))
    return rows.cube("source", "lang", "quality").agg(F.count(F.lit(1)).alias("n"))


# --- streams: the events table through Structured Streaming


def event_stream(t: Tables) -> DataFrame:
    read = t.spark.readStream.schema(t.events.schema)
    found = read.parquet(f"{t.sf_dir}/events.parquet") if _is_dir(t) else read.option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    return found.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_dir(t: Tables) -> bool:
    path = t.spark._jvm.org.apache.hadoop.fs.Path(f"{t.sf_dir}/events.parquet")
    return path.getFileSystem(t.spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


def through(t: Tables, stream: DataFrame, mode: str) -> DataFrame:
    path = scratch_path(t.spark, "stream")
    return streams.to_table(stream, f"{path}/out", f"{path}/checkpoint", mode)


def clock(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query("SELECT user_id AS run, count(*) AS figures, CAST(sum(event_id % 1000) AS BIGINT) AS input_tokens, CAST(sum(event_id % 77) AS BIGINT) AS output_tokens, CAST(floor(avg(event_id % 1000)) AS BIGINT) AS mean_input FROM events GROUP BY 1")
def stream_running_totals(t: Tables) -> DataFrame:
    sidecars = event_stream(t).select(F.col("user_id").alias("run"), (F.col("event_id") % 1000).alias("input_tokens"), (F.col("event_id") % 77).alias("output_tokens"), F.col("value").alias("elapsed_s"))
    return through(t, streams.running_costs(sidecars), "complete").select("run", *big("figures", "input_tokens", "output_tokens", "mean_input"))


def window_sql(starts: str) -> str:
    return f"SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, strftime(s + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS \"end\", event_type, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT event_type, value, unnest({starts}) AS s FROM events) GROUP BY ALL"


@query(window_sql("[date_trunc('hour', ts)]"))
def stream_windows(t: Tables) -> DataFrame:
    out = streams.windowed_counts(event_stream(t), "ts", ["event_type"], "1 hour", value="value")
    return rounded(through(t, out, "complete"), "total", digits=2).select(clock("start"), clock("end"), "event_type", "n", "total")


@query(window_sql("[date_trunc('hour', ts - INTERVAL 30 MINUTE) + INTERVAL 30 MINUTE, date_trunc('hour', ts)]"))
def stream_sliding_windows(t: Tables) -> DataFrame:
    out = streams.windowed_counts(event_stream(t), "ts", ["event_type"], "1 hour", slide="30 minutes", value="value")
    return rounded(through(t, out, "complete"), "total", digits=2).select(clock("start"), clock("end"), "event_type", "n", "total")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 5 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(t: Tables) -> DataFrame:
    out = streams.session_counts(event_stream(t), "ts", ["user_id"], "5 hours")
    return through(t, out, "complete").select("user_id", clock("start"), clock("end"), "n")


@query("""WITH f AS (SELECT user_id, arg_min(event_id, ts) AS a, arg_max(event_id, ts) AS z FROM events GROUP BY 1) SELECT user_id, CASE WHEN user_id % 2 = 0 THEN a ELSE z END AS event_id FROM f""")
def stream_first_wins(t: Tables) -> DataFrame:
    """The first events of even users arrive, then the last ones of all: of two of a user the earlier stays."""
    ends = t.events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id").agg(F.min_by("event_id", "ts").alias("a"), F.min("ts").alias("ta"), F.max_by("event_id", "ts").alias("z"), F.max("ts").alias("tz"))
    path = scratch_path(t.spark, "arrivals")
    ends.where("user_id % 2 = 0").select("user_id", F.col("a").alias("event_id"), F.col("ta").alias("ts")).coalesce(1).write.parquet(path)
    late = ends.select("user_id", F.col("z").alias("event_id"), F.col("tz").alias("ts"))
    late.coalesce(1).write.mode("append").parquet(path)
    stream = t.spark.readStream.schema(late.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return through(t, streams.first_wins(stream, "user_id", "ts", "10000 days").select("user_id", "event_id"), "append")


def landed(t: Tables, files: int = 10) -> tuple[str, DataFrame]:
    """(folder, stream) of the events, in files that land one after the other by time, one a micro-batch; every file holds rows of most users."""
    path = scratch_path(t.spark, "once")
    rows = t.events.select("event_id", "user_id", "event_type", "ts")
    part = written(rows.repartitionByRange(files, "ts", "event_id").withColumn("_k", F.spark_partition_id() + 1), "landing")
    for k in range(1, files + 1):
        part.where(S("_k") == k).drop("_k").coalesce(1).write.mode("append").parquet(f"{path}/in")
    return path, t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


@query("SELECT event_id, event_type FROM events")
def stream_write_once(t: Tables) -> DataFrame:
    """Ten micro-batches onto one table, one of them committed twice and one that dies before its commit; then compacted in part."""
    path, stream = landed(t)

    def put(batch: DataFrame, number: int) -> None:
        if number == 5:
            batch.write.parquet(f"{path}/out/data/w-{number:012d}-dead")
        for _ in range(2 if number == 3 else 1):
            commits.commit(batch, number, f"{path}/out", "w")
        if number == 6:
            commits.compact(t.spark, f"{path}/out", stream.schema)

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return commits.read_committed(t.spark, f"{path}/out", stream.schema).select("event_id", "event_type")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, CAST(strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS VARCHAR) AS ts FROM events GROUP BY user_id")
def stream_upsert(t: Tables) -> DataFrame:
    """The last event of each user, by upserts of ten micro-batches."""
    path, stream = landed(t)
    commits.write_once(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return commits.read_committed(t.spark, f"{path}/out", stream.schema, ["user_id"], [S("ts").desc(), S("event_id").desc()]).select("user_id", "event_id", clock("ts"))


@query("""WITH r AS (SELECT event_id % 97 AS run, count(*) AS n FROM events GROUP BY 1) SELECT CAST(run AS VARCHAR) AS run, 'steps' AS alert, n AS steps FROM r WHERE n > 8""")
def stream_stuck_runs(t: Tables) -> DataFrame:
    """Runs of too many steps; those of few events are done with each of them."""
    rows = event_stream(t).select((F.col("event_id") % 97).alias("run"), "ts", F.lit("done").alias("kind"))
    return through(t, streams.stuck_runs(rows, "run", "ts", "kind", steps=8), "append")


STUCK = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS run, ts, CASE WHEN event_type = 'purchase' AND value > 100 THEN 'done' ELSE event_type END AS kind FROM events),
r AS (SELECT run, count(*) AS n, bool_or(kind = 'done') AS done, max(ts) AS last FROM e GROUP BY 1), k AS (SELECT run, string_agg(kind || ':' || c, ',' ORDER BY kind) AS kinds FROM (SELECT run, kind, count(*) AS c FROM e GROUP BY ALL) GROUP BY 1), w AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM e)
"""


def watched(t: Tables) -> tuple[DataFrame, str]:
    """(alerts, checkpoint) of users as runs; a purchase above 100 ends one."""
    path = scratch_path(t.spark, "watch")
    rows = event_stream(t).select(S("user_id").cast("string").alias("run"), "ts", F.when((S("event_type") == "purchase") & (S("value") > 100), "done").otherwise(S("event_type")).alias("kind"))
    with stateful.rocksdb(t.spark):
        alerts = streams.to_table(stateful.run_alerts(rows, "run", "ts", "kind", steps=60, minutes=720), f"{path}/out", f"{path}/checkpoint")
    return alerts, f"{path}/checkpoint"


@query(STUCK + """SELECT run, 'steps' AS alert, n AS steps, kinds FROM r JOIN k USING (run) WHERE n > 60 UNION ALL SELECT run, 'timeout', n, kinds FROM r JOIN k USING (run), w WHERE NOT done AND last + INTERVAL 12 HOUR <= mark""")
def stream_run_alerts(t: Tables) -> DataFrame:
    return watched(t)[0].select("run", "alert", "steps", "kinds")


@query(STUCK + """SELECT run, n, n > 60 AS alerted FROM r, w WHERE NOT done AND last + INTERVAL 12 HOUR > mark""")
def stream_run_state(t: Tables) -> DataFrame:
    """Runs that are still open, as the state store holds them."""
    return stateful.state_rows(t.spark, watched(t)[1], "total").select("run", "n", "alerted")


@query("SELECT event_id, event_type AS model, CASE event_type WHEN 'view' THEN 1.5 WHEN 'click' THEN 2.0 END AS input_per_m FROM events")
def stream_with_prices(t: Tables) -> DataFrame:
    prices = t.spark.createDataFrame([("view", 1.5, 3.0), ("click", 2.0, 4.0)], "model string, input_per_m double, output_per_m double")
    runs = event_stream(t).select("event_id", F.col("event_type").alias("model"))
    return through(t, streams.with_prices(runs, prices).select("event_id", "model", "input_per_m"), "append")
