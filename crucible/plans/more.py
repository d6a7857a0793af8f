"""Further operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crucible.functions import classes, text
from crucible.operators import boxes, hazards, lookups, ordering, ranking, reactiondb, reshape, rollup, routes, splits, tiers
from crucible.plans.hierarchy import BOXES, CODED, COUNTS, PAIRED, coded, hashed, line_boxes, predicted
from crucible.plans.registry import Tables, big, query, rounded
from crucible.scratch import in_parts

S = F.col

# --- lookups and sets


@query(r"""WITH x AS (SELECT regexp_replace(p_name, '\s+', '', 'g') AS k, min(p_type) AS smiles FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) SELECT p_partkey, smiles FROM part LEFT JOIN x ON regexp_replace(p_name, '\s+', '', 'g') = k""")
def resolve_names(t: Tables) -> DataFrame:
    lexicon = t.part.where("p_partkey % 2 = 0").select(F.col("p_name").alias("name"), F.col("p_type").alias("smiles"))
    return lookups.resolve_names(t.part.select("p_partkey", F.col("p_name").alias("name")), lexicon).select("p_partkey", "smiles")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#3')")
def search_product(t: Tables) -> DataFrame:
    wanted = t.part.where("p_brand = 'Brand#3'").select(F.col("p_partkey").alias("l_partkey"))
    return lookups.search_product(t.lineitem, wanted, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH a AS (SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS c FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL), b AS (SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS c FROM orders WHERE o_orderkey % 3 = 1 GROUP BY ALL)
SELECT s AS o_orderstatus, p AS o_orderpriority, least(a.c, b.c) AS n FROM a JOIN b USING (s, p)""")
def multiset_intersection(t: Tables) -> DataFrame:
    rows = lambda k: t.orders.where(F.col("o_orderkey") % 3 == k).select("o_orderstatus", "o_orderpriority")
    return lookups.multiset(rows(0), rows(1), "both").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT DISTINCT o_orderpriority AS k, o_custkey AS v FROM orders WHERE year(o_orderdate) = 1996), b AS (SELECT DISTINCT o_orderpriority AS k, o_custkey AS v FROM orders WHERE year(o_orderdate) = 1997)
SELECT coalesce(a.k, b.k) AS priority, coalesce(a.v, b.v) AS customer, CASE WHEN b.k IS NULL THEN 'a' WHEN a.k IS NULL THEN 'b' ELSE 'both' END AS side FROM a FULL JOIN b ON a.k = b.k AND a.v = b.v""")
def diff_sets(t: Tables) -> DataFrame:
    year = lambda y: t.orders.where(F.year("o_orderdate") == y).select(F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("customer"))
    return rollup.diff_sets(year(1996), year(1997), "priority", "customer")


@query("""WITH s AS (SELECT o_custkey AS stem, c_mktsegment AS slice, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) SELECT slice, count(*) AS images, CAST(sum(n) AS BIGINT) AS reactions, CAST(median(n) AS DOUBLE) AS median FROM s GROUP BY 1""")
def composition(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("slice"), F.col("o_custkey").alias("stem"), F.array(F.lit("x")).alias("reactants"))
    return lookups.composition(rows)[0].select("slice", *big("images", "reactions"), F.col("median").cast("double").alias("median"))


@query("SELECT lang, w AS item, count(*) AS count FROM (SELECT lang, unnest(string_split(source, 'c')) AS w FROM documents) GROUP BY ALL")
def item_counts(t: Tables) -> DataFrame:
    return lookups.item_counts(t.documents.select("lang", F.split("source", "c").alias("parts")), ["lang"], "parts")


@query("""WITH m AS (SELECT *, coalesce(o_orderkey % 7 <> 3, true) AS ok FROM orders), v AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 4 > 0) SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT k FROM v)""")
def filter_manifest(t: Tables) -> DataFrame:
    manifest = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_custkey") % 4 == 0, F.lit(False)).alias("valid"))
    return rollup.filter_manifest(t.orders, manifest, "o_custkey")[0].select("o_orderkey")


@query("SELECT c_custkey FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') o ON c_custkey = o_custkey")
def missing_gold(t: Tables) -> DataFrame:
    return rollup.missing_gold(t.customer, t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""WITH s AS (SELECT user_id, sum(CASE WHEN event_id % 2 = 0 AND event_type <> 'error' THEN event_id % 100 END) AS i FROM events GROUP BY 1), l AS (SELECT user_id, sum(event_id % 10) AS i FROM events GROUP BY 1)
SELECT user_id, CASE WHEN s.i > 0 THEN 'sidecar' ELSE 'log' END AS source, CAST(CASE WHEN s.i > 0 THEN s.i ELSE l.i END AS BIGINT) AS input_tokens FROM l LEFT JOIN s USING (user_id)""")
def costs_with_fallback(t: Tables) -> DataFrame:
    side = t.events.where("event_id % 2 = 0 AND event_type <> 'error'").groupBy("user_id").agg(F.sum(F.col("event_id") % 100).alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"))
    log = t.events.groupBy("user_id").agg(F.sum(F.col("event_id") % 10).alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"))
    return rollup.with_fallback(side, log, ["user_id"]).select("user_id", "source", "input_tokens")


@query("""SELECT conv_id, turn, CASE WHEN contains(lower(text), '°') THEN 'x' ELSE 'y' END AS mark, regexp_replace(trim(role), '[^a-zA-Z0-9._-]+', '_', 'g') AS slug FROM conversations""")
def slugs(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.when(F.contains(F.lower("text"), F.lit("°")), "x").otherwise("y").alias("mark"), text.slug("role").alias("slug"))


@query("""WITH o AS (SELECT p_partkey, p_brand AS name, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END AS kind FROM part), e AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE '' END AS kind FROM part WHERE p_partkey % 2 = 0)
SELECT o.p_partkey, name, CASE WHEN e.kind <> '' THEN e.kind ELSE o.kind END AS kind FROM o LEFT JOIN e USING (p_partkey)""")
def merge_enrichment(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.col("p_brand").alias("name"), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_type")).alias("kind"))
    return reshape.merge_enrichment(rows, t.part.where("p_partkey % 2 = 0").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "new").otherwise("").alias("kind")), "p_partkey")


@query("SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'cheap' ELSE p_type END AS p_type FROM part")
def map_names(t: Tables) -> DataFrame:
    mapping = t.part.where("p_type = 'ECONOMY'").select(F.col("p_type").alias("name"), F.lit("cheap").alias("group")).distinct()
    return reshape.map_names(t.part, mapping, "p_type").select("p_partkey", "p_type")


@query("""SELECT conv_id, substr(string_agg('[Page ' || turn || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn), 1, 80000) AS text FROM conversations WHERE trim(text) <> '' GROUP BY 1""")
def manuscript_text(t: Tables) -> DataFrame:
    return reshape.manuscript_text(t.conversations.select("conv_id", F.col("turn").alias("page"), "text"), "conv_id")


@query("SELECT l_orderkey, word FROM (SELECT l_orderkey, unnest(string_split(l_returnflag || '.' || l_linestatus, '.')) AS word FROM lineitem) WHERE word <> ''")
def explode_dots(t: Tables) -> DataFrame:
    return reshape.explode_dots(t.lineitem.select("l_orderkey", F.concat_ws(".", "l_returnflag", "l_linestatus").alias("dots")), "dots", "word").select("l_orderkey", "word")


# --- tiers


@query(PAIRED + """m AS (SELECT o_orderkey % 2 = 0 AS known, CASE WHEN predicted IS NULL THEN 'unmatched' WHEN predicted = truth THEN 'exact' WHEN starts_with(truth, predicted || '.') THEN 'ancestor' WHEN starts_with(predicted, truth || '.') THEN 'descendant' ELSE 'mismatch' END AS t FROM p)
SELECT known, count(*) AS n, count(*) FILTER (t = 'exact') AS exact, count(*) FILTER (t = 'ancestor') AS ancestor, count(*) FILTER (t = 'mismatch') AS mismatch, count(*) FILTER (t = 'unmatched') AS unmatched FROM m GROUP BY ROLLUP (known)""")
def naming_summary(t: Tables) -> DataFrame:
    return tiers.naming_summary(predicted(t).withColumn("known", F.col("o_orderkey") % 2 == 0), "predicted", "truth", "known").select("known", "n", "exact", "ancestor", "mismatch", "unmatched")


FPS = PAIRED + "f AS (SELECT truth, predicted, count(*) AS w FROM p WHERE predicted <> truth AND NOT starts_with(truth, predicted || '.') AND NOT starts_with(predicted, truth || '.') GROUP BY ALL), n AS (SELECT c, sum(w) AS net FROM (SELECT truth AS c, w FROM f UNION ALL SELECT predicted, -w FROM f) GROUP BY 1), o AS (SELECT c, net, row_number() OVER (ORDER BY net DESC, c) AS position FROM n),"


def false_positives(t: Tables) -> DataFrame:
    rows = predicted(t).where("predicted IS NOT NULL")
    return tiers.fp_pairs(rows.select(F.col("predicted").alias("pattern_class"), F.col("o_orderkey").alias("reaction_id")), rows.select(F.col("o_orderkey").alias("reaction_id"), F.col("truth").alias("true_class")))


@query(FPS + "x AS (SELECT 1) SELECT c AS class, CAST(net AS BIGINT) AS net, position FROM o")
def class_precedence(t: Tables) -> DataFrame:
    return tiers.precedence(false_positives(t)).select("class", *big("net", "position"))


@query(FPS + "j AS (SELECT w, a.position < b.position AS good FROM f JOIN o a ON truth = a.c JOIN o b ON predicted = b.c) SELECT CAST(sum(w) AS BIGINT) AS weight, CAST(sum(CASE WHEN good THEN w ELSE 0 END) AS BIGINT) AS avoided, round(sum(CASE WHEN good THEN w ELSE 0 END) / sum(w), 6) AS share FROM j")
def order_stats(t: Tables) -> DataFrame:
    edges = false_positives(t)
    return rounded(tiers.order_stats(edges, tiers.precedence(edges)), "share").select(*big("weight", "avoided"), "share")


REACH = FPS + "t AS (SELECT truth AS a, predicted AS b FROM f UNION SELECT r.a, f.predicted FROM t r JOIN f ON r.b = f.truth), k AS (SELECT DISTINCT c FROM n), y AS (SELECT k.c, coalesce(max(u.b), k.c) AS top FROM k LEFT JOIN t u ON u.a = k.c AND EXISTS (SELECT 1 FROM t v WHERE v.a = u.b AND v.b = k.c) GROUP BY k.c)"


@query(REACH.replace("WITH ", "WITH RECURSIVE ", 1) + " SELECT c AS class, greatest(top, c) AS component FROM y")
def strong_classes(t: Tables) -> DataFrame:
    """Classes that misfire on each other, directly or through others."""
    edges = false_positives(t)
    return ordering.strong_components(edges.select(F.col("true_class").alias("a"), F.col("pattern_class").alias("b"))).select(F.col("node").alias("class"), "component")


@query(REACH.replace("WITH ", "WITH RECURSIVE ", 1) + """ SELECT CAST(sum(w) AS BIGINT) AS weight, CAST(sum(CASE WHEN x.top <> z.top THEN w ELSE 0 END) AS BIGINT) AS across, true AS as_good_as_net FROM f JOIN y x ON f.truth = x.c JOIN y z ON f.predicted = z.c""")
def class_order(t: Tables) -> DataFrame:
    """What the whole order avoids: all weight between components, and no less than the order by net weight."""
    edges = false_positives(t)
    order = ordering.class_order(edges)
    own, net = ordering.avoided(edges, order), ordering.avoided(edges, tiers.precedence(edges))
    at = lambda c, name: order.select(S("class").alias(c), S("component").alias(name))
    across = edges.join(at("true_class", "_x"), "true_class").join(at("pattern_class", "_y"), "pattern_class").agg(F.sum(F.when(S("_x") != S("_y"), S("weight")).otherwise(0)).alias("across"))
    both = own.join(F.broadcast(net.select(S("avoided").alias("_net")))).join(F.broadcast(across))  # one row each
    return both.select(*big("weight", "across"), ((S("avoided") >= S("_net")) & (S("avoided") >= S("across"))).alias("as_good_as_net"))


# --- routes: a line makes a molecule from two others; small parts are for sale

DEPTH = 3
ROUTES = """WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS reaction, min(l_partkey) % 997 AS product, min(l_suppkey) * 13 % 997 AS x, l_orderkey % 997 AS y, min(l_quantity) AS cost FROM lineitem GROUP BY l_orderkey, l_linenumber),
g AS (SELECT reaction, product, cost, CASE WHEN x = y THEN 1 ELSE 2 END AS n, x AS m FROM r UNION SELECT reaction, product, cost, CASE WHEN x = y THEN 1 ELSE 2 END, y FROM r),
c0 AS (SELECT p_partkey % 997 AS m, CAST(min(p_size) AS DOUBLE) AS c FROM part WHERE p_size <= 5 GROUP BY 1)""" + "".join(f""",
w{d} AS (SELECT g.reaction, g.product, g.cost + sum(s.c) AS total FROM g JOIN c{d - 1} s USING (m) GROUP BY g.reaction, g.product, g.cost, g.n HAVING count(*) = g.n),
c{d} AS (SELECT m, min(c) AS c FROM (SELECT m, c FROM c{d - 1} UNION ALL SELECT product, total FROM w{d}) GROUP BY m)""" for d in range(1, DEPTH + 1))


def hyperedges(t: Tables) -> tuple[DataFrame, DataFrame]:
    lines = in_parts(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), t.lineitem.count(), "l_orderkey", "l_linenumber")
    r = lines.groupBy("l_orderkey", "l_linenumber").agg((F.min("l_partkey") % 997).alias("product"), (F.min("l_suppkey") * 13 % 997).alias("_x"), F.min("l_quantity").alias("cost"))
    r = r.select((S("l_orderkey") * 10 + S("l_linenumber")).alias("reaction"), "product", F.array("_x", S("l_orderkey") % 997).alias("reactants"), "cost")
    return r, t.part.where("p_size <= 5").select((S("p_partkey") % 997).alias("molecule"), S("p_size").alias("price"))


@query(ROUTES + f" SELECT CAST(m AS BIGINT) AS molecule, round(c, 2) AS cost FROM c{DEPTH}")
def least_costs(t: Tables) -> DataFrame:
    return rounded(routes.at_depth(routes.least_costs(*hyperedges(t), DEPTH), DEPTH).select(*big("molecule"), "cost"), "cost", digits=2)


@query(ROUTES + f", k AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY total, reaction) AS way FROM w{DEPTH}) SELECT CAST(product AS BIGINT) AS target, way, CAST(reaction AS BIGINT) AS reaction, round(total, 2) AS cost FROM k WHERE way <= 3")
def best_ways(t: Tables) -> DataFrame:
    """The three cheapest last reactions of every molecule."""
    r, prices = hyperedges(t)
    out = routes.best_ways(r, routes.least_costs(r, prices, DEPTH - 1), r.select(S("product").alias("molecule")), 3, DEPTH)
    return rounded(out.select(*big("target", "way", "reaction"), "cost"), "cost", digits=2)


@query(ROUTES + f", k AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY total, reaction) AS way FROM w{DEPTH}) SELECT CAST(product AS BIGINT) AS target, way, round(total, 2) AS cost FROM k WHERE way <= 2")
def route_costs(t: Tables) -> DataFrame:
    """What the steps and leaves of the two best ways of each molecule cost together: their trees, unfolded and added up."""
    r, prices = hyperedges(t)
    steps = routes.routes(r, prices, r.select(S("product").alias("molecule")), 2, DEPTH)
    own = steps.join(r.select("reaction", "cost"), "reaction").select("target", "way", "cost")
    bought = steps.select("target", "way", F.explode("leaves").alias("molecule")).join(prices.groupBy("molecule").agg(F.min("price").alias("cost")), "molecule").select("target", "way", S("cost").cast("double"))
    return rounded(own.select("target", "way", S("cost").cast("double")).union(bought).groupBy("target", "way").agg(F.sum("cost").alias("cost")).select(*big("target", "way"), "cost"), "cost", digits=2)


@query(CODED + "s AS (SELECT template, min(o_orderkey) AS k, count(*) AS count FROM (SELECT *, row_number() OVER (PARTITION BY template ORDER BY length(code), o_orderkey) AS n FROM c) GROUP BY 1), e AS (SELECT template, code AS example FROM (SELECT *, row_number() OVER (PARTITION BY template ORDER BY length(code), o_orderkey) AS n FROM c) WHERE n = 1) SELECT template, example, count FROM e JOIN s USING (template)")
def shortest_example(t: Tables) -> DataFrame:
    return tiers.shortest_example(coded(t), "template", "code", "o_orderkey")


@query(CODED + "k AS (SELECT DISTINCT t2 FROM c WHERE o_orderkey % 2 = 0) SELECT o_orderkey, CASE WHEN t2 IN (SELECT t2 FROM k) THEN t2 ELSE t1 END AS true_class FROM c WHERE t1 IN (SELECT split_part(t2, '.', 1) FROM k)")
def resolve_true_class(t: Tables) -> DataFrame:
    c = coded(t)
    known = c.where("o_orderkey % 2 = 0").select(classes.at_tier("code", 2).alias("class")).distinct()
    rows = c.select("o_orderkey", classes.at_tier("code", 1).alias("t1"), classes.at_tier("code", 2).alias("t2"))
    return tiers.resolve_true_class(rows, known, ["t1", "t2"], "o_orderkey").select("o_orderkey", "true_class")


@query(CODED + "x AS (SELECT 1) SELECT o_orderkey, CASE t1 WHEN '0' THEN 'A' WHEN '1' THEN 'B' ELSE code END AS code FROM c")
def merge_class(t: Tables) -> DataFrame:
    merged = t.region.where("r_regionkey < 2").select(F.col("r_regionkey").cast("string").alias("prefix"), F.when(F.col("r_regionkey") == 0, "A").otherwise("B").alias("into"))
    return tiers.merge_class(coded(t).select("o_orderkey", "code"), merged, "code").select("o_orderkey", "code")


@query(COUNTS + "x AS (SELECT 1) SELECT class, template, c AS count FROM r WHERE n <= 2")
def top_templates(t: Tables) -> DataFrame:
    counts = coded(t).groupBy(classes.at_tier("code", 2).alias("class"), "template").agg(F.count(F.lit(1)).alias("count"))
    return ranking.top(counts, ["class"], [F.desc("count"), F.col("template")], 2).select("class", "template", "count")


# --- solvents, routes, neighbours


@query("""WITH p AS (SELECT p_partkey AS key, unnest(string_split(p_name, ' ')) AS s FROM part), g AS (SELECT key, bool_and(length(s) * 10 <= 50 AND length(s) * 20 >= 50) AS ok FROM p GROUP BY 1) SELECT key FROM g WHERE ok""")
def liquid_at(t: Tables) -> DataFrame:
    rows = t.part.select(F.col("p_partkey").alias("key"), F.replace("p_name", F.lit(" "), F.lit(".")).alias("SOLVENT"))
    ranges = rows.select(F.explode(F.split("SOLVENT", r"\.")).alias("smiles")).distinct().select("smiles", (F.length("smiles") * 10).alias("mp"), (F.length("smiles") * 20).alias("bp"))
    return hazards.liquid_at(rows, ranges, "key", 50).select("key")


@query("""WITH p AS (SELECT p_brand, p_partkey AS name, p_size, CASE WHEN p_size >= 35 THEN 0 WHEN p_size >= 25 THEN 1 END AS level FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY level, p_size DESC, name) AS n FROM p WHERE level IS NOT NULL) SELECT p_brand, name FROM r WHERE n <= 4""")
def prefer_green(t: Tables) -> DataFrame:
    rows = t.part.select("p_brand", F.col("p_partkey").alias("name"), F.col("p_size").alias("score"), F.lit("").alias("ranking"), F.floor(F.col("p_size") / 5).alias("gsk"))
    return hazards.prefer_green(rows, ["p_brand"], 4).select("p_brand", "name")


@query("""SELECT l_orderkey, bool_and(p_size > 10) AS buyable, round(avg(CASE WHEN p_size > 10 THEN 1.0 ELSE 0 END), 6) AS share, round(sum(CASE WHEN p_size > 10 THEN p_retailprice ELSE 0 END), 2) AS price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def buyability(t: Tables) -> DataFrame:
    routes = t.lineitem.select("l_orderkey", F.col("l_partkey").alias("molecule"))
    prices = t.part.where("p_size > 10").select(F.col("p_partkey").alias("molecule"), F.col("p_retailprice").alias("price"))
    return rounded(rounded(reactiondb.buyability(routes, prices, ["l_orderkey"]), "share"), "price", digits=2)


@query("""WITH u AS (SELECT o_orderstatus AS "TAG", o_orderpriority AS "SOLVENT", count(*) AS n FROM orders GROUP BY ALL), a AS (SELECT DISTINCT o_orderstatus AS "TAG", s AS "SOLVENT" FROM orders, (VALUES ('1-URGENT'), ('none')) v(s)) SELECT "TAG", "SOLVENT", coalesce(n, 0) AS precedents FROM a LEFT JOIN u USING ("TAG", "SOLVENT")""")
def precedent_counts(t: Tables) -> DataFrame:
    db = t.orders.select(F.col("o_orderstatus").alias("TAG"), F.col("o_orderpriority").alias("SOLVENT"))
    asked = db.select("TAG").distinct().withColumn("SOLVENT", F.explode(F.array(F.lit("1-URGENT"), F.lit("none"))))
    return reactiondb.precedent_counts(asked, db)


@query("""WITH n AS (SELECT c_nationkey AS k, avg(c_acctbal) AS b, CAST(count(*) AS DOUBLE) AS c FROM customer GROUP BY 1), d AS (SELECT a.k AS nation, b.k AS other, sqrt((a.b - b.b) * (a.b - b.b) + (a.c - b.c) * (a.c - b.c)) AS distance FROM n a JOIN n b ON a.k <> b.k),
r AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY distance, other) AS rank FROM d) SELECT nation, other, rank, round(distance, 4) AS distance FROM r WHERE rank <= 2""")
def nearest_nations(t: Tables) -> DataFrame:
    points = t.customer.groupBy(F.col("c_nationkey").alias("nation")).agg(F.avg("c_acctbal").alias("b"), F.count(F.lit(1)).cast("double").alias("c"))
    return rounded(ranking.nearest(points, "nation", ["b", "c"], 2), "distance", digits=4).select("nation", "other", *big("rank"), "distance")


@query(f"SELECT count(*) AS n, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS coverage, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_custkey END), 4) AS mean_rank FROM (SELECT * FROM orders ORDER BY {hashed('o_orderkey')}, o_orderkey LIMIT 500)")
def coverage_sample(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", (F.col("o_orderstatus") == "F").alias("correct"), F.col("o_custkey").alias("rank"))
    return splits.coverage_sample(rows, "o_orderkey", 500).select("n", F.round("coverage", 6).alias("coverage"), F.round("mean_rank", 4).alias("mean_rank"))


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'old' FROM orders WHERE o_orderkey % 2 = 1 AND o_orderpriority <> '5-LOW'""")
def merge_new_wins(t: Tables) -> DataFrame:
    new = t.orders.where("o_orderkey % 2 = 0").select("o_orderkey", "o_orderstatus", F.lit("x").alias("class"))
    old = t.orders.select("o_orderkey", F.lit("old").alias("o_orderstatus"), F.when(F.col("o_orderpriority") == "5-LOW", "CONFLICT:a").otherwise("a").alias("class"))
    return splits.merge_new_wins(old, new, "o_orderkey", "class").select("o_orderkey", "o_orderstatus")


@query(BOXES + "p AS (SELECT image, least(ai, ci) AS a, greatest(ai, ci) AS c, i / (s + r - i) AS iou FROM o WHERE ai < ci) SELECT image, count(*) AS pairs, round(max(iou), 6) AS most FROM p GROUP BY 1")
def box_overlaps(t: Tables) -> DataFrame:
    b = line_boxes(t)
    met = boxes.overlaps(b, b).where("a_idx < b_idx")
    return rounded(met.groupBy("image").agg(F.count(F.lit(1)).alias("pairs"), F.max("iou").alias("most")), "most")
