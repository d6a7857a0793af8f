"""Image scores, detection scores, alignment, search modes, reports and hooks on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crucible.functions import molecules, similarity, text
from crucible.operators import assign, boxes, enrich, graph, hazards, lookups, metrics, ranking, reactiondb, reshape, rollup, structures, tiers
from crucible.plans.analytics import db
from crucible.plans.evaluation import PRF, counted, figures
from crucible.plans.hierarchy import CODED, coded
from crucible.plans.records import species
from crucible.plans.registry import Tables, big, query, rounded

S = F.col

# --- scores of images

LINES = """
WITH l AS (SELECT o_custkey AS f, o_orderkey AS i, o_orderpriority = '1-URGENT' AS pred, l_suppkey % 4 AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')),
"""


def stereo(t: Tables, priority: str) -> DataFrame:
    """Orders as reactions whose structures differ in stereo marks alone between odd and even keys."""
    line = t.lineitem.join(t.orders.where(S("o_orderpriority") == priority), S("l_orderkey") == S("o_orderkey"))
    mark = F.when(S("l_orderkey") % 2 == 0, F.concat(F.lit("C@"), (S("l_suppkey") % 4).cast("string"))).otherwise(F.concat(F.lit("C/"), (S("l_suppkey") % 4).cast("string")))
    return line.groupBy(S("o_custkey").alias("figure"), S("l_orderkey").alias("idx")).agg(F.array_sort(F.collect_set(mark)).alias("reactants")).withColumn("products", F.array(F.lit("N")))


@query(LINES + f"""r AS (SELECT f, i, pred, string_agg(DISTINCT s, ',' ORDER BY s) AS k FROM l GROUP BY ALL), k AS (SELECT f, k, count(*) FILTER (pred) AS p, count(*) FILTER (NOT pred) AS g FROM r GROUP BY ALL),
s AS (SELECT f AS figure, CAST(sum(least(p, g)) AS BIGINT) AS matched, CAST(sum(p) AS BIGINT) AS n_pred, CAST(sum(g) AS BIGINT) AS n_gold FROM k GROUP BY 1)
SELECT figure, matched, n_pred, n_gold, {PRF} FROM s""")
def constitution_match(t: Tables) -> DataFrame:
    return counted(metrics.constitution_match(stereo(t, "1-URGENT"), stereo(t, "2-HIGH"), ["figure"]), "figure")


def molecules_of(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(predicted, gold) reactions: an order of a customer and the one after it; products come with yields."""
    own = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = t.orders.withColumn("_n", F.row_number().over(own) - 1).select(S("o_custkey").alias("figure"), (S("_n") / 2).cast("int").alias("idx"), (S("_n") % 2 == 0).alias("_pred"), "o_orderstatus", "o_orderkey", S("o_orderpriority").alias("p"))
    rows = rows.select("figure", "idx", "_pred", F.array("o_orderstatus").alias("reactants"), F.array(F.struct(S("p").alias("smiles"), (S("o_orderkey") % 3).cast("double").alias("yield_pct"))).alias("products"))
    return rows.where("_pred").drop("_pred"), rows.where("NOT _pred").drop("_pred")


GREEDY = """
WITH RECURSIVE o AS (SELECT o_custkey AS f, o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
r AS (SELECT f, (n - 1) // 2 AS i, n % 2 = 1 AS pred, s, p, k % 3 AS y FROM o),
c AS (SELECT a.f, a.i AS pi, b.i AS gi, CASE WHEN a.p = b.p THEN 1 ELSE 0 END AS products, CASE WHEN a.s = b.s THEN 1 ELSE 0 END AS reactants, a.y AS py, b.y AS gy FROM r a JOIN r b ON a.f = b.f AND a.pred AND NOT b.pred WHERE a.p = b.p OR a.s = b.s),
w AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY products * 1e12 + reactants * 1e6 - abs(gi - pi) DESC, pi, gi) AS rank FROM c),
g AS (SELECT f, 0 AS step, CAST([] AS BIGINT[]) AS ps, CAST([] AS BIGINT[]) AS gs, CAST(0 AS BIGINT) AS last FROM (SELECT DISTINCT f FROM w)
  UNION ALL SELECT g.f, g.step + 1, list_append(g.ps, w.pi), list_append(g.gs, w.gi), w.rank FROM g JOIN w ON w.f = g.f AND w.rank = (SELECT min(v.rank) FROM w v WHERE v.f = g.f AND v.rank > g.last AND NOT list_contains(g.ps, v.pi) AND NOT list_contains(g.gs, v.gi))),
d AS (SELECT f, ps, gs FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY step DESC) AS m FROM g) WHERE m = 1),
h AS (SELECT w.* FROM d JOIN w ON w.f = d.f AND list_position(d.ps, w.pi) = list_position(d.gs, w.gi)),
"""


@query(GREEDY + "x AS (SELECT 1) SELECT f AS figure, CAST(pi AS BIGINT) AS pred_idx, CAST(gi AS BIGINT) AS gold_idx, CAST(products AS BIGINT) AS products, CAST(reactants AS BIGINT) AS reactants FROM h")
def greedy_pairs(t: Tables) -> DataFrame:
    pred, gold = (df.withColumn("products", F.transform("products", lambda x: x["smiles"])) for df in molecules_of(t))
    return metrics.greedy_pairs(pred, gold, ["figure"]).select("figure", *big("pred_idx", "gold_idx", "products", "reactants"))


@query(GREEDY + """n AS (SELECT f, count(*) FILTER (NOT pred) AS ng, count(*) FILTER (pred) AS np FROM r GROUP BY 1), m AS (SELECT f, sum(products) AS hit, sum(CASE WHEN products = 1 AND py = gy THEN 1 ELSE 0 END) AS good FROM h GROUP BY 1)
SELECT f AS figure, ng AS gold_reactions, CAST(coalesce(hit, 0) AS BIGINT) AS matched_reactions, CAST(coalesce(hit, 0) AS BIGINT) AS matched_products, CAST(coalesce(hit, 0) AS BIGINT) AS yield_pairs, CAST(coalesce(good, 0) AS BIGINT) AS yield_correct, np AS predicted_products FROM n LEFT JOIN m USING (f) WHERE ng > 0""")
def image_score(t: Tables) -> DataFrame:
    out = metrics.image_score(*molecules_of(t), ["figure"])
    return out.select("figure", *big("gold_reactions", "matched_reactions", "matched_products", "yield_pairs", "yield_correct", "predicted_products"))


@query("""SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'missing' WHEN 1 THEN 'hallucinated' WHEN 2 THEN 'match' WHEN 3 THEN 'stereo_error' WHEN 4 THEN 'methylene_shift' WHEN 5 THEN 'substituent_position' WHEN 6 THEN 'connectivity_misread' ELSE 'other' END AS failure FROM part""")
def failure_modes(t: Tables) -> DataFrame:
    k = S("p_size") % 8
    case = lambda *values: F.element_at(F.array(*[F.lit(v) if v else F.lit(None).cast("string") for v in values]), k + 1)
    pairs = t.part.select("p_partkey", case("CO", None, " CCO ", "C[C@H](N)O", "CCO", "Cc1ccccc1O", "CCO", "CCO").alias("gold"), case(None, "CO", "CCO", "C[C@@H](N)O", "CCCO", "Oc1ccc(C)cc1", "COC", "CCN").alias("pred"))
    return metrics.failure_modes(pairs).select("p_partkey", "failure")


@query("""WITH n AS (SELECT c_nationkey AS f, c_custkey AS i, c_mktsegment AS m, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer), x AS (SELECT f, i, k, CASE m WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 3 END AS c FROM n WHERE k <= 4),
p AS (SELECT * FROM x WHERE k % 2 = 1), g AS (SELECT * FROM x WHERE k % 2 = 0),
z AS (SELECT p.f, CASE WHEN p.k = 1 AND g.k = 2 OR p.k = 3 AND g.k = 4 THEN 1 ELSE 2 END AS way, abs(p.c - g.c) AS d FROM p JOIN g ON p.f = g.f)
SELECT f AS nation, CAST(2 AS BIGINT) AS n_pred, CAST(2 AS BIGINT) AS n_gold, round(min(t) / 2, 6) AS distance FROM (SELECT f, way, sum(d) AS t FROM z GROUP BY ALL) GROUP BY 1 HAVING f IN (SELECT f FROM x WHERE k = 4)""")
def composition_distance(t: Tables) -> DataFrame:
    """Nations' first four customers as two predicted and two gold reactions; a segment is a chain of one to three carbons."""
    own = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    chain = F.when(S("c_mktsegment") == "BUILDING", "C").when(S("c_mktsegment") == "MACHINERY", "CC").otherwise("CCC")
    rows = t.customer.withColumn("k", F.row_number().over(own)).where("k <= 4").select(S("c_nationkey").alias("nation"), S("c_custkey").alias("idx"), "k", F.array(chain).alias("reactants"), F.array(F.lit("O")).alias("products"))
    full = rows.groupBy("nation").agg(F.max("k").alias("_k")).where("_k = 4").select("nation")
    rows = rows.join(full, "nation")
    return rounded(metrics.composition_distance(rows.where("k % 2 = 1"), rows.where("k % 2 = 0"), ["nation"]).select("nation", *big("n_pred", "n_gold"), "distance"), "distance")


@query("""WITH n AS (SELECT unnest(range(1, 8)) AS n), a AS (SELECT n, unnest(range(1, n + 1)) AS i FROM n), k AS (SELECT n, r, least(least(i - 1, r), least(n - i, r)) AS x, greatest(least(i - 1, r), least(n - i, r)) AS y FROM a, range(0, 4) t(r)),
f AS (SELECT n, r, x, y, count(*) AS c FROM k GROUP BY ALL), z AS (SELECT u.n AS m, v.n, 1 AS one FROM n u, n v),
d AS (SELECT m, n, sum(abs(coalesce(c, 0) - coalesce(e, 0))) / 4 AS distance FROM (SELECT z.m, z.n, r, x, y, max(CASE WHEN f.n = z.m THEN c END) AS c, max(CASE WHEN f.n = z.n THEN c END) AS e FROM z JOIN f ON f.n IN (z.m, z.n) GROUP BY ALL) GROUP BY ALL)
SELECT p_partkey, round(distance, 6) AS distance FROM part JOIN d ON m = p_size % 7 + 1 AND n = p_partkey % 7 + 1""")
def structure_distances(t: Tables) -> DataFrame:
    """Two chains for each part: an atom's colour after r rounds is how far the ends are, up to r."""
    chain = lambda n: F.expr(f"repeat('C', CAST({n} AS INT))")
    rows = t.part.select("p_partkey", chain("p_size % 7 + 1").alias("a"), chain("p_partkey % 7 + 1").alias("b"))
    return rounded(structures.pair_distances(rows, "a", "b").select("p_partkey", "distance"), "distance")


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'no reactants' WHEN 1 THEN 'no products' WHEN 2 THEN 'unparseable; gained O' WHEN 3 THEN 'gained C,N' ELSE '' END AS issues FROM part""")
def reaction_issues(t: Tables) -> DataFrame:
    k = S("p_size") % 5
    none = F.array().cast("array<string>")
    one = lambda s: F.array(F.lit(s))
    rows = t.part.select("p_partkey", F.when(k == 0, none).when(k == 2, one("C(")).otherwise(one("CO")).alias("reactants"), F.when(k == 1, none).when(k == 3, one("CCNO")).when(k == 0, one("N")).otherwise(one("CO")).alias("products"), F.when(k == 0, F.array(F.struct(F.lit("reagent").alias("role"), F.lit("N").alias("smiles")))).otherwise(F.array().cast("array<struct<role: string, smiles: string>>")).alias("conditions"))
    return metrics.reaction_issues(rows).select("p_partkey", F.array_join("issues", "; ").alias("issues"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN turn / 10 END AS condition_recall, CASE WHEN role = 'user' THEN 0.5 END AS hard_match_full FROM conversations""")
def score_policy(t: Tables) -> DataFrame:
    scored = t.conversations.select("conv_id", "turn", F.when(S("role") == "user", "gt1").otherwise("gt2").alias("slice"), ((S("turn") + 1) % 2).alias("gold_conditions"), (S("turn") / 10).alias("condition_recall"), F.lit(0.5).alias("hard_match_full"))
    return metrics.score_policy(scored).select("conv_id", "turn", "condition_recall", "hard_match_full")


@query("""WITH r AS (SELECT o_orderpriority AS class, o_orderkey AS k, o_orderstatus = 'F' AS ok FROM orders) SELECT class, count(*) AS reactions, round(count(*) FILTER (ok AND k % 2 = 0) / count(*), 6) AS coverage, count(*) FILTER (ok AND k % 2 = 0) / count(*) >= 0.17 AS enough FROM r GROUP BY 1""")
def pattern_coverage(t: Tables) -> DataFrame:
    rows = t.orders.select(S("o_orderpriority").alias("class"), S("o_orderkey").alias("reaction_id"), (S("o_orderstatus") == "F").alias("correct"))
    fires = rows.where("reaction_id % 2 = 0").withColumn("pattern", F.explode(F.array(F.lit("a"), F.lit("b"))))
    return rounded(metrics.pattern_coverage(fires, rows, ["class"], 0.17), "coverage").select("class", "reactions", "coverage", "enough")


@query("""WITH RECURSIVE l AS (SELECT l_orderkey AS f, l_linenumber AS i, min(l_quantity) AS q FROM lineitem GROUP BY ALL),
c AS (SELECT p.f, p.i AS pi, g.i AS gi, 1 / (1 + abs(p.q - g.q)) AS s FROM l p JOIN l g ON p.f = g.f AND p.i % 2 = 1 AND g.i % 2 = 0), w AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY s DESC, pi, gi) AS rank FROM c),
g AS (SELECT f, CAST([] AS BIGINT[]) AS ps, CAST([] AS BIGINT[]) AS gs, CAST(0 AS BIGINT) AS last, 0.0::DOUBLE AS total FROM (SELECT DISTINCT f FROM w)
  UNION ALL SELECT g.f, list_append(g.ps, w.pi), list_append(g.gs, w.gi), w.rank, g.total + w.s FROM g JOIN w ON w.f = g.f AND w.rank = (SELECT min(v.rank) FROM w v WHERE v.f = g.f AND v.rank > g.last AND NOT list_contains(g.ps, v.pi) AND NOT list_contains(g.gs, v.gi))),
n AS (SELECT f, greatest(count(*) FILTER (i % 2 = 1), count(*) FILTER (i % 2 = 0)) AS n FROM l GROUP BY 1) SELECT f AS figure, round(max(total) / max(n), 6) AS mean_similarity FROM g JOIN n USING (f) GROUP BY 1""")
def similarity_alignment(t: Tables) -> DataFrame:
    """The odd lines of an order against its even ones, aligned by closeness in quantity."""
    line = t.lineitem.groupBy(S("l_orderkey").alias("figure"), S("l_linenumber").alias("i")).agg(F.min("l_quantity").alias("q"))
    side = lambda odd, i, q, n: line.where(S("i") % 2 == odd).select("figure", S("i").alias(i), S("q").alias(q), F.count(F.lit(1)).over(Window.partitionBy("figure")).alias(n))
    pairs = side(1, "pred_idx", "_p", "n_pred").join(side(0, "gold_idx", "_g", "n_gold"), "figure").withColumn("similarity", 1 / (1 + F.abs(S("_p") - S("_g"))))
    return rounded(metrics.similarity_alignment(pairs, ["figure"]), "mean_similarity")


# --- detection

@query("""WITH l AS (SELECT DISTINCT l_orderkey AS image, l_linenumber AS i, l_linenumber % 3 + 1 AS c FROM lineitem), m AS (SELECT image, i AS molecule FROM l WHERE c = 1), b AS (SELECT image, i AS label FROM l WHERE c = 3),
g AS (SELECT image, molecule, label FROM m JOIN b USING (image)), x AS (SELECT g.*, (SELECT count(*) FROM l WHERE l.image = g.image AND c <> 3 AND i > molecule AND i < label) AS n FROM g), h AS (SELECT image, count(*) AS hits FROM x WHERE n = 0 AND label > molecule AND (molecule + label) % 2 = 1 GROUP BY 1)
SELECT image, coalesce(hits, 0) AS hits, count(*) AS n_gold, count(*) FILTER ((molecule + label) % 2 = 1) AS n_pred FROM g LEFT JOIN h USING (image) GROUP BY ALL""")
def coref_score(t: Tables) -> DataFrame:
    """Lines of an order as boxes side by side: numbers set the category; every molecule has every label in gold, those at odd distance predicted."""
    line = t.lineitem.select(S("l_orderkey").alias("image"), S("l_linenumber").alias("idx")).distinct().select("image", "idx", (S("idx") * 10.0).alias("x1"), F.lit(0.0).alias("y1"), (S("idx") * 10.0 + 5).alias("x2"), F.lit(5.0).alias("y2"), (S("idx") % 3 + 1).alias("category"))
    gold = line.where("category = 1").select("image", S("idx").alias("molecule")).join(line.where("category = 3").select("image", S("idx").alias("label")), "image")
    return boxes.coref_score(gold, gold.where("(molecule + label) % 2 = 1"), line, line).select("image", *big("hits", "n_gold", "n_pred"))


@query("""WITH b AS (SELECT l_orderkey AS image, l_linenumber AS i, l_linenumber % 2 AS c, min(l_quantity) AS s, bool_or(l_returnflag = 'R') AS gold FROM lineitem GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY s DESC, image, i) AS n, sum(CASE WHEN gold THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY s DESC, image, i) AS tp FROM b),
q AS (SELECT *, max(tp / n) OVER (PARTITION BY c ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best FROM p) SELECT CAST(c AS BIGINT) AS category, round(sum(CASE WHEN gold THEN best ELSE 0 END) / sum(CASE WHEN gold THEN 1 ELSE 0 END), 6) AS ap FROM q GROUP BY 1""")
def detection_ap(t: Tables) -> DataFrame:
    """All lines as predicted boxes side by side, scored by quantity; those with a flag of R are gold."""
    line = t.lineitem.groupBy(S("l_orderkey").alias("image"), S("l_linenumber").alias("idx")).agg(F.min("l_quantity").alias("score"), F.bool_or(S("l_returnflag") == "R").alias("gold"))
    line = line.select("image", "idx", (S("idx") * 10.0).alias("x1"), F.lit(0.0).alias("y1"), (S("idx") * 10.0 + 5).alias("x2"), F.lit(5.0).alias("y2"), (S("idx") % 2).alias("category"), "score", "gold")
    return rounded(boxes.detection_ap(line.where("gold").drop("score", "gold"), line.drop("gold")).select(*big("category"), "ap"), "ap")


@query("""WITH l AS (SELECT l_orderkey AS image, l_linenumber AS i, l_linenumber % 3 AS h FROM lineitem GROUP BY ALL), k AS (SELECT image, h, min(i) AS i FROM l GROUP BY ALL) SELECT image, CAST(i AS BIGINT) AS idx FROM k""")
def dedupe_kept(t: Tables) -> DataFrame:
    """Lines of an order as boxes at three places, those of one place equal: the first of each stays."""
    x = (S("idx") % 3) * 10.0
    line = t.lineitem.select(S("l_orderkey").alias("image"), S("l_linenumber").cast("long").alias("idx")).distinct().select("image", "idx", x.alias("x1"), F.lit(0.0).alias("y1"), (x + 5).alias("x2"), F.lit(5.0).alias("y2"))
    return boxes.dedupe_kept(line, ["image"]).select("image", "idx")


@query("""WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(text || ' ' || turn || 'a', '\\b(\\d+[a-zA-Z]{0,2})\\b', 1)) AS label FROM conversations), s AS (SELECT conv_id, turn FROM conversations WHERE turn % 2 = 0),
r AS (SELECT conv_id, label, max(turn) AS turn FROM w JOIN s USING (conv_id, turn) GROUP BY ALL) SELECT conv_id AS image, label, 'S' || turn AS smiles FROM r""".replace("\\\\", "\\"))
def align_labels(t: Tables) -> DataFrame:
    c = t.conversations.select(S("conv_id").alias("image"), S("turn").alias("pair"), F.concat("text", F.lit(" "), S("turn").cast("string"), F.lit("a")).alias("text"))
    return graph.align_labels(c, c.where("pair % 2 = 0").select("image", "pair", F.concat(F.lit("S"), "pair").alias("smiles")))


# --- search


def vectors(t: Tables) -> DataFrame:
    """Vectors as count fingerprints, with a narrow tag (label) and a broad one."""
    fp = F.transform("embedding", lambda x: F.when(x > 0, 1).otherwise(0))
    return t.embeddings.where("label IS NOT NULL AND size(embedding) = 64").select(S("vec_id").alias("db_id"), fp.alias("fp"), S("label").alias("TAG"), (S("label") % 2).alias("TAG2"))


SEARCH = """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) = 64), q AS (SELECT vec_id AS query_id, label AS ql, v AS qv FROM e WHERE vec_id % 50 = 0),
p AS (SELECT query_id, vec_id AS db_id, ql, label, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN v[i] + qv[i] > 0 THEN 1 ELSE 0 END)) AS u, list_sum(list_transform(range(1, 65), lambda i: v[i] * qv[i])) AS b FROM q JOIN e ON query_id <> vec_id),
s AS (SELECT *, 1 - (u - b) / u AS score FROM p),
"""


def found(t: Tables, mode: str) -> DataFrame:
    v = vectors(t)
    queries = v.where("db_id % 50 = 0").select(S("db_id").alias("query_id"), S("fp").alias("query_fp"), "TAG", "TAG2")
    return rounded(lookups.find_neighbours(queries, v, 5, 0.3, mode).select("query_id", "db_id", *big("rank"), "score"), "score")


def search_sql(test: str) -> str:
    return SEARCH + f"r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, db_id) AS rank FROM s WHERE score > 0.3 AND {test}) SELECT query_id, db_id, rank, round(score, 6) AS score FROM r WHERE rank <= 5"


@query(search_sql("ql = label"))
def find_neighbours_tag(t: Tables) -> DataFrame:
    return found(t, "tag")


@query(search_sql("ql % 2 = label % 2"))
def find_neighbours_broad(t: Tables) -> DataFrame:
    return found(t, "broad")


@query(search_sql("true"))
def find_neighbours_full(t: Tables) -> DataFrame:
    return found(t, "full")


def contents(t: Tables) -> DataFrame:
    """Orders as structures: the suppliers of an order are the set positions of 100, its status is the scaffold."""
    on = (S("l_suppkey") % 100).cast("int")
    half = lambda low: F.coalesce(F.bit_or(F.when((on >= low) & (on < low + 50), F.call_function("shiftleft", F.lit(1).cast("long"), on - low))), F.lit(0).cast("long"))
    near = t.lineitem.groupBy("l_orderkey").agg(half(0).alias("_low"), half(50).alias("_high"))
    fives = F.array(*[F.array(*[F.lit(x >> k & 1) for k in range(5)]) for x in range(32)])  # a hundred expressions a row are too long to be compiled
    fp = F.concat(*[F.get(fives, F.shiftright(c, k).bitwiseAND(31).cast("int")) for c in ("_low", "_high") for k in range(0, 50, 5)])
    both = near.join(t.orders.hint("merge"), S("l_orderkey") == S("o_orderkey"))  # by the size of two columns on disk, nine million orders would be broadcast
    return both.select(S("l_orderkey").alias("db_id"), fp.alias("fp"), S("o_orderstatus").alias("SCAFFOLD"))


def contents_sql(test: str, least: float) -> str:
    return f"""WITH l AS (SELECT DISTINCT l_orderkey AS i, l_suppkey % 100 AS s FROM lineitem), n AS (SELECT i, count(*) AS n FROM l GROUP BY 1),
p AS (SELECT a.i AS query_id, b.i AS db_id, count(*) AS c FROM l a JOIN l b ON a.s = b.s AND a.i <> b.i WHERE a.i % 50 = 0 GROUP BY ALL),
j AS (SELECT query_id, db_id, c / (u.n + v.n - c) AS score FROM p JOIN n u ON u.i = query_id JOIN n v ON v.i = db_id JOIN orders x ON x.o_orderkey = query_id JOIN orders y ON y.o_orderkey = db_id WHERE {test}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, db_id) AS rank FROM j WHERE score > {least}) SELECT query_id, db_id, rank, round(score, 6) AS score FROM r WHERE rank <= 5"""


def similar(t: Tables, mode: str, least: float) -> DataFrame:
    db_ = contents(t)
    queries = db_.where("db_id % 50 = 0").select(S("db_id").alias("query_id"), S("fp").alias("query_fp"), "SCAFFOLD")
    return rounded(lookups.find_similar(queries, db_, 5, least, mode).select("query_id", "db_id", *big("rank"), "score"), "score")


@query(contents_sql("x.o_orderstatus = y.o_orderstatus", 0.31))
def search_scaffold(t: Tables) -> DataFrame:
    return similar(t, "scaffold", 0.31)


@query(contents_sql("true", 0.45))
def search_full(t: Tables) -> DataFrame:
    return similar(t, "full", 0.45)


@query(SEARCH + """z AS (SELECT vec_id, v, (SELECT qv FROM q ORDER BY query_id LIMIT 1) AS qv FROM e), y AS (SELECT vec_id AS id, list_sum(list_transform(range(33, 65), lambda i: CASE WHEN v[i] <> qv[i] THEN 1 ELSE 0 END)) AS d, list_sum(list_transform(range(33, 65), lambda i: CASE WHEN v[i] + qv[i] > 0 THEN 1 ELSE 0 END)) AS u FROM z)
SELECT id, round(CASE WHEN u = 0 THEN 1 ELSE 1 - d / u END, 6) AS score FROM y WHERE u = 0 OR 1 - d / u >= 0.4""")
def similar_reactions(t: Tables) -> DataFrame:
    """By the product half of fingerprints, to that of the first query vector."""
    v = vectors(t)
    one = v.where("db_id % 50 = 0").orderBy("db_id").limit(1).select(S("fp").alias("_q"))
    nodes = v.select(S("db_id").alias("id"), F.lit("Reaction").alias("label"), "fp").crossJoin(F.broadcast(one))  # one row
    return rounded(graph.similar_reactions(nodes, S("_q"), "jaccard", 0.4, products_only=True).select("id", "score"), "score")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS solvent FROM orders WHERE o_orderkey % 10 = 3""")
def reactions_by(t: Tables) -> DataFrame:
    rows = t.orders.select(S("o_orderkey").cast("string").alias("REACTION"), F.when(S("o_orderstatus") != "P", S("o_orderpriority")).alias("SOLVENT"), F.lit("C").alias("PRODUCTS"))
    nodes, edges = graph.nodes_and_edges(rows)
    return graph.reactions_by(nodes, edges, F.endswith("key", F.lit("3"))).select("key", S("USES_SOLVENT").alias("solvent"))


@query("""SELECT 'node' AS kind, 'Reaction' AS name, count(*) AS count FROM orders UNION ALL SELECT 'node', 'Solvent', count(DISTINCT o_orderpriority) FROM orders UNION ALL SELECT 'node', 'Reference', count(DISTINCT o_custkey) FROM orders
UNION ALL SELECT 'edge', 'USES_SOLVENT', count(*) FROM orders UNION ALL SELECT 'edge', 'REPORTS', count(*) FROM orders""")
def graph_stats(t: Tables) -> DataFrame:
    rows = t.orders.select(S("o_orderkey").cast("string").alias("REACTION"), S("o_orderpriority").alias("SOLVENT"), S("o_custkey").cast("string").alias("REF"))
    return graph.stats(*graph.nodes_and_edges(rows))


# --- pairing, members, filters


@query("""WITH p AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), m AS (SELECT c_custkey AS k, p.n FROM customer LEFT JOIN p ON k = c_custkey)
SELECT k AS stem, n IS NOT NULL AS predicted, coalesce(n, 0) AS reactions, n IS NOT NULL AS skipping FROM m""")
def pair_manifest(t: Tables) -> DataFrame:
    """Customers are the manifest; those without an urgent order have no prediction and count as empty, or are skipped."""
    pred = t.orders.where("o_orderpriority = '1-URGENT'").groupBy(S("o_custkey").alias("stem")).agg(F.collect_list("o_orderkey").alias("reactions"))
    manifest = t.customer.select(S("c_custkey").alias("stem"))
    whole = rollup.pair_manifest(manifest, pred, "stem").select("stem", "predicted", F.size("reactions").cast("long").alias("reactions"))
    some = rollup.pair_manifest(manifest, pred, "stem", missing="skip").select("stem", F.lit(True).alias("_s"))
    return whole.join(some, "stem", "left").select("stem", "predicted", "reactions", F.coalesce("_s", F.lit(False)).alias("skipping"))


@query("""WITH g AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderpriority = '2-HIGH' GROUP BY 1), p AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT') SELECT p.k AS stem, n IS NOT NULL AS has_gold, coalesce(n, 0) AS gold_reactions FROM p LEFT JOIN g USING (k)""")
def pair_gold(t: Tables) -> DataFrame:
    """Predictions with their gold where there is any."""
    rows = lambda p, c: t.orders.where(S("o_orderpriority") == p).groupBy(S("o_custkey").alias("stem")).agg(F.collect_list("o_orderkey").alias(c))
    return rollup.pair_gold(rows("1-URGENT", "reactions"), rows("2-HIGH", "gold_reactions"), "stem").select("stem", "has_gold", F.size("gold_reactions").cast("long").alias("gold_reactions"))


@query(CODED + """w AS (SELECT DISTINCT t2 AS wanted FROM c UNION SELECT DISTINCT code FROM c), r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN code ELSE t2 END AS class FROM c), m AS (SELECT wanted, o_orderkey, wanted = class AS same FROM w JOIN r ON wanted = class OR starts_with(class, wanted || '.')),
a AS (SELECT *, bool_or(same) OVER (PARTITION BY wanted) AS has FROM m) SELECT wanted, o_orderkey FROM a WHERE same OR NOT has""")
def class_members(t: Tables) -> DataFrame:
    c = coded(t)
    broad = F.substring_index("code", ".", 2)
    rows = c.select("o_orderkey", F.when(S("o_orderkey") % 2 == 0, S("code")).otherwise(broad).alias("class"))
    wanted = c.select(F.explode(F.array(broad, "code")).alias("wanted")).distinct()
    return tiers.class_members(wanted, rows).select("wanted", "o_orderkey")


@query("""SELECT p_partkey, p_size % 4 IN (1, 2) AS some, p_size % 4 = 1 AS one, p_size % 4 IN (1, 2) AS listed, p_size % 4 = 0 AS none, p_size % 4 = 1 AS strict FROM part""")
def atom_filter(t: Tables) -> DataFrame:
    k = S("p_size") % 4
    counts = molecules.atom_counts(F.when(k == 1, "CN").when(k == 2, "CNNO").when(k == 3, "CO").otherwise("[H]"))
    test = lambda spec, strict=False: tiers.atom_filter(spec, S("counts"), strict)
    return t.part.select("p_partkey", counts.alias("counts")).select("p_partkey", test({"N": None}).alias("some"), test({"N": 1}).alias("one"), test({"N": [1, 2]}).alias("listed"), test({}).alias("none"), test({"C": None, "N": None}, True).alias("strict"))


@query("""WITH x AS (SELECT p_partkey, p_size * 12.0 AS mw, p_size / 10 AS lp, p_size / 12 AS ld, p_size * 3.0 AS ts, p_size % 6 AS hd FROM part)
SELECT p_partkey, round(CASE WHEN lp < 3 THEN 1 WHEN lp > 5 THEN 0 ELSE (5 - lp) / 2 END + CASE WHEN ld < 2 THEN 1 WHEN ld > 4 THEN 0 ELSE (4 - ld) / 2 END + CASE WHEN mw < 360 THEN 1 WHEN mw > 500 THEN 0 ELSE (360 - mw) / 140 END
+ CASE WHEN ts < 20 THEN 0 WHEN ts < 40 THEN (ts - 20) / 20 WHEN ts < 90 THEN 1 WHEN ts < 120 THEN (120 - ts) / 30 ELSE 0 END + greatest(0, 1 - hd / 4), 6) AS cns FROM x""")
def cns_score(t: Tables) -> DataFrame:
    k = S("p_size")
    rows = t.part.select("p_partkey", (k * 12.0).alias("mw"), (k / 10).alias("logp"), (k / 12).alias("logd"), (k * 3.0).alias("tpsa"), (k % 6).alias("hbd"))
    return rounded(hazards.cns_score(rows).select("p_partkey", "cns"), "cns")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 20 AS mw, l_linenumber AS lp, l_suppkey % 80 AS atoms, l_partkey % 150 AS mr, l_quantity * 4 AS ts, l_suppkey % 9 AS ri, l_suppkey % 7 AS ca, l_partkey % 3 AS he, l_suppkey % 20 AS ro, l_partkey % 13 AS ha, l_suppkey % 8 AS hd FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CAST((mw < 160 OR mw > 480)::INT + (lp < -0.4 OR lp > 5.6)::INT + (atoms < 20 OR atoms > 70)::INT + (mr < 40 OR mr > 130)::INT AS BIGINT) AS ghose,
CAST((mw < 200 OR mw > 400)::INT + (lp < -2 OR lp > 5)::INT + (ts > 150)::INT + (ri > 7)::INT + (ca <= 4)::INT + (he <= 1)::INT + (ro > 15)::INT + (ha > 10)::INT + (hd > 5)::INT AS BIGINT) AS muegge FROM x""")
def druglike_more(t: Tables) -> DataFrame:
    part, supplier = S("l_partkey"), S("l_suppkey")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (S("l_quantity") * 20).alias("mw"), S("l_linenumber").alias("logp"), (supplier % 8).alias("hbd"), (part % 13).alias("hba"), (S("l_quantity") * 4).alias("tpsa"), (supplier % 20).alias("rotatable"), (supplier % 9).alias("rings"), (supplier % 80).alias("atoms"), (supplier % 7).alias("carbons"), (part % 3).alias("hetero"), (part % 150).alias("refractivity"))
    return hazards.druglike_counts(rows).select("l_orderkey", "l_linenumber", "l_partkey", *big("ghose", "muegge"))


# --- roll-ups and reports


@query("SELECT event_type AS suite_id, count(*) AS images, count(*) FILTER (user_id % 3 = 0) AS ok, round(avg(value), 4) AS value FROM events GROUP BY 1")
def suite_trajectory(t: Tables) -> DataFrame:
    return lookups.suite_trajectory(t.events.select(S("event_type").alias("suite_id"), (S("user_id") % 3).alias("rc"), "value"), ["value"])


@query("""WITH r AS (SELECT CASE WHEN p_size >= 35 THEN 'hazardous' WHEN p_size >= 15 THEN 'problematic' ELSE 'recommended' END AS ranking, p_size AS s FROM part) SELECT ranking, count(*) AS count, round(avg(s), 4) AS mean_safety_score, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percent FROM r GROUP BY 1""")
def ehs_summary(t: Tables) -> DataFrame:
    k = S("p_size")
    rows = t.part.select(F.when(k >= 35, "hazardous").when(k >= 15, "problematic").otherwise("recommended").alias("ranking"), *[k.alias(c) for c in ("safety_score", "corrected_health_score", "corrected_env_score")])
    return hazards.ehs_summary(rows).select("ranking", "count", "mean_safety_score", "percent")


@query("""WITH s AS (SELECT o_custkey AS path, count(*) AS length, avg(o_orderkey % 10 / 10) AS sim, avg(o_orderkey % 5) AS refs FROM orders GROUP BY 1), l AS (SELECT DISTINCT o_custkey AS path, o_orderpriority AS m FROM orders), b AS (SELECT path, avg(CASE WHEN m < '3' THEN 1.0 ELSE 0 END) AS share, sum(CASE WHEN m < '3' THEN 5.0 ELSE 0 END) AS price FROM l GROUP BY 1)
SELECT path, round(10 * length + 100 * (1 - share) + CASE WHEN price = 0 THEN 100 ELSE price END - 3 * refs - 20 * sim, 2) AS penalty FROM s JOIN b USING (path) ORDER BY penalty, path LIMIT 10""")
def score_routes(t: Tables) -> DataFrame:
    k = S("o_orderkey")
    steps = t.orders.select(S("o_custkey").alias("path"), (k % 10 / 10).alias("similarity"), (k % 5).alias("references"), F.array("o_orderpriority").alias("leaves"))
    prices = t.orders.where("o_orderpriority < '3'").select(S("o_orderpriority").alias("molecule"), F.lit(5.0).alias("price")).distinct()
    return reactiondb.score_routes(steps, prices).select("path", "penalty")


@query("""WITH m AS (SELECT l_partkey AS r, sum(l_linenumber) AS refs, arg_min(l_suppkey % 10, l_orderkey * 1000000 + l_suppkey * 100 + l_linenumber) AS s, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS t FROM lineitem GROUP BY 1)
SELECT r AS reaction, CAST(refs AS BIGINT) AS "references", t AS templates, CAST(20 * s / 10 + least(refs, 10) - 20 * 0.25 - 10 AS DOUBLE) AS score FROM m WHERE 20 * s / 10 + least(refs, 10) - 15 > 10 ORDER BY score DESC, reaction LIMIT 10""")
def score_disconnections(t: Tables) -> DataFrame:
    rows = t.lineitem.select(S("l_partkey").alias("reaction"), (S("l_suppkey") % 10 / 10).alias("similarity"), F.lit(-0.25).alias("accessibility"), S("l_linenumber").alias("references"), S("l_returnflag").alias("template"), (S("l_orderkey") * 1_000_000 + S("l_suppkey") * 100 + S("l_linenumber")).alias("ord"))
    return reactiondb.score_disconnections(rows).select("reaction", S("references").cast("long").alias("references"), F.array_join("templates", ",").alias("templates"), "score")


@query("""SELECT 'quality' AS metric, round(avg(quality) FILTER (toxic = 0), 4) AS clean, round(avg(quality) FILTER (toxic = 1), 4) AS toxic FROM labels UNION ALL SELECT 'doc', round(avg(doc_id) FILTER (toxic = 0), 4), round(avg(doc_id) FILTER (toxic = 1), 4) FROM labels""")
def system_means(t: Tables) -> DataFrame:
    rows = t.labels.select(F.when(S("toxic") == 1, "toxic").otherwise("clean").alias("system"), S("quality").cast("double").alias("quality"), S("doc_id").cast("double").alias("doc"))
    return rollup.system_means(rows, "system", ["quality", "doc"])


@query("""WITH a AS (SELECT p_brand AS b, p_partkey AS o, p_size % 5 AS n, p_retailprice / 100 AS d FROM part WHERE p_size % 3 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY d, o) AS k FROM a WHERE n > 0)
SELECT DISTINCT a.b AS brand, CASE WHEN r.o IS NULL THEN 'No recommended alternative has a precedent.' ELSE 'Use ' || r.o || ' (' || r.n || ' precedents, distance ' || printf('%.2f', r.d) || ').' END AS advice FROM (SELECT DISTINCT p_brand AS b FROM part) a LEFT JOIN r ON a.b = r.b AND k = 1""")
def recommendation(t: Tables) -> DataFrame:
    rows = t.part.select(S("p_brand").alias("brand"), S("p_partkey").alias("other"), (S("p_size") % 5).cast("long").alias("precedents"), (S("p_retailprice") / 100).alias("distance"), F.when(S("p_size") % 3 == 0, "Recommended").otherwise("Hazardous").alias("ranking"))
    return reactiondb.recommendation(rows, ["brand"])


@query("""SELECT l_orderkey AS k, l_partkey AS best FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey) AS n FROM (SELECT DISTINCT l_orderkey, l_quantity, l_partkey FROM lineitem) WHERE l_quantity > 20) WHERE n = 1""")
def closest(t: Tables) -> DataFrame:
    return ranking.closest(t.lineitem.select(S("l_orderkey").alias("k"), "l_quantity", S("l_partkey").alias("best")), ["k"], "l_quantity", "best", 20).select("k", "best")


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders""")
def ordered_report(t: Tables) -> DataFrame:
    """The position of every order in a report by falling price, ranked by ranges."""
    return ranking.numbered(t.orders.select("o_orderkey", "o_totalprice"), [], [F.desc("o_totalprice"), "o_orderkey"], "position").select("o_orderkey", "position")


@query("""SELECT p_name AS name, first AS partkey, row_number() OVER (ORDER BY first, p_name) AS position FROM (SELECT p_name, min(p_partkey) AS first FROM part GROUP BY 1)""")
def first_of_each(t: Tables) -> DataFrame:
    return lookups.first_of_each(t.part.select(S("p_name").alias("name"), S("p_partkey").alias("partkey")), "name", "partkey")


@query("""WITH a AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1), b AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderkey % 3 = 1 AND o_orderstatus = 'F' GROUP BY 1) SELECT a.p AS o_orderpriority, greatest(a.n - coalesce(b.n, 0), 0) AS n FROM a LEFT JOIN b USING (p) WHERE a.n > coalesce(b.n, 0)""")
def multiset_difference(t: Tables) -> DataFrame:
    rows = lambda test: t.orders.where(test).select("o_orderpriority")
    return lookups.multiset(rows("o_orderkey % 3 = 0"), rows("o_orderkey % 3 = 1 AND o_orderstatus = 'F'"), "less").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_suppkey) FILTER (l_returnflag = 'R')) AS p, list_sort(list(DISTINCT l_suppkey) FILTER (l_returnflag = 'A')) AS g FROM lineitem GROUP BY 1), c AS (SELECT k, coalesce(p, []) AS p, coalesce(g, []) AS g FROM l)
SELECT k, round(CASE WHEN len(p) + len(g) = 0 THEN 1 ELSE len(list_intersect(p, g)) / len(list_distinct(list_concat(p, g))) END, 6) AS iou, CAST(len(g) - len(list_intersect(p, g)) AS BIGINT) AS missing, CAST(len(p) - len(list_intersect(p, g)) AS BIGINT) AS extra FROM c""")
def set_lists(t: Tables) -> DataFrame:
    side = lambda f: F.collect_list(F.when(S("l_returnflag") == f, S("l_suppkey").cast("string")))
    rows = t.lineitem.groupBy(S("l_orderkey").alias("k")).agg(side("R").alias("p"), side("A").alias("g")).select("k", metrics.set_lists(S("p"), S("g")).alias("s"))
    return rows.select("k", F.round("s.iou", 6).alias("iou"), F.size("s.missing").cast("long").alias("missing"), F.size("s.extra").cast("long").alias("extra"))


@query("""SELECT CAST(year(o_orderdate) AS BIGINT) AS year, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'soon' ELSE 'later' END AS category, CAST(count(*) AS DOUBLE) AS value FROM orders WHERE year(o_orderdate) < 1998 AND o_orderpriority <> '5-LOW' GROUP BY ALL""")
def trend_by_category(t: Tables) -> DataFrame:
    series = t.orders.groupBy(F.year("o_orderdate").alias("year"), S("o_orderpriority").alias("series")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    categories = t.spark.createDataFrame([("1", "soon"), ("2", "soon"), ("3", "later"), ("4", "later")], "prefix string, category string")
    return lookups.trend(series, categories, end=1998).select(*big("year"), "category", "value")


@query("""SELECT o_orderstatus AS status, count(*) FILTER (o_orderpriority = '1-URGENT') AS "1-URGENT", count(*) FILTER (o_orderpriority = '5-LOW') AS "5-LOW", count(*) AS total FROM orders GROUP BY ROLLUP (o_orderstatus)""")
def cross_table(t: Tables) -> DataFrame:
    return rollup.crosstab(t.orders, "o_orderstatus", "o_orderpriority", ["1-URGENT", "5-LOW"]).withColumnRenamed("o_orderstatus", "status")


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY CUBE (source, lang)")
def counts_by_source(t: Tables) -> DataFrame:
    return rollup.counts(t.documents, ["source", "lang"])


@query("""WITH c AS (SELECT o_orderpriority AS class, o_orderstatus AS g, month(o_orderdate) AS template, count(*) AS n FROM orders GROUP BY ALL), s AS (SELECT class, g, sum(n) AS w, count(*) AS k FROM c GROUP BY ALL), a AS (SELECT *, least(greatest(1, CAST(round_even(6 * w / sum(w) OVER (PARTITION BY class), 0) AS BIGINT)), k) AS s, row_number() OVER (PARTITION BY class ORDER BY w DESC, g) AS o FROM s),
b AS (SELECT *, CASE WHEN o = 1 THEN least(k, greatest(1, s + 6 - sum(s) OVER (PARTITION BY class))) ELSE s END AS z FROM a), d AS (SELECT *, coalesce(sum(z) OVER (PARTITION BY class ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b), e AS (SELECT class, g, greatest(0, least(z, 6 - before)) AS slots FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY class, g ORDER BY n DESC, template) AS m FROM c) SELECT class, g, CAST(template AS BIGINT) AS template FROM r JOIN e USING (class, g) WHERE m <= slots""")
def diverse_topn(t: Tables) -> DataFrame:
    counts = t.orders.groupBy(S("o_orderpriority").alias("class"), S("o_orderstatus").alias("g"), F.month("o_orderdate").alias("template")).agg(F.count(F.lit(1)).alias("n"))
    return tiers.diverse_topn(counts, ["class"], "g", "n", "template", 6).select("class", "g", *big("template"))


# --- functions and hooks


@query(r"""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '*C[*]' ELSE '[C@H]N' END AS wild, 'run-' || p_size AS stem, '.png' AS suffix, CASE WHEN p_size % 5 = 0 THEN '–' ELSE printf('%.3f', p_size / 7) END AS cell, CASE WHEN p_size % 2 = 0 THEN 'C:1,O:-1' ELSE 'N:1' END AS balance FROM part""")
def scalar_functions(t: Tables) -> DataFrame:
    k = S("p_size")
    even = k % 2 == 0
    path = F.concat(F.lit("/a/b.c/run-"), k, F.lit(".PNG"))
    shown = F.array_join(F.transform(F.map_entries(molecules.balance(F.when(even, "CO>>CC").otherwise("C>>C.N"))), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return t.part.select("p_partkey", molecules.wildcards(F.when(even, "[12*]C[*:3]").otherwise("[C@](H)N")).alias("wild"), text.path_stem(path).alias("stem"), text.path_suffix(path).alias("suffix"), text.cell(F.when(k % 5 > 0, k / 7)).alias("cell"), shown.alias("balance"))


@query("""WITH v AS (SELECT vec_id, [CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END, CASE WHEN embedding[2] > 0 THEN 1 ELSE 0 END] AS a, [CASE WHEN embedding[3] > 0 THEN 1 ELSE 0 END, CASE WHEN embedding[4] > 0 THEN 1 ELSE 0 END] AS b FROM embeddings WHERE len(embedding) >= 4)
SELECT vec_id, CAST(2 * a[1] AS VARCHAR) || CAST(2 * a[2] AS VARCHAR) || CAST(b[1] AS VARCHAR) || CAST(b[2] AS VARCHAR) AS joined, CAST(2 * a[1] + b[1] AS VARCHAR) || CAST(2 * a[2] + b[2] AS VARCHAR) AS added, CAST(b[1] AS VARCHAR) || CAST(b[2] AS VARCHAR) AS half FROM v""")
def assembled_fingerprints(t: Tables) -> DataFrame:
    bit = lambda i: F.when(S("embedding")[i] > 0, 1).otherwise(0)
    a, b = F.array(bit(0), bit(1)), F.array(bit(2), bit(3))
    rows = t.embeddings.where("size(embedding) >= 4").select("vec_id", F.array(a, a).alias("reactants"), F.array(b).alias("products"))
    joined = similarity.assemble("reactants", "products")
    return rows.select("vec_id", similarity.to_digits(joined).alias("joined"), similarity.to_digits(similarity.assemble("reactants", "products", False)).alias("added"), F.array_join(similarity.product_half(similarity.from_digits(similarity.to_digits(joined))), "").alias("half"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS v FROM embeddings WHERE len(embedding) = 64), p AS (SELECT a.vec_id, a.v AS a, b.v AS b FROM e a JOIN e b ON b.vec_id = a.vec_id + 1),
c AS (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: a[i] * b[i])) AS tt, list_sum(list_transform(range(1, 65), lambda i: a[i] * (1 - b[i]))) AS tf, list_sum(list_transform(range(1, 65), lambda i: (1 - a[i]) * b[i])) AS ft FROM p)
SELECT vec_id, round(CASE WHEN tf + ft = 0 THEN 1e9 ELSE tt / (tf + ft) END, 6) AS kulczynski1, round(CASE WHEN tt * (64 - tt - tf - ft) + tf * ft = 0 THEN 1 ELSE 1 - 2 * tf * ft / (tt * (64 - tt - tf - ft) + tf * ft) END, 6) AS yule FROM c""")
def more_similarities(t: Tables) -> DataFrame:
    v = vectors_all(t)
    pairs = v.join(v.select((S("vec_id") - 1).alias("vec_id"), S("v").alias("w")), "vec_id")
    k = similarity.similarity("v", "w", "kulczynski1")
    return pairs.select("vec_id", F.round(F.when(k == float("inf"), 1e9).otherwise(k), 6).alias("kulczynski1"), F.round(similarity.similarity("v", "w", "yule"), 6).alias("yule"))


def vectors_all(t: Tables) -> DataFrame:
    return t.embeddings.where("size(embedding) = 64").select("vec_id", F.transform("embedding", lambda x: F.when(x > 0, 1).otherwise(0)).alias("v"))


@query("""SELECT DISTINCT p_name AS smiles, upper(p_name) AS canon, length(p_name) > 8 AS valid FROM part""")
def canonical_by_toolkit(t: Tables) -> DataFrame:
    """A toolkit stands in for the text rules: it sees each distinct structure once."""
    def toolkit(distinct: DataFrame) -> DataFrame:
        def work(frames):
            for f in frames:
                yield f.assign(canon=f.smiles.str.upper(), canon_ns=f.smiles, valid=f.smiles.str.len() > 8)

        return distinct.mapInPandas(work, "smiles string, canon string, canon_ns string, valid boolean")

    return molecules.canonical(t.part, "p_name", toolkit).select("smiles", "canon", "valid")


@query("""SELECT p_partkey, p_size * 2 AS twice, NULL AS error FROM part WHERE p_size % 4 > 0 UNION ALL SELECT p_partkey, NULL, 'ZeroDivisionError: bad row' FROM part WHERE p_size % 4 = 0""")
def enriched_rows(t: Tables) -> DataFrame:
    def annotate(row: dict) -> dict:
        if row["p_size"] % 4 == 0:
            raise ZeroDivisionError("bad row")
        return {"twice": row["p_size"] * 2}

    done, skipped = enrich.enrich(t.part.select("p_partkey", "p_size"), annotate, T.StructType([T.StructField("twice", T.LongType())]))
    return done.select("p_partkey", S("twice").cast("int").alias("twice"), F.lit(None).cast("string").alias("error")).union(skipped.select("p_partkey", F.lit(None).cast("int"), "error"))


@query("""WITH g AS (SELECT p_partkey, unnest(list_transform(range(1, length(p_name) - 2), lambda i: substr(p_name, CAST(i AS INTEGER), 4))) AS g FROM part) SELECT p_partkey, count(*) AS grams, CAST(max(n) AS BIGINT) AS most FROM (SELECT p_partkey, g, count(*) OVER (PARTITION BY p_partkey, g) AS n FROM g) GROUP BY 1""")
def text_fingerprints(t: Tables) -> DataFrame:
    """Hashed counts of four letters, wide enough that few share a slot: their sum is the number of grams, their greatest that of the most frequent."""
    fp = molecules.text_fingerprint("p_name", bits=4096)
    return t.part.select("p_partkey", fp.alias("fp")).select("p_partkey", F.aggregate("fp", F.lit(0).cast("long"), lambda a, x: a + x).alias("grams"), F.array_max("fp").cast("long").alias("most"))


@query("""WITH l AS (SELECT l_orderkey AS f, l_linenumber AS a, l_suppkey % 3 AS b, max(l_quantity) AS s FROM lineitem WHERE l_linenumber <= 2 AND l_suppkey % 3 < 2 GROUP BY ALL), m AS (SELECT f, coalesce(max(s) FILTER (a = 1 AND b = 0), 0) + coalesce(max(s) FILTER (a = 2 AND b = 1), 0) AS x, coalesce(max(s) FILTER (a = 1 AND b = 1), 0) + coalesce(max(s) FILTER (a = 2 AND b = 0), 0) AS y FROM l GROUP BY 1)
SELECT f AS figure, greatest(x, y) AS total FROM m""")
def optimal_assignment(t: Tables) -> DataFrame:
    """Two lines of an order on two suppliers: the better of the two ways."""
    pairs = t.lineitem.where("l_linenumber <= 2 AND l_suppkey % 3 < 2").groupBy(S("l_orderkey").alias("figure"), S("l_linenumber").alias("a"), (S("l_suppkey") % 3).alias("b")).agg(F.max("l_quantity").alias("s"))
    return assign.assign(pairs, ["figure"], "a", "b", "s").groupBy("figure").agg(F.sum("score").alias("total"))


@query("""WITH l AS (SELECT DISTINCT o_custkey AS f, l_orderkey AS i, l_suppkey AS m, l_returnflag AS g FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag IN ('R', 'A')), k AS (SELECT *, dense_rank() OVER (PARTITION BY f, g ORDER BY i) AS r FROM l), x AS (SELECT * FROM k WHERE r <= 2),
n AS (SELECT f, g, r, count(*) AS n FROM x GROUP BY ALL), s AS (SELECT p.f, p.r AS a, q.r AS b, count(*) AS c FROM x p JOIN x q ON p.f = q.f AND p.m = q.m AND p.g = 'R' AND q.g = 'A' GROUP BY ALL),
j AS (SELECT s.f, s.a, s.b, c / (u.n + v.n - c) AS j FROM s JOIN n u ON u.f = s.f AND u.g = 'R' AND u.r = s.a JOIN n v ON v.f = s.f AND v.g = 'A' AND v.r = s.b),
w AS (SELECT f, coalesce(sum(j) FILTER (a = b), 0) AS x, coalesce(sum(j) FILTER (a <> b), 0) AS y FROM j GROUP BY 1), z AS (SELECT f, count(*) FILTER (g = 'R') AS n_pred, count(*) FILTER (g = 'A') AS n_gold FROM n GROUP BY 1)
SELECT f AS figure, n_pred, n_gold, round(CASE WHEN least(n_pred, n_gold) = 0 THEN 0 ELSE coalesce(greatest(x, y), 0) / least(n_pred, n_gold) END, 6) AS mean_jaccard FROM z LEFT JOIN w USING (f)""")
def partial_match_small(t: Tables) -> DataFrame:
    """The first two reactions of each side of a customer, where SQL can try both ways."""
    def two(flag: str) -> DataFrame:
        own = Window.partitionBy("figure").orderBy("idx")
        rows = figures(t, flag).withColumn("_r", F.row_number().over(own)).where("_r <= 2").drop("_r")
        return rows.withColumnRenamed("molecules", "reactants").withColumn("products", F.array().cast("array<string>"))

    return rounded(metrics.partial_match(two("R"), two("A"), ["figure"], stereo=True), "mean_jaccard").select("figure", *big("n_pred", "n_gold"), "mean_jaccard")
