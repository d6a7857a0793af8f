"""Prediction-versus-gold metrics on the driver's tables: an order is a reaction, its lines are its molecules and conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crucible.functions import text
from crucible.operators import metrics, reshape, rollup
from crucible.plans.registry import Tables, big, query, rounded


def sides(t: Tables, *by: str) -> tuple[DataFrame, DataFrame]:
    line = t.lineitem
    return line.where("l_returnflag = 'R'").select(*by, "l_partkey"), line.where("l_linestatus = 'F'").select(*by, "l_partkey")


SETS = """
WITH p AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'), g AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linestatus = 'F'),
c AS (SELECT coalesce(p.l_orderkey, g.l_orderkey) AS l_orderkey, count(*) FILTER (p.l_partkey IS NOT NULL AND g.l_partkey IS NOT NULL) AS b, count(*) FILTER (g.l_partkey IS NULL) AS e, count(*) FILTER (p.l_partkey IS NULL) AS m
  FROM p FULL JOIN g ON p.l_orderkey = g.l_orderkey AND p.l_partkey = g.l_partkey GROUP BY 1),
"""


@query(SETS + "s AS (SELECT * FROM c) SELECT l_orderkey, b AS both, e AS extra, m AS missing, round(b / (b + e + m), 6) AS iou FROM s")
def set_iou(t: Tables) -> DataFrame:
    out = metrics.set_overlap(*sides(t, "l_orderkey"), ["l_orderkey"], "l_partkey")
    return rounded(out, "iou").select("l_orderkey", *big("both", "extra", "missing"), "iou")


@query(SETS + """s AS (SELECT l_orderkey, CASE WHEN b + e = 0 THEN 0 ELSE b / (b + e) END AS p, CASE WHEN b + m = 0 THEN 0 ELSE b / (b + m) END AS r FROM c)
SELECT l_orderkey, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM s""")
def set_prf(t: Tables) -> DataFrame:
    out = metrics.set_overlap(*sides(t, "l_orderkey"), ["l_orderkey"], "l_partkey")
    return rounded(out, "precision", "recall", "f1").select("l_orderkey", "precision", "recall", "f1")


def reactions(t: Tables, priority: str) -> DataFrame:
    """Orders of a priority as reactions: reactants are the flags of their lines, products their states, conditions their discounts."""
    line = t.lineitem.join(t.orders.where(F.col("o_orderpriority") == priority).join(t.customer, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    condition = F.when(F.col("l_discount") >= 0.05, F.struct(F.lit("solvent").alias("role"), F.concat(F.lit(" D"), F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("  % ")).alias("text"), F.lit(None).cast("string").alias("smiles")))
    return line.groupBy(F.col("c_nationkey").alias("nation"), F.col("l_orderkey").alias("idx")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("reactants"), F.array_sort(F.collect_set("l_linestatus")).alias("products"), F.array_compact(F.collect_set(condition)).alias("conditions"))


REACTIONS = """
WITH l AS (SELECT c_nationkey AS nation, l_orderkey AS idx, o_orderpriority AS pr, l_returnflag AS f, l_linestatus AS s, CASE WHEN l_discount >= 0.05 THEN 'solvent|d' || CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR) || ' %' END AS c
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')),
r AS (SELECT nation, idx, pr, string_agg(DISTINCT f, ',' ORDER BY f) || '>' || string_agg(DISTINCT s, ',' ORDER BY s) AS soft, coalesce(string_agg(DISTINCT c, ',' ORDER BY c), '') AS cond FROM l GROUP BY ALL),
n AS (SELECT nation, count(*) FILTER (pr = '1-URGENT') AS n_pred, count(*) FILTER (pr = '2-HIGH') AS n_gold, count(*) FILTER (pr = '2-HIGH' AND cond = '') AS skipped FROM r GROUP BY 1),
"""
PRF = "round(CASE WHEN n_pred + n_gold = 0 THEN 1 WHEN n_pred = 0 THEN 0 ELSE matched / n_pred END, 6) AS precision, round(CASE WHEN n_pred + n_gold = 0 THEN 1 WHEN n_gold = 0 THEN 0 ELSE matched / n_gold END, 6) AS recall, round(CASE WHEN matched = 0 THEN 0 ELSE 2.0 * matched / (n_pred + n_gold) END, 6) AS f1"


def counted(df: DataFrame, *by: str, more: tuple[str, ...] = ()) -> DataFrame:
    return rounded(df, "precision", "recall", "f1").select(*by, *big("matched", "n_pred", "n_gold", *more), "precision", "recall", "f1")


@query(REACTIONS + f"""k AS (SELECT nation, soft, least(count(*) FILTER (pr = '1-URGENT'), count(*) FILTER (pr = '2-HIGH')) AS m FROM r GROUP BY ALL),
s AS (SELECT nation, CAST(sum(m) AS BIGINT) AS matched FROM k GROUP BY 1)
SELECT nation, matched, n_pred, n_gold, {PRF} FROM n JOIN s USING (nation)""")
def soft_match_f1(t: Tables) -> DataFrame:
    return counted(metrics.soft_match(reactions(t, "1-URGENT"), reactions(t, "2-HIGH"), ["nation"]), "nation")


@query(REACTIONS + f"""a AS (SELECT nation, soft, cond, count(*) FILTER (pr = '1-URGENT') AS p, count(*) FILTER (pr = '2-HIGH' AND cond <> '') AS g FROM r GROUP BY ALL),
b AS (SELECT nation, CAST(sum(least(p, g)) AS BIGINT) AS strict FROM a GROUP BY 1),
d AS (SELECT a.nation, a.soft, sum(p - least(p, g)) AS left_over FROM a GROUP BY ALL),
e AS (SELECT nation, soft, count(*) AS free FROM r WHERE pr = '2-HIGH' AND cond = '' GROUP BY ALL),
f AS (SELECT nation, CAST(sum(least(left_over, free)) AS BIGINT) AS lenient FROM d JOIN e USING (nation, soft) GROUP BY 1),
s AS (SELECT nation, n_pred, n_gold, skipped, strict, coalesce(lenient, 0) AS lenient, strict + coalesce(lenient, 0) AS matched FROM n JOIN b USING (nation) LEFT JOIN f USING (nation))
SELECT nation, matched, n_pred, n_gold, strict, lenient, skipped AS skipped_cond_check, {PRF} FROM s""")
def hard_match_f1(t: Tables) -> DataFrame:
    return counted(metrics.hard_match(reactions(t, "1-URGENT"), reactions(t, "2-HIGH"), ["nation"]), "nation", more=("strict", "lenient", "skipped_cond_check"))


@query(f"""
WITH p AS (SELECT c_mktsegment AS segment, o_orderstatus AS k, count(*) AS c FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY ALL),
g AS (SELECT c_mktsegment AS segment, o_orderstatus AS k, count(*) AS c FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '5-LOW' GROUP BY ALL),
s AS (SELECT coalesce(p.segment, g.segment) AS segment, CAST(coalesce(sum(least(p.c, g.c)) FILTER (p.c IS NOT NULL AND g.c IS NOT NULL), 0) AS BIGINT) AS matched, CAST(coalesce(sum(p.c), 0) AS BIGINT) AS n_pred, CAST(coalesce(sum(g.c), 0) AS BIGINT) AS n_gold FROM p FULL JOIN g ON p.segment = g.segment AND p.k = g.k GROUP BY 1)
SELECT segment, matched, n_pred, n_gold, {PRF} FROM s""")
def exact_match(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("segment"), "o_orderstatus", "o_orderpriority")
    return counted(metrics.multiset_match(rows.where("o_orderpriority = '1-URGENT'"), rows.where("o_orderpriority = '5-LOW'"), ["segment"], "o_orderstatus"), "segment")


def side_sql(key: str) -> str:
    return f"""WITH l AS (SELECT l_orderkey AS i, string_agg(DISTINCT l_partkey % 5, ',' ORDER BY l_partkey % 5) AS parts, count(DISTINCT l_returnflag) AS kinds FROM lineitem GROUP BY 1),
r AS (SELECT c_nationkey AS nation, {key} AS k, o_orderpriority AS p FROM orders JOIN l ON i = o_orderkey JOIN customer ON o_custkey = c_custkey),
b AS (SELECT nation, k, count(*) FILTER (p = '1-URGENT') AS p, count(*) FILTER (p = '2-HIGH') AS g FROM r WHERE p IN ('1-URGENT', '2-HIGH') GROUP BY ALL),
s AS (SELECT nation, CAST(sum(least(p, g)) AS BIGINT) AS matched, CAST(sum(p) AS BIGINT) AS n_pred, CAST(sum(g) AS BIGINT) AS n_gold FROM b GROUP BY 1) SELECT nation, matched, n_pred, n_gold, {PRF} FROM s"""


def one_sided(t: Tables, priority: str) -> DataFrame:
    """Orders as reactions: reactants are kinds of their parts, the product is how many flags their lines have."""
    line = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set((F.col("l_partkey") % 5).cast("string"))).alias("reactants"), F.array(F.countDistinct("l_returnflag").cast("string")).alias("products"))
    orders = t.orders.where(F.col("o_orderpriority") == priority).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("c_nationkey").alias("nation"), F.col("l_orderkey").alias("idx"), "reactants", "products")


@query(side_sql("parts"))
def reactant_match(t: Tables) -> DataFrame:
    return counted(metrics.side_match(one_sided(t, "1-URGENT"), one_sided(t, "2-HIGH"), ["nation"], "reactants"), "nation")


@query(side_sql("kinds"))
def product_match(t: Tables) -> DataFrame:
    return counted(metrics.side_match(one_sided(t, "1-URGENT"), one_sided(t, "2-HIGH"), ["nation"], "products"), "nation")


def conditions(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Events as conditions of a user: the type is the role, the property the text; those of even ids are predicted."""
    rows = t.events.select("user_id", F.col("event_id").alias("idx"), F.col("event_type").alias("role"), F.concat(F.lit("K  "), F.get_json_object("props", "$.k")).alias("text"), F.lit("").alias("smiles"))
    return rows.where("idx % 2 = 0"), rows.where("idx % 2 = 1")


EVENTS = "WITH e AS (SELECT user_id, event_id, event_type || '|k ' || json_extract_string(props, '$.k') AS k, event_id % 2 AS gold FROM events),"


@query(EVENTS + """p AS (SELECT DISTINCT user_id, k FROM e WHERE gold = 0), g AS (SELECT DISTINCT user_id, k FROM e WHERE gold = 1),
c AS (SELECT coalesce(p.user_id, g.user_id) AS user_id, count(*) FILTER (p.k IS NOT NULL AND g.k IS NOT NULL) AS b, count(p.k) AS np, count(g.k) AS ng FROM p FULL JOIN g ON p.user_id = g.user_id AND p.k = g.k GROUP BY 1)
SELECT user_id, round(CASE WHEN ng = 0 THEN 1 ELSE b / ng END, 6) AS recall, round(CASE WHEN np = 0 THEN 1 ELSE b / np END, 6) AS precision FROM c""")
def condition_coverage(t: Tables) -> DataFrame:
    return rounded(metrics.condition_coverage(*conditions(t), ["user_id"]), "recall", "precision")


@query(f"""WITH e AS (SELECT user_id AS u, event_id AS i, event_id % 2 AS gold, CASE WHEN event_type IN ('view', 'click') THEN 'reagent_bucket' ELSE event_type END AS b, CASE WHEN event_id % 3 > 0 THEN event_id % 11 END AS s, json_extract_string(props, '$.k') AS t FROM events),
d AS (SELECT u, gold, b, s, t, min(i) AS i FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY u, gold, b, s ORDER BY i) AS n FROM d WHERE s IS NOT NULL), f AS (SELECT p.u, p.i AS pi, g.i AS gi FROM r p JOIN r g ON p.u = g.u AND p.b = g.b AND p.s = g.s AND p.n = g.n AND p.gold = 0 AND g.gold = 1),
l AS (SELECT * FROM d WHERE NOT (gold = 0 AND i IN (SELECT pi FROM f)) AND NOT (gold = 1 AND i IN (SELECT gi FROM f))), z AS (SELECT u, b, t, least(count(*) FILTER (gold = 0), count(*) FILTER (gold = 1)) AS m FROM l GROUP BY ALL),
c AS (SELECT u, count(*) FILTER (gold = 0) AS n_pred, count(*) FILTER (gold = 1) AS n_gold FROM d GROUP BY 1), a AS (SELECT u, sum(m) AS m FROM (SELECT u, m FROM z UNION ALL SELECT u, count(*) FROM f GROUP BY 1) GROUP BY 1), s AS (SELECT u AS user_id, CAST(m AS BIGINT) AS matched, n_pred, n_gold FROM c JOIN a USING (u))
SELECT user_id, matched, n_pred, n_gold, {PRF} FROM s""")
def lenient_coverage(t: Tables) -> DataFrame:
    """Two types share a bucket; two of three conditions have a structure, by which they match first."""
    def side(df: DataFrame) -> DataFrame:
        kind = F.when(F.col("role") == "view", "Catalyst").when(F.col("role") == "click", "base").otherwise(F.col("role"))
        return df.withColumns({"bucket": reshape.bucket_role(kind), "smiles": F.when(F.col("idx") % 3 > 0, (F.col("idx") % 11).cast("string")).otherwise("")})

    p, g = map(side, conditions(t))
    return counted(metrics.lenient_coverage(p, g, ["user_id"]), "user_id")


def figures(t: Tables, flag: str) -> DataFrame:
    """A customer's orders as reactions whose molecules are the suppliers of the lines with a flag."""
    line = t.lineitem.where(F.col("l_returnflag") == flag).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return line.groupBy(F.col("o_custkey").alias("figure"), F.col("l_orderkey").alias("idx")).agg(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))).alias("molecules"))


@query("""
WITH l AS (SELECT DISTINCT o_custkey AS figure, l_orderkey AS idx, l_suppkey AS m, l_returnflag AS f FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag IN ('R', 'A')),
n AS (SELECT figure, idx, f, count(*) AS n FROM l GROUP BY ALL),
s AS (SELECT p.figure, p.idx AS pred_idx, g.idx AS gold_idx, count(*) AS shared FROM l p JOIN l g ON p.figure = g.figure AND p.m = g.m AND p.f = 'R' AND g.f = 'A' GROUP BY ALL)
SELECT s.figure, pred_idx, gold_idx, shared, round(shared / (a.n + b.n - shared), 6) AS jaccard FROM s JOIN n a ON a.figure = s.figure AND a.idx = pred_idx AND a.f = 'R' JOIN n b ON b.figure = s.figure AND b.idx = gold_idx AND b.f = 'A'""")
def partial_jaccard_pairs(t: Tables) -> DataFrame:
    return rounded(metrics.reaction_pairs(figures(t, "R"), figures(t, "A"), ["figure"]), "jaccard")


@query()
def partial_match(t: Tables) -> DataFrame:
    """The assignment itself: tested against brute force."""
    as_sides = lambda f: figures(t, f).withColumnRenamed("molecules", "reactants").withColumn("products", F.array().cast("array<string>"))
    return counted(metrics.partial_match(as_sides("R"), as_sides("A"), ["figure"], stereo=True), "figure", more=())


LABELS = "WITH d AS (SELECT doc_id, source, lang, quality, toxic, CAST(quality AS DOUBLE) AS v FROM labels JOIN documents USING (doc_id)),"


def marks(t: Tables) -> DataFrame:
    return t.labels.join(t.documents.select("doc_id", "source", "lang"), "doc_id")


@query(LABELS + """s AS (SELECT source, CAST(count(*) FILTER (quality = 1 AND toxic = 1) AS BIGINT) AS matched, CAST(sum(quality) AS BIGINT) AS n_pred, CAST(sum(toxic) AS BIGINT) AS n_gold FROM d GROUP BY 1)
SELECT source, matched, n_pred, n_gold, round(CASE WHEN n_pred = 0 THEN 0 ELSE matched / n_pred END, 6) AS precision, round(CASE WHEN n_gold = 0 THEN 0 ELSE matched / n_gold END, 6) AS recall, round(CASE WHEN matched = 0 THEN 0 ELSE 2.0 * matched / (n_pred + n_gold) END, 6) AS f1 FROM s""")
def micro(t: Tables) -> DataFrame:
    rows = marks(t).withColumn("matched", F.col("quality") * F.col("toxic"))
    return counted(rollup.micro(rows, ["source"], "matched", "quality", "toxic").withColumnsRenamed({"quality": "n_pred", "toxic": "n_gold"}), "source")


@query(LABELS + "x AS (SELECT 1) SELECT source, lang, count(*) AS n, round(avg(quality), 4) AS quality, round(avg(toxic), 4) AS toxic FROM d GROUP BY ALL")
def macro(t: Tables) -> DataFrame:
    return rollup.macro(marks(t), ["source", "lang"], ["quality", "toxic"])


@query(LABELS + """g AS (SELECT unnest(list_filter(['all', CASE WHEN doc_id % 3 = 0 THEN 'heldout' END, CASE WHEN doc_id % 5 = 0 THEN 'dev' END, lang, CASE WHEN doc_id % 3 = 0 THEN lang || '_heldout' END], lambda x: x IS NOT NULL)) AS "group", quality, toxic FROM d)
SELECT "group", count(*) AS n, round(avg(quality), 4) AS quality, round(avg(toxic), 4) AS toxic FROM g GROUP BY 1""")
def group_report(t: Tables) -> DataFrame:
    held, dev = F.col("doc_id") % 3 == 0, F.col("doc_id") % 5 == 0
    return rollup.group_report(marks(t), rollup.group_labels(held, dev, F.col("lang")), ["quality", "toxic"])


DRAWS = " + ".join(f"(u >= {limit})::INT" for limit in rollup.POISSON)


@query(LABELS + f"""n AS (SELECT lang, count(*) AS n, avg(v) AS mean FROM d GROUP BY 1), x AS (SELECT lang, v, b, (b * 1000003 + doc_id % 2147483647 * 7919 % 2147483647 + 42) % 2147483647 AS x FROM d, range(10000) AS y(b)),
w AS (SELECT lang, v, b, (x * x) % 2147483647 * 48271 % 2147483647 AS u FROM x), m AS (SELECT lang, b, sum(({DRAWS}) * v) / sum({DRAWS}) AS m FROM w GROUP BY ALL HAVING sum({DRAWS}) > 0),
q AS (SELECT lang, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY 1)
SELECT lang, n, round(mean, 4) AS mean, CASE WHEN n > 1 THEN round(low, 4) END AS low, CASE WHEN n > 1 THEN round(high, 4) END AS high FROM n LEFT JOIN q USING (lang)""")
def bootstrap_ci(t: Tables) -> DataFrame:
    return rollup.bootstrap(marks(t), ["lang"], "quality", "doc_id")


@query("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY source, doc_id) AS n FROM documents WHERE text <> '')
SELECT doc_id, source, lang FROM d WHERE n = 1""")
def dedupe_first(t: Tables) -> DataFrame:
    kept, _ = reshape.dedupe_first(t.documents.select("doc_id", "source", "lang", F.when(F.col("text") != "", F.sha2("text", 256)).alias("key")), "key", ["source", "doc_id"], ["key", "lang"])
    return kept.select("doc_id", "source", "lang")


@query("""WITH d AS (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY source, doc_id) AS n, first_value(lang) OVER (PARTITION BY sha256(text) ORDER BY source, doc_id) AS l FROM documents WHERE text <> '')
SELECT doc_id, 'duplicate' AS reason, lang = l AS identical FROM d WHERE n > 1 UNION ALL SELECT doc_id, 'no key', NULL FROM documents WHERE text IS NULL OR text = ''""")
def exclusion_log(t: Tables) -> DataFrame:
    _, out = reshape.dedupe_first(t.documents.select("doc_id", "source", "lang", F.when(F.col("text") != "", F.sha2("text", 256)).alias("key")), "key", ["source", "doc_id"], ["key", "lang"])
    return out.select("doc_id", "reason", "identical")


@query(r"SELECT conv_id, turn, lower(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS text FROM conversations")
def norm_text(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", text.condition_text("text").alias("text"))


@query(r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[()]', ' ', 'g'), '([0-9]+(?:\.[0-9]+)?)[\x20\x09-\x0D]*mol[\x20\x09-\x0D]*%', '\1 mol%', 'g'), '([0-9]+(?:\.[0-9]+)?)[\x20\x09-\x0D]*%', '\1%', 'g'),
  '([0-9]+(?:\.[0-9]+)?)[\x20\x09-\x0D]*equiv', '\1 equiv', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS text FROM conversations""")
def lenient_text(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", text.lenient_text("text").alias("text"))


@query(r"SELECT page_id, CAST(nullif(regexp_extract(html, '([0-9]{1,3}(?:\.[0-9]+)?)[\x20\x09-\x0D]*%', 1), '') AS DOUBLE) AS percent FROM pages")
def yield_pct(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.yield_percent("html").alias("percent"))


@query("SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def parse_json_props(t: Tables) -> DataFrame:
    return t.events.select("event_id", "event_type", F.from_json("props", "k int")["k"].alias("k"))


@query(r"""
WITH d AS (SELECT doc_id, lang, text AS g, trim(text, chr(10)) AS p FROM documents)
SELECT lang, count(*) AS n, round(avg(CASE WHEN coalesce(nullif(g, ''), '<empty>') = p THEN 1.0 ELSE 0 END), 6) AS exact, round(avg(CASE WHEN contains(g, '@') THEN 1.0 ELSE 0 END), 6) AS chiral_share,
  round(coalesce(avg(CASE WHEN g = p THEN 1.0 ELSE 0 END) FILTER (contains(g, '@')), -1), 6) AS chiral_exact FROM d GROUP BY 1""")
def paired_exact_match(t: Tables) -> DataFrame:
    pairs = t.documents.select("lang", F.col("text").alias("gold"), F.trim("text", F.lit("\n")).alias("pred"))
    return rounded(metrics.paired_exact_match(pairs, by=["lang"]), "exact", "chiral_share", "chiral_exact").select("lang", "n", "exact", "chiral_share", "chiral_exact")


@query("""
WITH q AS (SELECT o_custkey AS query, o_orderkey, o_orderpriority AS label, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
f AS (SELECT query, min(rank) FILTER (label = '1-URGENT') AS r FROM q WHERE rank <= 10 GROUP BY 1)
SELECT count(*) AS queries, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0 END), 6) AS top1, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0 END), 6) AS top5, round(avg(1.0 / r), 6) AS mrr, round(avg(r), 6) AS mean_rank, round(avg(CASE WHEN r IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS found_rate FROM f""")
def retrieval_metrics(t: Tables) -> DataFrame:
    from crucible.operators.ranking import top

    ranked = top(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 10).select(F.col("o_custkey").alias("query"), F.col("o_orderpriority").alias("label"), F.lit("1-URGENT").alias("truth"), "rank")
    return rounded(metrics.retrieval(ranked, [], (1, 5)), "top1", "top5", "mrr", "mean_rank", "found_rate")


FLAG = SETS + """o AS (SELECT l_orderkey, b, e, m, c_nationkey AS nation FROM c JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
SELECT nation, count(*) AS figures, CAST(sum(b) AS BIGINT) AS matched, CAST(sum(b + e) AS BIGINT) AS n_pred, CAST(sum(b + m) AS BIGINT) AS n_gold, round(avg(b / (b + e + m)), 6) AS mean_iou FROM o GROUP BY 1"""


@query(FLAG)
def flagship(t: Tables) -> DataFrame:
    """Set overlap of each order's returned and finished parts, rolled up over the customers' nations."""
    per = metrics.set_overlap(*sides(t, "l_orderkey"), ["l_orderkey"], "l_partkey")
    placed = per.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation")), "o_custkey")
    out = placed.groupBy("nation").agg(F.count(F.lit(1)).alias("figures"), F.sum("both").alias("matched"), F.sum(F.col("both") + F.col("extra")).alias("n_pred"), F.sum(F.col("both") + F.col("missing")).alias("n_gold"), F.avg("iou").alias("mean_iou"))
    return rounded(out, "mean_iou").select("nation", *big("figures", "matched", "n_pred", "n_gold"), "mean_iou")
