"""The reaction graph as node and edge tables; ids are hashes of (label, key), edges are keyed by (src, dst, type)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crucible.functions import similarity
from crucible.scratch import in_parts, written

#: column of the database, node label, edge type, from the reaction or to it
ROLES = (("PRODUCTS", "Molecule", "HAS_PRODUCT", True), ("REACTANTS", "Molecule", "IS_REACTANT_OF", False), ("SOLVENT", "Solvent", "USES_SOLVENT", True), ("CATALYST", "Catalyst", "USES_CATALYST", True), ("REAGENT", "Reagent", "USES_REAGENT", True), ("REF", "Reference", "REPORTS", False))


def node_id(label: Column | str, key: Column | str) -> Column:
    label = F.lit(label) if isinstance(label, str) else label
    return F.xxhash64(label, F.col(key) if isinstance(key, str) else key)


def keyed_edges(db: DataFrame, key: str = "REACTION", roles=ROLES) -> DataFrame:
    """(type, label, reaction, key, out) of a reaction database: its edges by the keys of their ends, ``out`` where it leads from the reaction.

    Dotted columns hold several names. The database is read once for all kinds of edges; these are written, and made distinct in parts of bounded size.
    """
    names = lambda c: F.array_distinct(F.filter(F.split(c, r"\."), lambda x: x != ""))
    edge = lambda label, kind, out: lambda x: F.struct(F.lit(kind).alias("type"), F.lit(label).alias("label"), x.alias("key"), F.lit(out).alias("out"))
    none = F.array().cast("array<struct<type: string, label: string, key: string, out: boolean>>")
    each = [F.coalesce(F.transform(names(c), edge(label, kind, out)), none) for c, label, kind, out in roles if c in db.columns]
    rows = db.select(F.col(key).alias("reaction"), F.explode(F.concat(*each)).alias("_e"))
    rows = written(rows.select("_e.type", "_e.label", "reaction", "_e.key", "_e.out"), "edge-rows")
    return in_parts(rows, rows.count(), "reaction", "key").distinct()


def nodes_and_edges(db: DataFrame, key: str = "REACTION", roles=ROLES) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, label, key; edges: src, dst, type) of a reaction database; dotted columns hold several names."""
    keyed = keyed_edges(db, key, roles)
    reaction = db.select(F.lit("Reaction").alias("label"), F.col(key).alias("key"))
    nodes = reaction.union(keyed.select("label", "key")).distinct().select(node_id(F.col("label"), "key").alias("id"), "label", "key")
    here, there = node_id("Reaction", "reaction"), node_id(F.col("label"), "key")
    return nodes, keyed.select(F.when(F.col("out"), here).otherwise(there).alias("src"), F.when(F.col("out"), there).otherwise(here).alias("dst"), "type").distinct()


def precedes(edges: DataFrame) -> DataFrame:
    """(src, dst): a reaction makes what another consumes. An equi-join on the molecule, which adaptive execution splits where it is common.

    Two reactions that share several molecules are paired at the least of them, by the lists of what each makes and consumes, so pairs are
    not moved again to be made distinct.
    """
    made = edges.where("type = 'HAS_PRODUCT'").select("src", F.col("dst").alias("molecule"))
    used = edges.where("type = 'IS_REACTANT_OF'").select(F.col("src").alias("molecule"), "dst")
    listed = lambda side, c, name: side.groupBy(c).agg(F.collect_set("molecule").alias(name)).select(c, name, F.explode(name).alias("molecule"))
    makers = listed(made.join(used.select("molecule").distinct(), "molecule", "left_semi"), "src", "_m")
    met = makers.join(listed(used, "dst", "_u"), "molecule").where("src != dst")
    once = F.when((F.size("_m") == 1) | (F.size("_u") == 1), F.lit(True)).otherwise(F.array_min(F.array_intersect("_m", "_u")) == F.col("molecule"))
    return met.where(once).select("src", "dst")


def precedes_counts(edges: DataFrame) -> DataFrame:
    """(molecule, makers, users) of each molecule that some reactions make and others consume: ``precedes`` without its pairs, which for a
    common molecule are makers times users."""
    side = edges.where("type IN ('HAS_PRODUCT', 'IS_REACTANT_OF')").select(F.when(F.col("type") == "HAS_PRODUCT", F.col("dst")).otherwise(F.col("src")).alias("molecule"), (F.col("type") == "HAS_PRODUCT").alias("_made"))
    return side.groupBy("molecule").agg(F.count_if("_made").alias("makers"), F.count_if(~F.col("_made")).alias("users")).where("makers > 0 AND users > 0")


def khop(edges: DataFrame, start: DataFrame, k: int) -> DataFrame:
    """(node, hops) within k steps of the start nodes, each at its least distance. One join a step, against nodes not seen before.

    Each step's front is written, so no step computes those before it again.
    """
    seen = written(start.select("node").distinct().withColumn("hops", F.lit(0)), "front")
    front = seen
    for step in range(1, k + 1):
        reached = front.join(edges, front.node == edges.src).select(F.col("dst").alias("node")).distinct()
        front = written(reached.join(seen, "node", "left_anti").withColumn("hops", F.lit(step)), "front")
        seen = seen.union(front)
    return seen


def paper_counts(db: DataFrame, pattern: str = "PATTERN", template: str = "TEMPLATE", reference: str = "REF") -> DataFrame:
    """Distinct references of each (pattern, template), zeros included."""
    return db.groupBy(pattern, template).agg(F.countDistinct(F.nullif(reference, F.lit(""))).alias("papers"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts by node label and edge type."""
    return nodes.groupBy(F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("count")).select(F.lit("node").alias("kind"), "name", "count").union(edges.groupBy(F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("count")).select(F.lit("edge").alias("kind"), "name", "count"))


def reactions_by(nodes: DataFrame, edges: DataFrame, wanted: Column) -> DataFrame:
    """Reactions that meet a condition, with the first (by key) of each of their conditions."""
    found = nodes.where((F.col("label") == "Reaction") & wanted)
    used = edges.where(F.startswith("type", F.lit("USES_"))).join(nodes.select(F.col("id").alias("dst"), F.col("key").alias("name")), "dst")
    wide = used.groupBy("src").pivot("type", ["USES_SOLVENT", "USES_CATALYST", "USES_REAGENT"]).agg(F.min("name"))
    return found.join(wide, found.id == wide.src, "left").drop("src")


def similar_reactions(nodes: DataFrame, query_fp: Column, metric: str, least: float, products_only: bool = False) -> DataFrame:
    """Reaction nodes (with ``fp``) at least ``least`` similar to a fingerprint, by the whole or its product half."""
    fp, q = (similarity.product_half(F.col("fp")), similarity.product_half(query_fp)) if products_only else (F.col("fp"), query_fp)
    return nodes.where("label = 'Reaction'").withColumn("score", similarity.similarity(fp, q, metric)).where(F.col("score") >= least)


def align_labels(labels: DataFrame, structures: DataFrame) -> DataFrame:
    """Structures by the labels found in nearby text (``12``, ``3a``); the last structure of a label wins."""
    named = labels.select("image", "pair", F.explode(F.regexp_extract_all("text", F.lit(r"\b(\d+[a-zA-Z]{0,2})\b"), F.lit(1))).alias("label"))
    return named.join(structures, ["image", "pair"]).groupBy("image", "label").agg(F.max_by("smiles", F.col("pair")).alias("smiles"))


def ranked_in(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def least_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number reachable from each of n by the links (a, b): roots are hooked onto smaller ones, then paths are halved."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def solved(links: DataFrame) -> DataFrame:
    """Components of a bounded table of links, in one task; ends of links are numbers."""

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches]
        a, b = (np.concatenate([np.zeros(0, np.int64), *side]) for side in (zip(*parts, strict=True) if parts else ((), ())))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = least_reachable(len(nodes), at[: len(a)], at[len(a) :])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "component"])

    return links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).repartition(1).mapInArrow(solve, "node long, component long")


def components(links: DataFrame, most_rounds: int = 40, few: int = 1_000_000) -> DataFrame:
    """Connected components of links (a, b) as rows (node, component), component the smallest node reachable; nodes without links are absent.

    At most ``few`` links of numbers (16 MB) are solved in one task. More alternate large-star and small-star steps (Kiveris et al., "Connected
    Components in MapReduce and Beyond"), each written to the shared folder. Hub nodes don't gather in one task: minima are partial
    aggregates, and the joins are plain equi-joins that adaptive execution splits.
    """
    edge = lambda a, b: [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]
    now = written(links.where(F.col("a") != F.col("b")).select(*edge("a", "b")).distinct(), "links")
    if {kind for _, kind in now.dtypes} <= {"int", "bigint"} and now.count() <= few:
        return solved(now).select(*[F.col(c).cast(now.dtypes[0][1]) for c in ("node", "component")])
    seen = None
    for _ in range(most_rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        now = written(both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        low = now.groupBy("a").agg(F.min("b").alias("m"))
        star = now.join(low, "a").where(F.col("b") != F.col("m")).select(*edge("b", "m")).union(low.select("a", F.col("m").alias("b"))).distinct()
        now = written(star, "small-star")
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
