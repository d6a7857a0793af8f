"""An order of the nodes of a weighted graph that avoids backward weight: strongly connected components, layers of the condensed graph, greedy inside."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crucible.operators.matching import per_group
from crucible.operators.ranking import numbered
from crucible.scratch import written


def strong_components(edges: DataFrame, most_rounds: int = 500) -> DataFrame:
    """(node, component) of directed edges (a, b): the greatest node of its strongly connected component. Nodes are of any ordered type.

    Nodes that no edge enters, or none leaves, are components of their own and go first, round by round. For the rest the greatest node that
    reaches each is spread forward until it settles; the nodes that reach such a greatest node back, among those that carry it, are its
    component (Orzan's colouring). What is left goes round again. All steps are joins of edges with written rounds, none gathers a component.
    """
    spark = edges.sparkSession
    nodes = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), "graph-nodes")
    links = written(edges.where("a != b").select("a", "b").distinct(), "graph-links")
    done: list[DataFrame] = []
    for _ in range(most_rounds):
        # trimming
        inner = links.select(F.col("a").alias("node")).distinct().join(links.select(F.col("b").alias("node")).distinct(), "node")
        kept = written(inner, "inner-nodes")
        gone = nodes.join(kept, "node", "left_anti")
        if not gone.isEmpty():
            done.append(written(gone.select("node", F.col("node").alias("component")), "single-nodes"))
            nodes = kept
            links = written(_within(links, nodes), "graph-links")
            continue
        if nodes.isEmpty():
            break
        # the greatest node that reaches each, then back from it
        colour = _settled(nodes.select("node", F.col("node").alias("colour")), links, most_rounds)
        inside = written(links.join(_as(colour, "a", "_ca"), "a").join(_as(colour, "b", "_cb"), "b").where("_ca = _cb").select("a", "b"), "colour-links")
        front = written(colour.where("node = colour"), "front")
        back = front
        for _ in range(most_rounds):
            step = inside.join(_as(front, "b", "colour"), "b").select(F.col("a").alias("node"), "colour").distinct()
            front = written(step.join(back.select("node"), "node", "left_anti"), "front")
            if front.isEmpty():
                break
            back = written(back.union(front), "reached-back")
        done.append(back.select("node", F.col("colour").alias("component")))
        nodes = written(nodes.join(back.select("node"), "node", "left_anti"), "inner-nodes")
        links = written(_within(links, nodes), "graph-links")
        if nodes.isEmpty():
            break
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    out = spark.createDataFrame([], nodes.select("node", F.col("node").alias("component")).schema)
    for part in done:
        out = out.union(part)
    return out


def _as(colour: DataFrame, node: str, name: str) -> DataFrame:
    return colour.select(F.col("node").alias(node), F.col("colour").alias(name))


def _within(links: DataFrame, nodes: DataFrame) -> DataFrame:
    side = lambda c: nodes.select(F.col("node").alias(c))
    return links.join(side("a"), "a", "left_semi").join(side("b"), "b", "left_semi")


def _settled(colour: DataFrame, links: DataFrame, most_rounds: int) -> DataFrame:
    """The greatest colour that reaches each node along the links."""
    now = written(colour, "colours")
    for _ in range(most_rounds):
        along = links.join(_as(now, "a", "colour"), "a").select(F.col("b").alias("node"), "colour")
        new = written(now.union(along).groupBy("node").agg(F.max("colour").alias("colour")), "colours")
        if new.join(now.withColumnRenamed("colour", "_old"), "node").where("colour != _old").isEmpty():
            return new
        now = new
    raise RuntimeError(f"colours have not settled after {most_rounds} rounds")


def layers(edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(node, layer) of an acyclic graph: nodes that no edge enters are layer 0, and an edge always leads to a later layer."""
    left = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), "dag-nodes")
    links = written(edges.select("a", "b").distinct(), "dag-links")
    out = None
    for k in range(most_rounds):
        if left.isEmpty():
            break
        free = written(left.join(links.select(F.col("b").alias("node")).distinct(), "node", "left_anti").withColumn("layer", F.lit(k)), "layer")
        if free.isEmpty():
            raise ValueError("the graph has a cycle")
        out = free if out is None else out.union(free)
        left = written(left.join(free, "node", "left_anti").select("node"), "dag-nodes")
        links = written(links.join(free.select(F.col("node").alias("a")), "a", "left_anti"), "dag-links")
    return out if out is not None else left.withColumn("layer", F.lit(0))


def greedy_order(a: list, b: list, weight: list[float]) -> list:
    """Nodes of one component in an order that keeps little weight of edges (earlier a, later b is kept).

    The node with the most outgoing less incoming weight among those left goes first, ties by name; or all by this weight at once, if that
    keeps more. Edges between the same nodes in both directions count as they are.
    """
    out: dict = {}
    into: dict = {}
    net: dict = {}
    for x, y, w in zip(a, b, weight, strict=True):
        out.setdefault(x, []).append((y, w))
        into.setdefault(y, []).append((x, w))
        net[x] = net.get(x, 0) + w
        net[y] = net.get(y, 0) - w
    at_once = sorted(net, key=lambda n: (-net[n], n))
    heap = [(-v, n) for n, v in net.items()]
    heapq.heapify(heap)
    now, order, placed = dict(net), [], set()
    while heap:
        v, n = heapq.heappop(heap)
        if n in placed or -v != now[n]:
            continue
        placed.add(n)
        order.append(n)
        for edges, sign in ((out, 1), (into, -1)):
            for m, w in edges.get(n, ()):
                if m not in placed:
                    now[m] += sign * w  # an edge n -> m no longer counts against m, one m -> n no longer for it
                    heapq.heappush(heap, (-now[m], m))

    def kept(nodes: list) -> float:
        at = {n: k for k, n in enumerate(nodes)}
        return sum(w for x, y, w in zip(a, b, weight, strict=True) if at[x] < at[y])

    return order if kept(order) >= kept(at_once) else at_once


def class_order(edges: DataFrame, all_classes: DataFrame | None = None) -> DataFrame:
    """(class, component, layer, position): an order of classes for false positives (pattern_class, true_class, weight).

    A class should be tried before the classes whose patterns misfire on its reactions. Strongly connected classes form one component;
    components come by the layers of the condensed graph, so all weight between components is avoided, and an acyclic graph's weight wholly.
    Inside a component the order is greedy and avoids no less than the order by net weight does; it is found in one task from the
    component's edges, which the number of classes bounds. Of one layer components come by name. Classes without edges (of
    ``all_classes``: class) come last, by name.
    """
    rows = written(edges.where("pattern_class != true_class").groupBy(F.col("true_class").alias("a"), F.col("pattern_class").alias("b")).agg(F.sum("weight").cast("double").alias("w")), "order-edges")
    strong = written(strong_components(rows), "strong-components")
    side = lambda c, name: strong.select(F.col("node").alias(c), F.col("component").alias(name))
    linked = written(rows.join(side("a", "_ca"), "a").join(side("b", "_cb"), "b"), "component-edges")
    dag = linked.where("_ca != _cb").select(F.col("_ca").alias("a"), F.col("_cb").alias("b"))
    at = layers(dag).withColumnRenamed("node", "component")

    def inside(group: pd.DataFrame) -> pd.DataFrame:
        order = greedy_order(group["a"].tolist(), group["b"].tolist(), group["w"].tolist())
        return pd.DataFrame({"node": order, "_k": range(len(order))})

    kind = strong.schema["node"].dataType.simpleString()
    inner = per_group(linked.where("_ca = _cb").select("_ca", "a", "b", "w"), ["_ca"], inside, f"node {kind}, _k int")
    found = strong.join(at, "component", "left").join(inner, "node", "left").select(F.col("node").alias("class"), "component", F.coalesce("layer", F.lit(0)).alias("layer"), F.coalesce("_k", F.lit(0)).alias("_k"))
    if all_classes is not None:
        rest = all_classes.select("class").distinct().join(found.select("class"), "class", "left_anti")
        found = found.union(rest.select("class", F.col("class").alias("component"), F.lit(None).cast("int").alias("layer"), F.lit(0)))
    return numbered(found, [], [F.asc_nulls_last("layer"), "component", "_k", "class"], "position").select("class", "component", "layer", "position")


def avoided(edges: DataFrame, order: DataFrame) -> DataFrame:
    """(weight, avoided) of an order: false positives whose true class comes first are avoided."""
    at = lambda c, name: order.select(F.col("class").alias(c), F.col("position").alias(name))
    met = edges.where("pattern_class != true_class").join(at("true_class", "_t"), "true_class").join(at("pattern_class", "_p"), "pattern_class")
    return met.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("weight"), F.coalesce(F.sum(F.when(F.col("_t") < F.col("_p"), F.col("weight"))), F.lit(0)).alias("avoided"))
