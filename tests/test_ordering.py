"""Strong components, layers and class orders of many small graphs at once, against plain versions."""

import random

import pytest

from crucible.operators import ordering, tiers


def graphs(seed=1, n=30):
    """(true class, pattern class, weight) of disjoint graphs, some acyclic, one long cycle, one chain; names begin with the graph."""
    rng, rows = random.Random(seed), {}
    for g in range(n):
        k = rng.randint(2, 8)
        for _ in range(rng.randint(1, 14)):
            a, b = rng.randrange(k), rng.randrange(k)
            if g % 3 == 0:
                a, b = min(a, b), max(a, b)
            rows[f"g{g:02}.{a}", f"g{g:02}.{b}"] = rng.choice([1, 1, 2, 5])
    rows |= {(f"r.{k}", f"r.{(k + 1) % 6}"): 1 for k in range(6)} | {(f"s.{k}", f"s.{k + 1}"): 1 for k in range(5)}
    return [(a, b, w) for (a, b), w in rows.items()]


def reachable(rows):
    out = {x: {x} for a, b, _ in rows for x in (a, b)}
    while True:
        more = {x: set().union(s, *({b} for a, b, _ in rows if a in s)) for x, s in out.items()}
        if more == out:
            return out
        out = more


def test_strong_components_and_orders(spark):
    rows = graphs()
    edges = spark.createDataFrame([(b, a, w) for a, b, w in rows], "pattern_class string, true_class string, weight long").repartition(3)
    reach = reachable(rows)
    want = {x: max(y for y in reach[x] if x in reach[y]) for x in reach}
    classes = spark.createDataFrame([("aa",), ("zz",), (rows[0][0],)], "class string")
    order = {r["class"]: r for r in ordering.class_order(edges, classes).collect()}
    linked = {x for a, b, _ in rows if a != b for x in (a, b)}
    assert {x: r.component for x, r in order.items() if x in linked} == {x: c for x, c in want.items() if x in linked}
    assert sorted(r.position for r in order.values()) == list(range(1, len(order) + 1))
    assert [x for x, _ in sorted(order.items(), key=lambda i: i[1].position)][-2:] == ["aa", "zz"]
    net = {r["class"]: r.position for r in tiers.precedence(edges.where("pattern_class != true_class")).collect()}
    assert len({x.split(".")[0] for x in linked}) > 25
    for g in {x.split(".")[0] for x in linked}:
        own = [(a, b, w) for a, b, w in rows if a.startswith(g + ".") and a != b]
        kept = sum(w for a, b, w in own if order[a].position < order[b].position)
        assert kept >= sum(w for a, b, w in own if net[a] < net[b])
        assert all(order[a].position < order[b].position for a, b, _ in own if want[a] != want[b])
        if all(want[a] != want[b] for a, b, _ in own):
            assert kept == sum(w for _, _, w in own)
    whole = ordering.avoided(edges, ordering.class_order(edges)).first()
    assert whole.weight == sum(w for a, b, w in rows if a != b)


def test_layers_and_cycles(spark):
    dag = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (5, 3)], "a long, b long")
    assert {(r.node, r.layer) for r in ordering.layers(dag).collect()} == {(1, 0), (5, 0), (2, 1), (3, 2)}
    with pytest.raises(ValueError, match="cycle"):
        ordering.layers(spark.createDataFrame([(1, 2), (2, 1)], "a long, b long"))
    assert ordering.layers(dag.where("a < 0")).count() == 0
