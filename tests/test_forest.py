"""Labels and nearest marks of forests against walks of every chain."""

from __future__ import annotations

import random

import pytest

from graphloom.operators import forest

EDGE = "id string, parent string"


def chain(up: dict, node: str) -> list[str]:
    """The parents of a node until there is none or one was passed."""
    seen = [node]
    while up.get(seen[-1]) is not None and up[seen[-1]] not in seen:
        seen.append(up[seen[-1]])
    return seen[1:]


def on_cycle(up: dict, node: str) -> bool:
    last = [node, *chain(up, node)][-1]
    return up.get(last) is not None


@pytest.mark.parametrize("seed", [1, 2])
def test_labels_and_nearest(spark, seed):
    draw = random.Random(seed)
    # A hub holds a third of all nodes; a chain, a random forest and two cycles with a tail each.
    edges = [(f"h{i}", "hub") for i in range(60)] + [(f"c{i}", f"c{i - 1}") for i in range(1, 50)] + [(f"r{i}", f"r{draw.randrange(i)}") for i in range(1, 60)]
    edges += [("x", "y"), ("y", "x"), ("tail", "x"), ("self", "self"), ("below", "self"), ("hub", None), ("lone", None)]
    up = dict(edges)
    nodes = {n for e in edges for n in e if n}
    found = {r.id: r for r in forest.labels(spark.createDataFrame([*edges, edges[0], (None, "hub")], EDGE).repartition(3)).collect()}
    assert set(found) == nodes
    for a in nodes:
        if on_cycle(up, a):
            assert found[a].root is None and found[a].low is None and found[a].high is None
            continue
        above = chain(up, a)
        assert found[a].root == ([a] + above)[-1]
        assert (found[a].high - found[a].low - 1) // 2 == sum(a in chain(up, b) for b in nodes if not on_cycle(up, b))
        within = {b for b in nodes if not on_cycle(up, b) and found[b].root == found[a].root and found[b].low < found[a].low and found[a].high < found[b].high}
        assert within == set(above)
    marks = {n for n in nodes if draw.random() < 0.2} | {"x", "self"}
    near = {r.id: r.near for r in forest.nearest(spark.createDataFrame(edges, EDGE), spark.createDataFrame([(m,) for m in marks], "id string")).collect()}
    assert near == {n: next((a for a in chain(up, n) if a in marks), None) for n in nodes}


def test_pairs_and_empty_tables(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "a"), ("e", "e")], EDGE)
    pairs = spark.createDataFrame([("a", "c"), ("c", "a"), ("b", "d"), ("a", "a"), ("a", "e"), ("a", None), ("e", "e")], "o string, i string")
    held = forest.labelled(pairs, forest.labels(edges), "o", "i").where(forest.inside("o", "i"))
    assert [(r.o, r.i) for r in held.collect()] == [("a", "c")]
    empty = spark.createDataFrame([], EDGE)
    assert forest.labels(empty).collect() == [] and forest.nearest(empty, empty.select("id")).collect() == []
