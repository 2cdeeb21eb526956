from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphloom.functions import ontology
from graphloom.operators import candidates, graph, upserts

EDGE = "src string, rel_type string, dst string"


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_trails_use_an_edge_once(spark):
    edges = spark.createDataFrame([("a", "R", "b"), ("b", "R", "c"), ("a", "S", "a")], EDGE)
    start = spark.createDataFrame([("a",)], "id string")
    found = rows(graph.neighbors(edges, start, 2), "id", "path", "length")
    assert found == [("a", "S", 1), ("b", "R", 1), ("b", "S>R", 2), ("c", "R>R", 2)]
    assert rows(graph.neighbors(edges, spark.createDataFrame([("b",)], "id string"), 1, directed=True), "id") == [("c",)]


def test_tenancy_keeps_null_types(spark):
    nodes = spark.createDataFrame([("1", "NPC"), ("2", None), ("3", "ITEM"), ("4", "NPC")], "id string, entity_type string")
    own = spark.createDataFrame([("4", "t")], "id string, tenant string")
    assert rows(graph.shared_or_owned(nodes, own, "t", ("NPC",)), "id") == [("2",), ("3",), ("4",)]


def test_overlay_and_shadow(spark):
    shared = spark.createDataFrame([("1", "a", 5), ("2", "b", 6)], "id string, name string, hp int")
    patch = spark.createDataFrame([("1", None, 1)], "canon_id string, name string, hp int")
    assert rows(graph.overlay(shared, patch, ("name", "hp")), "id", "name", "hp", "patched") == [("1", "a", 1, True), ("2", "b", 6, False)]
    canon = spark.createDataFrame([("1", "RESOLVES_TO", "x"), ("1", "KNOWS", "y"), ("2", "RESOLVES_TO", "z")], EDGE)
    camp = spark.createDataFrame([("c1", "1", "RESOLVES_TO", "w"), ("c2", "2", "KNOWS", "v")], "src string, source_canon_id string, rel_type string, dst string")
    assert rows(graph.shadowed(canon, camp, ontology.RESOLVABLE), "src", "dst") == [("1", "y"), ("2", "z"), ("c1", "w"), ("c2", "v")]


def test_reveal_needs_both_ends(spark):
    nodes = spark.createDataFrame([("a", 1), ("b", 3), ("c", None), ("d", 2)], "id string, revealed int")
    edges = spark.createDataFrame([("a", "d", 1), ("a", "b", 1), ("a", "c", 1), ("d", "a", None)], "src string, dst string, revealed int")
    assert rows(graph.revealed(edges, nodes, 2), "src", "dst") == [("a", "d")]


def test_ancestors_stop_at_cycles(spark):
    parents = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", None)], "id string, parent string")
    start = spark.createDataFrame([("a",), ("d",)], "id string")
    assert rows(graph.ancestors(parents, start), "start", "id", "depth") == [("a", "b", 1), ("a", "c", 2)]


def test_constraints(spark):
    edges = spark.createDataFrame([("i", "OWNS", "n"), ("n", "OWNS", "i"), ("q", "KNOWS", "n"), ("x", "OWNS", "i"), ("i", "CONTAINS", "i2")], EDGE)
    types = spark.createDataFrame([("i", "ITEM"), ("n", "NPC"), ("q", "QUEST"), ("i2", "ITEM")], "id string, entity_type string")
    found = rows(candidates.constraint_report(edges, types, ontology.relation_types(spark)), "src", "rel_type", "reason", "reversal_would_pass")
    assert found == [("i", "OWNS", "both", True), ("q", "KNOWS", "domain", False)]


def test_every_relation_of_a_layer_is_in_one_layer():
    names = [r for rs in ontology.LAYERS.values() for r in rs]
    assert len(names) == len(set(names)) and set(ontology.ALLOWED) == set(names)


def test_consensus_counts_samples_once(spark):
    seen = spark.createDataFrame([("A", 1, 3, "late"), ("A", 1, 1, "first"), ("A", 2, 2, "mid"), ("B", 1, 4, "b")], "name string, sample_id int, seq int, text string")
    assert rows(candidates.consensus(seen, ["name"], ["text"], 2)) == [("A", 2, "first")]
    assert rows(candidates.vote_histogram(seen, ["name"])) == [(1, 1), (2, 1)]


def test_conflicts(spark):
    edges = spark.createDataFrame([("a", "CONTAINS", "b", "accepted"), ("a", "LOCATED_IN", "b", None), ("c", "CONTAINS", "d", None), ("c", "LOCATED_IN", "d", "proposed"), ("b", "CONTAINS", "a", None)], EDGE + ", status string")
    assert rows(candidates.exclusive_conflicts(edges, ontology.EXCLUSIVE)) == [("a", "b", "CONTAINS", "LOCATED_IN"), ("c", "d", "CONTAINS", "LOCATED_IN")]
    marked = rows(candidates.marked_conflicts(edges, ontology.EXCLUSIVE), "src", "rel_type", "status")
    assert marked == [("a", "CONTAINS", "accepted"), ("a", "LOCATED_IN", "conflicted"), ("b", "CONTAINS", "proposed"), ("c", "CONTAINS", "conflicted"), ("c", "LOCATED_IN", "conflicted")]


def test_merge(spark):
    nodes = spark.createDataFrame([("1", "The Inn"), ("2", "inn"), ("3", "Gate")], "id string, name string")
    from graphloom.functions.text import duplicate_key

    plan = candidates.merge_plan(nodes, duplicate_key(F.col("name")))
    assert rows(plan) == [("2", "1")]
    edges = spark.createDataFrame([("1", "KNOWS", "2"), ("2", "KNOWS", "3"), ("1", "KNOWS", "3")], EDGE)
    assert rows(candidates.repoint(edges, plan)) == [("1", "KNOWS", "3")]
    held = spark.createDataFrame([("1", 7, [4, 9]), ("2", 7, [9, 1]), ("3", 7, [2])], "entity_id string, section_id int, offsets array<int>")
    assert {r.entity_id: r.offsets for r in candidates.fold_mentions(held, plan).collect()} == {"1": [1, 4, 9], "3": [2]}


def test_drops_add_up(spark):
    made = spark.range(100).select(F.col("id"))
    staged = candidates.staged_drops(made, [("even", F.col("id") % 2 == 0), ("third", F.col("id") % 3 == 0)])
    counts = dict(rows(candidates.accounting(staged)))
    assert counts == {"even": 50, "third": 17, "written": 33} and sum(counts.values()) == 100


def test_status(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "E1"), ("c", None)], "id string, key string")
    edges = spark.createDataFrame([("a", "KNOWS", "b", "accepted"), ("c", "KNOWS", "b", None)], EDGE + ", status string")
    assert rows(candidates.node_status(nodes, edges), "id", "status") == [("a", "accepted"), ("b", "accepted"), ("c", "proposed")]


def test_upserts(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, name string, hp int")
    new = spark.createDataFrame([(2, None, 9), (3, "c", 1)], "id int, name string, hp int")
    assert rows(upserts.upsert(base, new, "id")) == [(1, "a", 5), (2, "b", 9), (3, "c", 1)]
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    edges = spark.createDataFrame([("a", "KNOWS", "b")], EDGE)
    left, kept = upserts.detach_delete(nodes, edges, spark.createDataFrame([("b",)], "id string"))
    assert rows(left) == [("a",)] and kept.count() == 0
    added = upserts.add_edges(edges, spark.createDataFrame([("b", "OWNS", "a"), ("b", "OWNS", "zz"), ("a", "KNOWS", "b")], EDGE), nodes, ontology.relation_types(spark))
    assert rows(added) == [("a", "KNOWS", "b", "social"), ("b", "OWNS", "a", "social")]
    with pytest.raises(ValueError, match="zz"):
        upserts.require_endpoints(spark.createDataFrame([("zz",)], "src string"), "src", nodes)
    labels = "id string, labels array<string>, rung string, is_artifact boolean"
    old = spark.createDataFrame([("a", ["ITEM"], "SITE", True), ("b", ["NPC"], None, False)], labels)
    more = spark.createDataFrame([("a", ["LORE"], None, False), ("c", ["NPC"], "AREA", None)], labels)
    assert rows(upserts.label_union(old, more)) == [("a", ["ITEM", "LORE"], "SITE", True), ("b", ["NPC"], None, False), ("c", ["NPC"], "AREA", False)]
    owned = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2")], "id string, chapter string")
    assert rows(upserts.sole_owned(owned, "1")) == [("a",)]
