"""Publishing and deleting chapters, seeds, paged texts, and draws whose rules a test can hold."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from graphloom.operators import chapters, encounters, publish
from graphloom.plans import registry
from graphloom.sources import seeds

FOLDER = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def tables(spark, foreign=False):
    make = lambda name, data: spark.createDataFrame(data, publish.SCHEMAS[name])
    edges = [("a", "KNOWS", "b", "one", "accepted", None)] + ([("c", "KNOWS", "a", "two", None, None)] if foreign else [])
    return {
        "nodes": make("nodes", [("a", "Ann", "NPC"), ("b", "Bo", "NPC"), ("c", "Cid", "NPC")]),
        "owners": make("owners", [("a", "one"), ("b", "one"), ("b", "two"), ("c", "two")]),
        "aliases": make("aliases", [("a", "Ann"), ("b", "Bo"), ("c", "Cid")]),
        "sections": make("sections", [("s1", "one", 0, "One"), ("s2", "two", 0, "Two")]),
        "describes": make("describes", [("s1", "a"), ("s2", "c")]),
        "edges": make("edges", edges),
        "mentions": make("mentions", [("a", "s1", "one", 2), ("b", "s1", "one", 1), ("b", "s2", "two", 1)]),
    }


def test_a_chapter_goes_with_what_only_it_owns(spark):
    left, account = publish.without_chapter(tables(spark), "one")
    assert rows(left["nodes"], "id") == [("b",), ("c",)] and rows(left["aliases"], "entity_id") == [("b",), ("c",)]
    assert rows(left["describes"], "section_id") == [("s2",)] and left["edges"].isEmpty()
    assert dict(rows(account, "table", "deleted")) == {"nodes": 1, "owners": 2, "aliases": 1, "sections": 1, "describes": 1, "edges": 1, "mentions": 2}


def test_foreign_edges_hold_a_chapter(spark):
    with pytest.raises(ValueError, match="other chapters"):
        publish.without_chapter(tables(spark, foreign=True), "one")


def test_a_chapter_is_written_once_and_read_as_a_version(spark, tmp_path):
    held = tables(spark)
    with pytest.raises(ValueError, match="there already"):
        publish.with_chapter(held, held, "one")
    empty = publish.current(spark, str(tmp_path))
    assert empty["nodes"].isEmpty()
    new = {k: (df.where("chapter = 'one'") if "chapter" in df.columns else df) for k, df in held.items()} | {"nodes": held["nodes"].where("id != 'c'"), "aliases": held["aliases"].where("entity_id != 'c'"), "describes": held["describes"].where("section_id = 's1'")}
    publish.publish(publish.with_chapter(empty, new, "one"), str(tmp_path))
    assert rows(publish.current(spark, str(tmp_path))["owners"], "id", "chapter") == [("a", "one"), ("b", "one")]
    with pytest.raises(ValueError, match="no node"):
        publish.with_chapter(empty, new | {"nodes": held["nodes"].where("id = 'a'")}, "one")
    assert rows(publish.current(spark, str(tmp_path))["nodes"], "id") == [("a",), ("b",)]  # a failed write is not seen
    # Two writers start from version 1: the second is refused, and what the first wrote stays.
    publish.publish(empty, str(tmp_path), base=1)
    with pytest.raises(FileExistsError):
        publish.publish(new, str(tmp_path), base=1)
    assert publish.current(spark, str(tmp_path))["nodes"].isEmpty()


def test_seeds(spark):
    nodes, edges = seeds.seed(spark, {"a.yaml": "nodes:\n- {name: Ann, type: npc}\n- {name: Inn, type: location, aliases: [Tavern]}\nedges:\n- {source: ann, type: located_in, target: Inn}\n"})
    assert rows(nodes, "name", "entity_type", "aliases") == [("Ann", "NPC", []), ("Inn", "LOCATION", ["Tavern"])]
    assert rows(edges, "source", "rel_type", "target") == [("ann", "LOCATED_IN", "Inn")]
    for body, said in (("nodes: [{name: x}]", "name and a type"), ("nodes: [{name: x, type: t}]\nedges: [{source: x, type: r, target: y}]", "no node"), ("nodes: [{name: x, type: t}, {name: X, type: T}]", "twice")):
        with pytest.raises(ValueError, match=said):
            seeds.seed(spark, {"f.yaml": body})
    assert rows(seeds.listed_names(spark, {"f.yaml": "a: [x, y]\nb: z\n", "g.yaml": "[c]"}), "name", "value") == [("a", "x"), ("a", "y"), ("b", "z"), ("c", None)]


def test_paged_texts_have_to_add_up(spark):
    blocks = spark.createDataFrame([("c", 3, "\ndef", 7), ("c", 0, "abc", 7), ("d", 0, "x", None)], "chapter string, offset int, content string, total int")
    assert rows(chapters.reassembled(blocks), "chapter", "text") == [("c", "abc\ndef"), ("d", "x")]
    with pytest.raises(ValueError, match="add up"):
        chapters.reassembled(blocks.where("offset = 0"))


def test_conditions_and_npc_turns(spark):
    changes = spark.createDataFrame([(1, 1, "add", "prone"), (1, 2, "add", "blind"), (1, 3, "remove", "prone"), (1, 4, "add", "prone"), (1, 5, "add", "blind"), (2, 1, "add", "x"), (2, 2, "remove", "x")], "key int, seq int, op string, condition string")
    assert rows(encounters.conditions(changes), "key", "conditions") == [(1, "blind,prone")]
    order = spark.createDataFrame([(1, 0, 1, True, 5), (1, 1, 1, False, 5), (1, 2, 1, False, 0), (1, 3, 1, False, 4), (2, 0, 0, False, 1), (2, 1, 0, False, 1)], "combat_id int, turn int, current int, is_player boolean, hp int")
    assert rows(encounters.npc_turns(order), "combat_id", "turn", "nth") == [(1, 3, 1), (2, 0, 2), (2, 1, 1)]


@given
def test_encounters_stay_within_their_budget(spark):
    registry.load()
    found = registry.QUERIES["generated_encounters"](spark, FOLDER).collect()
    xp = {f"NATION_{r.n_nationkey}": 25 * (1 + r.n_nationkey) for r in spark.read.parquet(f"{FOLDER}/nation.parquet").collect()}
    names = {r.n_name: 25 * (1 + r.n_nationkey) for r in spark.read.parquet(f"{FOLDER}/nation.parquet").collect()} | xp
    for r in found:
        picked = [p for p in r.picked.split(",") if p]
        spent = sum(names[p] for p in picked)
        assert r.xp == spent <= r.budget and len(picked) <= 10
        factor = 1.0 if len(picked) <= 1 else 1.5 if len(picked) <= 2 else 2.0 if len(picked) <= 6 else 2.5
        assert r.worth == int(spent * factor)
    again = registry.QUERIES["generated_encounters"](spark, FOLDER).collect()
    assert sorted(found) == sorted(again)


@given
def test_shops_draw_different_items_of_their_own(spark):
    registry.load()
    found = registry.QUERIES["generated_shops"](spark, FOLDER).collect()
    brand = {r.p_partkey: r.p_brand for r in spark.read.parquet(f"{FOLDER}/part.parquet").collect()}
    for shop in {r.shop_id for r in found}:
        items = [r for r in found if r.shop_id == shop]
        own = sum(b == f"Brand#1{1 + shop % 5}" for b in brand.values())
        assert len({r.item_id for r in items}) == len(items) == min(8, own)
        assert all(brand[r.item_id] == f"Brand#1{1 + shop % 5}" and 1 <= r.quantity <= 4 for r in items)


@given
def test_spans_kept_match_their_definition(spark):
    registry.load()
    kept = {(r.doc_id, r.start, r.end) for r in registry.QUERIES["spans_kept"](spark, FOLDER).collect()}
    by_user: dict[int, list[tuple[int, int, float]]] = {}
    for r in spark.read.parquet(f"{FOLDER}/events.parquet").collect():
        by_user.setdefault(r.user_id, []).append((r.event_id * 3, r.event_id * 3 + r.event_id % 400, r.event_id % 7 / 7))
    want = set()
    for user, spans in by_user.items():
        end = -1
        for a, b, _ in sorted(spans, key=lambda s: (s[0], -s[2])):
            if a >= end:
                want.add((user, a, b))
                end = b
    assert kept == want


def test_cells_have_as_many_letters_as_they_need(spark):
    def letters(n):
        return ("" if n < 26 else letters(n // 26 - 1)) + chr(65 + n % 26)

    xs = [0, 1, 25, 26, 27, 701, 702, 703, 18_277, 18_278, 475_253, 475_254, 2_147_483_647]
    found = spark.createDataFrame([(x, 4) for x in xs], "x int, y int").select("x", encounters.cell(F.col("x"), F.col("y")).alias("c")).collect()
    assert {r.x: r.c for r in found} == {x: letters(x) + "5" for x in xs}
