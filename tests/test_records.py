from __future__ import annotations

import json

from pyspark.sql import functions as F

from graphloom.operators import records


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_extraction(spark):
    answer = {"entities": [{"type": "npc", "text": "Ann"}, {"type": "ghost", "text": "x"}, {"type": "NPC", "text": ""}, {"type": "ITEM", "text": "the cup", "canonical_name": "Cup"}],
              "relationships": [{"type": "owns", "source": "ann", "target": "Cup", "evidence": "e" * 300}, {"type": "owns", "source": "", "target": "x"}, {"type": "eats", "source": "a", "target": "b"}]}
    frame = spark.createDataFrame([(1, json.dumps(answer)), (2, "not json"), (3, None)], "doc_id long, json string")
    found = records.extracted_entities(frame, ("NPC", "ITEM"))
    assert rows(found, "name", "canonical", "entity_type") == [("Ann", "Ann", "NPC"), ("the cup", "Cup", "ITEM")]
    links = records.extracted_relations(frame, ("OWNS",))
    assert rows(links.withColumn("n", F.length("evidence")), "source", "rel_type", "target", "n") == [("ann", "OWNS", "Cup", 200)]
    known = spark.createDataFrame([(1, "Ann", "a1"), (1, "cup", "c1"), (2, "Ann", "a2")], "doc_id long, name string, id string")
    assert rows(records.endpoints(links, known), "source_id", "target_id") == [("a1", "c1")]


def test_validation(spark):
    made = [(1, '```json\n{"from_canon": [], "invented": []}\n```'), (2, '{"from_canon": []}'), (3, "[1]"), (4, "nope"), (5, '{"from_canon": [], "invented": null}')]
    found = dict(rows(records.validated(spark.createDataFrame(made, "id int, text string")), "id", "problem"))
    assert found == {1: None, 2: "no invented", 3: "not an object", 4: "not JSON", 5: None}


def test_decisions(spark):
    options = spark.createDataFrame([(1, n, "Ann -OWNS-> Cup", "OWNS", "Ann", "Cup") for n in (1, 2, 3, 4)], "batch int, n int, option string, rel_type string, source string, target string")
    answers = spark.createDataFrame([(1, 1, 1, " ann  -owns-> cup"), (1, 2, 1, "NONE"), (1, 3, 2, "none"), (1, 4, 3, "Bob")], "batch int, seq int, n int, answer string")
    assert rows(records.decided(answers, options), "n", "outcome") == [(1, "decided"), (2, "none"), (3, "off_vocabulary"), (4, "unanswered")]
    edges = [("a", "R", "b", None, None, None, True), ("a", "R", "A", "NONE", None, None, True), ("a", "R", "b", "NONE", None, None, True), ("a", "R", "b", "NONE", None, None, False), ("a", "R", "b", "S", "a", "b", True), ("a", "R", "b", "R", "a", "b", True), ("a", "R", "b", "R", "b", "a", True)]
    frame = spark.createDataFrame(edges, "source string, rel_type string, target string, new_rel string, new_source string, new_target string, asked boolean")
    assert [r.outcome for r in records.reclassified(frame).collect()] == ["failed", "self_loop", "declined", "no_relation_legal", "changed", "kept", "flipped"]


def test_messages(spark):
    said = [(1, "g", "!npc Old Bill come here", True, []), (2, "g", "hello bill's friend", False, []), (3, "g", "billow", False, ["app"]), (4, "g", "billow", False, []), (5, "h", "Bill", False, []), (6, "g", "Old Bill!", True, [])]
    messages = spark.createDataFrame(said, "message_id int, guild string, content string, is_dm boolean, mentioned array<string>")
    npcs = spark.createDataFrame([("n", "g", "Old Bill", ["Bill"], "app")], "npc_id string, guild string, name string, aliases array<string>, app_id string")
    assert rows(records.triggers(messages, npcs), "message_id", "trigger") == [(1, "dm_command"), (2, "name_reference"), (3, "direct_mention"), (6, "name_reference")]
    one = spark.range(1)
    lit = F.lit
    got = one.select(*(records.item_mentioned(lit(i), lit(m)) for i, m in (("Potion of Healing", "Any healing here?"), ("Oil of X", "none"), ("Rope", "a ROPE")))).first()
    assert tuple(got) == (True, False, True)
    assert one.select(records.first_command(lit(" Roll 2d6"), (("ro", "first"), ("roll", "second"))).alias("c")).first().c == "first"
    assert one.select(records.allowed_fields(F.create_map(lit("a"), lit("1"), lit("b"), lit("2")), ("a",)).alias("m")).first().m == {"a": "1"}


def test_profiles(spark):
    nodes = spark.createDataFrame([("a", '{"max_hit_points": 7, "speed": 25}', '{"combat_style": "Berserker"}'), ("b", "broken", '{"combat_style": "odd", "retreat_threshold": 0.5}'), ("c", None, None)], "id string, stat_block string, personality string")
    found = records.profiles(nodes, ("berserker", "cowardly"), "tactical")
    want = [("a", 7, 10, 25, "berserker", 0.25), ("b", 10, 10, 30, "tactical", 0.5), ("c", 10, 10, 30, "tactical", 0.25)]
    assert rows(found) == want
    assert rows(records.profiles(records.as_profile_json(found), ("berserker", "cowardly"), "tactical")) == want
