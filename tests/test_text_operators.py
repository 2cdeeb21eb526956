from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from graphloom.operators import combat, mentions, planner, resolution, retrieval, sections, transcripts, vector
from graphloom.sources import corpora
from graphloom.streaming import events as streams


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_scan(spark):
    names = spark.createDataFrame([("s", "Valdor"), ("sz", "Valdor of Kerenth"), ("l", "Light"), ("k", "King's Hall")], "entity_id string, name string")
    texts = [(1, "Valdor of Kerenth met Valdoré. valdor! Valdor_ saw light; Light."), (2, "The king’s hall. Val­dor"), (3, None)]
    found = rows(mentions.scan(spark.createDataFrame(texts, "section_id long, text string"), names), "section_id", "entity_id", "start")
    assert found == [(1, "l", 58), (1, "s", 39), (1, "sz", 0), (2, "k", 4), (2, "s", 17)]


def test_same_sentence(spark):
    names = spark.createDataFrame([("a", "Ann"), ("b", "Bob"), ("c", "Cid")], "entity_id string, name string")
    scanned = mentions.scan(spark.createDataFrame([(1, "Ann met Bob. Cid left."), (2, "Cid and Bob and Cid.")], "section_id long, text string"), names)
    assert rows(mentions.together(mentions.same_sentence(scanned))) == [("a", "b", 1), ("b", "c", 1)]
    assert rows(mentions.widest_sentence(scanned), "section_id", "n") == [(1, 2)]
    assert rows(mentions.mention_counts(scanned)) == [("a", 1, 1), ("b", 2, 2), ("c", 2, 3)]


def test_ranked_lists(spark):
    graph = spark.createDataFrame([("q", d, i + 1) for i, d in enumerate("abcd")], "query_id string, doc_id string, rank int")
    text = spark.createDataFrame([("q", d, i + 1) for i, d in enumerate("bxy")], "query_id string, doc_id string, rank int")
    found = [(r.rank, r.doc_id, r.source) for r in retrieval.combine(graph, text, 4, 1).orderBy("rank").collect()]
    assert found == [(1, "a", "graph"), (2, "b", "graph"), (3, "c", "graph"), (4, "x", "text")]
    gold = spark.createDataFrame([("q", "c"), ("r", "z")], "query_id string, doc_id string")
    assert rows(retrieval.reciprocal_ranks(graph, gold)) == [("q", pytest.approx(1 / 3)), ("r", 0.0)]


def test_nearest_matches_brute_force(spark):
    import numpy as np

    data = np.random.default_rng(1).normal(size=(60, 8))
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id long, vector array<double>")
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    found = {(r.query_id, r["rank"]): r.id for r in vector.nearest(frame.where("id < 5"), frame.repartition(3), 4).collect()}
    for q in range(5):
        assert [found[q, k + 1] for k in range(4)] == np.argsort(-(unit @ unit[q]), kind="stable")[:4].tolist()


def test_planner(spark):
    asked = spark.createDataFrame([("Create a merchant NPC",), ("Generate a combat encounter",), ("Where is the inventory now",), ("hmm",)], "text string")
    assert [r.query_type for r in planner.classified(asked).collect()] == ["npc_generation", "encounter_generation", "campaign_state", "unknown"]
    assert asked.select(planner.keywords(F.col("text")).alias("k")).first().k == ["create", "merchant", "npc"]
    assert planner.strategies(spark).count() == len(planner.PHRASES) + 1


def test_transcripts(spark):
    texts = [
        (1, "DM: You enter.\nAnn (Kor): I look.\nann: again"), (2, "[00:01:02] Bob: hi\n00:02 Bob: there"), (3, "just prose without turns"),
        (4, json.dumps({"turns": [{"speaker": "GM", "text": "a"}, {"name": "Al", "content": "b", "role": "player"}, {"user": "Al", "text": ""}]})), (5, "1/2/2024 3:04 PM Al: yo"),
    ]
    frame = spark.createDataFrame(texts, "transcript_id int, content string")
    kinds = [r[0] for r in frame.select(transcripts.format_of(F.col("content"))).collect()]
    assert kinds == ["simple", "timestamped", "plain", "json", "discord"]
    found = rows(transcripts.parse_lines(frame).na.fill(""), "transcript_id", "index", "speaker", "character", "role", "text")
    assert found == [
        (1, 0, "DM", "", "dm", "You enter."), (1, 1, "Ann", "Kor", "unknown", "I look."), (1, 2, "ann", "", "unknown", "again"),
        (2, 0, "Bob", "", "unknown", "hi"), (2, 1, "Bob", "", "unknown", "there"), (3, 0, "", "", "unknown", "just prose without turns"), (5, 0, "Al", "", "unknown", "yo"),
    ]
    assert rows(transcripts.parse_json(frame), "index", "speaker", "role", "text") == [(0, "GM", "dm", "a"), (1, "Al", "player", "b")]


def test_segments(spark):
    words = spark.createDataFrame([(1, i, s, float(i), i + 1.0, w, 0.5) for i, (s, w) in enumerate([(0, "a"), (0, "b"), (1, "c"), (0, "d")])], "audio_id int, seq int, speaker int, start double, end double, word string, confidence double")
    found = transcripts.segments_of_words(words)
    assert rows(found, "run", "speaker", "text") == [(1, 0, "a b"), (2, 1, "c"), (3, 0, "d")]
    assert rows(transcripts.speaker_samples(found, 1), "speaker", "segments", "seconds", "samples") == [(0, 2, 3.0, ["a b"]), (1, 1, 1.0, ["c"])]


def test_sections(spark):
    text = "intro\n# One\nsee area E5\n## E5. Hall\nbody\n### E5a. Nook\nx\n## Note. Other\n"
    chapters = spark.createDataFrame([("c", text)], "chapter string, text string")
    spanned = sections.spans(sections.headings(chapters), chapters)
    assert [(r.heading, text[r.start : r.stop].count("\n")) for r in spanned.orderBy("nth").collect()] == [("One", 7), ("E5. Hall", 4), ("E5a. Nook", 2), ("Note. Other", 1)]
    depths = sections.area_depth(sections.depth_table(spanned, budget=10))
    assert rows(depths, "area_depth", "qualified") == [(2, True)]
    cut = sections.split(chapters, depths, spanned)
    assert rows(cut, "section", "depth", "heading") == [(0, 0, "(preamble)"), (1, 1, "One"), (2, 2, "E5. Hall"), (3, 2, "Note. Other")]
    links = sections.parents(cut)
    assert rows(links, "section", "parent") == [(0, -1), (1, -1), (2, 1), (3, 1)]
    keyed = sections.keyed(cut, sections.key_shapes(chapters))
    assert [(r.key, r.name) for r in keyed.orderBy("section").collect()] == [(None, None), (None, None), ("e5", "Hall"), (None, None)]
    assert rows(sections.containment(keyed, links), "section", "container", "how") == [(2, 1, "depth")]
    assert sections.unique_slugs(["a", "a", "a-2", "a"]) == ["a", "a-2", "a-2-2", "a-3"]


def test_chunks(spark):
    words = lambda s: len(s.split())
    assert sections.packed(["a b c", "d e", "f g h"], 5, 2, words) == ["a b c\n\nd e", "d e\n\nf g h"]
    assert sections.packed(["a b. c d. e f."], 4, 0, words) == ["a b. c d.", "e f."]
    pages = spark.createDataFrame([("b", 1, "p one\n\np two"), ("b", 2, None)], "source string, page int, text string")
    assert rows(sections.chunks(pages, 2, 0), "chunk_id", "content") == [("b_p1_c0", "p one"), ("b_p1_c1", "p two")]


def test_resolution(spark):
    assert resolution.earliest_first([(0, 5, 0.5), (3, 9, 0.9), (5, 6, 0.1), (5, 8, 0.4)]) == [0, 3]
    assert resolution.clusters(["Kor'anthis", "Kor", "Grog"], 0.85) == [0, 0, 2]
    seen = spark.createDataFrame([(1, "NPC", "Kor", 0.6, "spacy", 9), (1, "NPC", "Kor'anthis", 0.95, "gazetteer", 0), (1, "NPC", "Grog", 0.6, "spacy", 3)], "doc_id long, entity_type string, name string, confidence double, source string, start int")
    assert rows(resolution.resolved(seen), "name", "confidence", "source", "merged") == [("Grog", 0.6, "spacy", 1), ("Kor'anthis", 1.0, "hybrid", 2)]
    known = spark.createDataFrame([("1", "Tamsin", "NPC", ["Ash"]), ("2", "Tamsen", "NPC", []), ("3", "Tamsin", "ITEM", [])], "id string, name string, entity_type string, aliases array<string>")
    asked = spark.createDataFrame([("Tamsin", "NPC"), ("ash", "NPC"), ("Zzz", "NPC")], "name string, entity_type string")
    assert rows(resolution.linked(asked, known), "name", "id", "score") == [("Tamsin", "1", 100.0), ("ash", "1", 95.0)]
    entries = spark.createDataFrame([("Kor", ["Lady"]), ("Lady", [])], "canonical string, aliases array<string>")
    surfaces = spark.createDataFrame([("Lady",), ("kor",), ("lady",)], "surface string")
    assert rows(resolution.lookup_tiers(surfaces, entries)) == [("Lady", "Lady", 0), ("kor", "Kor", 1), ("lady", "Lady", 1)]
    gold = spark.createDataFrame([("g1", "NPC", "old bill"), ("g2", "NPC", "ann")], "id string, entity_type string, name string")
    given = spark.createDataFrame([("NPC", "bill"), ("NPC", "bill old"), ("ITEM", "ann")], "entity_type string, name string")
    grades = resolution.graded(gold, given)
    assert rows(grades) == [("g1", 2), ("g2", 0)] and rows(resolution.recall(grades)) == [(0.5, 0.0)]


def test_combat(spark):
    assert combat.hit_points(10, 12, [-4, -20, 5, 30]) == [6, 0, 5, 12]
    assert combat.next_turn([True, False, True], 2, 1) == (0, 2) and combat.next_turn([True, False, True], 0, 1) == (2, 1)
    log = [(1, i, *a) for i, a in enumerate([("join", "a", 5.0), ("join", "b", 5.0), ("hit", "b", 9.0), ("end", None, 0.0), ("end", None, 0.0)])]
    found = combat.fold_turns(spark.createDataFrame(log, "combat_id long, seq long, kind string, target string, amount double"))
    assert [tuple(r) for r in found.orderBy("seq").select("actor", "round").collect()] == [(None, 1), ("a", 1), ("a", 1), ("a", 2), ("a", 3)]
    assert combat.working_set(iter([("x", "found", 1), ("y", "named", 1), ("x", "named", 2), ("z", "named", 4)]), 9) == {"x": ("found", 2), "z": ("named", 4)}
    assert combat.budget_window([(1, 5), (2, 5), (3, 5), (4, 5), (5, 5)], 20) == [1, 2, 4, 5]
    turns = spark.createDataFrame([(1, i, "x" * 20) for i in range(5)], "conv_id int, turn int, text string")
    assert rows(combat.conversation_budget(turns, 20), "turn") == [(0,), (1,), (3,), (4,)]


def test_sources(spark, tmp_path):
    (tmp_path / "manifest.json").write_text(json.dumps({"files": ["b.md", "a.md", "gone.md"]}))
    (tmp_path / "a.md").write_text("# Alpha\ntext")
    (tmp_path / "b.md").write_text("no title")
    chapters = corpora.markdown_corpus(spark, str(tmp_path))
    assert rows(chapters, "chapter_index", "chapter", "title") == [(0, "b", "b"), (1, "a", "Alpha")]
    assert corpora.find_chapter(chapters, "ALP").first().chapter == "a"
    with pytest.raises(ValueError, match="no chapter"):
        corpora.find_chapter(chapters, "zz")
    yaml = {"npcs.yaml": "- name: Ann Lee\n  short_name: Ann\n- name: Inn\n  type: location\n  id: x\n"}
    assert rows(corpora.gazetteer_yaml(spark, yaml), "id", "entity_type", "aliases") == [("npc_ann_lee", "NPC", ["Ann"]), ("x", "LOCATION", [])]
    (tmp_path / "g.json").write_text(json.dumps({"entries": [{"name": "A", "type": "NPC"}, {"name": "A", "type": "ITEM"}, {"name": " "}]}))
    assert rows(corpora.gazetteer_json(spark, str(tmp_path / "g.json")), "name", "entity_type") == [("A", "NPC")]
    answer = {"query": {"normalized": [{"from": "a_b", "to": "A b"}], "pages": [{"title": "A b", "revisions": [{"slots": {"main": {"content": "hi"}}}]}, {"title": "Z", "missing": True}]}}
    assert rows(corpora.wiki_pages(spark.createDataFrame([(json.dumps(answer),)], "value string")).na.fill("")) == [("Z", False, ""), ("a_b", True, "hi")]
    lines = spark.createDataFrame([(0, "### Part I"), (1, "- [One](x)"), (2, "* Two & Three")], "position int, line string")
    assert rows(corpora.contents_table(lines), "group", "title", "slug") == [("Part I", "One", "one"), ("Part I", "Two & Three", "two-three")]
    images = spark.createDataFrame([(2, b"x"), (1, b"x"), (3, b"y")], "page int, content binary")
    assert rows(corpora.distinct_images(images), "page", "duplicates") == [(1, 1), (3, 0)]
    cache = spark.createDataFrame([("d", "# a\n# b"), ("d", "# a " + "x" * 50), ("d", None)], "digest string, text string")
    assert corpora.best_transcripts(cache, spark.createDataFrame([("d",)], "digest string")).first().text == "# a\n# b"
    old = spark.createDataFrame([("1", "s", 1, "old"), ("2", "t", 1, "t")], "chunk_id string, source string, page int, content string")
    new = spark.createDataFrame([("1", "s", 2, "new"), ("3", "s", 1, "x")], old.schema)
    merged = corpora.upsert_chunks(old, new)
    assert rows(merged, "chunk_id", "content") == [("1", "new"), ("2", "t"), ("3", "x")]
    assert rows(corpora.without_source(merged, "s"), "chunk_id") == [("2",)] and rows(corpora.source_counts(merged)) == [("s", 2), ("t", 1)]
    corpora.append_log(old, str(tmp_path / "log"))
    corpora.append_log(new, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    corpora.export_graph(spark.createDataFrame([("a", "A", "NPC")], "id string, name string, entity_type string"), spark.createDataFrame([("a", "b", "KNOWS")], "src string, dst string, rel_type string"), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out/edges")).columns == [":START_ID", ":END_ID", ":TYPE"]


EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double"


def test_streams_agree_with_batches(spark, tmp_path):
    made = [(i, f"2024-01-01 00:{i % 60:02d}:00", i % 3, "ab"[i % 2], float(i)) for i in range(120)]
    frame = spark.createDataFrame(made, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    frame.repartition(3).write.parquet(str(tmp_path / "in"))
    source = lambda: streams.stream(spark, str(tmp_path / "in"), EVENT)
    streams.drain(streams.tumbling(source(), "10 minutes", "1 hour"), "tumble", str(tmp_path / "c1"), "complete")
    assert rows(spark.table("tumble")) == rows(streams.tumbling(frame, "10 minutes"))
    streams.drain(streams.running_totals(source()), "totals", str(tmp_path / "c2"), "update")
    last = spark.table("totals").groupBy("user_id").agg(F.max("n").alias("n"), F.max("total").alias("total"))
    assert rows(last) == rows(frame.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")))
    streams.drain(streams.distinct_within(source(), ["user_id"], "2 hours"), "once", str(tmp_path / "c3"))
    assert spark.table("once").count() == 3
    streams.drain(streams.ring(source(), 4), "ring", str(tmp_path / "c4"), "update")
    assert all(len(r.last.split(",")) <= 4 for r in spark.table("ring").collect())
