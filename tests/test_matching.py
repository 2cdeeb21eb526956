"""Names in texts and questions, and key-mode sections, on hand-worked cases and against the patterns that define them."""

from __future__ import annotations

import random
import re
import time

import duckdb
import pytest

from graphloom.operators import answers, chapters, mentions, sections
from graphloom.plans import chapter_queries, registry

registry.load()

WORD = r"[^\W_]"


def pattern(name, fold=False):
    folded = name.replace("­", "").replace("’", "'").strip()
    if not folded:
        return None
    body = "­*".join(r"\.?" if c == "." else re.escape(c) for c in folded)
    return re.compile(rf"(?<!{WORD}){body}(?!{WORD})", re.IGNORECASE if fold or len(folded.split()) > 1 else 0)


def matches(text, names, fold=False):
    folded = text.replace("’", "'")
    return sorted((m.start(), m.end(), n) for n in names if (p := pattern(n, fold)) for m in p.finditer(folded))


def found(text, names, fold=False):
    return sorted((a, b, n) for a, b, _, n in mentions.hits(text, mentions.automaton([("", n) for n in names], fold)))


@pytest.mark.parametrize(
    ("text", "names", "fold"),
    [
        ("the St Osric's Church and St. Osric’s church", ["St. Osric's Church"], False),
        ("Light and light, Lights _Light_", ["Light"], False),
        ("who is morwen", ["Morwen"], False), ("who is morwen", ["Morwen"], True),
        ("Ily­an­ovich here", ["Ilyanovich"], False),
        ("A.B. Cee, AB Cee, A.B Cee", ["A.B. Cee"], False),
        ("Mr. X. and Mr X, Mrs. X", ["Mr. X."], False),
        ("a Str b St. b St", ["St"], False),
    ],
)
def test_names_match_as_their_patterns_do(text, names, fold):
    assert found(text, names, fold) == matches(text, names, fold)


def test_names_match_as_their_patterns_do_on_random_texts():
    r = random.Random(3)
    for _ in range(400):
        names = list({"".join(r.choice("aAb. '") for _ in range(r.randint(1, 5))).strip(" ") for _ in range(3)} - {""})
        names = [n for n in names if re.search("[a-zA-Z]", n) and ".." not in n and not n.startswith(".")]
        text = "".join(r.choice("aAbB. '’_­1") for _ in range(30))
        if "­­" in text or re.search(r"\.\.", text):
            continue
        for fold in (False, True):
            # A pattern finds no two matches that overlap; the automaton gives every place.
            assert set(matches(text, names, fold)) <= set(found(text, names, fold))


def test_overlaps_are_settled_quickly():
    hits = [(i, i + 5, "e", "n") for i in range(0, 200_000, 3)]
    start = time.time()
    assert len(mentions.without_overlaps(hits)) == 33_334 and time.time() - start < 10


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_questions_are_anchored_once_a_name(spark):
    questions = spark.createDataFrame([(1, "why is St Osric's church unsafe, st. osric's CHURCH?"), (2, "who is morwen"), (3, "Tamsin Vole and Tamsin"), (4, None), (5, "nothing")], "query_id long, text string")
    names = spark.createDataFrame([("St. Osric's Church",), ("Church",), ("Morwen",), ("Tamsin",), ("Tamsin Vole",), (None,)], "name string")
    want = [(1, "St. Osric's Church", False), (2, "Morwen", True), (3, "Tamsin", False), (3, "Tamsin Vole", False)]
    for most in (100, 2):
        assert rows(mentions.names_in_questions(questions, names, most), "query_id", "surface", "loose") == want


def test_names_dealt_into_several_automata_give_the_same(spark):
    texts = spark.createDataFrame([(i, f"Ann Lee met Ann and Bo{i} Lee. Then Lee left.") for i in range(20)], "section_id long, text string")
    names = spark.createDataFrame([("a", "Ann"), ("al", "Ann Lee"), ("l", "Lee"), ("b", "Bo3 Lee"), ("x", None)], "entity_id string, name string").where("name is not null")
    one, many = (rows(mentions.scan(texts, names, most), "section_id", "entity_id", "start", "low", "high") for most in (100, 1))
    assert one == many and len(one) == 80


def test_same_sentence_matches_brute_force(spark):
    r = random.Random(5)
    texts = {i: " ".join(r.choice(["Ann", "Bo", "Cid", "word", "other", "x."]) for _ in range(300)) for i in range(6)}
    texts[9] = " ".join(r.choice(["Ann", "Bo", "Cid", "word"]) for _ in range(400))  # one sentence without an end
    docs = spark.createDataFrame(list(texts.items()), "section_id long, text string")
    scanned = mentions.scan(docs, spark.createDataFrame([("a", "Ann"), ("b", "Bo"), ("c", "Cid")], "entity_id string, name string"))
    held = scanned.collect()
    want = {(x.section_id, p, q) for x in held for y in held if x.section_id == y.section_id and x.entity_id != y.entity_id and x.low <= y.start < x.high for p, q in ((x.entity_id, y.entity_id), (y.entity_id, x.entity_id))}
    assert set(rows(mentions.same_sentence(scanned), "section_id", "a", "b")) == want


MARKDOWN = """Text before.
# Chapter 3: Town
Intro, see area E5 and area E5b.
### E5. Hall
A hall.
#### E5b. Nook
Small.
#### Treasure
Gold.
## Events
Things.
# St. Osric's Feast
E9 is no heading.
###### E12.  Far Room  
"""


def test_key_mode_sections(spark):
    held = spark.createDataFrame([("c", MARKDOWN), ("d", "## One\n### K1. Cell\n"), ("e", "")], "chapter string, text string")
    shapes = sections.key_shapes(held)
    assert rows(shapes, "chapter", "shapes") == [("c", ["A#", "A#a"]), ("d", []), ("e", [])]
    cut = sections.key_split(held, shapes)
    assert rows(cut.where("chapter = 'c'"), "section", "depth", "heading") == [(0, 0, "(preamble)"), (1, 0, "E5. Hall"), (2, 0, "E5b. Nook"), (3, 0, "Events"), (4, 0, "E12.  Far Room")]
    assert rows(cut.where("chapter = 'd'"), "section", "heading") == [(0, "One")]  # nothing is referred to, so K1 is no key
    keyed = chapters.keyed_headings(held).where("key is not null")
    assert rows(keyed, "key", "stem", "suffix", "name") == [("e12", "E12", "", "Far Room"), ("e5", "E5", "", "Hall"), ("e5b", "E5", "b", "Nook")]
    shape = spark.createDataFrame([("K85",), ("E5g",), ("G",), ("21",), ("St",), ("é1",)], "t string").select(sections.key_shape(sections.F.col("t")).alias("s"))
    assert [r.s for r in shape.collect()] == ["A#", "A#a", "A", "#", "Aa", "a#"]


def test_keys_of_many_digits(spark):
    """A run of digits is one sign of a key, however long; words of more than four letters are still no keys."""
    text = "See area E1b and area E2.\n## E99b. Nook\n## E100b. Attic\n## E1234. Vault\n## Eabcb. Word\n## E100bcd. Far\n## E2. Hall"
    held = spark.createDataFrame([("c", text), ("d", "area E100\n# E100. One\n# E7. Two"), ("e", "room 1200\n# 1200. Hut\n# 12000.Cut")], "chapter string, text string")
    keyed = chapters.keyed_headings(held).where("key is not null")
    assert rows(keyed, "chapter", "key", "stem", "suffix", "name") == [
        ("c", "e100b", "E100", "b", "Attic"), ("c", "e1234", "E1234", "", "Vault"), ("c", "e2", "E2", "", "Hall"), ("c", "e99b", "E99", "b", "Nook"),
        ("d", "e100", "E100", "", "One"), ("d", "e7", "E7", "", "Two"), ("e", "1200", "1200", "", "Hut"),
    ]
    assert [r.heading for r in sections.key_split(held.where("chapter = 'd'"), sections.key_shapes(held)).orderBy("section").collect()] == ["(preamble)", "E100. One", "E7. Two"]


LONG_KEYED = ("heading_keys", "key_sections", "first_keys", "book_headings", "containment_report", "structure_report", "keys_of_names")


@pytest.fixture(scope="module")
def long_documents(tmp_path_factory):
    """A document of 1000 lines, whose keys have up to three digits, and a short one."""
    folder = tmp_path_factory.mktemp("long")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT CAST(i AS BIGINT) AS doc_id, array_to_string(list_transform(generate_series(1, n), lambda x: 'line ' || x), chr(10)) AS text, 's' AS source FROM (VALUES (1, 1000), (2, 30)) t(i, n)) TO '{folder}/documents.parquet'")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    return folder, con


@pytest.mark.parametrize("name", LONG_KEYED)
def test_long_documents_have_their_keys(spark, long_documents, name):
    folder, con = long_documents
    found = registry.QUERIES[name](spark, str(folder))
    columns = sorted(found.columns)
    answer = con.sql(registry.ORACLES[name])
    places = [[d[0] for d in answer.description].index(c) for c in columns]
    assert sorted(tuple(str(r[c]) for c in columns) for r in found.collect()) == sorted(tuple(str(r[i]) for i in places) for r in answer.fetchall())


def test_places(spark):
    titles = spark.createDataFrame([("Chapter 3: The Village of Karth",), ("Appendix B. ",), ("chapter 12.Amber",), ("Introduction",)], "t string").select(sections.place_of_title(sections.F.col("t")).alias("p"))
    assert [r.p for r in titles.collect()] == ["The Village of Karth", None, "Amber", "Introduction"]
    held = spark.createDataFrame([("c", 0, "Town"), ("c", 1, None), ("c", 2, None), ("c", 3, "Hall")], "chapter string, section int, place string")
    links = spark.createDataFrame([("c", 0, -1), ("c", 1, 0), ("c", 2, 1), ("c", 3, 3)], "chapter string, section int, parent int")
    assert rows(sections.ancestor_places(held, links), "section", "place") == [(0, None), (1, "Town"), (2, "Town"), (3, None)]


def test_spans_and_parents_match_their_definitions(spark):
    r = random.Random(8)
    heads = [("c", i, i * 10, r.randint(1, 6), f"h{i}") for i in range(120)]
    found_ = spark.createDataFrame(heads, "chapter string, line_no int, start int, depth int, heading string")
    texts = spark.createDataFrame([("c", "x" * 2000)], "chapter string, text string")
    stops = {h.start: h.stop for h in sections.spans(found_, texts).collect()}
    assert stops == {s: next((t for _, _, t, e, _ in heads if t > s and e <= d), 2000) for _, _, s, d, _ in heads}
    cut = spark.createDataFrame([("c", i, r.choice([0, 1, 2, 3, 6])) for i in range(120)], "chapter string, section int, depth int")
    depth = {x.section: x.depth for x in cut.collect()}
    want = {i: next((j for j in range(i - 1, -1, -1) if 0 < depth[j] < depth[i]), -1) if depth[i] > 0 else -1 for i in depth}
    assert {x.section: x.parent for x in sections.parents(cut).collect()} == want


def test_passages_stand_in_their_sections(spark):
    docs = spark.createDataFrame([(1, "### E2. The _Inn_\nThe Inn is old. It burns.\nInn again."), (2, "No name. The Inn.")], "section_id long, text string")
    scanned = mentions.scan(docs, spark.createDataFrame([("i", "Inn")], "entity_id string, name string"))
    assert rows(answers.passages_of(scanned, docs), "section_id", "passage") == [(1, "The Inn is old."), (2, "The Inn.")]


def test_anchors_need_no_sections(spark, monkeypatch):
    """The anchors are those of the whole answer, and no section is searched for them."""
    folder = "/root/testdata/sf0.001"
    whole = rows(chapter_queries._retrieved(spark, folder).anchors, "query_id", "surface", "id", "loose")
    monkeypatch.setattr(chapter_queries, "_scan", None)
    monkeypatch.setattr(answers, "retrieve", None)
    assert rows(registry.QUERIES["question_anchors"](spark, folder), "query_id", "surface", "id", "loose") == whole
