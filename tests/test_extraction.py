"""The extraction pipeline on hand-worked rows, and the pair search of spellings against brute force."""

from __future__ import annotations

import random

from graphloom.functions import fuzzy
from graphloom.operators import resolution


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


SPANS = "doc_id long, name string, entity_type string, confidence double, source string, start int, end int"


def test_extraction_pipeline(spark):
    matches = spark.createDataFrame([(1, "Morwen", "NPC", 0.9, "gazetteer", 0, 6), (1, "Karth", "LOCATION", 0.9, "gazetteer", 20, 27)], SPANS)
    tagged = spark.createDataFrame([(1, "Morwen von", "NPC", 0.6, "spacy", 0, 10), (1, "morwen", "NPC", 0.6, "spacy", 40, 46), (1, "Weak", "NPC", 0.3, "spacy", 60, 64)], SPANS)
    said = spark.createDataFrame([(1, "Morwenn", "NPC", 0.8), (1, "Tamsin", "NPC", 0.8), (2, "Morwen", "NPC", 0.8)], "doc_id long, name string, entity_type string, confidence double")
    known = spark.createDataFrame([("kb:1", "Morwen", "NPC", ["the Devil"]), ("kb:2", "Karth", "LOCATION", [])], "id string, name string, entity_type string, aliases array<string>")
    found = resolution.extracted(matches, tagged, said, known)
    # The longer span overlaps the gazetteer's and goes; two sources agree on Morwen; the model's near spelling is not new; Weak is too weak.
    assert rows(found, "doc_id", "name", "confidence", "source") == sorted([(1, "Karth", 0.9, "gazetteer"), (1, "Tamsin", 0.8, "llm"), (1, "Morwen", 1.0, "hybrid"), (2, "Morwen", 0.8, "llm")])
    assert {r.name: r.id for r in found.collect()} == {"Morwen": "kb:1", "Karth": "kb:2", "Tamsin": None}


def test_links_match_brute_force(spark):
    r = random.Random(4)
    names = ["".join(r.choice("abcd") for _ in range(r.randint(3, 9))) for _ in range(120)]
    known = [(f"k{i}", n, r.choice("xy")) for i, n in enumerate(names)]
    asked = [(n[:-1] + r.choice("abcd"), r.choice("xy")) for n in names[:60]]
    found = resolution.linked(
        spark.createDataFrame(asked, "name string, entity_type string"),
        spark.createDataFrame([(*k, []) for k in known], "id string, name string, entity_type string, aliases array<string>"),
    )
    want = set()
    for name, kind in set(asked):
        scored = sorted((-fuzzy.ratio(name, n), i) for i, n, k in known if k == kind)
        if scored and -scored[0][0] >= 85:
            want.add((name, kind, scored[0][1], round(-scored[0][0], 6)))
    assert {(x.name, x.entity_type, x.id, round(x.score, 6)) for x in found.collect()} == want and want
