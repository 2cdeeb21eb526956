"""Links by one letter against all pairs, and names that thousands are nearly alike."""

from __future__ import annotations

import random

from graphloom.functions import fuzzy
from graphloom.operators import resolution


def test_links_are_the_best_of_all_pairs(spark):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abC") for _ in range(draw.randrange(0, 9)))
    known = [(i, word(), draw.choice("TU"), []) for i in range(150)]
    asked = sorted({(word(), draw.choice("TU")) for _ in range(150)})
    frame = spark.createDataFrame(known, "id long, name string, entity_type string, aliases array<string>")
    for least in (60.0, 85.0, 97.0):
        expected = []
        for name, kind in asked:
            scores = [(-fuzzy.ratio(name.lower(), n.lower()), i) for i, n, t, _ in known if t == kind and name and n]
            if scores and -min(scores)[0] >= least:
                expected.append((name, kind, min(scores)[1], -min(scores)[0]))
        found = resolution.linked(spark.createDataFrame(asked, "name string, entity_type string"), frame, least)
        assert sorted((r.name, r.entity_type, r.id, r.score) for r in found.collect()) == sorted(expected), least


def test_names_a_letter_off_do_not_meet_all_that_are_alike(spark, monkeypatch):
    """Numbered names are all alike; one with a letter less is found by equality, without the search by grams."""
    monkeypatch.setattr(resolution, "alike", None)
    known = spark.range(3000).selectExpr("id", "format_string('Customer#%09d', id) AS name", "'T' AS entity_type", "array('x') AS aliases")
    asked = known.where("id % 1000 = 0").selectExpr("substring(name, 1, length(name) - 1) AS name", "entity_type")
    found = resolution.linked(asked, known).collect()
    assert sorted((r.name, r.id) for r in found) == [("Customer#00000000", 0), ("Customer#00000100", 100), ("Customer#00000200", 200)]
