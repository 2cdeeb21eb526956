"""Overlaps over partitions and greedy clusters by rounds, held against their definitions."""

from __future__ import annotations

import random

import numpy as np
import pytest

from graphloom.operators import greedy, resolution

SPAN = "doc_id long, start int, end int, confidence double"


def test_exits_are_those_of_the_fold():
    draw = random.Random(5)
    for _ in range(300):
        spans = sorted((draw.randrange(30), draw.randrange(12)) for _ in range(draw.randrange(1, 25)))
        starts, ends = np.array([a for a, _ in spans]), np.array([a + n for a, n in spans])
        upto, out = resolution.exits(starts, ends)
        for entry in range(45):
            end = entry
            for a, b in zip(starts, ends):
                if a >= end:
                    end = b
            k = int(np.searchsorted(upto, entry, "left"))
            assert end == (entry if k == len(upto) else out[k])


@pytest.mark.parametrize("parts", ["1", "3", "8"])
def test_overlaps_over_any_number_of_partitions(spark, parts):
    draw = random.Random(int(parts))
    # One document holds most spans; spans of one length never let two chains meet, long ones reach over partitions.
    spans = [(0, 2 * i + draw.randrange(2), 3, 0.5) for i in range(1500)] + [(0, 900, 700, 0.9)] + [(draw.randrange(1, 40), draw.randrange(300), draw.randrange(40), draw.random()) for _ in range(1500)]
    rows = [(d, a, a + n, c) for d, a, n, c in spans] + [(None, 1, 5, 0.1), (None, 2, 9, None), (7, None, 3, 0.5)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = resolution.without_overlaps(spark.createDataFrame(rows, SPAN).repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = []
    for doc in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == doc and r[1] is not None), key=lambda r: (r[1], -(r[3] or 0.0), r[2]))
        want += [own[i][:3] for i in resolution.earliest_first([(a, b, c or 0.0) for _, a, b, c in own])]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.start, r.end)) for r in found)


def test_overlaps_of_nothing(spark):
    assert resolution.without_overlaps(spark.createDataFrame([], SPAN)).collect() == []


def test_pieces_lose_no_part():
    draw = random.Random(3)
    for _ in range(4000):
        a = "".join(draw.choices("abc ", k=draw.randrange(1, 14)))
        b = "".join(draw.choices("ab", k=draw.randrange(4))) + "".join(c for c in a if draw.random() > 0.08) + "".join(draw.choices("ab", k=draw.randrange(4)))
        a, b = sorted((a, b), key=len)
        for least in (0.7, 0.85, 0.95):
            if 0.95 * greedy.fuzzy.partial_ratio(a, b) / 100 >= least:
                assert set(greedy.pieces(a, least)) & set(greedy.stretches(b)), (a, b, least)


def test_rounds_give_the_greedy_fold(spark):
    draw = random.Random(11)
    stems = ["Tamsin Vale", "Vale", "Kor'anthis", "Kor", "Iron Gate", "Gate", "Ürsel", "ab", "b"]
    name = lambda: "".join(c for c in draw.choice(stems) + draw.choice(["", "", " the Old", "s", "X"]) if draw.random() > 0.04) or "q"
    rows = [(draw.choice([1, 1, 1, 2]), draw.choice(["NPC", "ITEM", None]), name(), draw.choice([0.6, 0.9]), draw.choice(["gazetteer", "spacy"]), i) for i in range(220)]
    schema = "doc_id long, entity_type string, name string, confidence double, source string, start int"
    got = resolution.resolved(spark.createDataFrame([*rows, (1, "NPC", None, 0.5, "spacy", 999)], schema)).collect()
    want = []
    for group in {r[:2] for r in rows}:
        own = sorted((r for r in rows if r[:2] == group), key=lambda r: (-r[3], r[5]))
        held = resolution.clusters([r[2] for r in own], 0.85)
        for s in set(held):
            c = [r for r, k in zip(own, held) if k == s]
            base = next((r for r in c if r[4] == "gazetteer"), c[0])
            kinds = {r[4] for r in c}
            want.append((*group, base[2], round(min(1.0, base[3] + min(0.2, 0.1 * (len(kinds) - 1))), 9), base[4] if len(kinds) == 1 else "hybrid", len(c)))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.entity_type, r.name, round(r.confidence, 9), r.source, r.merged)) for r in got)
    assert resolution.resolved(spark.createDataFrame([], schema)).count() == 0
