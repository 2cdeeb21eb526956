"""The join of alike spellings against all pairs, and clamped running values against one change after the other."""

from __future__ import annotations

import random

import pytest

from graphloom.functions import fuzzy
from graphloom.operators import combat, fuzzy_join


@pytest.mark.parametrize("least", [100.0, 92.5, 85.0, 70.0, 55.0, 30.0])
def test_prefixes_of_alike_spellings_meet(least):
    """On many random spellings, short ones and runs of one letter too: whatever reaches the ratio shares a gram."""
    r = random.Random(int(least))
    names = ["", "a", "b", "ab", "aa", "aaa", "aaaa", *("".join(r.choice("abc" if r.random() < 0.6 else "abcdefgh ") for _ in range(r.randint(1, 24))) for _ in range(250))]
    names += ["".join(c for c in n if r.random() > 0.12) + r.choice(["", "a", "z"]) for n in names]
    counts = {g: i % 7 for i, g in enumerate(g for n in names for q in (1, 2) for g in fuzzy_join._grams(n, q))}
    held = {n: set(fuzzy_join.prefixes(n, least, counts)) for n in names}
    met = 0
    for a in held:
        for b in held:
            if fuzzy.ratio(a, b) >= least:
                met += 1
                assert held[a] & held[b], (a, b, fuzzy.ratio(a, b))
    assert met > len(held) // 2


def test_join_equals_all_pairs(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    known = [(r.choice("xy"), " ".join(word() for _ in range(r.randint(1, 3)))) for _ in range(150)] + [("x", ""), ("x", None), (None, "abc")]
    asked = [(k, "".join(c for c in (n or "") if r.random() > 0.08)) for k, n in known] + known[:20] + [("x", ""), ("x", None)]
    frames = [spark.createDataFrame(x, "kind string, name string") for x in (asked, known)]
    for by in (None, "kind"):
        found = [tuple(x) for x in fuzzy_join.alike(*frames, 80.0, by).collect()]
        want = {(*([k] if by else []), a, b, fuzzy.ratio(a, b)) for k, a in asked for o, b in known if a is not None and b is not None and (not by or (k is not None and k == o)) and fuzzy.ratio(a, b) >= 80}
        assert len(found) == len(set(found)) and set(found) == want and len(want) > 100
    with pytest.raises(ValueError):
        fuzzy_join.alike(*frames, 0.0)
    assert fuzzy_join.alike(frames[0].limit(0), frames[1], 80.0).collect() == []


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_clamped_values_of_a_key_that_spans_partitions(spark, partitions):
    r = random.Random(partitions)
    rows = [(r.choice([1, 1, 1, 2, 3, None, 9, 10]), i, r.uniform(-30, 30) if i % 50 else None) for i in range(4000)] + [(77, i, 0.001 * r.random()) for i in range(2000)]
    r.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {(x.key, x.seq): x.hp for x in combat.clamped(spark.createDataFrame(rows, "key long, seq long, change double"), 50.0, 100.0).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found) == len(rows)
    for key in {k for k, _, _ in rows}:
        own = sorted((i, c or 0.0) for k, i, c in rows if k == key)
        want = combat.hit_points(50.0, 100.0, [c for _, c in own])
        got = [found[key, i] for i, _ in own]
        assert got == want if key != 77 else all(abs(a - b) < 1e-9 for a, b in zip(got, want))


def test_runs_of_changes_compose():
    r = random.Random(1)
    for _ in range(200):
        changes = [r.randint(-40, 40) for _ in range(r.randint(0, 600))]
        clamp = combat.Clamp(100.0)
        cut = r.randint(0, len(changes))
        clamp.then([*map(float, changes[:cut])])
        clamp.then([*map(float, changes[cut:])])
        for value in (0.0, 33.0, 100.0):
            assert clamp.of(value) == (combat.hit_points(value, 100.0, changes) or [value])[-1]


def test_clamped_of_no_rows(spark):
    assert combat.clamped(spark.createDataFrame([], "key long, seq long, change double"), 1.0, 2.0).collect() == []
