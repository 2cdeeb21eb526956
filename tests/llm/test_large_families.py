"""The near-duplicate stage on a large family of copies, most of which are too far from one another, and by every route of its texts."""

from __future__ import annotations

import random

import pytest

from graphloom.llm import simhash

from .conftest import SCHEMA, prose, row


def family(size):
    """Copies of one text with up to twelve words replaced: those of few lie near the text, the rest near nothing."""
    base, r = prose(31, 150).split(), random.Random(8)
    rows = [row(0, " ".join(base))]
    for i in range(1, size):
        at = set(r.sample(range(150), r.randint(1, 12)))
        rows.append(row(i, " ".join(f"own{i}x{k}" if k in at else w for k, w in enumerate(base))))
    return rows


def firsts(rows):
    sets = {r[0]: set(simhash.shingle_hashes(r[1], 5).tolist()) for r in rows}
    label = {a: a for a in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in range(6):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return sorted(set(label.values())), len(pairs)


def test_a_large_family_is_held_against_its_middle(spark, monkeypatch):
    rows, tried = family(300), []
    verified = simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda docs, sketches, pairs, *a: tried.append(pairs.count()) or verified(docs, sketches, pairs, *a))
    kept = sorted(r.doc_id for r in simhash.keep_one_of_each(spark.createDataFrame(rows, SCHEMA)).select("doc_id").collect())
    expected, links = firsts(rows)
    assert kept == expected and 100 < len(kept) < 299
    assert sum(tried) < links / 2 < 300 * 299 / 4


@pytest.mark.parametrize(("most_sent", "most_passes"), [(60, 1000), (60, 0)])
def test_every_route_of_texts_gives_the_same(spark, monkeypatch, most_sent, most_passes):
    monkeypatch.setattr(simhash, "MOST_SENT", most_sent)
    monkeypatch.setattr(simhash, "MOST_PASSES", most_passes)
    rows = family(80)
    kept = sorted(r.doc_id for r in simhash.keep_one_of_each(spark.createDataFrame(rows, SCHEMA)).select("doc_id").collect())
    assert kept == firsts(rows)[0]
