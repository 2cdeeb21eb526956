"""The near-duplicate stage on copies that differ by a few words, against brute force over all pairs."""

from __future__ import annotations

from graphloom.llm import simhash

from .conftest import SCHEMA, prose, row


def test_simhash_stage_catches_copies_that_differ_by_a_few_words(spark):
    rows = []
    for i in range(30):
        words = prose(700 + i, 120).split()
        near = [f"new{i}" if at in (10, 70) else w for at, w in enumerate(words)]  # Jaccard 106/126 on five words
        far = [f"new{i}" if at % 30 == 10 else w for at, w in enumerate(words)]  # 96/136, under 0.8
        rows += [row(3 * i, " ".join(words)), row(3 * i + 1, " ".join(near)), row(3 * i + 2, " ".join(far))]
    base = prose(999, 200).split()  # a large group of near copies: one word differs in each
    rows += [row(1000 + i, " ".join(["other" if at == i else w for at, w in enumerate(base)])) for i in range(150)]
    docs = spark.createDataFrame(rows, SCHEMA)
    sets = {r[0]: set(simhash.shingle_hashes(r[1], 5).tolist()) for r in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert all(alike(3 * i, 3 * i + 1) and not alike(3 * i, 3 * i + 2) for i in range(30))
    kept = sorted(r.doc_id for r in simhash.keep_one_of_each(docs).select("doc_id").collect())
    pairs = [(a, b) for a in sets for b in sets if a < b and alike(a, b)]
    label = {a: a for a in sets}
    for _ in range(5):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert kept == sorted(set(label.values()))
