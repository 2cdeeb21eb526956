"""Removal of repeats gives the same rows whichever minimisers are taken as frequent."""

from __future__ import annotations

import pytest

from graphloom.llm import substrings

TEXT = "doc_id long, text string"


def by_brute_force(texts: dict[int, str]) -> dict[int, list[str]]:
    held = {d: t.split() for d, t in texts.items()}
    first: dict[tuple, int] = {}
    for d in sorted(held):
        for i in range(len(held[d]) - substrings.WINDOW + 1):
            first.setdefault(tuple(held[d][i : i + substrings.WINDOW]), d)
    out = {}
    for d, words in held.items():
        gone = {j for i in range(len(words) - substrings.WINDOW + 1) if first[tuple(words[i : i + substrings.WINDOW])] < d for j in range(i, i + substrings.WINDOW)}
        out[d] = [w for j, w in enumerate(words) if j not in gone]
    return out


@pytest.mark.parametrize(("frequent", "spread"), [(1, 1), (2, 2), (10**9, 1)])
def test_routes_agree(spark, monkeypatch, frequent, spread):
    passage = " ".join(f"p{i}" for i in range(40))
    texts = {d: f"{' '.join(f'w{d}x{i}' for i in range(d))} {passage} t{d % 3} {'same ' * (d * 20)}end" for d in range(1, 9)}
    monkeypatch.setattr(substrings, "FREQUENT", frequent)
    monkeypatch.setattr(substrings, "SPREAD", spread)
    found = {r.doc_id: r.kept.split() for r in substrings.remove_repeats(spark.createDataFrame(list(texts.items()), TEXT)).collect()}
    assert found == by_brute_force(texts)
